"""Regulation chunks: embedding and nearest chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .ordered import top_per_key

#: Queries of a block that are compared with its chunks at once.
QUERY_ROWS = 64


def embed_chunks(chunks: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list]], batch: int = 64) -> DataFrame:
    """Adds ``embedding`` to chunks ``(..., content)``.

    ``make_encoder`` runs once per task and returns the batch encoder, so a model
    is loaded once and texts reach it in batches.
    """
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(frames):
        encode = make_encoder()
        for frame in frames:
            texts = frame["content"].tolist()
            vectors = []
            for start in range(0, len(texts), batch):
                vectors += [[float(x) for x in v] for v in encode(texts[start:start + batch])]
            yield frame.assign(embedding=vectors)

    return chunks.mapInPandas(run, schema)


def match_chunks(
    queries: DataFrame, chunks: DataFrame, k: int = 3, q_block: int = 1024, c_block: int = 16384
) -> DataFrame:
    """The ``k`` most similar chunks of the query's framework, per query.

    ``queries(query_id, framework, embedding)``, ``chunks(id, framework, embedding [, content, metadata])``.
    Similarity is the cosine; ties go to the smaller id.  A vector that is NULL, holds a NULL or has no length has no
    similarity: such chunks are not found and such queries find nothing; vectors of different lengths do not meet.
    ``content`` and ``metadata`` are returned where the chunks have them.

    Blocks of queries meet blocks of chunks, cut inside each framework from its own counts: a task holds one block of
    each, multiplies QUERY_ROWS queries at once with the chunks and passes on only ``k`` rows per query.
    """
    vector = F.col("embedding").cast("array<double>")
    usable = ~F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x != 0)
    key = ["framework", "size"]
    q = queries.select("query_id", "framework", vector.alias("v")).where(usable).withColumn("size", F.size("v"))
    c = chunks.select("id", "framework", vector.alias("v")).where(usable).withColumn("size", F.size("v"))
    blocks = q.groupBy(*key).agg(F.ceil(F.count("*") / q_block).alias("q_blocks")).join(
        c.groupBy(*key).agg(F.ceil(F.count("*") / c_block).alias("c_blocks")), key
    )
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    q = q.join(blocks, key).withColumn("qb", own("query_id", "q_blocks")).withColumn("cb", every("c_blocks"))
    c = c.join(blocks, key).withColumn("cb", own("id", "c_blocks")).withColumn("qb", every("q_blocks"))
    types = dict(q.dtypes) | dict(c.dtypes)

    def compare(qs, cs):
        import numpy as np
        import pandas as pd

        columns = ["query_id", "framework", "id", "similarity"]
        if qs.empty or cs.empty:
            return pd.DataFrame(columns=columns)
        a, b = np.stack(qs["v"].to_numpy()), np.stack(cs["v"].to_numpy())
        a_norms, b_norms = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        ids = cs["id"].to_numpy()
        told = list(zip(qs["query_id"], qs["framework"]))
        rows = []
        for lo in range(0, len(a), QUERY_ROWS):
            far = -((a[lo : lo + QUERY_ROWS] @ b.T) / np.outer(a_norms[lo : lo + QUERY_ROWS], b_norms))
            for own, (query, framework) in zip(far, told[lo : lo + QUERY_ROWS]):
                # Only the k nearest and their ties are sorted.
                near = np.flatnonzero(~(own > np.partition(own, k - 1)[k - 1])) if len(own) > k else np.arange(len(own))
                for j in near[np.lexsort((ids[near], own[near]))[:k]]:
                    rows.append((query, framework, ids[j], float(-own[j])))
        return pd.DataFrame(rows, columns=columns)

    tile = [*key, "qb", "cb"]
    # New columns for the queries, which may stem from the chunks.
    q = q.select(*[F.col(name).alias(name) for name in (*tile, "query_id", "v")])
    best = q.groupBy(*tile).cogroup(c.select(*tile, "id", "v").groupBy(*tile)).applyInPandas(
        compare,
        f"query_id {types['query_id']}, framework {types['framework']}, id {types['id']}, similarity double",
    )
    found = top_per_key(best, ["query_id"], [F.desc("similarity"), "id"], k)
    told = [name for name in ("content", "metadata") if name in chunks.columns]
    return found.join(chunks.select("id", "framework", *told), ["id", "framework"], "left") if told else found


def framework_centroids(chunks: DataFrame) -> DataFrame:
    """Mean vector per framework, as queries.

    The sums are formed per (framework, dimension), so a large framework is
    reduced map-side.
    """
    cells = chunks.select("framework", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = cells.groupBy("framework", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("framework").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("embedding")
    ).select(F.col("framework").cast("string").alias("query_id"), "framework", "embedding")

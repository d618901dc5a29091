"""Nearest vectors by inner product: int8 product tiles with error bounds, exact sums for what survives, heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile: queries that are multiplied at once, and candidates that meet them in one task.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
PRODUCT_ROWS = 1024


class Quantised:
    """Vectors as whole numbers from -127 to 127 times a scale each, with the lengths that bound the error."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.exact = vectors
        # Scaled by powers of two, so that neither lengths nor codes of very small or large vectors vanish.
        self.power = np.frexp(np.abs(vectors).max(1))[1]
        vectors = np.ldexp(vectors, -self.power[:, None])
        top = np.abs(vectors).max(1)
        self.scale = top / 127
        self.whole = np.rint(vectors / self.scale[:, None])
        rounded = self.whole * self.scale[:, None]
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.rounded_length = np.sqrt((rounded * rounded).sum(1))
        self.rest_length = np.sqrt(((vectors - rounded) ** 2).sum(1))
        # Products of int8 pairs add up exactly in 4-byte floats up to 2**24, in 8-byte floats beyond.
        self.tile = self.whole.astype(np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64)


def tile_bounds(queries: Quantised, found: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value that the score of every query with every candidate may have.

    x.y = x'.y' + x'.(y - y') + (x - x').y, so the error is at most |x'| |y - y'| + |x - x'| |y|; the sums of the score
    itself are rounded, at the least number that can be told from zero by one unit a component.
    """
    near = (queries.tile @ found.tile.T).astype(np.float64) * queries.scale[:, None] * found.scale[None, :]
    off = queries.rounded_length[:, None] * found.rest_length[None, :] + queries.rest_length[:, None] * found.length[None, :]
    slack = 1e-9 * queries.length[:, None] * found.length[None, :]
    power = queries.power[:, None] + found.power[None, :]
    least = 2 * found.exact.shape[1] * np.finfo(np.float64).smallest_subnormal
    with np.errstate(over="ignore", under="ignore"):
        return np.ldexp(near - off - slack, power) - least, np.ldexp(near + off + slack, power) + least


def best_of_tile(query_ids: np.ndarray, queries: Quantised, ids: np.ndarray, found: Quantised, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k greatest exact products among the candidates, as (-score, id) in order."""
    low, high = tile_bounds(queries, found)
    own = query_ids[:, None] == ids[None, :]
    low[own] = high[own] = -np.inf
    if len(ids) > k:
        reach = -np.partition(-low, k - 1, axis=1)[:, k - 1]
    else:
        reach = np.full(len(query_ids), -np.inf)
    for i, ident in enumerate(query_ids.tolist()):
        left = np.flatnonzero((high[i] >= reach[i]) & ~own[i])
        score = np.add.accumulate(found.exact[left] * queries.exact[i], axis=1)[:, -1]  # summed from the first component on
        if len(left) > k:
            edge = -np.partition(-score, k - 1)[k - 1]
            stay = score >= edge
            left, score = left[stay], score[stay]
        yield ident, heapq.nsmallest(k, zip((-score).tolist(), ids[left].tolist(), strict=True))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


TILE = "query_id long, found array<struct<d:double,id:long>>"


def _tiles(k: int):
    def multiply(left: list[pa.RecordBatch], right: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, given = pa.Table.from_batches(left), pa.Table.from_batches(right)
        query_ids = asked["id"].to_numpy()
        queries = Quantised(_vectors(asked["v"].combine_chunks()))
        heaps: dict[int, list] = {}
        ids, vectors = given["id"].to_numpy(), _vectors(given["v"].combine_chunks())
        for at in range(0, len(ids), PRODUCT_ROWS):
            found = Quantised(vectors[at : at + PRODUCT_ROWS])
            for ident, best in best_of_tile(query_ids, queries, ids[at : at + PRODUCT_ROWS], found, k):
                heaps[ident] = best if ident not in heaps else [x for x, _ in zip(heapq.merge(heaps[ident], best), range(k))]
        rows = [[{"d": d, "id": i} for d, i in best] for best in heaps.values()]
        kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(list(heaps), pa.int64()), pa.array(rows, kind)], names=["query_id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile and side (queries first), so one tile at a time is in memory."""
        tile, left, right = None, [], []
        for batch in batches:
            keys = batch.column("tile").to_pylist()
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != tile:
                    if left and right:
                        yield from multiply(left, right)
                    tile, left, right = keys[a], [], []
                part = batch.slice(a, b - a)
                sides = part.column("side").to_numpy()
                edge = int(np.searchsorted(sides, 1))
                if edge:
                    left.append(part.slice(0, edge))
                if edge < len(sides):
                    right.append(part.slice(edge))
        if left and right:
            yield from multiply(left, right)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query: merge the sorted lists of its tiles with a heap."""
        held, lists = None, []

        def close() -> list[tuple]:
            best = [x for x, _ in zip(heapq.merge(*lists), range(k))]
            return [(held, rank, ident, -d) for rank, (d, ident) in enumerate(best, 1)]

        for batch in batches:
            out = []
            for query, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lists and query != held:
                    out += close()
                    lists = []
                held = query
                lists.append([(f["d"], f["id"]) for f in found])
            yield _ranked(out)
        if lists:
            yield _ranked(close())

    return run


NEAREST = "query_id long, rank int, vec_id long, score double"


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "rank", "vec_id", "score"])


def nearest_vectors(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
) -> DataFrame:
    """The k rows with the greatest inner product for each row that ``is_query`` holds for, never with itself.

    Columns query_id, rank (from 1), vec_id, score: exact sums in double precision over the vectors as they are; equal
    scores go by the smaller id.  Fewer candidates than k: all of them.  Every query meets every row in tiles of
    QUERY_ROWS x CANDIDATE_ROWS: a product of int8 codes bounds each score from both sides, and whatever could be among
    the k best is computed exactly, so nothing is lost to the codes.

    Vectors that are null, empty, zero, or hold a null, NaN or infinity take no part, nor do rows with a null id.  Only
    vectors of equal length meet.  Of several rows with one id one counts (the least vector).  Empty table: no rows.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = clean.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0))
    clean = clean.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("size", F.size("v"))
    sizes = clean.groupBy("size").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("asks").cast("long")).alias("queries"))
    sizes = sizes.where("queries > 0").withColumn("q_blocks", F.ceil(F.col("queries") / QUERY_ROWS)).withColumn("c_blocks", F.ceil(F.col("rows") / CANDIDATE_ROWS))
    dealt = clean.join(sizes.select("size", "q_blocks", "c_blocks"), "size")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    tile = F.concat_ws("/", "size", "q", "c")
    asked = dealt.where("asks").withColumn("q", own("q_blocks")).withColumn("c", every("c_blocks")).select(tile.alias("tile"), F.lit(0).alias("side"), "id", "v")
    given = dealt.withColumn("c", own("c_blocks")).withColumn("q", every("q_blocks")).select(tile.alias("tile"), F.lit(1).alias("side"), "id", "v")
    tiles = asked.unionByName(given).repartition("tile").sortWithinPartitions("tile", "side")
    found = tiles.select("tile", "side", "id", "v").mapInArrow(_tiles(k), TILE)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), NEAREST)

"""Document fingerprints by winnowing, and their likeness to an edited and to the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Fixed odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A chosen k-gram is one 64-bit number: 40 bits of hash, then 24 bits that grow towards the left of the text.
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every k code points, from running sums modulo 2**64."""
    n = len(points)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_mixed(points.astype(U64) + U64(1)) * _powers(BASE, n), out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * _powers(INVERSE, n - k + 1))


def shape(n: int, k: int, window: int) -> tuple[int, int]:
    """Length of the k-grams and of the windows for a text of ``n`` code points.

    Either half of a text must hold a whole window, so windows are shorter in texts of fewer than ``2 * (k + window - 1)``
    code points, and k-grams in those of fewer than ``2 * k``.  What a long window chooses, a short one chooses, too, so
    texts of different lengths stay comparable down to ``2 * k``.
    """
    k = max(1, min(k, n // 2))
    return k, max(1, min(window, n // 2 - k + 1))


def winnow(points: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (40 bits) and places of the chosen k-grams: the least of each window, the rightmost if equal.

    Both lengths follow ``shape``.  No code points: nothing.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k, window = shape(n, k, window)
    hashes = kgram_hashes(points, k) >> U64(PLACE_BITS)
    found, width = [], max(1, min(window, len(hashes)))
    # Places count from the start of a stretch; stretches overlap by one window less one, so each window lies in one.
    step = PLACES + 1
    for at in range(0, max(1, len(hashes) - width + 1), step - width + 1):
        part = hashes[at : at + step]
        least = (part << U64(PLACE_BITS)) | (U64(PLACES) - np.arange(len(part), dtype=U64))
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            rest = width - span
            least = np.minimum(least[:-rest], least[rest:])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        found.append((least >> U64(PLACE_BITS), (U64(PLACES) - (least & U64(PLACES))).astype(np.int64) + at))
    picked, places = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    places, first = np.unique(places, return_index=True)
    return picked[first], places


def as_text(hashes: np.ndarray, places: np.ndarray) -> str:
    """Ten hex digits of hash and eight of place for each chosen k-gram."""
    raw = np.zeros((len(hashes), 9), np.uint8)
    raw[:, :5] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    raw[:, 5:] = places.astype(">u4").view(np.uint8).reshape(-1, 4)
    return raw.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes (each sorted, without repeats); two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 16, window: int = 72) -> DataFrame:
    """Columns: id, ``hashes`` and ``places`` (arrays of long) of the chosen k-grams of each text.

    Any passage of ``k + window - 1`` code points that two texts share puts at least one equal hash into both, and so
    does half of a text of ``2 * k`` or more that stays as it is (see ``shape``).  Null text counts as empty and has
    none; one row per input row, repeated rows alike.  Other columns are not read.  Empty table: empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [winnow(_code_points(t or ""), k, window) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([m[0].astype(np.int64) for m in made], pa.list_(pa.int64())),
                    pa.array([m[1] for m in made], pa.list_(pa.int64())),
                ], names=["id", "hashes", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, hashes array<long>, places array<long>").withColumnRenamed("id", id_col)


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, n_picked long"
)


def _range_of(cuts: list[int]):
    """Number of the id range, highest ids first, nulls last."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def at(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(edges), np.int32)
        out[known] = len(edges) - np.searchsorted(edges, ids[known].to_numpy(np.int64), "left")
        return pd.Series(out)

    return at


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 16, window: int = 72, ranges: int | None = None
) -> DataFrame:
    """Fingerprint of each text, of the text with its second half replaced, and of how near they are.

    The last floor(n / 2) code points are replaced by the first as many (or all) of the next document: documents go by
    descending id, after the last comes the first.  Rows of one id go by text, ascending; null ids come last; null text
    counts as empty and comes before others.  Repeated rows follow each other.  A table of one row follows itself.
    Empty table: empty result.  ``near_edited`` and ``near_next`` are the shared part (Jaccard) of the sets of hashes.

    Ids are cut into ranges by quantiles, each range is sorted, and neighbours meet while the range streams by; the
    first row of each range (one per range) is also given to the range before.  So each text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(20 * ranges))).first()[0] or []
    number = _range_of(sorted(set(cuts)))
    placed = rows.withColumn("range", number("id")).withColumn("guest", F.lit(0))
    # The first row of each range: one id per range, so both lists are as long as the number of ranges.
    firsts = placed.groupBy("range").agg(F.max("id").alias("id")).orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], EDIT_SCHEMA)
    ids = [r["id"] for r in firsts if r["id"] is not None]
    has_null = len(ids) < len(firsts)
    wanted = F.col("id").isin(ids) | F.col("id").isNull() if has_null else F.col("id").isin(ids)
    heads = placed.where(wanted).groupBy("range", "id").agg(F.min("text").alias("text"))
    before = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    home = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
    guests = heads.select("id", "text", home.alias("range"), F.lit(1).alias("guest"))
    dealt = placed.unionByName(guests).repartition(len(firsts), "range").sortWithinPartitions(
        "range", "guest", F.col("id").desc_nulls_last(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                part = batch.slice(at, 64)
                for ident, text, where, guest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    points = _code_points(text)
                    row = (ident, points, winnow(points, k, window), where)
                    if held is not None and held[3] == where:
                        out.append(_compared(held, row, k, window))
                    held = None if guest else row
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names
                )

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    names = [part.split()[0] for part in EDIT_SCHEMA.split(", ")]
    return dealt.select("id", "text", "range", "guest").mapInArrow(run, EDIT_SCHEMA)


def _compared(row: tuple, after: tuple, k: int, window: int) -> tuple:
    ident, points, mark, _ = row
    n = len(points)
    edited = np.concatenate((points[: n - n // 2], after[1][: n // 2]))
    edited_mark = winnow(edited, k, window)
    own = np.unique(mark[0])
    return (
        ident, n, hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest(),
        as_text(*mark), as_text(*edited_mark), likeness(own, np.unique(edited_mark[0])), likeness(own, np.unique(after[2][0])), len(mark[0]),
    )

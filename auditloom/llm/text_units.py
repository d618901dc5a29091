"""Removal of repeated lines or paragraphs by the digest of their normalised form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import join_facts, row_key, unused, written

#: What ends a unit of each kind.
BREAKS = {"line": regex.compile("\n"), "paragraph": regex.compile("\n[\x20\x09-\x0D]*\n")}
NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")

UNIT_SCHEMA = "id long, row binary, digest binary, start int, stop int"


def units_of(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Start and end (code points) of each unit; line ends belong to none."""
    start = 0
    for found in BREAKS[kind].finditer(text):
        yield start, found.start()
        start = found.end()
    yield start, len(text)


def normalised(unit: str) -> str:
    """Words of letters and digits in lower case, one blank between them."""
    return NOT_WORD.sub(" ", unit.lower()).strip()


def _digests(kind: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            for ident, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, stop in units_of(text or "", kind):
                    form = normalised(text[start:stop]) if stop > start else ""
                    if form.count(" ") + 1 >= min_words and form:
                        for column, value in zip(out, (ident, row, hashlib.md5(form.encode()).digest(), start, stop), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "row", "digest", "start", "stop"]
            )

    return run


def drop_repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", min_words: int = 1
) -> DataFrame:
    """``docs`` with every later occurrence of a line (or paragraph) taken out of the text.

    Units are equal if their words of letters and digits are, whatever the case, punctuation and white space between.
    Units without a letter or digit, or of fewer than ``min_words`` words, never go.  The occurrence of the smallest rank (id, then row digest, then
    place in the text) stays, all others go.  ``kind``: "line", or "paragraph" (parted by blank lines).

    Columns of ``docs`` stay, with the kept text (kept units joined by a line feed or a blank line); four are added:
    ``n_units``, ``n_removed``, ``removed`` and ``kept``, arrays of (start, stop) in code points of the input text,
    in order.  Null text: no unit, stays null.  Empty text: one empty unit, which stays.  A null id is the smallest;
    ids must be whole numbers.  Repeated rows (same id and text) are treated alike and stay as many.  An existing
    column named like an added one gets replaced.  Empty table: empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    units = written(rows.mapInArrow(_digests(kind, min_words), UNIT_SCHEMA), "units").withColumn("place", F.struct("id", "row", "start"))
    firsts = written(
        units.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "unit-firsts"
    )
    later = join_facts(units, firsts, "digest", "n").where(F.col("place") > F.col("first"))
    key, gone = unused(docs, "row_key"), unused(docs, "gone_units")
    removed = later.groupBy(F.col("row").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(gone))
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(removed.hint("merge"), key, "left")
    return _apply(joined, key, gone, text_col, kind)


def _apply(joined: DataFrame, key: str, gone: str, text_col: str, kind: str) -> DataFrame:
    """Cut the spans in ``gone`` out of the text, batch by batch."""
    columns = [c for c in joined.columns if c not in (key, gone)]
    added = {"n_units": "int", "n_removed": "int", "removed": "array<struct<start:int,stop:int>>", "kept": "array<struct<start:int,stop:int>>"}
    names = [c for c in columns if c.lower() not in added]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in names]
    glue = "\n" if kind == "line" else "\n\n"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept_texts, counts, removed, kept = batch.column(text_col).to_pylist(), [], [], [], []
            for text, cut in zip(texts, batch.column(gone).to_pylist(), strict=True):
                cut = cut or []
                starts = {s["start"] for s in cut}
                units = [] if text is None else list(units_of(text, kind))
                stay = [u for u in units if u[0] not in starts or u[0] == u[1]]
                kept_texts.append(text if not cut else glue.join(text[a:b] for a, b in stay))
                counts.append(len(units))
                removed.append(cut)
                kept.append([{"start": a, "stop": b} for a, b in stay])
            given = [pa.array(kept_texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            made = [pa.array(counts, pa.int32()), pa.array([len(x) for x in removed], pa.int32()), pa.array(removed, spans), pa.array(kept, spans)]
            yield pa.RecordBatch.from_arrays(given + made, names=names + list(added))

    return joined.select(*names, gone).mapInArrow(run, ", ".join(fields + [f"{n} {t}" for n, t in added.items()]))

"""Removal of repeated long strings, found with a run-length compressed index of what surrounds repeated anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_blocks as tb
from .scratch import HOT_SHARE, row_key, written

U64 = tb.U64
#: Length of the hashed strings that anchor a place, in bytes.
ANCHOR = 20
#: Bytes of distinct contexts that one index holds at least (a single anchor may bring more).
INDEX_BYTES = 1 << 18
#: Parts that the contexts of a hot anchor are dealt to before they meet.
HOT_PARTS = 64
#: Bits of the filter of repeated anchors: 16 for each, up to 32 MB.  Past that it passes more single anchors, no fewer
#: repeated ones.
FILTER_BITS = (20, 28)
#: Ends a context; no byte of UTF-8.
STOP = 0xFF


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, first and last start, and document, for every run of ``length``-byte strings with one anchor.

    The anchor of a string is its ANCHOR-byte substring of least hash (rightmost of equal ones), so it depends on the
    string alone and equal strings have equal anchors.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - ANCHOR + 1)
    hashes = tb.span_hashes(data, at, at + ANCHOR)
    # Least hash per stretch, by doubling; the low bits make the rightmost of equal hashes the least.
    places = U64((1 << 24) - 1)
    mixed = (hashes & ~places) | (places - (at.astype(U64) & places))
    width = length - ANCHOR + 1
    least, span = mixed, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[: len(least)] == doc[length - 1 :]
    start = np.flatnonzero(inside)
    least = least[start]
    if not len(start):
        return np.zeros(0, U64), start, start, start
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]]))))
    low, high = start[first], start[np.concatenate((first[1:], [len(start)])) - 1]
    where = low + ((places - (least[first] & places)) - (low.astype(U64) & places) & places).astype(np.int64)
    return hashes[where], low, high, doc[low]


def _anchor_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tb.text_blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offsets, length)[0].view(np.int64))], names=["anchor"])

    return run


def _bits_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> U64(32)) & mask).astype(np.int64)


def _filter_part(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            for place in _bits_of(batch.column(0).to_numpy(zero_copy_only=False).view(U64), bits):
                held[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    return run


CONTEXTS = "anchor long, part int, id long, row binary, start long, context binary"


def _contexts(length: int, filled: bytes, bits: int, hot: np.ndarray):
    """The bytes around every occurrence of an anchor that may be repeated: all strings it anchors, in one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(filled, np.uint8)
        for batch in batches:
            for rows, data, offsets in tb.text_blocks(batch.column("text")):
                hashes, low, high, doc = anchors(data, offsets, length)
                a, b = _bits_of(hashes, bits)
                one = lambda x: (held[x >> 3] >> (7 - (x & 7))) & 1
                seen = np.flatnonzero(one(a) & one(b))
                hashes, low, high, doc = hashes[seen], low[seen], high[seen], doc[seen]
                taken = pa.array(rows.start + doc)
                raw = data.tobytes()
                split = np.isin(hashes, hot)
                part = np.where(split, (low + doc * 7919 + rows.start * 31) % HOT_PARTS, -1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), pa.array(part.astype(np.int32)), batch.column("id").take(taken), batch.column("row").take(taken),
                    pa.array(low - offsets[doc]),
                    pa.array([raw[s : e + length] for s, e in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()),
                ], names=[c.split()[0] for c in CONTEXTS.split(", ")])

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a block: sorts by 8 bytes, then thrice the depth from the ranks reached, until all differ."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", padded.tobytes(), 0, (1,)).astype(U64)
    depth, bits = 8, max(1, int(n + 1).bit_length())
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
        if rank[order[-1]] == n:
            return order
        times = 3 if 3 * bits <= 64 else 2
        key = np.zeros(n, U64)
        for i in range(times):
            later = np.zeros(n, np.int64)
            if i * depth < n:
                later[: n - i * depth] = rank[i * depth :]
            key = (key << U64(bits)) | later.astype(U64)
        depth *= times


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``most``."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(most + 16, np.uint8)))
    words = np.ndarray((n + most + 8,), ">u8", padded.tobytes(), 0, (1,))
    length = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    while len(going):
        x = words[a[going] + length[going]].astype(U64) ^ words[b[going] + length[going]].astype(U64)
        same = x == 0
        rest = x[~same]
        equal_bytes = np.zeros(len(rest), np.int64)
        for i in range(1, 8):
            equal_bytes += rest < (U64(1) << U64(64 - 8 * i))
        length[going[~same]] += equal_bytes
        going = going[same]
        length[going] += 8
        going = going[length[going] < most]
    return np.minimum(length, most)


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of a block of contexts, sampled at the ends of its runs.

    Kept: the letter and start of each run, and for the first suffix of each run its place in the text, the place of
    the suffix before it (the last of the run before), and how long both agree.  Inside a run neighbours move through
    the text side by side, so these samples give every place its neighbour and the length they share.
    """

    def __init__(self, text: np.ndarray, most: int) -> None:
        order = suffix_order(text)
        letters = np.where(order > 0, text[order - 1].astype(np.int64), -1)  # nothing stands before the first place
        heads = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
        self.size, self.run_letters, self.run_starts = len(text), letters[heads], heads
        heads = heads[heads > 0]
        place, before = order[heads], order[heads - 1]
        by_place = np.argsort(place, kind="stable")
        self.places, self.before = place[by_place], before[by_place]
        self.agree = _shared(text, self.places, self.before, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Streams through the text: for each place its neighbour in suffix order and the length both share."""
        at = np.arange(self.size)
        sample = np.searchsorted(self.places, at, "right") - 1
        known = sample >= 0
        sample = np.maximum(sample, 0)
        gone = at - self.places[sample]
        length = np.where(known, self.agree[sample] - gone, 0)
        return np.where(known, self.before[sample] + gone, at), length


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For distinct contexts, earliest first: whether the string at each start occurs at an earlier start of any of them."""
    counts = np.array([len(c) - length + 1 for c in contexts])
    if len(contexts) == 1:
        # All strings of one context have the same anchor at different distances, so none occurs twice.
        return [np.zeros(counts[0], bool)]
    text = np.frombuffer(b"".join(c + bytes([STOP]) for c in contexts), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Two places agree less than a whole context and a rest, as no two contexts are equal.
    link, shared = RunIndex(text, 2 * int(sizes.max())).statistics()
    root = np.where(shared >= length, link, np.arange(len(text)))
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    starts = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    earliest = np.full(len(text), len(text))
    np.minimum.at(earliest, root[starts], starts)
    return np.split(earliest[root[starts]] < starts, np.cumsum(counts)[:-1])


MARKS = "row binary, start long, stop long, anchor long, id long, context binary"


class _Block:
    """Contexts of whole anchors until an index is worth while; equal contexts of an anchor are held once."""

    def __init__(self, length: int, keep: bool) -> None:
        self.length, self.keep = length, keep
        self.out: list[tuple] = []
        self.clear()

    def clear(self) -> None:
        self.distinct: list[tuple[bytes, list]] = []
        self.bytes = 0

    def anchor_done(self, group: dict[bytes, tuple]) -> None:
        if len(group) == 1:
            context, first = next(iter(group.items()))
            self.survives(first, context)
            return
        for context, first in group.items():
            self.distinct.append((context, first))
            self.bytes += len(context)
        if self.bytes >= INDEX_BYTES or self.keep:  # parts of one anchor must not meet here, their order is not by place
            self.index()

    def index(self) -> None:
        if not self.distinct:
            return
        # Anchors come in any order of documents; strings of different anchors differ, so only order within one counts.
        for flags, (context, first) in zip(repeated_starts([c for c, _ in self.distinct], self.length), self.distinct, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
            for a, b in edges.reshape(-1, 2).tolist():
                self.gone(first, a, b - 1)
            if not flags.all():
                self.survives(first, context)
        self.clear()

    def gone(self, place: tuple, first: int, last: int) -> None:
        """All strings from the first to the last start of this context occur earlier."""
        _, _, row, start = place
        self.out.append((row, start + first, start + last + self.length, None, None, None))

    def survives(self, place: tuple, context: bytes) -> None:
        if self.keep:
            anchor, ident, row, start = place
            self.out.append((row, start, None, anchor, ident, context))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        made = pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in self.out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in MARKS.split(", ")]
        )
        self.out = []
        return made


def _mark(length: int, hot_parts: bool):
    """Arrow function over contexts sorted by anchor, part, id, row, start: spans that occur earlier.

    Where an anchor is hot its parts are worked on one by one, and what is earliest in its part is returned as well.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {False: _Block(length, False), True: _Block(length, True)}
        held, group = None, {}

        def close() -> None:
            if group:
                blocks[hot_parts and held[1] >= 0].anchor_done(group)

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                columns = [c.to_pylist() for c in batch.slice(at, 4096).columns]
                for anchor, part, ident, row, start, context in zip(*columns, strict=True):
                    if held != (anchor, part):
                        close()
                        held, group = (anchor, part), {}
                    place = (anchor, ident, row, start)
                    if context in group:
                        if group[context][2:] != (row, start):  # a repeated row is no earlier occurrence
                            blocks[hot_parts and part >= 0].gone(place, 0, len(context) - length)
                    else:
                        group[context] = place
                yield from (b.batch() for b in blocks.values() if b.out)
        close()
        for b in blocks.values():
            b.index()
            yield b.batch()

    return run


REMOVED = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def _cut(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for ident, text, spans in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    raw = (text or "").encode()
                    gone = merged([(s["start"], s["stop"]) for s in spans or ()])
                    edges = [0, *(x for span in gone for x in span), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((
                        ident, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(),
                        [{"start": a, "stop": b} for a, b in gone], kept if keep_bytes else None,
                    ))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
                )

    return run


def remove_repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_bytes: bool = True
) -> DataFrame:
    """Each text without the bytes of any ``length``-byte string that also starts earlier in the table.

    Earlier: smaller (id, row digest), or the same row and an earlier start.  Overlaps count; strings lie within one
    text (as UTF-8) and are judged on the input.  The result is exact.

    Every string has an anchor that depends on it alone, so equal strings meet at their anchor: anchors are counted
    first, the surroundings of repeated ones are gathered by anchor, and a run-length index over the distinct
    surroundings yields, streaming through them, how far each place agrees with its neighbours in suffix order.  Places
    that agree in ``length`` bytes hold the same string, of which the earliest stays.  The contexts of an anchor that
    makes up 1/1000 of all are first worked on in parts, of which only what is earliest goes on.

    Columns: the id column, n_bytes, n_removed, n_spans, kept_sha256 (lower-case hex), spans (start and stop in bytes of
    the maximal removed runs), kept (bytes; left out unless ``keep_bytes``).  One row per input row.  Null text counts as
    empty.  A null id is the smallest.  Repeated rows (same id and text) share their places, are treated alike and stay
    as many.  Other columns of ``docs`` are not read.  Empty table: empty result.
    """
    if length < ANCHOR:
        raise ValueError(f"strings must have {ANCHOR} bytes or more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_anchor_hashes(length), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(counts.where("n > 1"), "repeated-anchors")
    total, n_repeated = repeated.agg(F.sum("n"), F.count(F.lit(1))).first()
    # At most HOT_SHARE anchors, by counting.
    hot = [r["anchor"] for r in repeated.where(F.col("n") * HOT_SHARE >= (total or 0)).select("anchor").collect()]
    bits = min(max(int(16 * n_repeated).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    filled = np.zeros(1 << bits >> 3, np.uint8)
    for part in repeated.select("anchor").coalesce(8).mapInArrow(_filter_part(bits), "bits binary").toLocalIterator():
        filled |= np.frombuffer(part["bits"], np.uint8)
    made = rows.mapInArrow(_contexts(length, filled.tobytes(), bits, np.array(hot, np.int64).view(U64)), CONTEXTS)
    order = ("anchor", "part", "id", "row", "start")
    first = made.repartition("anchor", "part").sortWithinPartitions(*order).mapInArrow(_mark(length, True), MARKS)
    first = written(first, "marks")
    again = first.where("stop IS NULL").select("anchor", F.lit(-1).alias("part"), "id", "row", "start", "context")
    second = again.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_mark(length, False), MARKS)
    spans = first.where("stop IS NOT NULL").select("row", "start", "stop").unionByName(second.select("row", "start", "stop"))
    per_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    out = rows.join(per_row.hint("merge"), "row", "left").select("id", "text", "spans").mapInArrow(_cut(keep_bytes), REMOVED).withColumnRenamed("id", id_col)
    return out if keep_bytes else out.drop("kept")

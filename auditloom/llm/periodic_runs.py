"""Periodic runs of words (maximal stretches that repeat a period at least twice), by maximal pairs of equal suffixes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once; one longer text is worked on alone.
BLOCK_BYTES = 1 << 21

BASE = np.uint64(0x9E3779B97F4A7C15)


def _repeated(words: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """Marks each place whose ``k`` words, all of one part, stand at another place of the part, too.

    By 64-bit sums: two different ones that agree only leave a place in that the exact steps then find single.
    """
    n = len(words)
    marks = np.zeros(n, bool)
    if n < k + 1:
        return marks
    whole = np.flatnonzero(part[: n - k + 1] == part[k - 1 :])
    sums = part[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for j in range(k):
            sums = (sums ^ words[whole + j].astype(np.uint64)) * BASE
            sums ^= sums >> np.uint64(29)
    order = np.argsort(sums)
    same = sums[order][1:] == sums[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marks[whole[order[twice]]] = True
    return marks


def _regions(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words that may belong to a run, and the number of the stretch each belongs to.

    Both occurrences in a run share ``k`` words, and the run is covered by such repeated words without a gap; what
    repeats only from another stretch is dropped as long as any is.
    """
    place, part = np.arange(len(words)), doc
    while True:
        marks = _repeated(words[place], part, k)
        covered = np.zeros(len(place) + 1, np.int64)
        starts = np.flatnonzero(marks)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + k, -1)
        kept = np.cumsum(covered[:-1]) > 0
        if kept.all():
            return place, part
        # A stretch ends where words were dropped and where the one before ended.
        breaks = np.ones(len(place), bool)
        breaks[1:] = (part[1:] != part[:-1]) | (kept[1:] != kept[:-1])
        place, part = place[kept], np.cumsum(breaks)[kept]


def _suffixes(words: np.ndarray) -> np.ndarray:
    """Suffix array of ``words``, whose last element occurs once: doubled prefixes, equal ones sorted on."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    heads = np.ones(n, bool)
    heads[1:] = words[order][1:] != words[order][:-1]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[n] = -1
    h = 1
    while True:
        single = heads & np.append(heads[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        at = order[open_]
        first, second = rank[at], rank[np.minimum(at + h, n)]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2


def _common(words: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order and the one before it (the first: 0)."""
    n = len(words)
    before, common = [-1] * n, [0] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    lengths, same = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            same = 0
            continue
        # The last word of all occurs once, so neither index runs out.
        while words[i + same] == words[j + same]:
            same += 1
        lengths[i] = same
        same = same - 1 if same else 0
    for at, i in enumerate(order):
        common[at] = lengths[i]
    return common


def _joined(a: list[int], b: list[int], same: int, left: list[int], min_length: int, found: dict) -> list[int]:
    """Places of a node from those of two children (sorted), the maximal pairs between them noted in ``found``.

    ``left`` is the class of a place: the word in front of it.  Only neighbours in the order of places are paired: had
    a pair a third occurrence between its two, the distance of the pair would be no smallest period.
    """
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    for x in b:
        at = bisect_left(a, x)
        if at < n:
            d = a[at] - x
            if d <= same and d + same >= min_length and left[x] != left[a[at]]:
                key = (x, d + same)
                if found.get(key, d) >= d:
                    found[key] = d
        if at:
            y = a[at - 1]
            d = x - y
            if d <= same and d + same >= min_length and left[x] != left[y]:
                key = (y, d + same)
                if found.get(key, d) >= d:
                    found[key] = d
    if len(b) * 16 < n:
        for x in b:
            insort(a, x)
    else:
        a += b
        a.sort()
    return a


def maximal_pairs(words: np.ndarray, k: int, min_length: int) -> dict[tuple[int, int], int]:
    """Smallest period by (start, length) of every run in ``words``, of pairs that share at least ``k`` words.

    The intervals of the suffix array are walked bottom-up: a node stands for a repeated string of ``same`` words, two
    places below different children agree in exactly these, and if the words in front differ, too, the pair is
    maximal.  A pair no further apart than ``same`` is a run from its first place to the end of its second occurrence:
    nothing is extended.  Other distances give no run and are not enumerated.  ``words[0]`` and ``words[-1]`` occur once.
    """
    order = _suffixes(words).tolist()
    text = words.tolist()
    common = _common(text, order)
    common.append(0)
    left = [-1, *text[:-1]]
    found: dict[tuple[int, int], int] = {}
    # Open nodes: string length and sorted places so far.
    lengths: list[int] = []
    places: list[list[int]] = []
    for at, place in enumerate(order):
        after = common[at + 1]
        if not lengths and after < k:
            continue
        current = [place]
        while lengths and lengths[-1] > after:
            current = _joined(places.pop(), current, lengths.pop(), left, min_length, found)
        if after >= k:
            if lengths and lengths[-1] == after:
                places[-1] = _joined(places[-1], current, after, left, min_length, found)
            else:
                lengths.append(after)
                places.append(current)
    return found


def runs_of_texts(texts: list[list[bytes]], min_length: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period."""
    counts = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not counts.sum():
        return out
    flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    words = flat.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    # Of length n and period q, a run repeats n - q words, which is least for n = min_length.
    k = max(1, (min_length + 1) // 2)
    place, part = _regions(words, doc, k)
    if not len(place):
        return out
    # Between stretches stands a word that occurs once, so no common prefix crosses them.
    bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    gaps = np.zeros(len(place), np.int64)
    gaps[bounds] = 1
    at = np.arange(len(place)) + np.cumsum(gaps)
    joined = np.full(len(place) + len(bounds) + 1, -1, np.int64)
    joined[at] = words[place]
    alone = joined < 0
    joined[alone] = words.max() + 1 + np.arange(alone.sum())
    back = np.full(len(joined), -1, np.int64)
    back[at] = place
    for (start, length), period in maximal_pairs(joined, k, min_length).items():
        word = int(back[start])
        out[int(doc[word])].append((word - int(first[doc[word]]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run, or only among the first period of each, joined by blanks."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
#: The same for Arrow.
ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 12, keep_text: bool = True) -> DataFrame:
    """``docs`` with the runs of each whole text and the text without their repetitions.

    Words are runs of bytes other than blank, tab to carriage return.  A run is a stretch of words with smallest
    period q and a length of at least ``max(min_length, 2 * q)`` that no neighbouring word extends.  Added:
    ``n_words``, ``runs`` (array of start, length, period in words from 0, by start, then period) and ``collapsed``
    (the words that are in no run behind its first q words, joined by one blank).  All runs are found, whatever their
    period.  ``min_length`` is 2 or more.

    Null and empty text: no words, no runs, empty ``collapsed``.  Repeated rows are treated alike.  Columns of
    ``docs`` stay (the text only with ``keep_text``), unless named like an added one: those are replaced.  Empty table:
    empty result.  A text is worked on by one task, whole, in room of about a hundred bytes a word; nothing is
    compared across texts, so no key can be hot.
    """
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    added = ("n_words", "runs", "collapsed")
    others = [c for c in docs.columns if c.lower() not in added and c != text_col]
    rows = docs.select(F.col(text_col).alias("the text"), *others, *[F.col(text_col)] * (keep_text and text_col.lower() not in added))
    kept = T.StructType(rows.schema.fields[1:])
    schema = T.StructType([*kept.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            texts = batch.column(0)
            while start < batch.num_rows:
                # As many rows as fit into a block, one at least.
                words, size, stop = [], 0, start
                while stop < batch.num_rows and (size < BLOCK_BYTES or stop == start):
                    text = (texts[stop].as_py() or "").encode()
                    size += len(text)
                    words.append(text.split())
                    stop += 1
                runs = runs_of_texts(words, min_length)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[1:],
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], ARROW_RUN),
                    pa.array([collapsed(w, r).decode() for w, r in zip(words, runs)], pa.string()),
                ], names=schema.names)
                start = stop

    return rows.mapInArrow(run, schema)

"""Words of whole batches of texts as arrays: bounds, hashes and documents, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Fixed odd multiplier of the hash and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)

BYTES = np.arange(256, dtype=np.uint8)
IS_BLANK = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))
IS_UPPER = (BYTES >= 65) & (BYTES <= 90)
LOWERED = np.where(IS_UPPER, BYTES + 32, BYTES).astype(np.uint8)

#: Bytes of text worked on at once; one longer text is worked on alone.
BLOCK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_tables: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of texts of up to ``limit`` bytes: their rows, all bytes, and where each text starts (and the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, n)
        yield slice(start, stop), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes that are not blank."""
    inked = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_BLANK[data], out=inked[1:-1])
    begins = inked[1:-1] & ~inked[:-2]
    ends = inked[1:-1] & ~inked[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = inked[1:-1][inner]
    ends[inner - 1] = inked[1:-1][inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    per_doc = np.searchsorted(starts, offsets)
    return starts, stops, np.repeat(np.arange(len(offsets) - 1), np.diff(per_doc))


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """64-bit hash of the bytes of each span; ``values`` gives what each byte counts for."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * down[starts])


#: Byte values that make capital letters A-Z count as small ones.
LOWER_VALUES = _VALUES[LOWERED]


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``size`` words; a shorter text is one run of all its words."""
    counts = np.bincount(doc, minlength=n_docs)
    last = np.cumsum(counts)
    at = np.arange(len(hashes))
    room = last[doc] - at
    keep = (room >= size) | ((at == last[doc] - counts[doc]))
    at, room = at[keep], room[keep]
    out = np.zeros(len(at), U64)
    padded = np.concatenate((hashes, np.zeros(size, U64)))
    for j in range(size):
        part = padded[at + j] * U64(pow(BASE, j + 1, 1 << 64))
        out += np.where(room > j, part, U64(0))
    return mixed(out), doc[keep]

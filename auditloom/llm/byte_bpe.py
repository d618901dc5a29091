"""Byte-level BPE by backtracking over the longest matches of an Aho-Corasick automaton."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept per worker; on reaching the limit the table starts again, which costs time and nothing else.
MEMO_PIECES = 400_000
MEMO_PAIRS = 1_000_000


class Vocabulary:
    """Ranks of a byte-level BPE, ready for linear-time encoding.

    Bytes are mapped to the Latin-1 characters of the same numbers, so the automaton works on text.  For every token
    the table holds its next shorter prefix token and the last merge that makes it.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.bytes_of = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.rank_of = {token: rank for rank, token in self.bytes_of.items()}
        self.automaton = ahocorasick.Automaton()
        for rank, token in self.bytes_of.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = {rank: len(token) for rank, token in self.bytes_of.items()}
        self.parts = {rank: self._last_merge(rank) for rank in self.bytes_of}
        self.merged = {halves: rank for rank, halves in self.parts.items() if halves is not None}
        self.over = max(self.bytes_of) + 1
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self._shorter:
            text = self.bytes_of[token]
            self._shorter[token] = next((self.rank_of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank_of), None)
        return self._shorter[token]

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token`` last; None for a single byte or a token no merge reaches."""
        text, rank_of = self.bytes_of[token], self.rank_of
        pieces = [text[i : i + 1] for i in range(len(text))]
        while len(pieces) > 2:
            ranks = [rank_of.get(a + b, token) for a, b in pairwise(pieces)]
            lowest = min(ranks)
            if lowest >= token:
                return None
            i = ranks.index(lowest)
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return (rank_of[pieces[0]], rank_of[pieces[1]]) if len(pieces) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are what the merges make of their bytes."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges, latest first: no merge across the border may come before the one that hides it."""
        limit, merged, parts = self.over, self.merged, self.parts
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            halves_l, halves_r = parts[left], parts[right]
            if halves_r is None or (halves_l is not None and left > right):
                if halves_l is None:
                    return True
                limit, left = left, halves_l[1]
            else:  # of equal ranks the left one merges first
                limit, right = right + 1, halves_r[0]

    def encode(self, piece: bytes) -> list[int]:
        """The ranks that greedy merging gives for ``piece``."""
        whole = self.rank_of.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - self.size[rank]
            if not longest[start] or self.size[longest[start] - 1] < self.size[rank]:
                longest[start] = rank + 1
        open_at, out, at = bytearray(b"\1") * (n + 1), [], 0
        token: int | None = longest[0] - 1
        while token is not None:
            end = at + self.size[token]
            if open_at[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end] - 1
                continue
            token = self.shorter(token)
            if token is None:
                open_at[at] = 0
                if not out:
                    break
                token = out.pop()
                at -= self.size[token]
        raise ValueError("the ranks do not cover all bytes")


class Memo(dict):
    """Little-endian ids of each piece met, worked out on first use."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        ids = np.array(self.vocabulary.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> tuple[Memo, regex.Pattern, list[bytes]]:
    vocabulary = Vocabulary(path)
    table = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]
    return Memo(vocabulary), regex.compile(pattern), table


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of the whole text as little-endian unsigned 32-bit integers."""
    memo, pieces, _ = _loaded(path, pattern)
    return b"".join(map(memo.__getitem__, pieces.findall(text)))


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    """The bytes that the ids stand for."""
    table = _loaded(path, pattern)[2]
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


SCHEMA = "id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    pattern: str = public_tokenizers.PATTERN, keep_ids: bool = True,
) -> DataFrame:
    """Token ids of each whole text and the digest of what they decode to.

    Columns: the id column, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit; left out unless ``keep_ids``),
    ``ids_sha256``, ``decoded_sha256`` (lower-case hex).  ``path`` names a file of base64 tokens and ranks that every
    executor can read.  The pattern cuts the text into pieces, each encoded by itself; no special tokens.
    Null text counts as empty: no ids, digests of nothing.  One row per input row, whatever repeats; other columns of
    ``docs`` are not read.  Empty table: empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode_text(t or "", path, pattern) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids if keep_ids else [None] * len(ids), pa.binary()),  # not sent if nobody asks
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(decode_ids(i, path, pattern)).hexdigest() for i in ids], pa.string()),
                ], names=["id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")

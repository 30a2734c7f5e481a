"""Vectorised word work on the UTF-8 bytes of Arrow text columns.

Texts are handled in chunks of about ``CHUNK_BYTES``: whole documents, at least
one, so memory follows the longest document and not the batch. Word classes of
all operators here are ASCII classes, so a byte table decides them: every byte
of a non-ASCII character counts alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """256 flags: True where the byte lies in one of the inclusive ranges."""
    flags = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        flags[lo : hi + 1] = True
    return flags


#: ``[^\x20\x09-\x0D]+``: anything but white space.
SPACED_WORDS = byte_class([(0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, all beyond ASCII.
ALNUM_WORDS = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: Letters only: A-Z, a-z, all beyond ASCII.
LETTER_WORDS = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])

_RUNS = np.where(ALNUM_WORDS, 1, np.where(byte_class([(0x21, 0x7E)]), 2, 0)).astype(np.uint8)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[FOLD]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in ((0, _BASE), (1, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


class Chunk(NamedTuple):
    """Rows ``first:last`` of a batch; ``buf`` their bytes, ``at`` the rows' offsets in it (one more than rows)."""

    first: int
    last: int
    buf: np.ndarray
    at: np.ndarray

    def text(self, row: int) -> bytes:
        return self.buf[self.at[row] : self.at[row + 1]].tobytes()


class Words(NamedTuple):
    """Words of a chunk: byte ``start`` and ``end`` of each, and ``at``: the rows' offsets in the list of words."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a string column; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Chunk(first, last, whole[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def words(chunk: Chunk, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of a class; a run ends where its document does."""
    n = len(chunk.buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(chunk.at), np.int64))
    inside = kind[chunk.buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edge = chunk.at[:-1][chunk.at[:-1] < chunk.at[1:]]
    before[edge] = False
    after[edge[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.at))


def runs(chunk: Chunk) -> Words:
    """Maximal runs of letters and digits and, apart from them, of other printing characters; white space and controls lie between."""
    n = len(chunk.buf)
    if not n:
        return words(chunk, SPACED_WORDS)
    kind = _RUNS[chunk.buf]
    change = np.empty(n + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = kind[1:] != kind[:-1]
    change[chunk.at] = True
    edges = np.flatnonzero(change)
    solid = kind[edges[:-1]] > 0
    start = edges[:-1][solid]
    return Words(start, edges[1:][solid], np.searchsorted(start, chunk.at))


def word_hashes(chunk: Chunk, found: Words) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    power, inverse = _grown(len(chunk.buf) + 1)
    total = np.empty(len(chunk.buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODES[chunk.buf] * power[: len(chunk.buf)], out=total[1:])
    h = (total[found.end] - total[found.start]) * inverse[found.start]
    return mix(h + (found.end - found.start).astype(np.uint64))


_PLACE = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive word hashes, by position of the first; runs over document ends too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _PLACE[0]
    for j in range(1, k):
        out += h[j : j + n] * _PLACE[j]
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """The hash of a whole sequence of fewer than 64 words, as ``gram_hashes`` gives for its length."""
    return gram_hashes(h, len(h))

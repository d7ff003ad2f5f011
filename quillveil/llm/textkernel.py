"""Vectorised word kernels over UTF-8 buffers.

The kernels work on the raw buffers of an Arrow string column, so no Python
string is made. Texts are taken in slices of about ``SLICE_BYTES`` (one text at
least), which bounds the memory of a task by its longest text.

Null texts count as empty. All hashes are 64 bit and depend on the bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mask(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes that end a word: space and the controls 09-0D.
SPACES = _mask([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes that end an alphanumeric word: ASCII other than digits and lower-case letters.
NOT_ALNUM = _mask([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        step, back = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        step[0] = back[0] = 1
        _powers, _inverses = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers, _inverses


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``buf``; equal bytes, equal hash."""
    return hash_values(_BYTE[buf], starts, ends)


def hash_values(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a uint64 sequence."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _tables(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    spans = (total[ends] - total[starts]) * inverse[starts]
    return mix64(spans + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hash(word: str) -> int:
    """The hash that ``Words.hashes`` has for this word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


@dataclass
class Slice:
    """Consecutive texts: ``buf`` holds their bytes, text i is buf[offsets[i]:offsets[i + 1]]."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def column(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls."""
    import pyarrow.compute as pc

    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_string())
    return pc.fill_null(values, "") if values.null_count else values


def slices(values: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """The texts of a column in slices of bounded size."""
    values = column(values)
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield Slice(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """The words of a slice in order. Word w is buf[starts[w]:ends[w]]; text i has words firsts[i] to firsts[i + 1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts)


def words(part: Slice, ends_word: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Splits the texts at bytes that ``ends_word`` marks and at their ends."""
    buf = LOWER[part.buf] if lower else part.buf
    inside = np.zeros(len(buf) + 2, dtype=bool)
    np.logical_not(ends_word[buf], out=inside[1:-1])
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[part.offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(buf, starts, ends, np.searchsorted(starts, part.offsets))


def grams(found: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling k-word hashes: (text index, word index in the text, hash). Texts with fewer words have none."""
    h = found.hashes() if hashes is None else hashes
    n = len(h) - k + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    doc = found.docs()
    whole = doc[: n] == doc[k - 1 :]
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out = out * _U(0xC2B2AE3D27D4EB4F) + h[at + j]
    doc = doc[at]
    return doc, at - found.firsts[doc], mix64(out)


def gram_hash(words_: list[str]) -> int:
    """The hash that ``grams`` has for these words."""
    out = 0
    for w in words_:
        out = (out * 0xC2B2AE3D27D4EB4F + word_hash(w)) % (1 << 64)
    return int(mix64(np.array([out], dtype=np.uint64))[0])


def shingle_sets(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes, one after the other, and where each text's begin.

    A text with 1 to k - 1 words has its whole sequence as one shingle, a text without words none.
    """
    h = found.hashes()
    doc, _, hashes = grams(found, k, h)
    counts = found.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.array([hash_words(h[found.firsts[i] : found.firsts[i + 1]]) for i in short], dtype=np.uint64)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
    if len(short):
        order = np.argsort(doc, kind="stable")
        doc, hashes = doc[order], hashes[order]
    bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[a:b].sort()
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[first], hashes[first]
    return hashes, np.searchsorted(doc, np.arange(len(counts) + 1))


def hash_words(h: np.ndarray) -> int:
    """Hash of a short sequence of word hashes, apart from those of full shingles."""
    out = len(h)
    for x in h.tolist():
        out = (out * 0xC2B2AE3D27D4EB4F + x) % (1 << 64)
    return int(mix64(np.array([out], dtype=np.uint64))[0])

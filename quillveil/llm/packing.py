"""Sum-of-squares online packing of tokenised documents into windows.

Each partition is packed as it streams, without a shuffle: a document is
tokenised, cut into full windows, and its rest goes to the fill level that
minimises the sum of the squared counts of partially filled windows, which are
tracked in an array by level. There are ``LEVELS`` of them, so a window is full
when what it lacks or what is over is less than a level: the piece is cut there,
and its rest is placed as a piece of its own. So windows close all along, few
are open at a time, and at the end of a partition only those are poured
together by cutting pieces, which leaves one open window; its content becomes
sequences whose lengths are powers of two, so that nothing is padded.

Memory: one slice of texts, and the open windows, of which the method keeps
few for each level. A lost task packs the same rows in the same order again.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillveil.llm import textkernel as tk

#: Distinct words whose ids a worker remembers; beyond it the less used half goes.
CACHE_WORDS = 300_000
#: Sequence ids of a partition begin at its number times this.
PARTITION_STEP = 1 << 40
#: Fill levels of a window.
LEVELS = 32

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    """The pre-tokeniser's class of each code point; those that Python's tables do not assign are unknown, as the tokeniser's may be newer."""
    import regex

    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    kinds = {"L": _LETTER, "N": _DIGIT}
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        if category == "Cn":
            table[code] = _UNKNOWN
        elif category[0] in kinds:
            table[code] = kinds[category[0]]
    for code in [*range(0x3100), 0xFEFF]:
        if regex.match(r"\s", chr(code)):
            table[code] = _SPACE
    return table


class WordTokenizer:
    """Ids of whole texts from a word-level BPE file, equal to those of ``tokenizers``.

    The pre-tokeniser cuts a text into words that are encoded one by one, so the
    ids of each distinct word are kept. Texts in which that cutting needs more
    than the classes of code points (apostrophes, a final sigma, special tokens,
    unknown code points) go to the tokeniser whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.classes = _classes()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.index: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.offsets = np.zeros(1 << 14, dtype=np.int64)
        self.hits = np.zeros(1 << 14, dtype=np.int64)
        self.known = 0

    def _forget(self) -> None:
        """Keeps at most half of the words, those met in the most slices."""
        order = np.argsort(-self.hits[: self.known], kind="stable")[: CACHE_WORDS // 2]
        keep = np.sort(order[self.hits[order] > 1])
        begin = self.offsets[keep]
        lengths = self.offsets[keep + 1] - begin
        total = np.zeros(len(keep) + 1, dtype=np.int64)
        np.cumsum(lengths, out=total[1:])
        flat = self.flat[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
        place = np.full(self.known, -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        place = place.tolist()
        self.index = {h: place[i] for h, i in self.index.items() if place[i] >= 0}
        self.flat[: len(flat)] = flat
        self.offsets[: len(total)] = total
        self.hits[: len(keep)] = self.hits[keep] // 2
        self.hits[len(keep) :] = 0
        self.known = len(keep)

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        flat = np.asarray(self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, dtype=np.uint32)
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        used, n = int(self.offsets[self.known]), len(texts)
        if len(ends) != n:
            raise ValueError("the vocabulary has no mark at the end of each word")
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + n + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.flat[used : used + len(flat)] = flat
        self.offsets[self.known + 1 : self.known + n + 1] = used + ends
        self.index.update(zip(hashes, range(self.known, self.known + n)))
        self.known += n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        plain: list[str] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if "'" in text or "Σ" in text or "<|" in text:
                whole.append(i)
                plain.append("")
            else:
                plain.append(unicodedata.normalize("NFC", text).lower())
        out, unknown = self._encode_plain(plain)
        whole += unknown
        if whole:
            for i, x in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = np.asarray(x.ids, dtype=np.uint32)
        return out

    def _encode_plain(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """The ids of normalised texts, and the numbers of those with unknown code points, whose ids are not theirs."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = self.classes[codes]
        cut = np.ones(len(kinds), dtype=bool)
        cut[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        at = np.flatnonzero(cut)
        ends = np.append(at[1:], len(kinds))
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        unknown = np.unique(np.searchsorted(text_at, np.flatnonzero(kinds == _UNKNOWN), side="right") - 1).tolist()
        word = (kinds[at] != _SPACE) & (kinds[at] != _UNKNOWN)
        at, ends = at[word], ends[word]
        hashes = tk.hash_values((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E6C63D0876A9A47), at, ends)
        distinct, first, rows = np.unique(hashes, return_index=True, return_inverse=True)
        if self.known + len(distinct) > CACHE_WORDS:
            self._forget()
        keys = distinct.tolist()
        index = self.index
        fresh = [i for i, k in enumerate(keys) if k not in index]
        if fresh:
            self._learn([keys[i] for i in fresh], [joined[at[j] : ends[j]] for j in first[fresh].tolist()])
            index = self.index
        entry = np.fromiter(map(index.__getitem__, keys), dtype=np.int64, count=len(keys))
        self.hits[entry] += 1
        entry = entry[rows]
        begin = self.offsets[entry]
        lengths = self.offsets[entry + 1] - begin
        total = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=total[1:])
        ids = self.flat[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
        bounds = total[np.searchsorted(at, text_at)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], unknown


class _Window:
    __slots__ = ("fill", "pieces")

    def __init__(self) -> None:
        self.fill = 0
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.fill += len(piece[2])


class SumOfSquaresPacker:
    """Places pieces into windows of ``capacity`` online; ``closed`` gathers the full ones.

    A window with content is on level ceil(fill / unit). Where a piece is cut to
    fill a window, what goes in or what is left of it is less than a unit; with a unit of 1 only exact fits close.
    """

    def __init__(self, capacity: int, unit: int = 1) -> None:
        self.capacity, self.unit = capacity, unit
        self.counts = np.zeros(-(-capacity // unit) + 1, dtype=np.int64)  # open windows by level
        self.open: dict[int, list[_Window]] = {}
        self.closed: list[_Window] = []

    def level_for(self, size: int) -> int:
        """The level that makes the sum of squared counts least; the fullest of equal ones; 0 is a new window."""
        cap, unit = self.capacity, self.unit
        counts = self.counts.tolist()
        best, least = 0, 2 * counts[-(-size // unit)] + 1
        for level in range(1, len(counts)):
            count = counts[level]
            if not count:
                continue
            held = self.open.get(level)
            free = cap - (held[-1].fill if held else level * unit)
            # one window leaves its level and enters another, or leaves the open ones when it is full
            if size < free:
                after = -(-(cap - free + size) // unit)
                change = 0 if after == level else 2 * (counts[after] - count + 1)
            elif min(free, size - free) < unit:
                change = 1 - 2 * count
            else:
                continue
            if change <= least:
                best, least = level, change
        return best

    def place(self, piece: tuple) -> None:
        doc_id, start, ids, n = piece
        while len(ids):
            level = self.level_for(len(ids)) if len(ids) < self.capacity else 0
            if level:
                window = self.open[level].pop()
                self.counts[level] -= 1
            else:
                window = _Window()
            take = min(self.capacity - window.fill, len(ids))
            window.add((doc_id, start, ids[:take], n))
            start, ids = start + take, ids[take:]
            if window.fill == self.capacity:
                self.closed.append(window)
            else:
                level = -(-window.fill // self.unit)
                self.counts[level] += 1
                self.open.setdefault(level, []).append(window)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        for start in range(0, n, cap):
            self.place((doc_id, start, ids[start : start + cap], n))

    def take_closed(self) -> list[_Window]:
        out, self.closed = self.closed, []
        return out

    def drain(self) -> list[_Window]:
        """Pours the open windows together, the emptiest into the fullest, and splits the last at powers of two."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.counts[:] = {}, 0
        i, j = 0, len(left) - 1
        while i < j:
            into, source = left[i], left[j]
            doc_id, start, ids, n = source.pieces.pop()
            take = min(self.capacity - into.fill, len(ids))
            into.add((doc_id, start, ids[:take], n))
            source.fill -= len(ids)
            if take < len(ids):
                source.add((doc_id, start + take, ids[take:], n))
            i += into.fill == self.capacity
            j -= not source.pieces
        out = left[:i]
        if i == j and left[i].fill:
            out += _split(left[i])
        return out


def _split(window: _Window) -> list[_Window]:
    out, rest = [], window.fill
    pieces = list(window.pieces)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        part = _Window()
        while part.fill < size:
            doc_id, start, ids, n = pieces.pop(0)
            take = min(size - part.fill, len(ids))
            part.add((doc_id, start, ids[:take], n))
            if take < len(ids):
                pieces.insert(0, (doc_id, start + take, ids[take:], n))
        out.append(part)
        rest -= size
    return out


def _rows(windows: list[_Window], first: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for number, window in enumerate(windows, first):
        offset = 0
        for doc_id, start, ids, n in window.pieces:
            size = len(ids)
            for col, value in zip(cols, (doc_id, start, size, zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset)):
                col.append(value)
            offset += size
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokeniser for each file and worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Packs each row's ids and an end id into sequences of at most ``capacity`` ids.

    One row a piece: doc_id, start (ids of its row before it), length, ids_crc32
    (of the ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id and offset in the sequence. Null and empty texts are their end
    id alone; repeated rows are packed each; an empty table gives no rows. Only
    the two named columns are read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) * PARTITION_STEP
        tokenizer, packer = tokenizer_at(tokenizer_path), SumOfSquaresPacker(capacity, max(1, capacity // LEVELS))
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = tk.column(batch.column(1))
            at = 0
            for part in tk.slices(texts):
                for tokens in tokenizer.encode(texts.slice(part.first, len(part)).to_pylist()):
                    packer.add(ids[at], np.concatenate([tokens, end]))
                    at += 1
                if done := packer.take_closed():
                    yield _rows(done, first)
                    first += len(done)
        if done := packer.take_closed() + packer.drain():
            yield _rows(done, first)

    return docs.select(id_col, text_col).mapInArrow(pack, SCHEMA)

"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public
vocabulary, all of them, in lower case. A text is its words between white space,
each with the blank before it. The likelihood of a word is the sum over all ways
to cut it into pieces, by the forward algorithm, so no single segmentation is
trusted; the likelihood of a text is the product over all its words. Words are
scored once for each slice of texts, and those that a worker has met before not
again; the forward sums of words run side by side in numpy, those of very long
words position by position with rescaled sums.

Distributions are estimated by expectation maximisation over the same lattice,
from the distinct words of a sample of documents of each language, which is
bounded by a parameter. The words stay in Spark: a round sends the distributions
to the workers and gets expected counts back, a row a language and piece.
Scoring covers every word of every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm import textkernel as tk
from quillveil.llm.common import settle

#: Documents that the distributions are learned from, about, for each language.
SAMPLE_DOCS = 400
ROUNDS = 3
#: Probability of a piece that the language's sample does not hold, at least.
FLOOR = 1e-7
#: Bytes, with the blank, of the groups in which words run side by side; longer ones run alone.
WIDTHS = (8, 16, 32, 64)
#: Words that a worker remembers the scores of.
CACHE_WORDS = 300_000
#: Factor by byte that keeps the sums of words in the range of floating point.
_PER_BYTE = 1e3

_U = np.uint64
_FACTOR = _U(0x100000001B3)


class Pieces:
    """The vocabulary's pieces in lower case as bytes, and all single bytes; a blank marks the start of a word."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                found.add(model.id_to_piece(i).replace("\u2581", " ").lower().encode())
        found.discard(b"")
        self.pieces = sorted(found, key=lambda p: (len(p), p))
        self.sizes = np.array([len(p) for p in self.pieces])
        self.longest = int(self.sizes.max())
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)]
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(self.sizes == size)
            flat = np.frombuffer(b"".join(self.pieces[i] for i in at.tolist()), np.uint8).reshape(-1, size).astype(np.uint64)
            keys = np.zeros(len(at), np.uint64)
            for k in range(size):
                keys = keys * _FACTOR + flat[:, k] + _U(1)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.ids.append(at[order])
        self._machine = None

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, or -1."""
        own = self.keys[size]
        if not len(own):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, self.ids[size][at], -1)

    @property
    def machine(self):
        """An automaton that finds all pieces in bytes read as Latin-1."""
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for i, piece in enumerate(self.pieces):
                self._machine.add_word(piece.decode("latin-1"), (len(piece), i))
            self._machine.make_automaton()
        return self._machine


_pieces: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _matrices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, sizes with the blank, bytes as a matrix with zeros behind) of the words of a group of widths."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    least = 0
    for width in WIDTHS:
        at = np.flatnonzero((sizes > least) & (sizes <= width))
        least = width
        if len(at):
            flat = b"".join((b" " + words[i]).ljust(width, b"\0") for i in at.tolist())
            yield at, sizes[at], np.frombuffer(flat, np.uint8).reshape(len(at), width)


def _lattice(pieces: Pieces, m: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each (end, size) the rows of the matrix where a piece ends there, and its numbers."""
    out = {}
    length, wide = m.shape[1], m.astype(np.uint64) + _U(1)
    for start in range(length):
        key = np.zeros(len(m), np.uint64)
        for size in range(1, min(pieces.longest, length - start) + 1):
            key = key * _FACTOR + wide[:, start + size - 1]
            ids = pieces.find(size, key)
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                out[start + size, size] = rows, ids[rows]
    return out


def _forward(pieces: Pieces, lattice, n: int, length: int, table: np.ndarray) -> np.ndarray:
    """Sums over the ways to reach each position: (length + 1, n, languages)."""
    alpha = np.zeros((length + 1, n, table.shape[1]))
    alpha[0] = 1.0
    for end in range(1, length + 1):
        for size in range(1, min(pieces.longest, end) + 1):
            if (end, size) in lattice:
                rows, ids = lattice[end, size]
                alpha[end][rows] += alpha[end - size][rows] * table[ids]
    return alpha


def _scaled(pieces: Pieces, table: np.ndarray) -> np.ndarray:
    return table * np.minimum(_PER_BYTE ** pieces.sizes.astype(float), 1e290)[:, None]


def word_scores(pieces: Pieces, table: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log likelihood of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    scaled = _scaled(pieces, table)
    for at, sizes, m in _matrices(words):
        alpha = _forward(pieces, _lattice(pieces, m), len(m), m.shape[1], scaled)
        out[at] = np.log(alpha[sizes, np.arange(len(at))]) - np.log(_PER_BYTE) * sizes[:, None]
    for i, word in enumerate(words):
        if len(word) + 1 > WIDTHS[-1]:
            out[i] = _long_score(pieces, table, b" " + word)
    return out


def _long_score(pieces: Pieces, table: np.ndarray, word: bytes) -> np.ndarray:
    """The same for one word of any length: the sums of the last positions, divided by the greatest from time to time."""
    ring = pieces.longest + 1
    alpha = np.zeros((ring, table.shape[1]))
    alpha[0] = 1.0
    total, last = np.zeros(table.shape[1]), 0
    for end, (size, piece) in pieces.machine.iter(word.decode("latin-1")):
        if end + 1 != last:
            # single bytes are pieces, so every position is met, one after the other
            if last % 16 == 0:
                scale = alpha.max(axis=0)
                alpha /= scale
                total += np.log(scale)
            last = end + 1
            alpha[last % ring] = 0.0
        alpha[last % ring] += alpha[(last - size) % ring] * table[piece]
    return total + np.log(alpha[last % ring])


def expected_counts(pieces: Pieces, p: np.ndarray, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words under the probabilities ``p``."""
    expected = np.zeros(len(pieces))
    weights = _scaled(pieces, p[:, None])
    column = weights[:, 0]
    for at, sizes, m in _matrices(words):
        length, rows_ = m.shape[1], np.arange(len(at))
        lattice = _lattice(pieces, m)
        alpha = _forward(pieces, lattice, len(m), length, weights)[:, :, 0]
        beta = np.zeros((length + 1, len(m)))
        beta[sizes, rows_] = 1.0
        for start in range(length - 1, -1, -1):
            for size in range(1, min(pieces.longest, length - start) + 1):
                if (start + size, size) in lattice:
                    rows, ids = lattice[start + size, size]
                    beta[start][rows] += column[ids] * beta[start + size][rows]
        whole = times[at] / alpha[sizes, rows_]
        for (end, size), (rows, ids) in lattice.items():
            expected += np.bincount(ids, alpha[end - size][rows] * column[ids] * beta[end][rows] * whole[rows], len(pieces))
    for i, word in enumerate(words):
        if len(word) + 1 > WIDTHS[-1]:
            expected += times[i] * _long_counts(pieces, p, b" " + word)
    return expected


def _long_counts(pieces: Pieces, p: np.ndarray, word: bytes) -> np.ndarray:
    """The same for one word of any length, in logarithms: each piece by the ways that go through it."""
    found = [(end + 1 - size, end + 1, piece) for end, (size, piece) in pieces.machine.iter(word.decode("latin-1"))]
    starts, ends, ids = np.array(found).T
    weight = np.log(p[ids])
    n = len(word)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    # pieces come by their ends; single bytes are pieces, so no position is without one
    at = np.searchsorted(ends, np.arange(n + 2))
    for end in range(1, n + 1):
        here = slice(at[end], at[end + 1])
        forward[end] = np.logaddexp.reduce(forward[starts[here]] + weight[here])
    by_start = np.argsort(starts, kind="stable")
    at = np.searchsorted(starts[by_start], np.arange(n + 1))
    for start in range(n - 1, -1, -1):
        here = by_start[at[start] : at[start + 1]]
        backward[start] = np.logaddexp.reduce(weight[here] + backward[ends[here]])
    return np.bincount(ids, np.exp(forward[starts] + weight + backward[ends] - forward[n]), len(pieces))


def _lowered(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(tk.column(texts))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _lowered(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for part in tk.slices(texts):
            found, raw = tk.words(part), part.buf.tobytes()
            totals: dict[tuple[str, bytes], int] = {}
            for a, b, d in zip(found.starts.tolist(), found.ends.tolist(), found.docs().tolist()):
                key = langs[part.first + d], raw[a:b]
                totals[key] = totals.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.binary()), pa.array(list(totals.values()), pa.int64())], names=["lang", "word", "times"])


@dataclass
class LanguageModel:
    """Piece probabilities, a column a language."""

    path: str
    langs: list[str]
    table: np.ndarray

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.path, self.langs)).encode() + self.table.tobytes()).hexdigest()


def fit_languages(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Distributions from docs (doc_id, text, lang); null languages are left out, and so are those without words."""
    known = docs.filter(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not sizes:
        return LanguageModel(vocabulary_path, [], np.zeros((0, 0)))
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(int(1_000_000 * min(1.0, sample_docs / r["n"])))) for r in sizes])
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    counted = settle(sample.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, times long").groupBy("lang", "word").agg(F.sum("times").alias("times")))
    pieces = pieces_at(vocabulary_path)
    tables: dict[str, np.ndarray] = {}
    for number in range(ROUNDS):
        start = np.full(len(pieces), 1.0 / len(pieces)) if number == 0 else None
        rows = counted.mapInArrow(_expect(vocabulary_path, tables, start), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        rows = rows.sort_values(["lang", "piece"])
        tables = {}
        for lang, own in rows.groupby("lang"):
            expected = np.zeros(len(pieces))
            expected[own["piece"].to_numpy()] = own["n"].to_numpy()
            tables[lang] = np.maximum((expected + 0.01) / (expected.sum() + 0.01 * len(pieces)), FLOOR)
    langs = sorted(tables)
    return LanguageModel(vocabulary_path, langs, np.stack([tables[x] for x in langs], axis=1) if langs else np.zeros((0, 0)))


def _expect(path: str, tables: dict[str, np.ndarray], start: np.ndarray | None):
    """One round's expected counts of a part of the words, by language and piece."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_at(path)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            words, times = batch.column("word").to_pylist(), batch.column("times").to_numpy().astype(float)
            for lang in sorted(set(langs.tolist())):
                at = np.flatnonzero(langs == lang)
                p = start if start is not None else tables[lang]
                totals[lang] = totals.get(lang, 0) + expected_counts(pieces, p, [words[i] for i in at.tolist()], times[at])
        for lang, expected in totals.items():
            used = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(expected[used])], names=["lang", "piece", "n"])

    return expect


_remembered: dict[str, tuple[dict[int, int], np.ndarray]] = {}


def _scores_of(key: str, pieces: Pieces, table: np.ndarray, hashes: np.ndarray, word) -> np.ndarray:
    """Scores of the words of these hashes, of which ``word(i)`` gives the bytes; met ones come from the worker's memory."""
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = {}, np.zeros((1 << 12, table.shape[1]))
    index, scores = _remembered[key]
    if len(index) + len(hashes) > CACHE_WORDS:
        index.clear()
    keys = hashes.tolist()
    fresh = [i for i, h in enumerate(keys) if h not in index]
    if fresh:
        first = len(index)
        while first + len(fresh) > len(scores):
            scores = np.concatenate([scores, np.zeros_like(scores)])
        _remembered[key] = index, scores
        scores[first : first + len(fresh)] = word_scores(pieces, table, [word(i) for i in fresh])
        index.update(zip((keys[i] for i in fresh), range(first, first + len(fresh))))
    return scores[np.fromiter(map(index.__getitem__, keys), np.int64, len(keys))]


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row.

    The score is the posterior of the best language, with equal priors; equal
    ones go to the first by name. Null and empty texts and those without letters
    are ``und`` with score 0, and so is everything when no language was learned.
    Words of any length are scored whole. Repeated rows are predicted each; an
    empty table gives no rows.
    """
    key = model.key

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_at(model.path)
        names = np.array([*model.langs, "und"], dtype=object)
        letters = tk._mask([(0x41, 0x5A), (0x61, 0x7A)])
        for batch in batches:
            texts = _lowered(batch.column("text"))
            best, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in tk.slices(texts):
                n = len(part)
                total = np.zeros(len(part.buf) + 1, np.int64)
                np.cumsum(letters[part.buf], out=total[1:])
                lettered = total[part.offsets[1:]] > total[part.offsets[:-1]]
                for i in np.flatnonzero(~lettered).tolist():  # bytes beyond ASCII need not be letters
                    text = part.buf[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    lettered[i] = any(c.isalpha() for c in text)
                if not model.langs:
                    best.append(np.zeros(n, np.int64))
                    scores.append(np.zeros(n))
                    continue
                found = tk.words(part)
                distinct, first, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
                raw, starts, ends = part.buf.tobytes(), found.starts[first], found.ends[first]
                own = _scores_of(key, pieces, model.table, distinct, lambda i: raw[starts[i] : ends[i]])  # noqa: B023
                doc = found.docs()
                total = np.stack([np.bincount(doc, own[inverse, j], n) for j in range(len(model.langs))], axis=1)
                at = total.argmax(axis=1)
                odds = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
                best.append(np.where(lettered, at, len(model.langs)))
                scores.append(np.where(lettered, 1 / odds, 0.0))
            at, values = np.concatenate(best), np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[at].tolist(), pa.string()), pa.array(values)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")

"""Toxicity from a weighted lexicon.

Texts are folded (case, accents in either form, full-width forms, homoglyphs,
digits that stand for letters), an Aho-Corasick automaton finds the terms and the exception phrases
in one pass, a term counts where it stands as a word of its own, or as a stem at
a word's start, outside any exception phrase, and the summed weights are
normalised by the number of words.

The lexicon is a fixed list of insults and terms learned from labelled rows:
words and word beginnings, of any length, whose share among toxic documents is
far above that among others. Learning takes a sample of at most about
``SAMPLE_ROWS`` labelled rows of each kind, spread over the table by a hash of
the id, and a term must stand in a thousandth of the toxic ones, which bounds the
terms that are broadcast or reach the driver whatever the tables hold. The
calibration of the normalised weight to a score is fitted on
loads that each half of the sample has under the terms of the other half, so
that terms do not vouch for the documents they come from. Scoring covers every
row and whole texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm import textkernel as tk
from quillveil.llm.common import settle

# Insults by language, each a severity from 1 (mild) to 3, which is the weight of a term that labelled rows say nothing of.
TERMS = {
    "ass": 2, "asshole": 3, "bastard": 3, "bitch": 3, "brainless": 1, "bullshit": 2, "clown": 1, "coward": 1, "crap": 1, "creep": 1, "cretin": 2,
    "cunt": 3, "degenerate": 2, "despicable": 1, "dickhead": 3, "dimwit": 2, "disgusting": 1, "dumb": 1, "dumbass": 3, "filth": 2, "fool": 1, "freak": 1,
    "fuck": 3, "fucking": 3, "garbage": 1, "halfwit": 2, "hateful": 1, "idiot": 2, "idiotic": 2, "idiots": 2, "imbecile": 2, "jackass": 2, "jerk": 1,
    "loser": 2, "losers": 2, "lunatic": 1, "maggot": 2, "moron": 2, "moronic": 2, "morons": 2, "nitwit": 2, "parasite": 1, "pathetic": 1, "pig": 1,
    "prick": 3, "repulsive": 1, "retard": 3, "retarded": 3, "scum": 2, "scumbag": 3, "shit": 3, "shithead": 3, "sick": 0.5, "simpleton": 2, "slut": 3,
    "stupid": 1, "subhuman": 3, "trash": 1, "twat": 3, "ugly": 1, "useless": 1, "vermin": 2, "vile": 1, "wanker": 3, "whore": 3, "worthless": 1,
    "abschaum": 2, "arschloch": 3, "bloedmann": 2, "depp": 2, "dreckskerl": 3, "dummkopf": 2, "hurensohn": 3, "schlampe": 3, "schwachkopf": 2, "trottel": 2, "vollidiot": 3, "wichser": 3,
    "abruti": 2, "connard": 3, "connasse": 3, "cretine": 2, "debile": 2, "encule": 3, "imbecille": 2, "merde": 2, "ordure": 2, "putain": 2, "salaud": 3, "salope": 3,
    "cabron": 3, "escoria": 2, "estupido": 2, "gilipollas": 3, "idiota": 2, "imbecil": 2, "malparido": 3, "mierda": 2, "pendejo": 3, "puta": 3, "subnormal": 3, "tarado": 2,
}
# Phrases in which a term is no insult.
EXCEPTIONS = ["clown fish", "class clown", "circus clown", "trash can", "trash bin", "trash bag", "garbage can", "garbage collection", "garbage collector", "guinea pig", "pig iron", "sick leave", "sick day", "idiot proof", "fool proof", "jerk chicken", "pathetic fallacy", "parasite drag"]
# Letters that look like a Latin one, small and capital ones apart, as Greek eta looks like n and its capital like H.
SMALL_LOOKALIKES = {
    "а": "a", "в": "b", "г": "r", "е": "e", "ё": "e", "з": "z", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ш": "w", "ь": "b",
    "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v", "ү": "y",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ȷ": "j", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ʏ": "y",
}
CAPITAL_LOOKALIKES = {
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "Ѕ": "s", "І": "i", "Ј": "j", "Ԁ": "d", "Ԛ": "q", "Ԝ": "w", "Ү": "y",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
}
# Digits and signs that stand for letters.
LEET = ("013457@", "oieasta")
ZERO_WIDTH = [0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]

#: Labelled rows of each kind that terms are learned from, about.
SAMPLE_ROWS = 6_000
#: Toxic documents that a term needs, the share of them that it needs beside that, and how many times its share among them is that among others at least.
LEAST_SUPPORT, LEAST_SHARE, LEAST_LIFT = 3, 0.001, 10.0
#: Letters of the shortest word beginning that is a candidate, and up to where every length is; beyond it lengths grow by half.
FIRST_STEM, EVERY_STEM = 4, 8
#: Terms that a worker counts before it passes its counts on.
PARTIAL_TERMS = 100_000
#: Words at least in the length that normalises, so that one term in a short text weighs no more than in this many.
LEAST_WORDS = 8

_LETTERS = re.compile(r"[^\W\d_]+")
_STEM, _WORD, _EXEMPT = 0, 1, 2


def _fold_table() -> dict[int, int | None]:
    import unicodedata

    table: dict[int, int | None] = {ord(a): ord(b) for a, b in SMALL_LOOKALIKES.items()}
    table |= {ord(a): ord(b) for a, b in zip(*LEET)}
    table |= {code: code - 0xFEE0 for code in range(0xFF41, 0xFF5B)}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        if base.isascii() and base.isalpha():
            table[code] = ord(base)
    return table


_FOLD = _fold_table()
_CAPITALS = {ord(a): ord(b) for a, b in CAPITAL_LOOKALIKES.items()}
_INVISIBLE = re.compile("[" + "".join(chr(c) for c in ZERO_WIDTH) + "\u0300-\u036f]")


def fold(text: str) -> tuple[str, str]:
    """The lowered text without marks that combine and what shows nothing, and its folded form, of equal length."""
    import unicodedata

    if text.isascii():
        plain = text.lower()
        return plain, plain.translate(_FOLD)
    whole = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    plain, folded = whole.lower(), whole.translate(_CAPITALS).lower()
    # marks that lowering splits off
    plain, folded = (_INVISIBLE.sub("", unicodedata.normalize("NFC", x)) for x in (plain, folded))
    return plain, folded.translate(_FOLD)


@dataclass
class Model:
    """Weights of stems and whole words, and the calibration."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=lambda: {t: float(w) for t, w in TERMS.items()})
    intercept: float = -4.0
    slope: float = 3.0

    def machine(self):
        import ahocorasick

        entries: dict[str, list] = {}
        for kind, table in ((_STEM, self.stems), (_WORD, self.words), (_EXEMPT, dict.fromkeys(EXCEPTIONS, 0.0))):
            for term, weight in table.items():
                entries.setdefault(term, []).append((kind, len(term), weight))
        machine = ahocorasick.Automaton()
        for term, found in entries.items():
            machine.add_word(term, found)
        machine.make_automaton()
        return machine

    def load_of(self, weight: float, words: int) -> float:
        """The weight normalised by length, on a logarithmic scale."""
        return math.log1p(100.0 * weight / max(words, LEAST_WORDS))

    def score_of(self, weight: float, words: int) -> float:
        z = self.intercept + self.slope * self.load_of(weight, words)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def weigh(machine, text: str) -> tuple[int, float]:
    """Hits and their summed weight; of the terms at one word the heaviest counts."""
    plain, folded = fold(text)
    found: dict[int, tuple[float, int]] = {}
    exempt: list[tuple[int, int]] = []
    last = len(plain) - 1
    for end, entries in machine.iter(folded):
        for kind, size, weight in entries:
            start = end - size + 1
            # bounds are those of the unfolded text, so that signs after a word do not read as letters
            if (start and plain[start - 1].isalnum()) or (kind != _STEM and end < last and plain[end + 1].isalnum()):
                continue
            if kind == _EXEMPT:
                exempt.append((start, end))
            elif start not in found or found[start][0] < weight:
                found[start] = weight, end
    if exempt:
        exempt.sort()
        begins = [a for a, _ in exempt]
        for start in list(found):
            k = bisect_right(begins, start)
            # phrases are short, so only the last few that begin before can reach this far
            if any(found[start][1] <= b for _, b in exempt[max(0, k - 3) : k]):
                del found[start]
    return len(found), sum(w for w, _ in found.values())


_machines: dict[str, tuple] = {}


def _machine_of(key: str, model: Model):
    """One automaton for each model and worker."""
    if key not in _machines:
        if len(_machines) > 3:
            _machines.clear()
        _machines[key] = (model.machine(),)
    return _machines[key][0]


def _key(model: Model) -> str:
    import hashlib

    return hashlib.sha256(repr((sorted(model.stems.items()), sorted(model.words.items()))).encode()).hexdigest()


def _weighed(machine, texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, float]]]:
    counts = [tk.words(p).counts for p in tk.slices(texts)]
    return np.concatenate(counts) if counts else np.zeros(0, np.int64), [weigh(machine, t) if t else (0, 0.0) for t in tk.column(texts).to_pylist()]


def stems(word: str) -> list[str]:
    """The beginnings of a word that are candidates; so few that a word of any length has no more letters in them than some times its own."""
    out, k = [], FIRST_STEM
    while k <= len(word):
        out.append(word[:k])
        k += 1 if k < EVERY_STEM else k // 2
    return out


def _candidates(text: str) -> set[tuple[int, str]]:
    words = set(_LETTERS.findall(fold(text)[1]))
    out = {(_WORD, w) for w in words}
    for w in words:
        out.update((_STEM, x) for x in stems(w))
    return out


def _term_batch(totals: dict[tuple, list[int]]) -> pa.RecordBatch:
    cols = list(zip(*totals.values())) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in totals], pa.int32()), pa.array([t for _, t in totals], pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["kind", "term", "a0", "a1", "b0", "b1"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts; they are passed on before they outgrow the worker."""
    totals: dict[tuple, list[int]] = {}
    for batch in batches:
        for text, label, half in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("half").to_pylist()):
            for term in _candidates(text.as_py() or ""):
                totals.setdefault(term, [0, 0, 0, 0])[2 * half + label] += 1
            if len(totals) > PARTIAL_TERMS:
                yield _term_batch(totals)
                totals = {}
    yield _term_batch(totals)


def fit_line(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """Logistic regression of one feature by Newton's method."""
    features = np.stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ features, -30, 30)))
        gradient = features @ (y - p) - penalty * np.array([0, 1]) * beta
        curve = (features * (p * (1 - p))) @ features.T + np.diag([1e-6 * len(x), penalty])
        step = np.clip(np.linalg.solve(curve, gradient), -5, 5)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _lexicon(rows: list[tuple[int, str, int, int]], negative: int, positive: int) -> Model:
    """Terms from (kind, term, documents without and with the label)."""
    model = Model()
    support = max(LEAST_SUPPORT, LEAST_SHARE * positive)
    for kind, term, n0, n1 in rows:
        # half a document is added to either side, more to that of the others, so that rare terms need support
        odds = math.log((n1 + 0.5) / (positive + 1)) - math.log((n0 + 0.5) / (negative + 1))
        if n1 >= support and odds >= math.log(LEAST_LIFT):
            (model.stems if kind == _STEM else model.words)[term] = min(odds, 6.0)
        elif term in TERMS and kind == _WORD and n0 + n1 >= 2 * LEAST_SUPPORT:
            model.words[term] = max(0.0, min(odds, float(TERMS[term])))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, label); labels other than 0 and 1 are left out.

    Of repeated labels the highest holds. Without labels of both kinds the fixed
    list and a fixed calibration hold.
    """
    known = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(int(1_000_000 * min(1.0, sample_rows / n)))) for k, n in sizes.items()])
    chosen = known.filter(place < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")).withColumn("label", F.col("label").cast("int"))
    # bounded by sample_rows, whatever the tables hold: of rows that share an id one counts
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = settle(joined.groupBy("doc_id", "label", "half").agg(F.min("text").alias("text")).select("text", "label", "half"))
    n = {(r["half"], r["label"]): r["n"] for r in sample.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = [F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")]
    counted = sample.mapInArrow(_count_terms, "kind int, term string, a0 long, a1 long, b0 long, b1 long").groupBy("kind", "term").agg(*sums)
    positive, negative = n.get((0, 1), 0) + n.get((1, 1), 0), n.get((0, 0), 0) + n.get((1, 0), 0)
    if not positive or not negative:
        return Model()
    both1, both0 = F.col("a1") + F.col("b1"), F.col("a0") + F.col("b0")
    # half of a sample needs half of the support
    lifted = (both1 >= max(LEAST_SUPPORT, LEAST_SHARE * positive / 2)) & ((both1 + 0.5) * (negative + 1) >= LEAST_LIFT / 2 * (both0 + 0.5) * (positive + 1))
    listed = F.col("term").isin(sorted(TERMS)) & (F.col("kind") == _WORD)
    rows = sorted(counted.filter(lifted | listed).collect())
    halves = [_lexicon([(r["kind"], r["term"], r[f"{h}0"], r[f"{h}1"]) for r in rows], n.get((i, 0), 0), n.get((i, 1), 0)) for i, h in enumerate("ab")]
    model = _lexicon([(r["kind"], r["term"], r["a0"] + r["b0"], r["a1"] + r["b1"]) for r in rows], negative, positive)
    keys = [_key(m) for m in halves]

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, half in zip(batch.column("text"), batch.column("half").to_pylist()):
                other = 1 - half
                words, hits = _weighed(_machine_of(keys[other], halves[other]), pa.array([text.as_py()], pa.string()))
                out.append(model.load_of(hits[0][1], int(words[0])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column("label")], names=["load", "label"])

    pairs = sample.mapInArrow(loads, "load double, label int").toPandas().sort_values(["load", "label"])
    model.intercept, model.slope = fit_line(pairs["load"].to_numpy(float), pairs["label"].to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hits, score) of each row of ``docs``; ``labels`` (doc_id, label) are the rows to learn from.

    Null and empty texts have no hits and the lowest score. Repeated rows are
    scored each. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_toxicity(named, labels)
    key = _key(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine_of(key, model)
        for batch in batches:
            words, hits = _weighed(machine, batch.column("text"))
            scores = [model.score_of(w, int(n)) for (_, w), n in zip(hits, words.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array([h for h, _ in hits], pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_hits", "score"])

    return named.mapInArrow(score, "doc_id long, n_words long, n_hits long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that score below ``threshold``, in all their columns, whatever those are called.

    Null and empty texts have no terms and stay where the model's intercept is
    below the threshold. Repeated rows are each judged, and alike; ids may be
    null. An empty table gives no rows.
    """
    model = fit_toxicity(docs, labels)
    key = _key(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine_of(key, model)
        for batch in batches:
            words, hits = _weighed(machine, batch.column("text"))
            good = [model.score_of(w, int(n)) < threshold for (_, w), n in zip(hits, words.tolist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

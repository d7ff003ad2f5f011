"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts over the raw bytes of each whole text. Trees grow
level by level from histograms of binned features, and are flattened into
arrays (feature, threshold, children, value), which numpy walks for a whole
batch at once, a level of all trees a step.

The model is fitted on a sample of labelled rows of at most about
``SAMPLE_ROWS`` rows, taken by a hash of the id; their statistics, some hundred
bytes a row, are all that reaches the driver. Everything else covers all rows,
whose statistics and scores are taken in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm import textkernel as tk
from quillveil.llm.docstats import BASE, MORE, counts, with_counts

#: Labelled rows that the trees are fitted on, about; the bound of what the driver gathers.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE = 60, 4, 64, 0.15, 8.0, 1.0


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics, a row a text, from counts of ``docstats``."""
    f = {k: v.astype(float) for k, v in c.items()}
    words, chars, lines = np.maximum(f["n_words"], 1), np.maximum(f["n_chars"], 1), np.maximum(f["n_lines"], 1)
    letters = np.maximum(f["n_upper"] + f["n_lower"] + f["n_wide"], 1)
    return np.stack(
        [
            np.log1p(f["n_words"]),
            f["word_chars"] / words,
            f["n_symbols"] / words,
            f["n_dup_lines"] / lines,
            f["n_repeat_words"] / words,
            f["n_distinct_words"] / words,
            f["n_distinct_words"] / np.sqrt(words),
            f["n_long_words"] / words,
            f["n_upper"] / letters,
            f["n_wide"] / letters,
            f["n_digits"] / chars,
            f["n_punct"] / chars,
            f["n_exclaim"] / words,
            f["n_lines"] / words,
            f["word_chars"] / chars,
            np.log1p(f["n_dup_lines"]),
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Flattened trees: node i of tree t stands at t * nodes + i, its children at 2 i + 1 and 2 i + 2."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        nodes = 2 ** (self.depth + 1) - 1
        trees = len(self.feature) // nodes
        out = np.full(len(x), self.base)
        if not trees or not len(x):
            return out
        root = np.arange(trees) * nodes
        at = np.zeros((len(x), trees), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = root + at
            right = x[rows, self.feature[node]] > self.threshold[node]
            at = 2 * at + 1 + right
        return out + self.value[root + at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts the logistic loss. Nodes that gain nothing send all rows left with the same value."""
    n, width = x.shape if len(x) else (0, 1)
    nodes = 2 ** (DEPTH + 1) - 1
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(base, DEPTH, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    margin = np.full(n, base)
    feature, threshold, value = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, dtype=np.int64)
        f, t, v = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            own = at - first
            cell = own * BINS
            total_g, total_h = np.bincount(own, g, count), np.bincount(own, h, count)
            best = np.zeros(count)
            for j in range(width):
                left_g = np.bincount(cell + binned[:, j], g, count * BINS).reshape(count, BINS).cumsum(axis=1)
                left_h = np.bincount(cell + binned[:, j], h, count * BINS).reshape(count, BINS).cumsum(axis=1)
                size = np.bincount(cell + binned[:, j], minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                right_g, right_h, rest = total_g[:, None] - left_g, total_h[:, None] - left_h, size[:, -1:] - size
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None]
                gain[(size < LEAST_LEAF) | (rest < LEAST_LEAF)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(axis=1)
                top = gain[np.arange(count), cut]
                better = top > best + 1e-9
                best[better] = top[better]
                f[first : first + count][better] = j
                t[first : first + count][better] = edges[j][cut[better]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf_first = 2**DEPTH - 1
        own = at - leaf_first
        v[leaf_first:] = RATE * np.bincount(own, g, 2**DEPTH) / (np.bincount(own, h, 2**DEPTH) + RIDGE)
        margin += v[at]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(base, DEPTH, np.concatenate(feature), np.concatenate(threshold), np.concatenate(value))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from docs (doc_id, text) and labels (doc_id, label); labels other than 0 and 1 are left out.

    The sample is the rows whose hashed id falls under the share that gives
    about ``sample_rows`` of them, so it is spread over all of the table. Of
    rows that share an id one counts.
    """
    known = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    size = known.count()
    if size > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample_rows / size)))
    # bounded by sample_rows, whatever the tables hold
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    counted = with_counts(chosen, "doc_id", "text", ["label"], more=True)
    once = counted.groupBy("doc_id").agg(F.min(F.struct("label", *BASE, *MORE)).alias("c")).select("doc_id", "c.*")
    rows = once.toPandas().sort_values("doc_id", kind="stable")
    return fit_trees(features({k: rows[k].to_numpy() for k in BASE + MORE}), rows["label"].to_numpy(float))


def _scores(trees: Trees, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and score of each text."""
    words, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
    for part in tk.slices(texts):
        found = counts(part, more=True)
        words.append(found["n_words"])
        scores.append(trees.scores(features(found)))
    return np.concatenate(words), np.concatenate(scores)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Trees]:
    """Scores each row; gives (doc_id, n_words, score) and the trees.

    Null and empty texts have all counts 0 and are scored by them. Repeated rows
    are scored each; of repeated labels the highest holds. Without labels of
    both kinds the score is their share, or 0.5. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trees = fit_quality(named, labels, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, scores = _scores(trees, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(scores)], names=["doc_id", "n_words", "score"])

    return named.mapInArrow(score, "doc_id long, n_words long, score double"), trees


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that score ``threshold`` or more, in all their columns, whatever those are called.

    Null and empty texts are scored by the statistics of an empty text. Repeated
    rows are each judged, and alike; ids may be null. An empty table gives no rows.
    """
    trees = fit_quality(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(trees, batch.column("text"))[1] >= threshold))

    return docs.mapInArrow(keep, docs.schema)

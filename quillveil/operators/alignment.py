"""How a text became another one: alignments with their operations, by words and by characters, summed by stage.

An alignment costs as little as any. It is sought in a band about the diagonal,
which is doubled until the cost shows that no cheaper way leaves it. Where a
band would take more than ``CELLS`` cells, the pair is cut in two where the
costs of both halves add up to the least, so memory is bounded at any length.
Short pairs are aligned many at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = "struct<equal:long,replaced:long,deleted:long,inserted:long>"
#: Cells of a band that is kept for the way back.
CELLS = 1 << 22
#: Cells of a pair up to which all of its costs are kept, together with those of other pairs.
SHORT = 1 << 18
#: Words: placeholders as one each, else runs of letters and digits.
WORD = r"\[[A-Z]+(?:_[A-Z0-9]+)*\]|[\p{L}\p{N}]+"


def _next_row(before: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Costs of one more symbol of the left side against all beginnings of the right one."""
    row = np.minimum(before + 1, np.concatenate([[before[0] + 1], before[:-1] + (b != a)]))
    steps = np.arange(len(row))
    return np.minimum.accumulate(row - steps) + steps


def _banded(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Costs at (i, i + d - width) for all i and d; what lies outside of both sides costs more than any way."""
    n, m, size = len(a), len(b), 2 * width + 1
    far = n + m + 1
    out = np.full((n + 1, size), far, np.int32)
    d = np.arange(size)
    inside = d - width
    out[0] = np.where((inside >= 0) & (inside <= m), inside, far)
    for i in range(1, n + 1):
        j = i + inside
        ok = (j >= 0) & (j <= m)
        symbol = np.full(size, -1, np.int64)
        at = (j >= 1) & (j <= m)
        symbol[at] = b[j[at] - 1]
        row = np.minimum(np.where(j >= 1, out[i - 1] + (symbol != a[i - 1]), far), np.append(out[i - 1][1:], far) + 1)
        row = np.where(ok, row, far)
        out[i] = np.where(ok, np.minimum.accumulate(row - d) + d, far)
    return out


def _way_back(a: np.ndarray, b: np.ndarray, costs: np.ndarray, width: int) -> np.ndarray:
    """Counts of equal, replaced, deleted and inserted symbols; a pair is preferred to a deletion, that to an insertion."""
    i, j = len(a), len(b)
    counts = np.zeros(4, np.int64)
    while i or j:
        d = j - i + width
        here = costs[i, d]
        if i and j and here == costs[i - 1, d] + (a[i - 1] != b[j - 1]):
            counts[int(a[i - 1] != b[j - 1])] += 1
            i, j = i - 1, j - 1
        elif i and d + 1 < costs.shape[1] and here == costs[i - 1, d + 1] + 1:
            counts[2] += 1
            i -= 1
        else:
            counts[3] += 1
            j -= 1
    return counts


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both without what they begin and end with alike, which is part of a cheapest alignment, and how much that is."""
    short = min(len(a), len(b))
    same = a[:short] == b[:short]
    begin = short if same.all() else int(same.argmin())
    a, b = a[begin:], b[begin:]
    short = min(len(a), len(b))
    same = a[len(a) - short :][::-1] == b[len(b) - short :][::-1]
    end = short if same.all() else int(same.argmin())
    return a[: len(a) - end], b[: len(b) - end], begin + end


def operations(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Counts of equal, replaced, deleted and inserted symbols of a cheapest alignment of two sequences of numbers."""
    a, b, same = _trimmed(a, b)
    out = np.array([same, 0, 0, 0], np.int64)
    if not len(a) or not len(b):
        return out + [0, 0, len(a), len(b)]
    width = max(8, abs(len(a) - len(b)))
    while (len(a) + 1) * (2 * width + 1) <= cells:
        costs = _banded(a, b, width)
        least = costs[len(a), len(b) - len(a) + width]
        # a way that leaves the band has more deletions and insertions than it is wide
        if least <= width or width >= max(len(a), len(b)):
            return out + _way_back(a, b, costs, width)
        width = min(2 * width, max(len(a), len(b)))
    if len(a) == 1:
        hit = int((b == a[0]).any())
        return out + [hit, 1 - hit, 0, len(b) - 1]
    half = len(a) // 2
    ahead, back = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for x in a[:half]:
        ahead = _next_row(ahead, x, b)
    for x in a[half:][::-1]:
        back = _next_row(back, x, b[::-1])
    cut = int((ahead + back[::-1]).argmin())
    return out + operations(a[:half], b[:cut], cells) + operations(a[half:], b[cut:], cells)


def _padded(sides: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(sides), max(map(len, sides))), fill, np.int64)
    for row, side in zip(out, sides):
        row[: len(side)] = side
    return out


def _whole(lefts: list[np.ndarray], rights: list[np.ndarray]) -> np.ndarray:
    """Counts of several pairs of short sequences, with all costs of all of them, row by row at once; the way back is that of ``_way_back``."""
    a, b = _padded(lefts, -1), _padded(rights, -2)
    i, j, pair = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights]), np.arange(len(lefts))
    steps = np.arange(b.shape[1] + 1, dtype=np.int32)
    costs = np.empty((a.shape[1] + 1, len(pair), len(steps)), np.int32)
    costs[0] = steps
    for k in range(1, len(costs)):
        row = costs[k - 1] + np.int32(1)
        np.minimum(row[:, 1:], costs[k - 1][:, :-1] + (b != a[:, k - 1 : k]), out=row[:, 1:])
        row -= steps
        np.add(np.minimum.accumulate(row, axis=1), steps, out=costs[k])
    counts = np.zeros((len(pair), 4), np.int64)
    while len(pair):
        here, above, before = costs[i, pair, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        other = a[pair, above] != b[pair, before]
        both = (i > 0) & (j > 0) & (here == costs[above, pair, before] + other)
        gone = ~both & (i > 0) & (here == costs[above, pair, j] + 1)
        counts[pair, np.where(both, other, np.where(gone, 2, 3))] += 1
        i, j = i - (both | gone), j - ~gone
        left = (i > 0) | (j > 0)
        i, j, pair = i[left], j[left], pair[left]
    return counts


def _short_cells(a: np.ndarray, b: np.ndarray) -> int:
    return (len(a) + 1) * (len(b) + 1)


def counts(pairs: list[tuple[np.ndarray, np.ndarray]], short: int = SHORT, cells: int = CELLS) -> np.ndarray:
    """``operations`` of many pairs. Those with up to ``short`` cells are aligned together, as many of about one size as ``cells`` hold, others one by one."""
    out = np.zeros((len(pairs), 4), np.int64)
    waiting = []
    for at, (a, b) in enumerate(pairs):
        a, b, same = _trimmed(a, b)
        if not len(a) or not len(b):
            out[at] = [same, 0, len(a), len(b)]
        elif _short_cells(a, b) <= short:
            out[at, 0] = same
            waiting.append((len(a), len(b), at, a, b))
        else:
            out[at] = operations(a, b, cells) + [same, 0, 0, 0]
    waiting.sort(key=lambda w: w[:3])
    begin = 0
    while begin < len(waiting):
        end, widest = begin, 0
        while end < len(waiting):
            wider = max(widest, waiting[end][1])
            if end > begin and (waiting[end][0] + 1) * (wider + 1) * (end - begin + 1) > cells:
                break
            end, widest = end + 1, wider
        group = waiting[begin:end]
        out[[w[2] for w in group]] += _whole([w[3] for w in group], [w[4] for w in group])
        begin = end
    return out


def edits(left: Column, right: Column, unit: str = "char") -> Column:
    """COUNTS of the operations that turn the left text into the right one, by ``char`` or by ``word``. A null text counts as empty."""

    @F.pandas_udf(COUNTS)
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        numbers: dict[str, int] = {}
        if unit == "word":
            codes = lambda symbols: np.array([numbers.setdefault(s, len(numbers)) for s in symbols], np.int64)
        else:
            codes = lambda text: np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        # equal pairs are aligned once
        places: dict[tuple, int] = {}
        where = [places.setdefault(pair, len(places)) for pair in (zip(map(tuple, a), map(tuple, b)) if unit == "word" else zip(a, b))]
        found = counts([(codes(x), codes(y)) for x, y in places])
        return pd.DataFrame(found[where], columns=["equal", "replaced", "deleted", "inserted"])

    text = lambda c: F.coalesce(c, F.lit(""))
    units = (lambda c: F.regexp_extract_all(text(c), F.lit(WORD), F.lit(0))) if unit == "word" else text
    return count(units(left), units(right))


def quality_summary(pairs: DataFrame, keys: list[str], reference: str = "reference", output: str = "output") -> DataFrame:
    """By keys, such as split and stage: documents, and for words and characters the operations, the reference's length and the error rate.

    A rate is replaced, deleted and inserted symbols over those of the
    reference, and 0 where neither has any; with an empty reference it is null.
    """
    rows = pairs.select(*keys, edits(F.col(reference), F.col(output), "word").alias("w"), edits(F.col(reference), F.col(output), "char").alias("c"))
    kinds = ["equal", "replaced", "deleted", "inserted"]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), *[F.sum(f"{u}.{k}").alias(f"{name}_{k}") for u, name in (("w", "words"), ("c", "chars")) for k in kinds])

    def rate(name: str) -> Column:
        errors = F.col(f"{name}_replaced") + F.col(f"{name}_deleted") + F.col(f"{name}_inserted")
        length = F.col(f"{name}_equal") + F.col(f"{name}_replaced") + F.col(f"{name}_deleted")
        return F.when(errors == 0, F.lit(0.0)).otherwise(F.round(errors / F.nullif(length, F.lit(0)), 6))

    return out.withColumns({"wer": rate("words"), "cer": rate("chars")})

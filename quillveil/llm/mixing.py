"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size z gives each of its documents t / z expected
copies. The whole part is taken as it is. The fractional parts are rounded
dependently: two sides exchange mass, at random and without changing the
expected words of the pair, until one of them is integral, and the other goes on
to the next pair. Within a group the two sides are the largest document left and
the pool of all smaller ones, whose common share moves as one; so large
documents are settled while there are words enough to make up for them, what
is left over is a small document, and the words of a source come out within
about its smallest documents of its target. Each document's expected copies stay as they were.

The documents of a source are dealt to as many groups as its count needs, each
group is reduced to at most one fractional document, and these residuals meet
in pairs in a reduction tree of bounded fan-in; the last one of a source is drawn. All
draws come from hashes of ids and sizes, so reruns agree whatever the layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillveil.llm.common import WORD, settle

#: Documents of a source in one group of the first level, and residuals in one group of the next.
GROUP = 4096
FAN_IN = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """Targets for each source of ``sizes`` (source, source_size): weights repeat over the sources by code point, null last.

    All sizes are shared by weight; a target stops at ``cap`` times its source's
    size and the excess goes to the others by weight until none is above. That
    fixed point is one level for target / weight, found with running sums over
    the sources sorted by the level at which they stop. The table has one row a
    source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    slot = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (slot + 1).cast("int"))
    rated = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("stop", F.col("cap") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    before = F.sum("cap").over(by_stop) - F.col("cap")
    rest = F.sum("weight").over(everything) - F.sum("weight").over(by_stop) + F.col("weight")
    level = (F.sum("source_size").over(everything) - before) / rest
    place = F.row_number().over(Window.orderBy("stop", F.col("source").asc_nulls_last()))
    found = rated.withColumn("level", level).withColumn("place", place)
    # the first source that does not stop: all before it do, none after it does
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("place", "level"))).over(everything)["level"])
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(ids: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    from quillveil.llm.textkernel import mix64

    x = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64)))
    x = mix64(x ^ sizes.astype(np.int64).view(np.uint64))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


_NEAR = 1e-12


def _duel(p: float, w: float, q: float, z: float, draw: float) -> tuple[float, float]:
    """Moves words between two sides of sizes w and z with shares p and q until one of them is 0 or 1."""
    up = min((1 - p) * w, q * z)
    down = min(p * w, (1 - q) * z)
    move = up if draw * (up + down) < down else -down
    p, q = p + move / w, q - move / z
    return (round(p) if not _NEAR < p < 1 - _NEAR else p), (round(q) if not _NEAR < q < 1 - _NEAR else q)


def _pivot(share: np.ndarray, size: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """Rounds all shares but one at most; ``last`` also draws that one.

    Documents of one share duel with the pool of those behind them, the largest
    first; what is left of different shares, as residuals are, duels in pairs.
    """
    out = share.copy()
    integral = ~((share > _NEAR) & (share < 1 - _NEAR))
    out[integral] = np.round(share[integral])
    out[~integral & (size == 0)] = 0.0
    # equal sizes stay in their order, which is random
    left = np.flatnonzero(~integral & (size > 0))
    left = left[np.argsort(-size[left], kind="stable")].tolist()
    if not left:
        return out
    residuals = []
    for p in sorted(set(share[left].tolist())):
        # documents of one share, of which there is one but for rows that are equal or left over
        own = [i for i in left if share[i] == p]
        rest = float(size[own].sum())
        for at, i in enumerate(own[:-1]):
            rest -= float(size[i])
            out[i], q = _duel(p, float(size[i]), p, rest, float(draw[i]))
            if q in (0, 1):
                # the pool is settled; the document may be what is left
                out[own[at + 1 :]] = q
                residuals.append(i)
                break
            p = q
        else:
            out[own[-1]] = p
            residuals.append(own[-1])
    residuals.sort(key=lambda i: (-size[i], i))
    held = residuals[0]
    for i in residuals[1:]:
        if out[held] in (0, 1):
            held = i
        elif out[i] not in (0, 1):
            out[held], out[i] = _duel(float(out[held]), float(size[held]), float(out[i]), float(size[i]), float(draw[i]))
            held = held if out[held] not in (0, 1) else i
    if last and out[held] not in (0, 1):
        out[held] = float(draw[held] < out[held])
    return out


def _reduce(seed: int, last: bool):
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, size = pdf["row"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        order = np.lexsort((size, rows, _uniform(rows, size, seed)))
        pdf = pdf.iloc[order]
        share = _pivot(pdf["share"].to_numpy(float), size[order].astype(float), _uniform(rows[order], size[order], seed + 101), last)
        return pdf.assign(share=share)

    return step


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Copies for each row so that each source's words come near its target.

    Returns doc_id, size (words; 0 for null and empty texts), source_size,
    target, copies and taken (copies times size), and the columns of ``keep``
    (under their own names). Documents without words are taken once if their
    source's target is at least its size, as no draw can move words to them. A
    null source is a source of its own, the last. Rows of one id, text and
    source are one entry of so many rows, of which but one are rounded by
    count, so no group grows with them; all of them are returned. An empty
    table gives no rows.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col), text.isNull(), text).alias("row"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source"), *keep)
    sized = settle(sized.groupBy("doc_id", "row", "size", "source", *keep).agg(F.count(F.lit(1)).alias("n")))
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("documents"))
    targets = source_targets(sizes.select("source", "source_size"), weights, cap)
    targets = targets.join(sizes.select(F.col("source").alias("own"), "documents"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    targets = settle(targets.withColumn("groups", F.ceil(F.col("documents") / GROUP)).withColumnRenamed("source", "of"))
    depth = max(1, (targets.agg(F.max("groups")).first()[0] or 1))
    # one row a source; the documents side may be skewed, and such a join splits
    ready = sized.join(targets, sized["source"].eqNullSafe(targets["of"])).drop("of", "documents")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    ready = ready.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    # of n equal rows so many take one more, and one takes the rest
    mass = (F.col("expected") - F.col("whole")) * F.col("n")
    ready = ready.withColumn("more", F.when(F.col("n") > 1, F.floor(mass)).otherwise(F.lit(0)).cast("long")).withColumn("share", mass - F.col("more"))
    ready = ready.withColumn("bucket", F.when(F.col("groups") > 1, F.pmod(F.xxhash64("row", F.lit(seed)), F.col("groups"))).otherwise(F.lit(0).cast("long")))
    ready = ready.drop("groups", "expected")
    level, decided = 0, []
    while True:
        last = depth <= 1
        rounded = ready.groupBy("source", "bucket").applyInPandas(_reduce(seed + level, last), ready.schema)
        if last:
            decided.append(rounded)
            break
        rounded = settle(rounded)
        integral = (F.col("share") == 0.0) | (F.col("share") == 1.0)
        decided.append(rounded.filter(integral))
        ready = rounded.filter(~integral).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        depth, level = -(-depth // FAN_IN), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    one_more = F.when(F.col("nth") <= F.col("more"), F.lit(1.0)).when(F.col("nth") == F.col("more") + 1, F.col("share")).otherwise(F.lit(0.0))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    out = out.withColumn("copies", (F.col("whole") + one_more).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken", *keep)


def repeat_rows(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its ``copies`` says, without that column: none for 0 and for null. Rows that are equal are each repeated; an empty table gives no rows."""
    return docs.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).drop(copies)

"""Connected components of an edge table, by repeated contraction to a neighbour of high rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.common import discard, grows, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b); the root is a node of the component, the same for all of it.

    Each round maps a node to the one of highest rank among itself and its
    neighbours, and contracts the edges to those. In odd rounds the rank is the
    number of neighbours, which contracts a star of any size at once; ties, and
    the even rounds, are ranked by a hash drawn anew for the round, by which
    every component shrinks by a constant factor, chains too. Nulls and loops
    are left out. An empty table gives no rows.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    roots, number = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        number += 1
        degrees = F.lit(0).cast("long")
        if number % 2:
            count = both.groupBy(F.col("a").alias("b")).agg((-F.count(F.lit(1))).alias("degree"))
            both, degrees = both.join(grows(count), "b"), F.col("degree")
        rank = lambda c, d: F.struct(d.alias("degree"), F.xxhash64(c, F.lit(number)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(rank("b", degrees)).alias("best"), (-F.count(F.lit(1)) if number % 2 else F.lit(0).cast("long")).alias("own"))
        step = written(best.select(F.col("a").alias("node"), F.least(rank("a", F.col("own")), F.col("best"))["id"].alias("to")))
        ends = edges.join(grows(step.select(F.col("node").alias("a"), F.col("to").alias("ra"))), "a").join(grows(step.select(F.col("node").alias("b"), F.col("to").alias("rb"))), "b")
        before, edges = edges, written(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct())
        discard(before)
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
            last = step
        else:
            moved = step.withColumnsRenamed({"node": "old"})
            joined = written(roots.join(grows(moved), roots["root"] == moved["old"], "left").select("node", F.coalesce("to", "root").alias("root")))
            discard(last, step)
            roots = last = joined
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

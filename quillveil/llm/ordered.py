"""Running totals over groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillveil.llm.common import written

#: Aggregates whose totals can be combined, with the expression that combines two.
_COMBINE: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def running(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the totals of the rows of its key up to its own, and the table to discard once that is used.

    ``totals`` names each new column and has the aggregate (``sum``, ``max`` or
    ``xor``) and the column it is of; ``max`` passes over nulls, so with it a
    value is carried on, a struct too. Rows are sorted over range partitions,
    totalled inside each, and moved on by what the partitions before have of the
    key, so a key with most of the rows is shared out. Rows that the order
    does not tell apart come in any sequence.
    """
    placed = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*keys, "_part").agg(*[_COMBINE[kind][0](F.col(c)).alias(name) for name, (kind, c) in totals.items()])
    # a row only for keys that go over the border of a partition
    carried = ends.withColumn("_earlier", F.count(F.lit(1)).over(before) > 0).select(*keys, "_part", "_earlier", *[_COMBINE[kind][0](F.col(name)).over(before).alias(f"_{name}") for name, (kind, _) in totals.items()])
    inside = placed.select("*", *[_COMBINE[kind][0](F.col(c)).over(here).alias(name) for name, (kind, c) in totals.items()])
    both = inside.join(carried.filter("_earlier").drop("_earlier"), [*keys, "_part"], "left")
    whole = [F.coalesce(_COMBINE[kind][1](F.col(name), F.col(f"_{name}")), F.col(name), F.col(f"_{name}")).alias(name) for name, (kind, _) in totals.items()]
    return both.select(*df.columns, *whole), placed

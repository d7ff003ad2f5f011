"""How well detectors did: matches, precision, recall, preservation, edit distances, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(1.0)), 6)


def drop_nested(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that are not properly inside a larger one of the same keys: by the largest end so far, without pairs."""
    from pyspark.sql import Window

    ordered = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    same = (F.lag("start").over(ordered) == F.col("start")) & (F.lag("end").over(ordered) == F.col("end"))
    return spans.withColumn("_nested", (reach >= F.col("end")) & ~F.coalesce(same, F.lit(False))).filter(~F.coalesce(F.col("_nested"), F.lit(False))).drop("_nested")


def detector_metrics(expected: DataFrame, predicted: DataFrame, keys: list[str], kind: str = "type", severity: str = "severity") -> DataFrame:
    """TP, FN, FP, weighted FN, precision, recall and F1 by type and over all (type null), in one pass.

    Spans match when all keys and the type are equal; an empty denominator is 1.
    """
    on = [*keys, kind]
    joined = expected.withColumn("e", F.lit(1)).join(predicted.select(*on).distinct().withColumn("p", F.lit(1)), on, "full_outer")
    both, missed, extra = F.col("e").isNotNull() & F.col("p").isNotNull(), F.col("p").isNull(), F.col("e").isNull()
    out = joined.groupingSets([[F.col(kind)], []], kind).agg(F.count_if(both).alias("tp"), F.count_if(missed).alias("fn"), F.count_if(extra).alias("fp"), F.coalesce(F.sum(F.when(missed, F.col(severity))), F.lit(0)).cast("long").alias("weighted_fn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.select(kind, "tp", "fn", "fp", "weighted_fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def preservation(controls: DataFrame, category: str) -> DataFrame:
    """Controls (sample, control, category, kept) are preserved when every occurrence is; losses and rate by category and over all."""
    own = controls.groupBy("sample", "control", category).agg(F.bool_and("kept").alias("kept"))
    out = own.groupingSets([[F.col(category)], []], category).agg(F.count(F.lit(1)).alias("controls"), F.count_if(~F.col("kept")).alias("lost"))
    return out.withColumn("rate", _ratio(F.col("controls") - F.col("lost"), F.col("controls")))


def edit_summary(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Character errors by key: edit distance over the length of the reference."""
    rows = pairs.select(key, F.levenshtein(a, b).alias("d"), F.length(a).alias("n"))
    return rows.groupBy(key).agg(F.sum("d").cast("long").alias("errors"), F.sum("n").cast("long").alias("chars")).withColumn("cer", F.round(F.col("errors") / F.col("chars"), 6))


def phase_durations(events: DataFrame, phase: str, ms: str) -> DataFrame:
    """Nearest-rank p50 and p95, total and count by phase."""
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by {ms})")
    return events.groupBy(phase).agg(F.count(F.lit(1)).alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))

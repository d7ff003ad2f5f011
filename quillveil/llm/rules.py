"""Quality rules with adaptive thresholds.

Fixed base rules drop very short and very repetitive documents. Beyond them,
each measure has an upper threshold that follows the documents themselves: its
distribution is kept in a mergeable quantile sketch (logarithmic buckets with
counts, 1 % relative error) for each language and source, so sketches of
partitions, sources and languages add up, and the thresholds are joined to the
documents.

No cutoff is a number of its own. Where a measure parts a sketch into two heaps,
so that the best cut explains nearly all of its variance, the threshold lies
between them; else it is a fence beyond the upper quartile of the documents that
have any of it, as far as their quartiles are apart. A group's threshold is
weighed with its language's, and that with all documents', by their numbers of
documents. Only the counts of buckets are shuffled, never the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillveil.llm.common import settle
from quillveil.llm.docstats import with_counts

#: Ratio of neighbouring bucket bounds: quantiles are within about 1 %.
GAMMA = 1.02
#: Documents for which the language counts in a group's threshold, and all documents in a language's.
PRIOR = 200
#: A fence is the upper quartile plus so many times its distance from the median.
FENCE = 4.0
#: Share of the variance that a cut between two heaps explains, at least.
PARTED = 0.95

#: The part of the measures in terms of counts: numerator, denominator.
MEASURES = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "mean_word": ("word_chars", "n_words")}

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _bucket(value: Column) -> Column:
    """The sketch's bucket; zeros have one far below."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).otherwise(F.lit(-1_000_000)).cast("long")


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key, measure and bucket: (keys, measure, bucket, n)."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return rows.select(*keys, entries.alias("e")).groupBy(*keys, "e.measure", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up over the keys that are left out."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _value(bucket: Column) -> Column:
    """What a bucket stands for."""
    return F.when(bucket > -1_000_000, F.pow(F.lit(GAMMA), bucket) * F.lit(2 / (1 + GAMMA))).otherwise(F.lit(0.0))


def thresholds(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, documents, max_measure for each measure) from sketches; null where no document has any of a measure."""
    own = Window.partitionBy(*keys, "measure")
    running = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v, n = F.col("value"), F.col("n")
    ranked = sketches.withColumn("value", _value(F.col("bucket")))
    ranked = ranked.withColumns({"below": F.sum(n).over(running), "mass": F.sum(v * n).over(running), "documents": F.sum(n).over(own), "total": F.sum(v * n).over(own), "squares": F.sum(v * v * n).over(own), "zeros": F.sum(F.when(v > 0, 0).otherwise(n)).over(own)})
    # how much of the variance a cut behind each bucket explains
    above = F.col("documents") - F.col("below")
    low, high = F.col("mass") / F.col("below"), F.try_divide(F.col("total") - F.col("mass"), above)
    variance = F.col("squares") - F.col("total") * F.col("total") / F.col("documents")
    explained = F.try_divide(F.col("below") * above / F.col("documents") * (high - low) * (high - low), F.when(variance > 1e-9 * F.col("squares"), variance))
    some, nth = F.col("documents") - F.col("zeros"), F.col("below") - F.col("zeros")
    found = ranked.groupBy(*keys, "measure").agg(
        F.max("documents").alias("documents"),
        F.max(F.struct(explained.alias("share"), (-v).alias("first"), ((low + high) / 2).alias("between"))).alias("cut"),
        F.min(F.when((v > 0) & (nth * 4 >= some * 2), v)).alias("half"),
        F.min(F.when((v > 0) & (nth * 4 >= some * 3), v)).alias("upper"),
    )
    limit = F.when(F.col("cut.share") >= PARTED, F.col("cut.between")).otherwise(F.col("upper") + F.lit(FENCE) * (F.col("upper") - F.col("half")))
    return found.groupBy(*keys).agg(F.max("documents").alias("documents"), *[F.max(F.when(F.col("measure") == m, limit)).alias(f"max_{m}") for m in MEASURES])


def _shrunk(own: Column, documents: Column, wider: Column) -> Column:
    """A group's threshold, drawn towards the wider group's the more, the fewer documents it has."""
    return F.coalesce((documents * own + F.lit(PRIOR) * wider) / (documents + F.lit(PRIOR)), own, wider)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base counts and the verdicts of each row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and reasons (names of the measures above their
    thresholds). Null and empty texts have no words and fail. Null languages and
    sources are groups of their own. Repeated rows are judged each; ties at a
    threshold are kept. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = with_counts(named, "doc_id", "text", ["lang", "source"], also=("n_lines",))
    rows = rows.withColumns({m: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for m, (a, b) in MEASURES.items()})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = settle(rows.withColumn("base_failed", failed))
    # what the base rules drop does not set the thresholds
    by_source = settle(sketch(rows.filter(~F.col("base_failed")), ["lang", "source"]))
    # the sketches of groups, of languages and of all are one table, so that their thresholds take one pass
    level = lambda n, df: df.select(F.lit(n).alias("level"), F.col("lang") if n < 2 else F.lit(None).cast("string").alias("lang"), F.col("source") if n < 1 else F.lit(None).cast("string").alias("source"), "measure", "bucket", "n")
    every = level(0, by_source).unionByName(level(1, merge(by_source, ["lang"]))).unionByName(level(2, merge(by_source, [])))
    limits = settle(thresholds(every, ["level", "lang", "source"]))
    chosen = limits.filter("level = 0").drop("level")
    lang_level = limits.filter("level = 1").drop("level", "source").withColumnsRenamed({"lang": "l_lang", "documents": "l_documents"} | {f"max_{m}": f"l_{m}" for m in MEASURES})
    # a number for each measure; an empty table has none, and no groups either
    of_all = limits.filter("level = 2").first()
    wider = {m: F.lit(of_all[f"max_{m}"] if of_all else None).cast("double") for m in MEASURES}
    # one row for each group, joined with the one row for each language
    chosen = chosen.join(lang_level, F.col("lang").eqNullSafe(F.col("l_lang")))
    lang = {m: _shrunk(F.col(f"l_{m}"), F.col("l_documents"), wider[m]) for m in MEASURES}
    chosen = chosen.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[_shrunk(F.col(f"max_{m}"), F.col("documents"), lang[m]).alias(f"max_{m}") for m in MEASURES])
    chosen = settle(chosen)
    judged = rows.join(chosen, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    # values as the sketch holds them, so that equal ones are never above a threshold that they make
    above = F.array_compact(F.array(*[F.when(_value(_bucket(F.col(m))) > F.col(f"max_{m}") * (1 + 1e-9), F.lit(m)) for m in MEASURES]))
    judged = judged.withColumn("reasons", above).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))

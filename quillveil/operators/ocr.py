"""What follows a character recognition: words with ranges, spans on pixels, certainty of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_ranges(words: DataFrame) -> DataFrame:
    """Words (doc_id, word_no, text, ...) with their places in the text that blanks join."""
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("int")
    return words.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def span_boxes(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Boxes of the words that spans touch, each once: an interval join inside a document."""
    w, s = words.alias("w"), spans.alias("s")
    on = (F.col("w.doc_id") == F.col("s.doc_id")) & (F.col("w.end") > F.col("s.start")) & (F.col("w.start") < F.col("s.end"))
    return w.join(s, on, "left_semi").select("doc_id", "box").distinct()


def line_certainty(words: DataFrame, least: float = 90.0) -> DataFrame:
    """Least certainty of equal lines; words without a score leave a line unknown."""
    return words.groupBy("doc_id", "line").agg(F.min("confidence").alias("confidence"), F.bool_or(F.col("confidence").isNull()).alias("unknown")).withColumn("uncertain", F.coalesce(F.col("confidence") < least, F.lit(True)) | F.col("unknown"))

"""Documents as a stream: files that arrive are released in micro-batches, with the progress in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillveil.operators.detect import redact
from quillveil.operators.release import release


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, at timestamp", files_a_step: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_step).parquet(folder)


def release_stream(docs: DataFrame, out: str, checkpoint: str, passes: int = 3) -> StreamingQuery:
    """Writes what ``release`` gives once for each document, also when the query is started again.

    Each micro-batch is released as a table is, with all passes and the
    gate, into a folder of its own number (the column ``batch``). A batch that
    runs again replaces its folder. ``out`` must be new to this function: a
    folder that a file sink wrote is read by the sink's log.
    """

    def step(rows: DataFrame, number: int) -> None:
        release(rows, passes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.select("doc_id", "text").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finding_counts(docs: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by type and window of the documents' time; what comes later than the watermark is left out."""
    spans = redact(docs.withWatermark("at", late)).select("at", F.explode_outer("resolved").alias("s")).filter(F.col("s").isNotNull())
    return spans.groupBy(F.window("at", width).alias("w"), F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("findings"))

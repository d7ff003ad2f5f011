"""What happens to items and results around the release: admission, transitions, readiness, receipts, retention, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillveil.operators.batch import STATES

# Byte limits by format, files and bytes of a batch.
FORMAT_LIMITS = {
    "txt": 8_000_000, "md": 8_000_000, "markdown": 8_000_000, "csv": 1_500_000,
    "docx": 64 << 20, "xlsx": 64 << 20, "pptx": 64 << 20,
    "pdf": 25 << 20, "png": 25 << 20, "jpg": 25 << 20, "jpeg": 25 << 20, "bmp": 25 << 20,
}
MAX_FILES, MAX_BYTES = 200, 500 << 20
#: Attempts that end in the same code before an item stops.
MAX_RETRIES = 3
# Days that private files are kept, unless told, and at most.
KEEP_DAYS, MOST_DAYS = 7, 14
# Characters of a page of a released text.
PAGE_DEFAULT, PAGE_LEAST, PAGE_MOST = 16_000, 1_000, 30_000
# Guards of review findings, labels, occurrences and edits.
GUARDS = {"findings": 5_000, "labels": 10_000, "occurrences": 100_000, "edits": 50_000}

# The states that may follow each.
TRANSITIONS = {
    "pending": ["processing", "stopped"],
    "processing": ["delivery_pending", "mapping_pending", "deferred_review", "retryable", "stopped", "released"],
    "delivery_pending": ["mapping_pending", "released", "retryable", "stopped"],
    "mapping_pending": ["released", "retryable", "stopped"],
    "deferred_review": ["processing", "stopped"],
    "retryable": ["processing", "stopped"],
    "stopped": [],
    "released": [],
}


def admission(files: DataFrame, batch: str = "batch_id", order: str = "file_no") -> DataFrame:
    """Files (batch, order, format, bytes) with the verdict: the format, its limit, and the batch's number of files and bytes so far."""
    limits = F.create_map(*[F.lit(x) for pair in FORMAT_LIMITS.items() for x in pair])
    own = F.try_element_at(limits, F.lower("format"))
    running = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    code = F.when(own.isNull(), "FORMAT_UNSUPPORTED").when(F.col("bytes") > own, "FILE_TOO_LARGE").when(F.col("files_so_far") > MAX_FILES, "TOO_MANY_FILES").when(F.col("bytes_so_far") > MAX_BYTES, "BATCH_TOO_LARGE")
    return files.withColumn("files_so_far", F.count(F.lit(1)).over(running)).withColumn("bytes_so_far", F.sum("bytes").over(running)).withColumn("reason_code", code).withColumn("admitted", F.col("reason_code").isNull())


def transitions(journal: DataFrame, item: str, order: str) -> DataFrame:
    """Each journal entry (item, order, status, code) with the state before it, whether it may follow, and how often its code came in a row.

    An item begins as pending. The third retryable entry of one code in a row must be a stop.
    """
    own = Window.partitionBy(item).orderBy(order)
    allowed = F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(s) for s in b]).cast("array<string>"))])
    rows = journal.withColumn("previous", F.coalesce(F.lag("status").over(own), F.lit("pending")))
    failed = F.col("status").isin("retryable", "stopped")
    rows = rows.withColumn("failure", F.when(failed, F.coalesce("code", F.lit(""))))
    # entries between two failures do not end a row of equal codes; another code does
    last = F.last_value("failure", True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(failed & (F.coalesce(last, F.lit("\0")) != F.col("failure")), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(item, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("attempts", F.when(failed, F.count_if(failed).over(in_run)).otherwise(F.lit(0).cast("long")))
    valid = F.coalesce(F.array_contains(F.element_at(allowed, F.col("previous")), F.col("status")), F.lit(False)) & F.col("status").isin(STATES)
    return rows.withColumn("valid", valid & ~((F.col("status") == "retryable") & (F.col("attempts") >= MAX_RETRIES))).drop("failure", "fresh", "run")


def next_action(counts: DataFrame) -> DataFrame:
    """What is to be done with a batch, from its counts by state (``batch.status_counts``): nothing where all is completed, a review where all else is, and the batch's own work before."""
    working = F.col("pending") + F.col("processing") + F.col("delivery_pending") + F.col("mapping_pending") + F.col("retryable")
    completed = F.col("released") + F.col("stopped")
    ready = (F.col("deferred_review") > 0) & (completed + F.col("deferred_review") == F.col("total")) & (working == 0) & F.col("accounted")
    complete = (F.col("total") > 0) & (completed == F.col("total")) & F.col("accounted")
    return counts.withColumn("review_ready", ready).withColumn("next_action", F.when(complete, "none").when(ready, "review").otherwise("batch"))


def sweep(entries: DataFrame, protected: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Entries (id, scope, at) that are due: older than the days that they are kept, and not protected (id). Released output is never due."""
    kept = max(0, min(days, MOST_DAYS))
    due = entries.filter((F.col("scope") != "released") & (F.col("at") < now - F.make_dt_interval(F.lit(kept))))
    return due.join(protected.select("id"), "id", "left_anti")


def receipts(events: DataFrame) -> DataFrame:
    """Audit receipts without content: known states and codes only, numbers in their bounds, times cut to the second."""
    status = F.when(F.col("status").isin(STATES), F.col("status")).otherwise("unknown")
    code = F.when(F.regexp_like("code", F.lit("^[A-Z][A-Z0-9_]{1,63}$")), F.col("code"))
    bounded = lambda c, most: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(most)).cast("long")
    return events.select("item", status.alias("status"), code.alias("code"), bounded("findings", 1_000_000).alias("findings"), bounded("duration_ms", 86_400_000).alias("duration_ms"), F.date_trunc("second", "at").alias("at"))


def text_page(texts: DataFrame, offset: int, max_chars: int = PAGE_DEFAULT) -> DataFrame:
    """A page of each text: (doc_id, page, next_offset, total); offsets are code points, so no character is split."""
    size = max(PAGE_LEAST, min(max_chars, PAGE_MOST))
    begin, total = max(0, offset), F.length("text")
    following = F.least(F.lit(begin + size), total)
    return texts.select("doc_id", F.substring("text", begin + 1, size).alias("page"), F.when(following < total, following).alias("next_offset"), total.alias("total"))


def identity_snapshot(mappings: DataFrame) -> DataFrame:
    """The distinct (item, pseudonym, original) of mappings, with their number in each item."""
    own = Window.partitionBy("item").orderBy("pseudonym", "original")
    return mappings.select("item", "pseudonym", "original").distinct().withColumn("number", F.row_number().over(own))


def identity_status(items: DataFrame) -> DataFrame:
    """Captured against released items of each batch, and what has no mapping: (batch_id, captured, released, unmapped, complete)."""
    out = items.groupBy("batch_id").agg(F.count_if("captured").alias("captured"), F.count_if(F.col("status") == "released").alias("released"), F.coalesce(F.sum("unmapped"), F.lit(0)).cast("long").alias("unmapped"))
    return out.withColumn("complete", (F.col("captured") == F.col("released")) & (F.col("unmapped") == 0))


def result_counts(results: DataFrame) -> DataFrame:
    """Used, available and open results of each batch."""
    available = F.col("status") == "released"
    return results.groupBy("batch_id").agg(F.count_if(available & F.col("used")).alias("used"), F.count_if(available).alias("available"), F.count_if(~F.col("status").isin("released", "stopped")).alias("open"))


def throughput(documents: DataFrame, key: str) -> DataFrame:
    """Characters, milliseconds and characters a second by key."""
    out = documents.groupBy(key).agg(F.sum("chars").cast("long").alias("chars"), F.sum("ms").cast("long").alias("ms"))
    return out.withColumn("per_second", F.floor(F.col("chars") * 1000 / F.nullif(F.col("ms"), F.lit(0))).cast("long"))


def last_events(events: DataFrame, count: int = 20, most: int = 200) -> DataFrame:
    """The last events (seq) of the latest ``most``, newest first."""
    if not 1 <= count <= 50:
        raise ValueError("1 to 50 events are shown")
    return events.orderBy(F.desc("seq")).limit(min(count, most))


def completed_batches(batches: DataFrame, most: int = 50) -> DataFrame:
    """The latest ``most`` + 1 completed batches with their places, and whether there are more than ``most``: a guard, not a cut of what is there.

    Only the places that can be shown are sorted out of each partition and
    numbered, so neither a window over all batches nor a count is needed.
    """
    latest = [F.desc("completed_at"), F.col("token")]
    shown = batches.filter(F.col("completed_at").isNotNull()).orderBy(*latest).limit(most + 1)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(*latest))).withColumn("too_many", F.max("place").over(Window.partitionBy()) > most)


def guarded(counts: DataFrame) -> DataFrame:
    """Counts (any of findings, labels, occurrences, edits) with the first limit that they pass; nothing is dropped."""
    over = F.coalesce(*[F.when(F.col(c) > n, F.lit(f"TOO_MANY_{c.upper()}")) for c, n in GUARDS.items() if c in counts.columns], F.lit(None).cast("string"))
    return counts.withColumn("guard", over)


def binding(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """SHA-256 over the JSON of a key's rows in order, which an approval is bound to."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return rows.groupBy(key).agg(F.sha2(F.to_json(sorted_rows), 256).alias("binding"))

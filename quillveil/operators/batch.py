"""State, grades, ledgers and pages of batches of items, as plain aggregations, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillveil.functions.mac import cursor_place, signed_cursor

# The states of an item.
STATES = ["pending", "processing", "delivery_pending", "mapping_pending", "deferred_review", "retryable", "stopped", "released"]
OPEN = ["pending", "processing", "delivery_pending", "mapping_pending", "retryable"]
# The grades of a result.
GRADES = ["complete", "usable_with_omissions", "not_processed", "unavailable"]
#: Samples that an estimate needs, and the longest that counts, in milliseconds.
ETA_SAMPLES, ETA_LONGEST = 3, 3_600_000


def status_counts(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """Items (key, status) by state, whether all are accounted for, and the share that is done in percent."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    out = items.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *counts)
    accounted = sum((F.col(s) for s in STATES), F.lit(0))
    done = F.col("released") + F.col("stopped") + F.col("deferred_review")
    return out.withColumn("accounted", accounted == F.col("total")).withColumn("percent", F.floor(done * 100 / F.col("total")).cast("long"))


def remaining_seconds(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """Upper median of the measured durations times the open items, in whole seconds; null with too few samples."""
    measured = F.when(F.col("duration_ms").between(0, ETA_LONGEST), F.col("duration_ms"))
    upper = F.expr(f"percentile_disc(0.5) within group (order by case when duration_ms between 0 and {ETA_LONGEST} then duration_ms end desc)")
    out = items.groupBy(key).agg(F.count(measured).alias("n"), upper.alias("middle"), F.count_if(F.col("status").isin(OPEN)).alias("remaining"))
    return out.select(key, "remaining", F.when(F.col("n") >= ETA_SAMPLES, F.ceil(F.col("middle") * F.col("remaining") / 1000)).cast("long").alias("seconds"))


def document_grades(parts: DataFrame, key: str) -> DataFrame:
    """Grade of each document from its parts (key, state included / removed / review_required)."""
    count = lambda s: F.count_if(F.col("state") == s)
    out = parts.groupBy(key).agg(count("included").alias("included"), count("removed").alias("removed"), count("review_required").alias("review_required"))
    grade = F.when(F.col("review_required") > 0, "not_processed").when(F.col("removed") > 0, "usable_with_omissions").otherwise("complete")
    return out.withColumn("grade", grade)


def grade_counts(documents: DataFrame, key: str) -> DataFrame:
    """Documents by grade; one that cannot be verified makes all of its batch unavailable."""
    verified = F.coalesce(F.bool_and(F.col("verified")), F.lit(True))
    out = documents.groupBy(key).agg(F.count(F.lit(1)).alias("total"), verified.alias("grades_verified"), F.sum("removed").alias("omitted"), *[F.count_if(F.col("grade") == g).alias(g) for g in GRADES[:3]])
    held = lambda c: F.when(F.col("grades_verified"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    return out.select(key, "grades_verified", *[held(g) for g in GRADES[:3]], F.when(F.col("grades_verified"), F.lit(0).cast("long")).otherwise(F.col("total")).alias("unavailable"), F.when(F.col("grades_verified"), F.col("omitted")).alias("omissions"))


def page(items: DataFrame, key: str, order: str, eligible, cursor: int, size: int = 10) -> DataFrame:
    """The first ``size`` eligible items of each key from the cursor on, and where the next page begins."""
    if not 1 <= size <= 20:
        raise ValueError("a page has 1 to 20 items")
    own = Window.partitionBy(key).orderBy(order)
    # one more than the page holds tells where the next one begins, and lets the rest go before the sort
    numbered = items.filter(eligible & (F.col(order) >= cursor)).withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= size + 1)
    following = F.max(F.when(F.col("nth") == size + 1, F.col(order))).over(Window.partitionBy(key))
    return numbered.withColumn("next_cursor", following).filter(F.col("nth") <= size)


def signed_pages(items: DataFrame, requests: DataFrame, secret: bytes, key: str, order: str, eligible: Column, filter_name: str, size: int = 10) -> DataFrame:
    """(key, status, order, next_cursor): a page of the eligible items for each request (key, cursor).

    A null cursor asks for the first page. Cursors are signed with the key, the
    name of the filter and the size of the page; one that was changed, or was
    made for another of those, is refused with INVALID_CURSOR and gets no item.
    ``next_cursor`` points at the next eligible item and is null on the last
    page. A key without items has one row with the status and nothing else.
    """
    if not 1 <= size <= 20:
        raise ValueError("a page has 1 to 20 items")
    bound = F.concat_ws("|", F.col(key).cast("string"), F.lit(filter_name), F.lit(str(size)))
    asked = requests.select(key, "cursor").withColumn("from", cursor_place(secret, bound, F.col("cursor"))).withColumn("status", F.when(F.col("cursor").isNotNull() & F.col("from").isNull(), "INVALID_CURSOR").otherwise("ok")).drop("cursor")
    wanted = asked.filter("status = 'ok'").select(key, F.col("from").alias("_from"))
    after = items.filter(eligible).select(key, order).join(wanted, key).filter(F.col("_from").isNull() | (F.col(order) >= F.col("_from")))
    # one more than the page holds tells where the next one begins
    numbered = after.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_nth") <= size + 1)
    following = F.max(F.when(F.col("_nth") == size + 1, F.col(order))).over(Window.partitionBy(key))
    page_ = numbered.withColumn("next_cursor", signed_cursor(secret, bound, following)).filter(F.col("_nth") <= size).select(key, order, "next_cursor")
    return asked.select(key, "status").join(page_, key, "left")


def recent(runs: DataFrame, created: str, tie: str, hidden: DataFrame | None = None, count: int = 5) -> DataFrame:
    """The latest runs that are not hidden, newest first."""
    shown = runs.join(hidden, tie, "left_anti") if hidden is not None else runs
    return shown.orderBy(F.desc(created), F.desc(tie)).limit(count)


def append_ledger(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows with what happens to them: append, present (an equal row exists) or conflict (another row of the key does)."""
    columns = [c for c in new.columns if c != key]
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}"))
    joined = new.alias("n").join(existing.alias("e"), F.col(f"n.{key}") == F.col(f"e.{key}"), "left")
    action = F.when(F.col(f"e.{key}").isNull(), "append").when(same, "present").otherwise("conflict")
    return joined.select(*[F.col(f"n.{c}") for c in new.columns], action.alias("action"))


def formula_safe(value):
    """A spreadsheet cell that cannot start a formula."""
    return F.when(F.regexp_like(value, F.lit("^[\\s\\uFEFF]*['=+\\-@]")), F.concat(F.lit("'"), value)).otherwise(value)


def retention_due(entries: DataFrame, scope: str, at: str, cutoff) -> DataFrame:
    """Entries older than the cutoff by scope, and in all (scope null), in one pass."""
    return entries.rollup(scope).agg(F.count_if(F.col(at) < cutoff).alias("due"), F.count(F.lit(1)).alias("entries"))


def failure_tally(errors: DataFrame, scope: str, code: str) -> DataFrame:
    """Errors by scope with a map of codes as sorted text."""
    by_code = errors.groupBy(scope, code).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", code, F.col("n").cast("string")))), ";")
    return by_code.groupBy(scope).agg(F.sum("n").alias("errors"), pairs.alias("codes"))


def running_budget(rows: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Rows that the budget of their key admits, in order, with the sum so far."""
    so_far = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", so_far).withColumn("admitted", F.col("so_far") <= limit)


def decisions_complete(decisions: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """Every ambiguity with its decision, and what is missing on either side; undecided ones are redacted."""
    joined = ambiguities.alias("a").join(decisions.alias("d"), "ambiguity_id", "full_outer")
    state = F.when(F.col("a.kind").isNull(), "unknown").when(F.col("d.decision").isNull(), "missing").otherwise("decided")
    return joined.select("ambiguity_id", F.coalesce("d.decision", F.lit("redact")).alias("decision"), state.alias("state"))


def set_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """SHA-256 over a key's sorted distinct values, which binds a later approval to them."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ","), 256).alias("digest"))

"""The trace of a rewrite: edits with a chain of hashes, replayed and verified, and grouped into entities.

A step moves places by a map that is linear between its edits. Traces of several
steps are composed by merging the places in order with the breakpoints of one
step after the other, so no pairs of places and edits are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillveil.functions import spans as sp
from quillveil.lineage import settle

EDIT = "struct<start:int,end:int,type:string,replacement:string>"


def create(redacted: DataFrame, step: int = 1) -> DataFrame:
    """(doc_id, step, source_hash, output_hash, edits, chain) of rows with text, resolved and redacted.

    The chain binds the edits to the text before and after them; texts and
    originals are not kept.
    """
    edits = F.transform("resolved", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["replacement"].alias("replacement")))
    out = redacted.select("doc_id", F.lit(step).alias("step"), F.sha2("text", 256).alias("source_hash"), F.sha2("redacted", 256).alias("output_hash"), edits.alias("edits"))
    return out.withColumn("chain", F.sha2(F.concat_ws("|", F.col("step").cast("string"), "source_hash", "output_hash", F.to_json("edits")), 256))


def replay(texts: DataFrame, trace: DataFrame) -> DataFrame:
    """(doc_id, replayed) of the texts (doc_id, text) with the edits of a trace carried out again."""
    joined = texts.select("doc_id", "text").join(trace.select("doc_id", "edits"), "doc_id")
    return joined.select("doc_id", sp.rewrite("text", "edits").alias("replayed"))


def verify(texts: DataFrame, trace: DataFrame) -> DataFrame:
    """(doc_id, verdict): intact, or what does not fit: the chain, the source, or the output."""
    joined = texts.select("doc_id", "text").join(trace, "doc_id")
    joined = sp.hold(joined, _out=sp.rewrite("text", "edits"))
    chain = F.sha2(F.concat_ws("|", F.col("step").cast("string"), "source_hash", "output_hash", F.to_json("edits")), 256)
    verdict = F.when(F.col("chain") != chain, "CHAIN_BROKEN").when(F.sha2("text", 256) != F.col("source_hash"), "SOURCE_CHANGED").when(F.sha2("_out", 256) != F.col("output_hash"), "OUTPUT_CHANGED").otherwise("intact")
    return joined.select("doc_id", verdict.alias("verdict"))


def entity_plan(trace: DataFrame) -> DataFrame:
    """(doc_id, entity, type, replacement, start, end, out_start, out_end, occurrence) of a trace's edits.

    Places in the output are those in the source moved by what the edits before
    them put in or take away. Edits of a document with one replacement and type
    are one entity, numbered by its first place.
    """
    moved = trace.select("doc_id", "edits", sp.moved("edits").alias("moved"))
    rows = moved.select("doc_id", F.inline(F.arrays_zip(F.col("edits").alias("e"), F.col("moved").alias("m"))))
    rows = rows.select("doc_id", "e.type", "e.replacement", "e.start", "e.end", "m.out_start", "m.out_end")
    own = Window.partitionBy("doc_id", "type", "replacement")
    rows = rows.withColumn("first", F.min("start").over(own)).withColumn("occurrence", F.row_number().over(own.orderBy("start")))
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))
    return rows.withColumn("entity", F.concat(F.lit("E"), F.lpad(number.cast("string"), 6, "0"))).drop("first")


def _through(places: DataFrame, breaks: DataFrame) -> DataFrame:
    """Places (doc_id, place, side, at) on the other side of one step, whose edits (doc_id, a, b, to_a, to_b) are ranges here and there; ``cut`` tells places strictly inside an edit.

    A beginning inside an edit is moved to the edit's beginning, an end to its
    end. A beginning at a range without length is behind it, an end before it.
    """
    begin = F.col("side") == 0
    # of equal places: ends, then breakpoints, then beginnings
    mixed = places.select("doc_id", "at", F.when(begin, 2).otherwise(0).alias("kind"), "place", "side", F.lit(None).cast("struct<a:int,b:int,to_a:int,to_b:int>").alias("edit"))
    mixed = mixed.unionByName(breaks.select("doc_id", F.col("a").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("int").alias("side"), F.struct("a", "b", "to_a", "to_b").alias("edit")))
    last = F.last_value("edit", True).over(Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = mixed.withColumn("last", last).filter("kind <> 1")
    inside = (F.col("at") > F.col("last.a")) & (F.col("at") < F.col("last.b"))
    moved = F.when(F.col("last").isNull(), F.col("at")).when(inside & begin, F.col("last.to_a")).when(inside, F.col("last.to_b")).when(begin & (F.col("at") == F.col("last.a")) & (F.col("last.b") > F.col("last.a")), F.col("last.to_a")).otherwise(F.col("at") - F.col("last.b") + F.col("last.to_b"))
    return rows.select("doc_id", "place", "side", moved.alias("at"), F.coalesce(inside, F.lit(False)).alias("cut"))


def composed(trace: DataFrame) -> DataFrame:
    """(doc_id, step, type, replacement, start, end, out_start, out_end) of the edits of traces of several steps that the last text still shows.

    ``start`` and ``end`` are places in the first text, ``out_start`` and
    ``out_end`` in the last. What a later step changes again is that step's, with
    all of the first text that it came from. A document's steps are numbered
    without gaps; of repeated rows one counts. Null edits have none.
    """
    steps = trace.select("doc_id", "step", "edits").dropDuplicates(["doc_id", "step"]).filter(F.col("edits").isNotNull())
    steps = steps.select("doc_id", "step", F.explode_outer(F.arrays_zip(F.col("edits").alias("e"), sp.moved("edits").alias("m"))).alias("x")).filter(F.col("x").isNotNull())
    edits = steps.select("doc_id", "step", F.col("x.e.type").alias("type"), F.col("x.e.replacement").alias("replacement"), F.col("x.e.start").alias("start"), F.col("x.e.end").alias("end"), F.col("x.m.out_start").alias("out_start"), F.col("x.m.out_end").alias("out_end"))
    edits = settle(edits.withColumn("place", F.concat_ws("/", "step", "start", "end")))
    # one number
    count = edits.agg(F.max("step")).first()[0] or 0

    def sides(a: str, b: str) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("at")), F.struct(F.lit(1).alias("side"), F.col(b).alias("at"))))
        return edits.select("doc_id", "step", "place", both.alias("s")).select("doc_id", "step", "place", "s.side", "s.at")

    def joined(places: DataFrame, a: str, b: str) -> DataFrame:
        return places.groupBy("doc_id", "place").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias(a), F.max(F.when(F.col("side") == 1, F.col("at"))).alias(b))

    back, ahead = sides("start", "end"), sides("out_start", "out_end")
    gone = None
    for step in range(count - 1, 0, -1):
        # from what this step gave to what it was given
        breaks = edits.filter(F.col("step") == step).select("doc_id", F.col("out_start").alias("a"), F.col("out_end").alias("b"), F.col("start").alias("to_a"), F.col("end").alias("to_b"))
        later = back.filter(F.col("step") > step)
        back = settle(back.filter(F.col("step") <= step).unionByName(_through(later.drop("step"), breaks).drop("cut").join(edits.select("doc_id", "place", "step"), ["doc_id", "place"])))
    for step in range(2, count + 1):
        breaks = edits.filter(F.col("step") == step).select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"), F.col("out_start").alias("to_a"), F.col("out_end").alias("to_b"))
        earlier = ahead.filter(F.col("step") < step)
        changed = _changed(earlier, breaks)
        gone = changed if gone is None else gone.unionByName(changed)
        ahead = settle(ahead.filter(F.col("step") >= step).unionByName(_through(earlier.drop("step"), breaks).drop("cut").join(edits.select("doc_id", "place", "step"), ["doc_id", "place"])))
    shown = edits.select("doc_id", "place", "step", "type", "replacement")
    if gone is not None:
        shown = shown.join(gone.distinct(), ["doc_id", "place"], "left_anti")
    return shown.join(joined(back, "start", "end"), ["doc_id", "place"]).join(joined(ahead, "out_start", "out_end"), ["doc_id", "place"]).drop("place")


def _changed(places: DataFrame, breaks: DataFrame) -> DataFrame:
    """(doc_id, place) of the ranges that an edit overlaps: more edits begin before their end than end up to their beginning."""
    points = places.select("doc_id", "place", "side", "at", F.lit(0).alias("begins"), F.lit(0).alias("ends"))
    none = [F.lit(None).cast("string").alias("place"), F.lit(None).cast("int").alias("side")]
    points = points.unionByName(breaks.select("doc_id", *none, F.col("a").alias("at"), F.lit(1).alias("begins"), F.lit(0).alias("ends"))).unionByName(breaks.select("doc_id", *none, F.col("b").alias("at"), F.lit(0).alias("begins"), F.lit(1).alias("ends")))
    # an end counts the edits that begin before it, a beginning those that end up to it
    before = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = points.withColumn("n", F.when(F.col("side") == 1, F.coalesce(F.sum("begins").over(before), F.lit(0))).otherwise(F.sum("ends").over(up_to))).filter(F.col("place").isNotNull())
    sides = counted.groupBy("doc_id", "place").agg(F.max(F.when(F.col("side") == 1, F.col("n"))).alias("begun"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("ended"))
    return sides.filter("begun > ended").select("doc_id", "place")

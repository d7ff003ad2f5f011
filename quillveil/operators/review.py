"""Candidates that a person decides on: found in prose, tied to one place of the source, decided, and applied only to unchanged texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillveil.functions import names as nm
from quillveil.functions import spans as sp

_NAME = r"\p{Lu}[\p{L}'’-]+ \p{Lu}[\p{L}'’-]+"
# Verbs that persons are the subject of, and words that they are spoken to with.
VERBS = r"(?:hat|ist|war|wird|kann|leitet|betreut|schreibt|sagte|meldet|has|is|was|will|leads|wrote|said|reports)"
SPOKEN = r"(?:sprach mit|telefonierte mit|traf|schrieb an|spoke with|met|called|wrote to)"


def prose_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, text, kind) of names in running prose: subjects of a verb, and those that were spoken to; titles and abstract nouns are none."""
    subject = rf"(?u)(?<![\p{{L}}\p{{N}}]){_NAME}(?= {VERBS}(?![\p{{L}}]))"
    object_ = rf"(?u)(?<=(?<![\p{{L}}]){SPOKEN} ){_NAME}"
    found = sp.hold(docs.select("doc_id", "text"), _subject=sp.find("text", subject), _object=sp.find("text", object_))
    typed = lambda c, kind: F.transform(c, lambda s: s.withField("kind", F.lit(kind)))
    rows = found.select("doc_id", F.explode_outer(F.concat(typed("_subject", "subject"), typed("_object", "object"))).alias("s")).filter(F.col("s").isNotNull()).select("doc_id", "s.*")
    rows = rows.filter(nm.looks_name(F.col("text")) & ~nm.has_abstract_shape(F.col("text")) & ~nm.is_document_title(F.col("text")))
    # a name that is both counts once, as what it is first by kind
    return rows.groupBy("doc_id", "start", "end", "text").agg(F.max("kind").alias("kind"))


def ambiguities(candidates: DataFrame, prefix: str = "A") -> DataFrame:
    """Candidates with an id by their order in the document."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")).cast("string")
    return candidates.withColumn("ambiguity_id", F.concat(F.lit(prefix), F.lpad(nth, F.greatest(F.lit(6), F.length(nth)), "0")))


def source_places(residual: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(doc_id, value, start, state): a residual value's place in the source where it has exactly one, else why it has none."""
    places = occurrences.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
    joined = residual.select("doc_id", "value").distinct().join(places, ["doc_id", "value"], "left")
    state = F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return joined.select("doc_id", "value", F.when(F.col("n") == 1, F.col("start")).alias("start"), state.alias("state"))


def replayed(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """Decisions of an earlier run for the same kind at the same place of the source: (doc_id, ambiguity_id, decision), undecided ones null."""
    on = ["doc_id", "kind", "start", "end"]
    return current.join(decisions.select(*on, "decision").dropDuplicates(on), on, "left").select("doc_id", "ambiguity_id", "decision")


def bound(approvals: DataFrame, texts: DataFrame) -> DataFrame:
    """Approvals (doc_id, start, end, text_hash, range_hash, decision) with whether they still hold: the text and the range are what was approved."""
    joined = approvals.join(texts.select("doc_id", "text"), "doc_id", "left")
    piece = F.expr("substring(text, start + 1, `end` - start)")
    valid = (F.sha2("text", 256) == F.col("text_hash")) & (F.sha2(piece, 256) == F.col("range_hash"))
    return joined.select("doc_id", "start", "end", "decision", F.coalesce(valid, F.lit(False)).alias("valid"))


def applied(docs: DataFrame, decided: DataFrame, unclear: str = "[PERSON_UNKLAR]") -> DataFrame:
    """(doc_id, text) with the decided ranges (doc_id, start, end, decision) rewritten: all but those that are kept, undecided ones too."""
    organisation = F.col("decision") == "redact_organization"
    edit = F.struct("start", "end", F.when(organisation, "[ORGANISATION_REDACTED]").otherwise(unclear).alias("replacement"))
    edits = decided.filter(F.coalesce(F.col("decision") != "keep", F.lit(True))).groupBy("doc_id").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    joined = docs.join(edits, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(sp.rewrite("text", "edits"), "text").alias("text"))

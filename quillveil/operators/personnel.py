"""Profiles of persons: employers, customers and places by the section that a line is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillveil.functions.text import key
from quillveil.operators import lines

# Headings of sections, labels, and the placeholders of what stands behind them.
SECTIONS = {"projects": r"(?iu)^[#\s*]*(?:Projekte|Projekterfahrung|Projects?)[\s*:]*$", "work": r"(?iu)^[#\s*]*(?:Berufserfahrung|Werdegang|Work experience)[\s*:]*$", "other": r"(?iu)^# .*$"}
LABELS = {"ARBEITGEBER": r"(?:Arbeitgeber|Employer)", "KUNDE": r"(?:Kunde|Auftraggeber|Customer|Client)", "ORT": r"(?:Wohnort|Ort|Standort|Location)"}


def anonymise_profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text) of profiles (doc_id, text) line by line; the first rule that fits a line holds.

    Rules: a labelled employer, customer or place; in projects a heading
    ``Customer – Project`` and a line in capitals, both of a customer. Equal
    names of a kind have one number, in the order in which they come. Places
    have no number.
    """
    rows = lines.sections(lines.lines(docs), SECTIONS)
    label = lambda k: rf"(?iu)^([\s*_>-]*{LABELS[k]}[\s*_]*[:：]\s*)(\S.*?)\s*$"
    in_projects = F.col("section") == "projects"
    heading, capitals = r"(?u)^(#*\s*)(\p{Lu}[^–—|#]*?)(\s+[–—]\s+\S.*)$", r"(?u)^(\s*)(\p{Lu}[\p{Lu}&. -]{2,})\s*$"
    rule = F.coalesce(*[F.when(F.regexp_like("text", F.lit(label(k))), k) for k in LABELS], F.when(in_projects & F.regexp_like("text", F.lit(heading)), "HEADING"), F.when(in_projects & F.regexp_like("text", F.lit(capitals)), "CAPITALS"))
    rows = rows.withColumn("rule", rule)
    part = lambda i: F.coalesce(*[F.when(F.col("rule") == k, F.regexp_extract("text", label(k), i)) for k in LABELS], F.when(F.col("rule") == "HEADING", F.regexp_extract("text", heading, i)), F.when(F.col("rule") == "CAPITALS", F.regexp_extract("text", capitals, i)))
    kind = F.when(F.col("rule").isin("HEADING", "CAPITALS"), "KUNDE").otherwise(F.col("rule"))
    rows = rows.withColumns({"kind": kind, "before": part(1), "name": part(2), "behind": F.when(F.col("rule") == "HEADING", F.regexp_extract("text", heading, 3)).otherwise("")})
    first = F.min("line_no").over(Window.partitionBy("doc_id", "kind", key(F.col("name"))))
    rows = rows.withColumn("first", F.when(F.col("kind").isNotNull(), first))
    number = F.dense_rank().over(Window.partitionBy("doc_id", "kind").orderBy("first")).cast("string")
    code = F.when(F.col("kind") == "ORT", "[LOCATION_REDACTED]").otherwise(F.concat(F.lit("["), "kind", F.lit("_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), "0"), F.lit("]")))
    return rows.select("doc_id", "line_no", F.when(F.col("kind").isNull(), F.col("text")).otherwise(F.concat("before", code, "behind")).alias("text"))

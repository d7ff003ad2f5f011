"""All registered queries of the library's own operators, and the SQL that gives the same rows.

Where the tables hold no text of the kind that an operator reads, the query
builds it from relational columns, in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.functions import text as tx
from quillveil.lineage import settle, spread
from quillveil.operators import batch, detect, evaluate, identity, lines, ocr, release
from quillveil.sources import csv_source

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function as a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- detectors over the documents -------------------------------------------------------------

_TYPES = ["EMAIL", "IP", "CREDIT_CARD"]
_LUHN = "(SELECT sum(CASE WHEN i % 2 = 0 THEN d ELSE CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END END) FROM (SELECT unnest(range(length(ds))) AS i, unnest(list_transform(range(length(ds)), lambda k: CAST(substr(ds, length(ds) - k, 1) AS INTEGER))) AS d)) % 10 = 0"
# octets of an address and local parts of a mail address beside a card are no part of it: the octets lose their word bounds, the local parts go
_APART = r"regexp_replace(regexp_replace(regexp_replace(text, '[\p{L}\p{N}._%+-]*@', '@', 'g'), '(\d\.\d{1,3}\.\d{1,3}\.)(\d{1,3}[ -])', '\1_\2', 'g'), '([ -]\d{1,3})(\.\d{1,3}\.\d{1,3}\._?\d)', '\1_\2', 'g')"
# RE2 has no lookaround, but its word bounds consume nothing either
_FOUND = rf"""
cand AS (
  SELECT doc_id, lang, 'EMAIL' AS type, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}._%+-]+@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)*\.\p{{L}}{{2,}}')) AS v FROM documents
  UNION ALL
  SELECT doc_id, lang, 'IP', unnest(regexp_extract_all(text, '(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)')) FROM documents
  UNION ALL
  SELECT doc_id, lang, 'CREDIT_CARD', v FROM (
    SELECT doc_id, lang, v, regexp_replace(v, '[^0-9]', '', 'g') AS ds FROM (
      SELECT doc_id, lang, unnest(regexp_extract_all({_APART}, '\b\d(?:[ -]?\d){{12,18}}\b')) AS v FROM documents
    )
  ) WHERE {_LUHN}
)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.redact(spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), _TYPES)


@query(f"WITH {_FOUND} SELECT type, count(*) AS findings, count(DISTINCT substr(sha256(v), 1, 10)) AS distinct_values FROM cand GROUP BY type")
def finding_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(_found(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("value_hash").alias("distinct_values"))


@query(f"WITH {_FOUND} SELECT lang, type, count(*) AS findings FROM cand GROUP BY GROUPING SETS ((lang, type), (type), ())")
def finding_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detect.exploded(_found(spark, sf_dir), "resolved", "lang").select("lang", "s.type")
    return spans.groupingSets([["lang", "type"], ["type"], []], "lang", "type").agg(F.count(F.lit(1)).alias("findings"))


@query(f"WITH {_FOUND} SELECT doc_id, type, v AS text FROM cand")
def identifier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.exploded(_found(spark, sf_dir), "resolved", "doc_id").select("doc_id", "s.type", "s.text")


@query(r"""
WITH parts AS (
  SELECT doc_id, string_split_regex(text, '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}') AS gaps,
    regexp_extract_all(text, '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}') AS hits FROM documents
), rows AS (
  SELECT doc_id, hits[i] AS text, i, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS start
  FROM parts, LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)
)
SELECT doc_id, start::INTEGER AS start, (start + length(text))::INTEGER AS "end", text FROM rows""")
def email_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.redact(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), ["EMAIL"])
    return detect.exploded(found, "resolved", "doc_id").select("doc_id", "s.start", "s.end", "s.text")


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text,
  '[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}', '[EMAIL_REDACTED]', 'g'),
  '(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)', '[IP_REDACTED]', 'g')) AS redacted_sha256 FROM documents""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.redact(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), ["EMAIL", "IP"])
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"))


@query(f"WITH {_FOUND} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cand)")
def documents_without_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).filter(F.size("resolved") == 0).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE false")
def redaction_is_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a second run would change: none."""
    once = settle(detect.redact(spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "redacted"))
    again = detect.redact(once.select("doc_id", F.col("redacted").alias("text")))
    return again.filter(F.col("redacted") != F.col("text")).select("doc_id")


@query()
def released_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = release.release(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "verdict", "reason_code", F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


# --- detectors over constructed records ---------------------------------------------------------

_RECORD = [
    ("EMAIL", "Kontakt: ", "'kunde' || c_custkey || '@example.invalid'"),
    ("PHONE", "Telefon: ", "'+49 30 ' || lpad(c_custkey::VARCHAR, 8, '1')"),
    ("REFERENCE_ID", "Kundennummer: ", "'K-' || lpad(c_custkey::VARCHAR, 7, '0')"),
    ("DE_TAX_ID", "Steuer-ID: ", "lpad(c_custkey::VARCHAR, 11, '2')"),
    ("DATE_OF_BIRTH", "Geburtsdatum: ", "'1' || (c_custkey % 9) || '.0' || (1 + c_custkey % 9) || '.19' || (50 + c_custkey % 40)"),
    ("VEHICLE_PLATE", "Kennzeichen: ", "'B-AB ' || (1000 + c_custkey % 9000)"),
    ("IBAN", "Konto ", "'DE89 3704 0044 0532 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' 00'"),
    ("IP", "Adresse ", "'10.' || (c_custkey % 256) || '.7.' || (c_custkey % 100)"),
]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f"'{label}' || {value.replace('::VARCHAR', '::STRING')}" for _, label, value in _RECORD]
    return spread(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(" || '\\n' || ".join(parts)).alias("text")))


@query(" UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{t}' AS type, {v} AS text FROM customer" for t, _, v in _RECORD))
def labelled_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.redact(_records(spark, sf_dir))
    return detect.exploded(found, "resolved", "doc_id").select("doc_id", "s.type", "s.text")


@query("SELECT c_custkey AS doc_id, 'Kontakt: [EMAIL_REDACTED]\nTelefon: [PHONE_REDACTED]\nKundennummer: [ID_REDACTED]\nSteuer-ID: [ID_REDACTED]\nGeburtsdatum: [DATE_REDACTED]\nKennzeichen: [ID_REDACTED]\nKonto [BANK_DATA_REDACTED]\nAdresse [IP_REDACTED]' AS redacted FROM customer")
def redacted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.redact(_records(spark, sf_dir)).select("doc_id", "redacted")


@query("SELECT c_custkey AS doc_id, '' AS type FROM customer WHERE false")
def residual_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.residual(settle(detect.redact(_records(spark, sf_dir)).select("doc_id", "redacted"))).select("doc_id", "type")


# --- lines, windows, tables -----------------------------------------------------------------------

_LINES = """lines AS (
  SELECT doc_id, (i - 1)::INTEGER AS line_no, parts[i] AS text, (coalesce(list_sum(list_transform(parts[1:i-1], lambda p: length(p) + 1)), 0))::INTEGER AS start
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f'WITH {_LINES} SELECT doc_id, line_no, start, (start + length(text))::INTEGER AS "end" FROM lines')
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", "start", "end")


@query(f'WITH {_LINES} SELECT doc_id, line_no, start, (start + length(text))::INTEGER AS "end" FROM lines')
def line_offsets_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_offsets(_lines(spark, sf_dir).select("doc_id", "line_no", "text")).select("doc_id", "line_no", "start", "end")


@query(f"WITH {_LINES} SELECT doc_id, line_no, sha256(text) AS text_sha256, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS nth FROM lines WHERE trim(text) <> '') WHERE nth <= 40")
def first_40_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.first_lines(_lines(spark, sf_dir), 40).select("doc_id", "line_no", F.sha2("text", 256).alias("text_sha256"), "nth")


@query(f"WITH {_LINES} SELECT doc_id, line_no, length(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW), '')) AS context_chars FROM lines")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.neighbours(_lines(spark, sf_dir), 1).select("doc_id", "line_no", F.length("context").cast("long").alias("context_chars"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, md5(coalesce(last_value(CASE WHEN trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')) AS above_md5 FROM lines")
def nearest_line_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.label_line_above(_lines(spark, sf_dir)).select("doc_id", "line_no", F.md5(F.coalesce("above", F.lit(""))).alias("above_md5"))


def _heading_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.expr("n_name || '\\n' || CASE WHEN n_nationkey % 2 = 0 THEN '=====' ELSE 'no line' END || '\\nend'").alias("text"))


@query("SELECT n_nationkey AS doc_id, (0)::INTEGER AS line_no, n_nationkey % 2 = 0 AS is_heading FROM nation UNION ALL SELECT n_nationkey, 1, false FROM nation UNION ALL SELECT n_nationkey, 2, false FROM nation")
def setext_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.setext_headings(lines.lines(_heading_docs(spark, sf_dir))).select("doc_id", "line_no", "is_heading")


def _table_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").withColumn("row", F.expr("'| ' || n_name || ' | K-' || lpad(n_nationkey::STRING, 5, '0') || ' |'"))
    grouped = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    return grouped.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("Liste\n| Land | Kundennummer |\n|---|:--|\n"), "rows", F.lit("\nEnde")).alias("text"))


_CELLS = "SELECT n_regionkey AS doc_id, 'Land' AS header, n_name AS value FROM nation UNION ALL SELECT n_regionkey, 'Kundennummer', 'K-' || lpad(n_nationkey::VARCHAR, 5, '0') FROM nation"


@query(_CELLS)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cells(lines.lines(_table_docs(spark, sf_dir))).select("doc_id", "header", "value")


@query("SELECT n_regionkey AS doc_id, 'K-' || lpad(n_nationkey::VARCHAR, 5, '0') AS value FROM nation")
def identifier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.cells(lines.lines(_table_docs(spark, sf_dir)))
    return found.filter(F.regexp_like("header", F.lit(r"(?i)^Kundennummer$")) & F.regexp_like("value", F.lit(r"^[\p{L}\p{N}/-]*\d[\p{L}\p{N}/-]*$"))).select("doc_id", "value")


@query("""
WITH i AS (SELECT l_orderkey, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e FROM lineitem),
f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS island FROM f)
SELECT l_orderkey, min(s) AS s, max(e) AS e, count(*) AS parts FROM g GROUP BY l_orderkey, island""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
    return lines.merge_intervals(rows, "l_orderkey", "s", "e")


# --- text functions ----------------------------------------------------------------------------------

_PROFILE_SQL = {p: " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in ws) for p, ws in tx.PROFILE_WORDS.items()}
_PROFILE_CASE = "CASE WHEN personnel_profile >= 3 THEN 'personnel_profile' WHEN greatest(applicant, contract, customer) < 2 THEN 'general' WHEN applicant = greatest(applicant, contract, customer) THEN 'applicant' WHEN contract = greatest(applicant, contract, customer) THEN 'contract' ELSE 'customer' END"
_PROFILE_TEXT = "CASE c_custkey % 5 WHEN 0 THEN 'Bewerbung und Lebenslauf ' WHEN 1 THEN 'Vertrag mit Haftung ' WHEN 2 THEN 'Kunde: Rechnung ' WHEN 3 THEN 'Projekterfahrung, Rolle: x | Company | Certifications ' ELSE '' END || c_name || ' ' || c_mktsegment"


@query(f"WITH d AS (SELECT c_custkey AS doc_id, {_PROFILE_TEXT} AS text FROM customer), s AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _PROFILE_SQL.items())} FROM d) SELECT doc_id, {_PROFILE_CASE} AS profile FROM s")
def profile_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_PROFILE_TEXT).alias("text"))
    return rows.select("doc_id", tx.profile_of(F.col("text")).alias("profile"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS normal_sha256 FROM documents")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize_text(F.col("text")), 256).alias("normal_sha256"))


@query()
def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", tx.visible_text(F.col("html")).alias("text"))


@query("SELECT doc_id, CASE WHEN n_chars * 1000 <= 1048576 THEN 'tiny' WHEN n_chars * 1000 <= 10485760 THEN 'small' WHEN n_chars * 1000 <= 52428800 THEN 'medium' ELSE 'large' END AS size_class FROM documents")
def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.size_class(F.col("n_chars") * 1000).alias("size_class"))


# --- sources --------------------------------------------------------------------------------------------


@query("""
SELECT r_regionkey AS file_no, '| Land | Nummer | Land (2) |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' | a\\|b |', chr(10) ORDER BY n_nationkey) AS markdown, NULL::VARCHAR AS reason_code
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 0 GROUP BY 1
UNION ALL SELECT 0, NULL, 'CSV_DELIMITER_AMBIGUOUS'""")
def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat("n_name", F.lit(";"), F.col("n_nationkey").cast("string"), F.lit(';"a|b"')).alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.when(F.col("n_regionkey") == 0, F.lit("rot,blau;gelb")).otherwise(F.concat(F.lit("Land;Nummer;Land\n"), "lines"))
    files = rows.select(F.col("n_regionkey").alias("file_no"), text.cast("binary").alias("content"))
    return csv_source.csv_documents(files, keep=("file_no",))


@query("""
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS word_no, l_partkey, l_shipmode_, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem))
SELECT doc_id, CASE WHEN l_shipmode_ = 'N' THEN 'line n' ELSE 'line' END AS line, min(CASE WHEN l_partkey % 11 > 0 THEN (l_partkey % 100)::DOUBLE END) AS confidence, bool_or(l_partkey % 11 = 0) AS unknown,
  coalesce(min(CASE WHEN l_partkey % 11 > 0 THEN (l_partkey % 100)::DOUBLE END) < 90, true) OR bool_or(l_partkey % 11 = 0) AS uncertain FROM w GROUP BY 1, 2""")
def line_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "N", "line n").otherwise("line").alias("line"), F.when(F.col("l_partkey") % 11 > 0, (F.col("l_partkey") % 100).cast("double")).alias("confidence"))
    return ocr.line_certainty(words)


# --- identities ----------------------------------------------------------------------------------------

_KIND = "CASE WHEN c_custkey % 2 = 0 THEN 'person' ELSE 'unternehmen' END"


@query(f"""
WITH m AS (SELECT {_KIND} AS kind, c_name AS name, min(o_orderkey) AS first_seen FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
n AS (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY first_seen, name)::INTEGER AS number FROM m)
SELECT kind, name, number, '[' || upper(kind) || '_' || lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INTEGER, '0') || ']' AS pseudonym FROM n""")
def pseudonym_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    mentions = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.expr(_KIND).alias("kind"), F.col("c_name").alias("name"), "o_orderkey")
    return identity.readable_pseudonyms(identity.first_seen_numbers(mentions, "kind", "name", "o_orderkey"), "kind")


@query()
def keyed_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.collision_free(_table(spark, sf_dir, "customer"), "c_name", "seed of the batch", "PERSON")


@query("SELECT split_part(p_name, ' ', -1) AS alias, CASE WHEN count(DISTINCT p_partkey::VARCHAR) = 1 THEN min(p_partkey::VARCHAR) ELSE '[PERSON_UNKLAR]' END AS pseudonym, count(DISTINCT p_partkey::VARCHAR) AS identities FROM part WHERE length(split_part(p_name, ' ', -1)) >= 3 GROUP BY 1")
def alias_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").withColumn("code", F.col("p_partkey").cast("string"))
    return identity.alias_table(parts, "p_name", F.split_part("p_name", F.lit(" "), F.lit(-1)), "code", "PERSON")


@query("""
WITH g AS (SELECT l_orderkey AS doc_id, 'S' || (l_suppkey % 7) AS replacement, count(DISTINCT l_suppkey) AS identities, array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR)), '|') AS originals, count(*) AS occurrences FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, count(*) FILTER (identities <> 1) OVER (PARTITION BY doc_id) AS ambiguous FROM g)
SELECT doc_id, replacement, originals, occurrences, ambiguous FROM a WHERE identities = 1""")
def confidential_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("S"), F.col("l_suppkey") % 7).alias("replacement"), "l_suppkey", F.col("l_partkey").cast("string").alias("original"))
    return identity.overview(rows, "doc_id", "replacement", "l_suppkey", "original")


@query("""
WITH a AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS source_start, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS nth, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS output_start, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS nth, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'A')
SELECT l_suppkey, a.nth::INTEGER AS nth, source_start, output_start FROM a JOIN b USING (l_suppkey, nth) WHERE a.n = b.n""")
def aligned_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_returnflag")
    return identity.aligned(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), ["l_suppkey"], "at").select("l_suppkey", "nth", "source_start", "output_start")


@query("""
WITH p AS (SELECT user_id, event_id AS at FROM events WHERE event_type = 'purchase'), o AS (SELECT user_id, event_id AS at FROM events WHERE event_type <> 'purchase')
SELECT p.user_id, p.at, arg_min(o.at, abs(p.at - o.at) * 2 + CASE WHEN o.at > p.at THEN 1 ELSE 0 END) AS nearest FROM p LEFT JOIN o USING (user_id) GROUP BY 1, 2""")
def nearest_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return identity.nearest(events.filter("event_type = 'purchase'"), events.filter("event_type <> 'purchase'"), "user_id", "event_id")


@query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tokens FROM documents),
g AS (SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] AS gram FROM t, LATERAL (SELECT unnest(range(1, len(tokens))) AS i)),
a(alias) AS (VALUES ('apache license'), ('mit license'), ('all rights'), ('the mit license'))
SELECT doc_id, alias, count(*) AS occurrences FROM (
  SELECT doc_id, alias FROM g JOIN a ON gram = alias
  UNION ALL SELECT doc_id, 'the mit license' FROM (SELECT doc_id, tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2] AS gram FROM t, LATERAL (SELECT unnest(range(1, len(tokens) - 1)) AS i)) WHERE gram = 'the mit license'
) GROUP BY 1, 2""")
def known_alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("apache license",), ("mit license",), ("all rights",), ("the mit license",)], "alias string")
    return identity.known_aliases(_table(spark, sf_dir, "documents").select("doc_id", "text"), aliases)


# --- batches ---------------------------------------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'retryable' END ELSE 'stopped' END"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("batch_id"), F.col("o_orderkey").alias("item_no"), F.expr(_STATUS).alias("status"), F.floor("o_totalprice").cast("long").alias("duration_ms"))


_ITEMS = f"items AS (SELECT o_custkey % 50 AS batch_id, o_orderkey AS item_no, {_STATUS} AS status, floor(o_totalprice)::BIGINT AS duration_ms FROM orders)"


@query(f"WITH {_ITEMS} SELECT batch_id, count(*) AS total, {', '.join(f'count(*) FILTER (status = {s!r}) AS {s}' for s in batch.STATES)}, true AS accounted, floor(count(*) FILTER (status IN ('released', 'stopped', 'deferred_review')) * 100.0 / count(*))::BIGINT AS percent FROM items GROUP BY batch_id")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.status_counts(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS}, d AS (SELECT batch_id, list_sort(list(duration_ms) FILTER (duration_ms BETWEEN 0 AND 3600000)) AS d, count(*) FILTER (status IN ('pending', 'retryable')) AS remaining FROM items GROUP BY batch_id)
SELECT batch_id, remaining, CASE WHEN len(d) >= 3 THEN ceil(d[len(d) // 2 + 1] * remaining / 1000.0)::BIGINT END AS seconds FROM d""")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.remaining_seconds(_items(spark, sf_dir))


_PARTS = "CASE l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN CASE WHEN l_quantity > 48 THEN 'review_required' ELSE 'included' END ELSE 'included' END"
_GRADED = f"""parts AS (SELECT l_orderkey, {_PARTS} AS state FROM lineitem),
graded AS (SELECT l_orderkey, count(*) FILTER (state = 'included') AS included, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'review_required') AS review_required FROM parts GROUP BY 1),
named AS (SELECT *, CASE WHEN review_required > 0 THEN 'not_processed' WHEN removed > 0 THEN 'usable_with_omissions' ELSE 'complete' END AS grade FROM graded)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.document_grades(_table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_PARTS).alias("state")), "l_orderkey")


@query(f"WITH {_GRADED} SELECT l_orderkey, included, removed, review_required, grade FROM named")
def result_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir)


@query(f"""WITH {_GRADED}, b AS (SELECT o_custkey AS batch_id, grade, removed, o_orderpriority <> '1-URGENT' AS verified FROM named JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT batch_id, bool_and(verified) AS ok, count(*) AS total, sum(removed)::BIGINT AS omitted, count(*) FILTER (grade = 'complete') AS c, count(*) FILTER (grade = 'usable_with_omissions') AS u, count(*) FILTER (grade = 'not_processed') AS n FROM b GROUP BY 1)
SELECT batch_id, ok AS grades_verified, CASE WHEN ok THEN c ELSE 0 END AS complete, CASE WHEN ok THEN u ELSE 0 END AS usable_with_omissions, CASE WHEN ok THEN n ELSE 0 END AS not_processed, CASE WHEN ok THEN 0 ELSE total END AS unavailable, CASE WHEN ok THEN omitted END AS omissions FROM g""")
def grade_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("batch_id"), (F.col("o_orderpriority") != "1-URGENT").alias("verified"))
    return batch.grade_counts(_graded(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "batch_id")


@query(f"""WITH {_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY item_no) AS nth, lead(item_no, 10) OVER (PARTITION BY batch_id ORDER BY item_no) AS nx FROM items WHERE status = 'released' AND item_no >= 100)
SELECT batch_id, item_no, first_value(nx) OVER (PARTITION BY batch_id ORDER BY item_no) AS next_cursor FROM n WHERE nth <= 10""")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.page(_items(spark, sf_dir), "batch_id", "item_no", F.col("status") == "released", 100).select("batch_id", "item_no", "next_cursor")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = _table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return batch.recent(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", hidden)


@query("""
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE o_orderstatus END AS result FROM orders WHERE o_orderkey % 2 = 0)
SELECT o.o_orderkey, o.o_orderstatus AS result, CASE WHEN e.o_orderkey IS NULL THEN 'append' WHEN e.result = o.o_orderstatus THEN 'present' ELSE 'conflict' END AS action FROM orders o LEFT JOIN e USING (o_orderkey)""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("result"))
    existing = new.filter("o_orderkey % 2 = 0").withColumn("result", F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.col("result")))
    return batch.append_ledger(new, existing, "o_orderkey")


@query("SELECT event_type, count(*) FILTER (ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS due, count(*) AS entries FROM events GROUP BY ROLLUP (event_type)")
def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_type", "ts")
    latest = events.agg(F.max("ts").alias("latest"))
    return batch.retention_due(events.crossJoin(F.broadcast(latest)), "event_type", "ts", F.col("latest") - F.expr("INTERVAL 7 DAYS"))


@query("WITH c AS (SELECT o_orderpriority AS scope, o_orderstatus AS code, count(*) AS n FROM orders GROUP BY 1, 2) SELECT scope, sum(n)::BIGINT AS errors, array_to_string(list_sort(list(code || '=' || n)), ';') AS codes FROM c GROUP BY 1")
def failure_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.failure_tally(_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("code")), "scope", "code")


@query("SELECT doc_id, source, sum(n_chars) OVER w AS so_far, sum(n_chars) OVER w <= 20000 AS admitted FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def admission_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.running_budget(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 20000).drop("n_chars")


@query("""
WITH a AS (SELECT o_orderkey AS id, 'person' AS kind FROM orders WHERE o_orderkey % 3 > 0), d AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'keep' ELSE 'redact' END AS decision FROM orders WHERE o_orderkey % 5 > 0)
SELECT id AS ambiguity_id, coalesce(decision, 'redact') AS decision, CASE WHEN kind IS NULL THEN 'unknown' WHEN decision IS NULL THEN 'missing' ELSE 'decided' END AS state FROM a FULL JOIN d USING (id)""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    asked = orders.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("ambiguity_id"), F.lit("person").alias("kind"))
    decided = orders.filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("ambiguity_id"), F.when(F.col("o_orderstatus") == "F", "keep").otherwise("redact").alias("decision"))
    return batch.decisions_complete(decided, asked)


@query("SELECT l_orderkey, sha256(array_to_string(list_sort(list(DISTINCT l_suppkey::VARCHAR)), ',')) AS digest FROM lineitem GROUP BY 1")
def set_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.set_digest(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '''=' || p_name WHEN p_partkey % 4 = 1 THEN ''' +' || p_name ELSE p_name END AS cell FROM part")
def formula_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE WHEN p_partkey % 4 = 0 THEN '=' || p_name WHEN p_partkey % 4 = 1 THEN ' +' || p_name ELSE p_name END")
    return _table(spark, sf_dir, "part").select("p_partkey", batch.formula_safe(raw).alias("cell"))


# --- evaluation ---------------------------------------------------------------------------------------------



def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("start"), F.col("l_returnflag").alias("type"), (1 + F.col("l_suppkey") % 3).alias("severity"), "l_partkey")
    return rows.filter("l_partkey % 10 > 0").drop("l_partkey"), rows.filter("l_partkey % 7 > 0").select("sample", "start", "type")


@query("""
WITH e AS (SELECT l_orderkey AS sample, l_linenumber AS start, l_returnflag AS type, 1 + l_suppkey % 3 AS severity FROM lineitem WHERE l_partkey % 10 > 0),
p AS (SELECT DISTINCT l_orderkey AS sample, l_linenumber AS start, l_returnflag AS type, 1 AS p FROM lineitem WHERE l_partkey % 7 > 0),
j AS (SELECT sample, start, type, severity, p FROM e FULL JOIN p USING (sample, start, type)),
g AS (SELECT type, count(*) FILTER (severity IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (p IS NULL) AS fn, count(*) FILTER (severity IS NULL) AS fp, coalesce(sum(severity) FILTER (p IS NULL), 0)::BIGINT AS weighted_fn FROM j GROUP BY GROUPING SETS ((type), ()))
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 1), 6) AS "precision", round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 1), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 1), 6) AS f1 FROM g""")
def detector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, predicted = _expected(spark, sf_dir)
    return evaluate.detector_metrics(expected, predicted, ["sample", "start"])


@query("""
WITH o AS (SELECT l_orderkey, l_suppkey, l_returnflag AS category, bool_and(l_discount < 0.09) AS kept FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT category, count(*) AS controls, count(*) FILTER (NOT kept) AS lost FROM o GROUP BY GROUPING SETS ((category), ()))
SELECT *, round((controls - lost)::DOUBLE / controls, 6) AS rate FROM g""")
def preservation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("control"), F.col("l_returnflag").alias("category"), (F.col("l_discount") < 0.09).alias("kept"))
    return evaluate.preservation(rows, "category")


@query("SELECT p_brand, sum(levenshtein(p_name, p_type))::BIGINT AS errors, sum(length(p_name))::BIGINT AS chars, round(sum(levenshtein(p_name, p_type))::DOUBLE / sum(length(p_name)), 6) AS cer FROM part GROUP BY 1")
def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.edit_summary(_table(spark, sf_dir, "part"), "p_brand", "p_name", "p_type")


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def phase_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.phase_durations(_table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")

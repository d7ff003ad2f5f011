"""Registered queries of entity discovery, traces and the life of items, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.catalog import _table, query
from quillveil.functions import markdown as md
from quillveil.functions import names as nm
from quillveil.functions import spans as sp
from quillveil.functions import text as tx
from quillveil.lineage import settle, shared_folder, spread
from quillveil.operators import alignment, batch, detect, encoded, entities, evaluate, identity, lifecycle, lines, ocr, personnel, release, residual, review, trace
from quillveil.sources import csv_source, office
from quillveil.streaming import registry

_FIRST = ["Anna", "Bert", "Carla", "David", "Elif", "Farid", "Greta"]
_LAST = ["Berger", "Cordes", "Dahlmann", "Ehlers", "Funke"]
_FIRM = ["Nordwind Technik", "Blaue Werkstatt", "Gold und Sohn"]


def _pick(values: list[str], k: str, spark: bool) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _sql_docs(text: str) -> str:
    """Documents made of customers: k is the key, f, l and o are names."""
    return f"SELECT k AS doc_id, {text} AS text, f, l, o, k FROM (SELECT c_custkey AS k, {_pick(_FIRST, 'c_custkey', False)} AS f, {_pick(_LAST, 'c_custkey', False)} AS l, {_pick(_FIRM, 'c_custkey', False)} AS o FROM customer)"


_LETTER = "'Ansprechpartner: ' || l || ', ' || f || chr(10) || 'Sehr geehrte Frau Dr. ' || l || ',' || chr(10) || 'die ' || o || ' GmbH dankt Herrn ' || f || ' ' || l || '.' || chr(10) || '| Name | Ort |' || chr(10) || '|---|---|' || chr(10) || '| Wilma Quast | Ulm |'"


def _docs(spark: SparkSession, sf_dir: str, text: str = _LETTER) -> DataFrame:
    names = {"f": _pick(_FIRST, "c_custkey", True), "l": _pick(_LAST, "c_custkey", True), "o": _pick(_FIRM, "c_custkey", True)}
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *[F.expr(v).alias(c) for c, v in names.items()])
    return spread(rows.select(F.col("k").alias("doc_id"), F.expr(text).alias("text")))


@query(f"WITH d AS ({_sql_docs(_LETTER)}) SELECT doc_id, f || ' ' || l AS name, 0 AS rank, 0 AS line_no FROM d UNION ALL SELECT doc_id, l, 1, 1 FROM d UNION ALL SELECT doc_id, 'Wilma Quast', 2, 5 FROM d")
def person_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.person_seeds(_docs(spark, sf_dir))


@query(f"WITH d AS ({_sql_docs(_LETTER)}) SELECT doc_id, o || ' GmbH' AS name FROM d")
def organisations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.organisations(_docs(spark, sf_dir))


_PERSON_VARIANTS = "SELECT doc_id, f || ' ' || l AS value, '[PERSON_001]' AS replacement FROM d UNION ALL SELECT doc_id, l || ', ' || f, '[PERSON_001]' FROM d UNION ALL SELECT doc_id, f || '-' || l, '[PERSON_001]' FROM d UNION ALL SELECT doc_id, l, '[PERSON_001]' FROM d UNION ALL SELECT doc_id, v, '[PERSON_002]' FROM d, (SELECT unnest(['Wilma Quast', 'Quast, Wilma', 'Wilma-Quast', 'Quast']) AS v)"


@query(f"WITH d AS ({_sql_docs(_LETTER)}) SELECT doc_id, lower(value) AS key, value, replacement FROM ({_PERSON_VARIANTS})")
def person_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.person_dictionary(entities.person_seeds(_docs(spark, sf_dir)))


_TWO_FIRMS = "'Alpha Bau GmbH und ' || o || ' AG' || chr(10) || 'Alpha Bau KG'"


@query(f"WITH d AS ({_sql_docs(_TWO_FIRMS)}), n AS (SELECT doc_id, unnest(['Alpha Bau GmbH', 'Alpha Bau KG', o || ' AG']) AS name FROM d), r AS (SELECT *, '[UNTERNEHMEN_' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY name)::VARCHAR, 3, '0') || ']' AS replacement FROM n) SELECT doc_id, lower(name) AS key, name AS value, replacement FROM r UNION ALL SELECT doc_id, 'alpha bau', 'Alpha Bau', '[ORGANISATION_UNKLAR]' FROM d UNION ALL SELECT doc_id, lower(regexp_replace(name, ' AG$', '')), regexp_replace(name, ' AG$', ''), replacement FROM r WHERE name LIKE '% AG'")
def organisation_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.organisation_dictionary(entities.organisations(_docs(spark, sf_dir, _TWO_FIRMS)))


@query(f"WITH d AS ({_sql_docs(_LETTER)}) SELECT doc_id, 'Ansprechpartner: [PERSON_001]' || chr(10) || 'Sehr geehrte Frau Dr. [PERSON_001],' || chr(10) || 'die [UNTERNEHMEN_001] dankt [PERSON_001].' || chr(10) || '| Name | Ort |' || chr(10) || '|---|---|' || chr(10) || '| [PERSON_002] | Ulm |' AS redacted FROM d")
def anonymised_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.anonymise(_docs(spark, sf_dir)).select("doc_id", "redacted")


@query(f"WITH d AS ({_sql_docs(_LETTER)}) SELECT doc_id, 'PERSON' AS type, length('Ansprechpartner: ') AS start, l || ', ' || f AS text FROM d UNION ALL SELECT doc_id, 'PERSON', length('Ansprechpartner: ' || l || ', ' || f || '.Sehr geehrte Frau Dr. '), l FROM d UNION ALL SELECT doc_id, 'PERSON', strpos(text, ' dankt Herrn ') - 1 + length(' dankt Herrn '), f || ' ' || l FROM d UNION ALL SELECT doc_id, 'PERSON', strpos(text, 'Wilma') - 1, 'Wilma Quast' FROM d")
def person_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = entities.literal_spans(docs, entities.person_dictionary(entities.person_seeds(docs)), "PERSON")
    return detect.exploded(found, "literals", "doc_id").select("doc_id", "s.type", "s.start", "s.text")


@query(f"WITH d AS ({_sql_docs(_LETTER)}) SELECT doc_id, 'Wilma Quast' AS name, 2 AS rank, 5 AS line_no FROM d")
def late_person_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    first = docs.withColumn("text", F.substring_index("text", "\n| Name", 1))
    return entities.late_seeds(entities.person_seeds(docs), entities.person_seeds(first))


_NAMES = "CASE p_partkey % 8 WHEN 0 THEN 'Anna Berger' WHEN 1 THEN 'Team Berger' WHEN 2 THEN 'anna berger' WHEN 3 THEN 'Anna von der Berger' WHEN 4 THEN 'Berger' WHEN 5 THEN 'Dr. Berger' WHEN 6 THEN 'A B C D E' ELSE '' END"


@query("SELECT p_partkey, p_partkey % 8 IN (0, 3) AS name, p_partkey % 8 = 4 AS surname, p_partkey % 8 IN (1, 5) AS stop FROM part")
def name_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMES).alias("n"))
    return rows.select("p_partkey", nm.looks_name(F.col("n")).alias("name"), nm.looks_surname(F.col("n")).alias("surname"), nm.is_stop_token(F.split("n", " ")[0]).alias("stop"))


# --- traces ------------------------------------------------------------------------------------------

_MAIL = "'Mail kunde' || c_custkey || '@example.invalid, IP 10.0.0.' || (c_custkey % 200) || ', Mail kunde' || c_custkey || '@example.invalid.'"
_OUT = "'Mail [EMAIL_REDACTED], IP [IP_REDACTED], Mail [EMAIL_REDACTED].'"


def _traced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_MAIL).alias("text")))
    return docs, settle(trace.create(detect.redact(docs, ["EMAIL", "IP"])))


@query(f"SELECT c_custkey AS doc_id, 1 AS step, sha256({_MAIL}) AS source_hash, sha256({_OUT}) AS output_hash, 3 AS edits FROM customer")
def transform_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir)[1].select("doc_id", "step", "source_hash", "output_hash", F.size("edits").alias("edits"))


@query(f"SELECT c_custkey AS doc_id, {_OUT} AS replayed FROM customer")
def replayed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.replay(*_traced(spark, sf_dir))


@query("SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 1 THEN 'SOURCE_CHANGED' WHEN 2 THEN 'CHAIN_BROKEN' ELSE 'intact' END AS verdict FROM customer")
def verified_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = _traced(spark, sf_dir)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    made = made.withColumn("edits", F.when(F.col("doc_id") % 4 == 2, F.slice("edits", 1, 2)).otherwise(F.col("edits")))
    return trace.verify(docs, made)


_LEN = "length('kunde' || c_custkey || '@example.invalid')"
_IPLEN = "length('10.0.0.' || (c_custkey % 200))"


@query(f"""SELECT c_custkey AS doc_id, 'E000001' AS entity, 'EMAIL' AS type, 5 AS start, 5 + {_LEN} AS "end", 5 AS out_start, 21 AS out_end, 1 AS occurrence FROM customer
UNION ALL SELECT c_custkey, 'E000002', 'IP', 5 + {_LEN} + 5, 10 + {_LEN} + {_IPLEN}, 26, 39, 1 FROM customer
UNION ALL SELECT c_custkey, 'E000001', 'EMAIL', 10 + {_LEN} + {_IPLEN} + 7, 17 + 2 * {_LEN} + {_IPLEN}, 46, 62, 2 FROM customer""")
def entity_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.entity_plan(_traced(spark, sf_dir)[1]).select("doc_id", "entity", "type", "start", "end", "out_start", "out_end", "occurrence")


# --- items ---------------------------------------------------------------------------------------------

_FORMAT = "CASE o_orderkey % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'DOCX' WHEN 2 THEN 'exe' ELSE 'csv' END"


@query(f"""WITH f AS (SELECT o_custkey AS batch_id, o_orderkey AS file_no, {_FORMAT} AS format, floor(o_totalprice * 100)::BIGINT AS bytes FROM orders),
r AS (SELECT *, count(*) OVER w AS files_so_far, (sum(bytes) OVER w)::BIGINT AS bytes_so_far FROM f WINDOW w AS (PARTITION BY batch_id ORDER BY file_no ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN format = 'exe' THEN 'FORMAT_UNSUPPORTED' WHEN bytes > CASE format WHEN 'DOCX' THEN 67108864 WHEN 'txt' THEN 8000000 WHEN 'csv' THEN 1500000 END THEN 'FILE_TOO_LARGE' WHEN files_so_far > 200 THEN 'TOO_MANY_FILES' WHEN bytes_so_far > 524288000 THEN 'BATCH_TOO_LARGE' END AS reason_code,
  NOT (format = 'exe' OR bytes > CASE format WHEN 'DOCX' THEN 67108864 WHEN 'txt' THEN 8000000 WHEN 'csv' THEN 1500000 END OR files_so_far > 200 OR bytes_so_far > 524288000) AS admitted FROM r""")
def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("file_no"), F.expr(_FORMAT).alias("format"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("bytes"))
    return lifecycle.admission(files)


_ITEM = "SELECT o_custkey % 50 AS batch_id, o_orderkey AS item_no, CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'deferred_review' ELSE 'released' END ELSE CASE WHEN o_custkey % 2 = 0 THEN 'stopped' ELSE 'retryable' END END AS status FROM orders"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _ITEM.partition("SELECT ")[2].rpartition(" FROM orders")[0]
    return _table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in (own.split(",", 2))])


@query(f"WITH i AS ({_ITEM}), c AS (SELECT batch_id, count(*) FILTER (status = 'retryable') AS retry, count(*) FILTER (status = 'deferred_review') AS review FROM i GROUP BY 1) SELECT batch_id, retry = 0 AND review > 0 AS review_ready, CASE WHEN retry > 0 THEN 'batch' WHEN review > 0 THEN 'review' ELSE 'none' END AS next_action FROM c")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.next_action(batch.status_counts(_items(spark, sf_dir))).select("batch_id", "review_ready", "next_action")


@query("""WITH j AS (SELECT l_orderkey AS item, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT item, n, CASE i % 2 WHEN 1 THEN 'processing' ELSE 'retryable' END AS status, CASE i WHEN 1 THEN 'pending' ELSE CASE i % 2 WHEN 1 THEN 'retryable' ELSE 'processing' END END AS previous, CASE i % 2 WHEN 0 THEN i // 2 ELSE 0 END AS attempts, NOT (i % 2 = 0 AND i >= 6) AS valid FROM j""")
def item_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("item").orderBy("n")))
    rows = rows.select("item", "n", F.when(F.col("i") % 2 == 1, "processing").otherwise("retryable").alias("status"), F.when(F.col("i") % 2 == 0, "TIMEOUT").alias("code"))
    return lifecycle.transitions(rows, "item", "n").drop("code")


@query("SELECT event_id AS id, event_type AS scope FROM events WHERE event_type <> 'purchase' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND event_id % 5 <> 0")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "released").otherwise(F.col("event_type")).alias("scope"), F.col("ts").cast("timestamp").alias("at"))
    return lifecycle.sweep(events, events.filter("id % 5 = 0"), F.lit("2024-01-20").cast("timestamp")).select("id", "scope")


@query("SELECT o_orderkey AS item, CASE WHEN o_orderstatus = 'F' THEN 'released' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'RESIDUAL_PII' END AS code, greatest(o_custkey - 100, 0) AS findings, least(floor(o_totalprice * 1000)::BIGINT, 86400000) AS duration_ms FROM orders")
def audit_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", "released").otherwise("text of the user").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "RESIDUAL_PII").otherwise("a name in prose").alias("code"), (F.col("o_custkey") - 100).alias("findings"), F.floor(F.col("o_totalprice") * 1000).cast("long").alias("duration_ms"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return lifecycle.receipts(rows).drop("at")


@query("SELECT doc_id, sha256(substr(text, 501, 1000)) AS page_sha256, CASE WHEN length(text) > 1500 THEN 1500 END AS next_offset, length(text) AS total FROM documents")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = lifecycle.text_page(_table(spark, sf_dir, "documents").select("doc_id", "text"), 500, 10)
    return pages.select("doc_id", F.sha2("page", 256).alias("page_sha256"), "next_offset", "total")


@query("SELECT item, pseudonym, original, row_number() OVER (PARTITION BY item ORDER BY pseudonym, original)::INTEGER AS number FROM (SELECT DISTINCT l_orderkey AS item, 'P' || (l_suppkey % 9) AS pseudonym, l_suppkey::VARCHAR AS original FROM lineitem)")
def identity_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("P"), F.col("l_suppkey") % 9).alias("pseudonym"), F.col("l_suppkey").cast("string").alias("original"))
    return lifecycle.identity_snapshot(rows)


@query("WITH i AS (SELECT o_custkey % 50 AS batch_id, o_orderkey % 4 > 0 AS captured, o_orderstatus = 'F' AS released, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS unmapped FROM orders), g AS (SELECT batch_id, count(*) FILTER (captured) AS captured, count(*) FILTER (released) AS released, sum(unmapped)::BIGINT AS unmapped FROM i GROUP BY 1) SELECT *, captured = released AND unmapped = 0 AS complete FROM g")
def identity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("batch_id"), (F.col("o_orderkey") % 4 > 0).alias("captured"), F.when(F.col("o_orderstatus") == "F", "released").otherwise("stopped").alias("status"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("unmapped"))
    return lifecycle.identity_status(rows)


@query(f"WITH i AS ({_ITEM}) SELECT batch_id, count(*) FILTER (status = 'released' AND item_no % 2 = 0) AS used, count(*) FILTER (status = 'released') AS available, count(*) FILTER (status NOT IN ('released', 'stopped')) AS open FROM i GROUP BY 1")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.result_counts(_items(spark, sf_dir).withColumn("used", F.col("item_no") % 2 == 0))


@query("SELECT lang, sum(n_chars)::BIGINT AS chars, sum(1 + doc_id % 50)::BIGINT AS ms, floor(sum(n_chars) * 1000 / sum(1 + doc_id % 50))::BIGINT AS per_second FROM documents GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.throughput(_table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("chars"), (1 + F.col("doc_id") % 50).alias("ms")), "lang")


@query("SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.last_events(_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type"))


@query("WITH b AS (SELECT n_nationkey AS token, n_regionkey AS completed_at FROM nation WHERE n_regionkey > 0) SELECT token, completed_at, row_number() OVER (ORDER BY completed_at DESC, token)::INTEGER AS place, (SELECT count(*) FROM b) > 50 AS too_many FROM b")
def completed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.completed_batches(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("token"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("completed_at")))


@query("SELECT o_orderkey, o_custkey * 10 AS findings, o_orderkey AS labels, CASE WHEN o_custkey * 10 > 5000 THEN 'TOO_MANY_FINDINGS' WHEN o_orderkey > 10000 THEN 'TOO_MANY_LABELS' END AS guard FROM orders")
def count_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.guarded(_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 10).alias("findings"), F.col("o_orderkey").alias("labels")))


@query("""SELECT l_orderkey, sha256('[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']') AS binding FROM lineitem GROUP BY 1""")
def json_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.binding(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


#: Lines by the remainder of their key: text, the person in it, and the rank of the rule that finds it.
_BY_RULE = [
    ("upper(f) || ' ' || upper(l)", "f || ' ' || l", 3),
    ("f || ' von ' || l", "f || ' von ' || l", 4),
    ("'ein Gruß mit ' || f || ' ' || l", "f || ' ' || l", 5),
    ("'siehe [' || f || ' ' || l || '](tel:0' || k || ')'", "f || ' ' || l", 6),
    ("'| Name | ' || f || ' ' || l || ' |'", "f || ' ' || l", 7),
    ("'c/o ' || f || ' ' || l", "f || ' ' || l", 8),
    ("f || ' ' || l || ' betreut das'", "f || ' ' || l", 9),
    ("'der Kunde ' || f || ' ' || l || ' kam'", "f || ' ' || l", 10),
    ("'heute war ' || f || ' ' || l || ', geboren 1970, da'", "f || ' ' || l", 10),
    ("'Bewerbung und Lebenslauf' || chr(10) || 'streng geheim' || chr(9) || f || ' ' || l", "f || ' ' || l", 4),
    ("'Lebenslauf, Bewerbung' || chr(10) || '王小紅'", "'王小紅'", 4),
]
_RULE_TEXT, _RULE_NAME, _RULE_RANK = (f"CASE k % {len(_BY_RULE)} " + " ".join(f"WHEN {i} THEN {row[c]}" for i, row in enumerate(_BY_RULE)) + " END" for c in range(3))


@query(f"WITH d AS ({_sql_docs(_RULE_TEXT)}) SELECT doc_id, {_RULE_NAME} AS name, {_RULE_RANK} AS rank FROM d")
def seeds_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person a text, each found by another rule."""
    return entities.person_seeds(_docs(spark, sf_dir, _RULE_TEXT)).select("doc_id", "name", "rank")


#: Clauses that name parties, and the organisations in them.
_BY_CLAUSE = [
    ("'Vertrag zwischen der Alten Mühle, vertreten durch Dr. ' || l || ', und der ' || o || ' GmbH (nachfolgend Kunde). Die Neue Mühle liefert.'", "['Alten Mühle', o || ' GmbH']"),
    ("'Vertragsparteien sind die Weiße Taube, Birkenstr. 7, sowie die ' || o || ' GmbH & Co. KG'", "['Weiße Taube', o || ' GmbH & Co. KG']"),
    ("'Agreement between the River House and the ' || o || ' Inc. The Old Barn is none'", "['River House', o || ' Inc.']"),
    ("'| Vertragspartner |' || chr(10) || '|---|' || chr(10) || '| Haus ' || k || ' |'", "['Haus ' || k]"),
    ("'| Lieferant | x |' || chr(10) || '| Supplier | Hof ' || l || ' |'", "['Hof ' || l]"),
    ("'Employeur: Maison ' || l || ' SARL'", "['Maison ' || l || ' SARL']"),
    ("'Employeur: Maison ' || l", "[]"),
]
_CLAUSE_TEXT, _CLAUSE_NAMES = (f"CASE k % {len(_BY_CLAUSE)} " + " ".join(f"WHEN {i} THEN {row[c]}" for i, row in enumerate(_BY_CLAUSE)) + " END" for c in range(2))


@query(f"WITH d AS ({_sql_docs(_CLAUSE_TEXT)}) SELECT doc_id, unnest({_CLAUSE_NAMES}) AS name FROM d")
def organisations_in_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.organisations(_docs(spark, sf_dir, _CLAUSE_TEXT))


# --- literals, references, encodings ---------------------------------------------------------------------

#: Texts by the remainder of their key, and the IBAN, telephone number or address in them: type, what is written before it, and how it is written.
_CODED = [("IBAN", "Konto ", "'&#68;E1250010517064890' || lpad((k % 10000)::VARCHAR, 4, '0')"), ("EMAIL", "Mail `", "'a' || k || '&amp;#64;b&period;example'"), ("PHONE", "Tel: ", "'\\+49 30 1234' || (1000 + k % 1000)"), ("EMAIL", "Post an ", "'a' || k || '%40b.example'")]
_CODED_TEXT = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{before}' || {written} || CASE WHEN k % 4 = 1 THEN '`' ELSE '' END" for i, (_, before, written) in enumerate(_CODED)) + " END"
_SPARK_CODED = _CODED_TEXT.replace("::VARCHAR", "").replace("(k % 10000)", "string(k % 10000)").replace("'\\+49", "'\\\\+49")


@query(f"""WITH d AS ({_sql_docs(_CODED_TEXT)}) SELECT doc_id, CASE k % 4 {' '.join(f"WHEN {i} THEN '{kind}'" for i, (kind, _, _) in enumerate(_CODED))} END AS type, CASE k % 4 {' '.join(f"WHEN {i} THEN {len(before)}" for i, (_, before, _) in enumerate(_CODED))} END AS start, length(text) - CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS "end" FROM d""")
def encoded_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the source of identifiers that are only seen when it is decoded."""
    found = encoded.source_spans(_docs(spark, sf_dir, _SPARK_CODED))
    return detect.exploded(found, "encoded", "doc_id").select("doc_id", "s.type", "s.start", "s.end")


_MARKED_UP = "'**Haus** <b>' || l || '</b> &amp;lt;i&gt; `a*b*` _x_ <!-- ' || k || ' -->&auml;<br>q' || chr(10) || '~~~' || chr(10) || '**' || f || '** &amp;' || chr(10) || '~~~~'"


@query(f"WITH d AS ({_sql_docs(_MARKED_UP)}) SELECT doc_id, 'Haus ' || l || ' &lt;i> a\\*b\\* x ä q' || chr(10) || '~~~' || chr(10) || '**' || f || '** &amp;' || chr(10) || '~~~~' AS text FROM d")
def rendered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.rendered(_docs(spark, sf_dir, _MARKED_UP))


_FENCED = "'a `' || f || '` \\\\`n ``' || l || ' ` x`` \\\\*' || chr(10) || '````' || chr(10) || '```' || chr(10) || k || chr(10) || '````' || chr(10) || '` offen' || chr(10) || chr(10) || '`zu`'"


@query(f"WITH d AS ({_sql_docs(_FENCED.replace(chr(92) * 2, chr(92)))}), p AS (SELECT *, length(f) AS a, length(l) AS b, length(k::VARCHAR) AS c FROM d) SELECT doc_id, unnest([{{'start': 2, 'end': 4 + a, 'kind': 'code'}}, {{'start': 5 + a, 'end': 7 + a, 'kind': 'escape'}}, {{'start': 9 + a, 'end': 17 + a + b, 'kind': 'code'}}, {{'start': 18 + a + b, 'end': 20 + a + b, 'kind': 'escape'}}, {{'start': 21 + a + b, 'end': 36 + a + b + c, 'kind': 'fence'}}, {{'start': 45 + a + b + c, 'end': 49 + a + b + c, 'kind': 'code'}}], recursive := true) FROM p")
def markdown_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir, _FENCED).select("doc_id", F.explode(md.literals(F.col("text"))).alias("p"))
    return found.select("doc_id", "p.start", "p.end", "p.kind")


_SHORT = "'Name: ' || f || ' ' || l || ', Tel ' || k"
_NAMED = "length(f || ' ' || l)"


@query(f"""WITH d AS ({_sql_docs(_SHORT)}), n AS (SELECT *, {_NAMED} AS n, length(k::VARCHAR) AS t FROM d) SELECT doc_id, 3 AS step, 'PERSON' AS type, '[PERSON_001]' AS replacement, 6 AS start, 6 + n AS "end", 8 AS out_start, 20 AS out_end FROM n UNION ALL SELECT doc_id, 1, 'PHONE', '[T]', 12 + n, 12 + n + t, 26, 29 FROM n UNION ALL SELECT doc_id, 2, 'MARK', '> ', 0, 0, 0, 2 FROM n""")
def composed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps: a name and a number go, a mark is put in front, and the name's placeholder is changed again."""
    names = {"f": _pick(_FIRST, "c_custkey", True), "l": _pick(_LAST, "c_custkey", True)}
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *[F.expr(v).alias(c) for c, v in names.items()]).withColumn("n", F.expr(_NAMED))
    edit = lambda a, b, kind, put: f"struct(int({a}) as start, int({b}) as `end`, '{kind}' as type, '{put}' as replacement)"
    steps = [[edit(6, "6 + n", "PERSON", "[P]"), edit("12 + n", "12 + n + length(string(k))", "PHONE", "[T]")], [edit(0, 0, "MARK", "> ")], [edit(8, 11, "PERSON", "[PERSON_001]")]]
    each = ", ".join(f"struct({i} as step, array({', '.join(s)}) as edits)" for i, s in enumerate(steps, 1))
    return trace.composed(rows.select(F.col("k").alias("doc_id"), F.expr(f"inline(array({each}))")))


@query("SELECT o_orderpriority AS batch, o_orderstatus AS kind, o_custkey::VARCHAR AS name, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY min(o_orderdate), o_custkey::VARCHAR) AS number FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority, o_orderstatus, o_custkey")
def registry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers numbered by priority and status of their orders, which come as a stream."""
    schema = _table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/order[s].parquet")  # a pattern, as a stream takes no single file
    mentions = orders.select(F.col("o_orderpriority").alias("batch"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderdate").alias("at"), F.lit("seen").alias("action"))
    name, folder = "spark.sql.streaming.stateStore.providerClass", f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(name)
    spark.conf.set(name, registry.PROVIDER)
    try:
        numbers = registry.register(mentions, keep_seconds=100 * 366 * 86_400)
        numbers.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(numbers.schema).parquet(f"{folder}/out").select("batch", "kind", "name", "number")


_SECRET, _PAGE = b"a secret of the catalog", 3
_PADS = [bytes(x ^ pad for x in _SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]
_CURSOR = f"to_base64(encode(next || '.' || substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(r.batch_id || '|released|{_PAGE}' || chr(10) || next)))), 1, 32)))"


@query(f"""WITH i AS ({_ITEM}), e AS (SELECT batch_id, item_no, row_number() OVER (PARTITION BY batch_id ORDER BY item_no) AS nth FROM i WHERE status = 'released'),
b AS (SELECT batch_id, max(CASE WHEN nth = {_PAGE + 1} THEN item_no END) AS begins, max(CASE WHEN nth = {2 * _PAGE + 1} THEN item_no END) AS next FROM e GROUP BY 1),
r AS (SELECT *, CASE WHEN batch_id % 3 = 0 AND begins IS NOT NULL THEN 'INVALID_CURSOR' ELSE 'ok' END AS status FROM b)
SELECT r.batch_id, r.status, e.item_no, CASE WHEN e.item_no IS NOT NULL AND next IS NOT NULL THEN {_CURSOR} END AS next_cursor
FROM r LEFT JOIN e ON e.batch_id = r.batch_id AND r.status = 'ok' AND e.nth BETWEEN CASE WHEN begins IS NULL THEN 1 ELSE {_PAGE + 1} END AND CASE WHEN begins IS NULL THEN {_PAGE} ELSE {2 * _PAGE} END""")
def signed_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each batch by the first one's cursor, which a third of the batches have tampered with."""
    items, released = _items(spark, sf_dir), F.col("status") == "released"
    first = items.filter(released).select("batch_id").distinct().withColumn("cursor", F.lit(None).cast("string"))
    page = lambda requests: batch.signed_pages(items, requests, _SECRET, "batch_id", "item_no", released, "released", _PAGE)
    cursors = page(first).groupBy("batch_id").agg(F.max("next_cursor").alias("cursor"))
    return page(cursors.withColumn("cursor", F.when(F.col("batch_id") % 3 == 0, F.concat(F.lit("A"), F.expr("substring(cursor, 2)"))).otherwise(F.col("cursor"))))


_REFERENCE_TEXT, _OUTPUT_TEXT = "'Herr ' || f || ' ' || l || ' wohnt in Ulm und arbeitet'", "'Herr [PERSON_001] wohnt in ' || CASE k % 2 WHEN 0 THEN 'Ulm' ELSE 'Bonn' END || ', arbeitet'"


@query(f"WITH d AS ({_sql_docs(_REFERENCE_TEXT)}) SELECT k % 3 AS split, CASE k % 2 WHEN 0 THEN 'final' ELSE 'automatic' END AS stage, count(*) AS documents, (5 - any_value(k % 2)) * count(*) AS words_equal, (1 + any_value(k % 2)) * count(*) AS words_replaced, 2 * count(*) AS words_deleted, 0 AS words_inserted, (3 + any_value(k % 2)) / 8 AS wer, sum(levenshtein(text, {_OUTPUT_TEXT})) AS char_errors FROM d GROUP BY ALL")
def alignment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of words and errors of characters by split and stage."""
    names = {"f": _pick(_FIRST, "c_custkey", True), "l": _pick(_LAST, "c_custkey", True)}
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), *[F.expr(v).alias(c) for c, v in names.items()])
    pairs = rows.selectExpr("k % 3 as split", "case k % 2 when 0 then 'final' else 'automatic' end as stage", f"{_REFERENCE_TEXT} as reference", f"{_OUTPUT_TEXT} as output")
    out = alignment.quality_summary(spread(pairs), ["split", "stage"])
    errors = F.col("chars_replaced") + F.col("chars_deleted") + F.col("chars_inserted")
    return out.select("split", "stage", "documents", *[f"words_{k}" for k in ("equal", "replaced", "deleted", "inserted")], "wer", errors.alias("char_errors"))


# --- the gate ------------------------------------------------------------------------------------------

_LEAKS = "CASE k % 6 WHEN 0 THEN 'Karte 4111.1111.1111.1111 hier' WHEN 1 THEN 'Benutzername: wilma' || k WHEN 2 THEN '| Kunde | Pass |' || chr(10) || '| | wort |' || chr(10) || '|---|---|' || chr(10) || '| x | geheim' || k || ' |' WHEN 3 THEN '| Ansprache | Stand |' || chr(10) || '|---|---|' || chr(10) || '| Wilma Quast | 3 |' WHEN 4 THEN 'Durchwahl: 12-345-' || (1000 + k) ELSE 'nichts als Prosa' END"
_LEAK_ROWS = "SELECT doc_id, CASE k % 6 WHEN 0 THEN 'CREDIT_CARD' WHEN 3 THEN 'PERSON' WHEN 4 THEN 'PHONE' ELSE 'CREDENTIAL' END AS type, CASE k % 6 WHEN 0 THEN '4111.1111.1111.1111' WHEN 3 THEN 'Wilma Quast' WHEN 4 THEN '12-345-' || (1000 + k) ELSE '' END AS text, CASE k % 6 WHEN 0 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS start FROM d WHERE k % 6 < 5"


@query(f"WITH d AS ({_sql_docs(_LEAKS)}) {_LEAK_ROWS}")
def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.scan(_docs(spark, sf_dir, _LEAKS))


@query(f"WITH d AS ({_sql_docs(_LEAKS)}), r AS ({_LEAK_ROWS}) SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'released' ELSE 'stopped' END AS verdict, CASE WHEN r.doc_id IS NULL THEN '' ELSE r.type END AS classes FROM d LEFT JOIN r USING (doc_id)")
def gated_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.gated(_docs(spark, sf_dir, _LEAKS), passes=1).select("doc_id", "verdict", "classes")


# --- the way out -----------------------------------------------------------------------------------------

#: Letters by the remainder of their key: text, and what becomes of it in how many passes.
_OUT = [
    ("'Ansprechpartner: ' || f || ' ' || l || chr(10) || 'Herr ' || l || ' ruft an.'", "'Ansprechpartner: [PERSON_001]' || chr(10) || '[PERSON_001] ruft an.'", 1),
    ("'| Name | Telefon |' || chr(10) || '|---|---|' || chr(10) || '| ' || f || ' ' || l || ' | +49 30 1234' || (1000 + k % 1000) || ' |'", "'| Name | Telefon |' || chr(10) || '|---|---|' || chr(10) || '| [PERSON_001] | [PHONE_REDACTED] |'", 1),
    ("'Name: ' || f || chr(160) || l || chr(13) || chr(10) || upper(f) || ' ' || l || ' war da.'", "'Name: [PERSON_001]' || chr(10) || '[PERSON_001] war da.'", 1),
    ("'Die ' || o || ' GmbH dankt.' || chr(10) || 'Passwort: g' || k", "'Die [UNTERNEHMEN_001] dankt.' || chr(10) || 'Passwort: [CREDENTIAL_REDACTED]'", 1),
    ("'Kontakt: [' || f || ' ' || l || '](mailto:a' || k || '@example.invalid)'", "'Kontakt: [PERSON_001]([CONTACT_REDACTED])'", 1),
    ("'z. Hd. Herrn ' || f || ' ' || l || chr(10) || 'Mit freundlichen Grüßen' || chr(10) || 'Wilma Quast'", "'z. Hd. [PERSON_001]' || chr(10) || 'Mit freundlichen Grüßen' || chr(10) || '[PERSON_002]'", 1),
    ("'Name: ' || f || ' ' || l || chr(10) || f || ' ' || l || ' Wilma Quast'", "'Name: [PERSON_001]' || chr(10) || '[PERSON_001] [PERSON_002]'", 2),
    ("'Benutzername: wilma' || k", "NULL", 3),
    ("'Knoten ::ffff:10.1.' || (k % 200) || '.7 und \"w q\"@example.invalid'", "'Knoten [IP_REDACTED] und [EMAIL_REDACTED]'", 1),
    ("CASE WHEN k < 0 THEN '' END", "NULL", 1),
]
_OUT_TEXT, _OUT_WANT, _OUT_PASSES = (f"CASE k % {len(_OUT)} " + " ".join(f"WHEN {i} THEN {row[c]}" for i, row in enumerate(_OUT)) + " END" for c in range(3))


@query(f"WITH d AS ({_sql_docs(_OUT_TEXT)}) SELECT CASE WHEN k % 7 > 0 THEN doc_id END AS doc_id, {_OUT_WANT} AS redacted, CASE WHEN k % 10 IN (7, 9) THEN 'stopped' ELSE 'released' END AS verdict, CASE k % 10 WHEN 7 THEN 'RESIDUAL_PII' WHEN 9 THEN 'NO_TEXT' END AS reason_code, CASE k % 10 WHEN 7 THEN 'CREDENTIAL' ELSE '' END AS classes, {_OUT_PASSES} AS passes FROM d")
def released_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of ten forms, one in seven without an id."""
    docs = _docs(spark, sf_dir, _OUT_TEXT).withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")))
    return release.release(docs).drop("edits")


_READ = "CASE k % 3 WHEN 0 THEN 'Gruß von ' || upper(l) WHEN 1 THEN 'Mail a' || k || '@example.invalid' ELSE 'leer' END"


@query(f"WITH d AS ({_sql_docs(_READ)}) SELECT doc_id, CASE k % 3 WHEN 0 THEN 'LITERAL_LEFT' WHEN 1 THEN 'STRUCTURED_LEFT' ELSE 'clean' END AS verdict, CASE k % 3 WHEN 0 THEN 1 ELSE 0 END AS literals FROM d")
def recognised_texts_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, _READ)
    literals = _docs(spark, sf_dir, "l").withColumnRenamed("text", "value")
    return residual.verify(docs, literals)


@query(f"""SELECT c_custkey AS doc_id, 'EMAIL' AS type, 5 AS start, 5 + {_LEN} AS "end" FROM customer UNION ALL SELECT c_custkey, 'IP', 10 + {_LEN}, 10 + {_LEN} + {_IPLEN} FROM customer UNION ALL SELECT c_custkey, 'EMAIL', 17 + {_LEN} + {_IPLEN}, 17 + 2 * {_LEN} + {_IPLEN} FROM customer""")
def span_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_MAIL).alias("text"))
    return residual.locators(docs, ["EMAIL", "IP"])


_MARKED = "'[PERSON_001] und [EMAIL_REDACTED] und [PERSON_001]' || CASE WHEN k % 2 = 0 THEN ' [IP_REDACTED]' ELSE '' END"


@query(f"WITH d AS ({_sql_docs(_MARKED)}) SELECT doc_id, '[PERSON_001]' AS marker FROM d UNION ALL SELECT doc_id, '[IP_REDACTED]' FROM d WHERE k % 2 = 0")
def surviving_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, _MARKED)
    return residual.surviving_markers(docs, docs.withColumn("text", F.replace("text", F.lit("[EMAIL_REDACTED]"), F.lit("x"))))


@query(f"WITH d AS ({_sql_docs(_MARKED)}) SELECT 'PERSON' AS kind, count(*) AS entities, 2 * count(*) AS places FROM d UNION ALL SELECT 'EMAIL', count(*), count(*) FROM d UNION ALL SELECT 'IP', count(*) FILTER (k % 2 = 0), count(*) FILTER (k % 2 = 0) FROM d")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.entity_counts(_docs(spark, sf_dir, _MARKED))


@query("SELECT key, min(name) AS name FROM (SELECT l_orderkey AS key, l_returnflag AS name FROM lineitem) GROUP BY 1 HAVING count(DISTINCT name) = 1")
def person_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.person_anchors(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("name")))


_SPAN_ROWS = 'SELECT l_orderkey AS sample, l_partkey % 40 AS start, l_partkey % 40 + l_linenumber AS "end" FROM lineitem'


@query(f'WITH s AS (SELECT DISTINCT * FROM ({_SPAN_ROWS})) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS b WHERE b.sample = s.sample AND b.start <= s.start AND b."end" >= s."end" AND (b.start < s.start OR b."end" > s."end"))')
def nested_predictions_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 40
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"))
    return evaluate.drop_nested(rows.distinct(), ["sample"])


# --- further detectors over constructed records ----------------------------------------------------------

_MORE = [
    ("CREDENTIAL", "Passwort: ", "'geheim' || c_custkey"),
    ("CONTACT_URI", "Link ", "'mailto:kunde' || c_custkey"),
    ("BIC", "BIC: ", "'COBADEFF' || lpad((c_custkey % 1000)::VARCHAR, 3, '0')"),
    ("DE_SOCIAL_SECURITY", "Versichert ", "'65 170839 J 00 ' || (c_custkey % 10)"),
    ("PHONE", "Fax: ", "'01 44 55 66 ' || (10 + c_custkey % 90)"),
    ("IPV6", "Netz ", "'2001:db8::' || (1 + c_custkey % 90)"),
    ("STREET_ADDRESS", "Anschrift ", "'Lindenallee ' || (1 + c_custkey % 90)"),
    ("STREET_ADDRESS", "Adresse ", "(1 + c_custkey % 90) || ' rue de Metz'"),
    ("POSTAL_ADDRESS", "Ort ", "(10000 + c_custkey % 90000) || ' Neustadt'"),
    ("EMAIL", "Post ", "'kunde' || c_custkey || '&#64;example.invalid'"),
    ("EMAIL", "Brief ", "'kunde' || c_custkey || '%40example.invalid'"),
]


@query(" UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{t}' AS type, {v} AS text FROM customer" for t, _, v in _MORE))
def further_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f"'{label}' || {value.replace('::VARCHAR', '::STRING')}" for _, label, value in _MORE]
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(" || '\\n' || ".join(parts)).alias("text"))
    return detect.exploded(detect.redact(spread(docs)), "resolved", "doc_id").select("doc_id", "s.type", "s.text")


@query("SELECT c_custkey AS doc_id, 'seite' || c_custkey || '.example.com/a' AS text FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'https://x.invalid/' || c_custkey FROM customer")
def bare_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE WHEN c_custkey % 2 = 0 THEN 'seite' || c_custkey || '.example.com/a' ELSE 'github.com/x' END || ' und https://x.invalid/' || c_custkey"
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(text).alias("text"))
    return detect.exploded(detect.redact(docs, ["URL"], urls=True), "resolved", "doc_id").select("doc_id", "s.text")


# --- reviews and profiles ----------------------------------------------------------------------------------

_PROSE = "f || ' ' || l || ' hat geschrieben. Sie traf Wilma Quast und ' || f || ' ' || l || ' nicht.'"
_WILMA = "length(f || ' ' || l || ' hat geschrieben. Sie traf ')"


@query(f"""WITH d AS ({_sql_docs(_PROSE)}) SELECT doc_id, 0 AS start, length(f || ' ' || l) AS "end", f || ' ' || l AS text, 'subject' AS kind, 'A000001' AS ambiguity_id FROM d
UNION ALL SELECT doc_id, {_WILMA}, {_WILMA} + 11, 'Wilma Quast', 'object', 'A000002' FROM d""")
def prose_ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ambiguities(review.prose_candidates(_docs(spark, sf_dir, _PROSE)))


@query(f"WITH d AS ({_sql_docs(_PROSE)}) SELECT doc_id, CASE k % 3 WHEN 0 THEN text WHEN 1 THEN '[PERSON_UNKLAR]' || substr(text, length(f || ' ' || l) + 1) ELSE '[ORGANISATION_REDACTED]' || substr(text, length(f || ' ' || l) + 1) END AS text FROM d")
def reviewed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, _PROSE)
    first = review.prose_candidates(docs).filter("kind = 'subject'")
    decision = F.when(F.col("doc_id") % 3 == 0, "keep").when(F.col("doc_id") % 3 == 2, "redact_organization")
    return review.applied(docs, first.withColumn("decision", decision))


@query(f"""WITH d AS ({_sql_docs(_PROSE)}) SELECT doc_id, 0 AS start, 4 AS "end", 'keep' AS decision, k % 4 < 2 AS valid FROM d""")
def review_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, _PROSE)
    approvals = docs.select("doc_id", F.lit(0).alias("start"), F.lit(4).alias("end"), F.sha2("text", 256).alias("text_hash"), F.sha2(F.when(F.col("doc_id") % 4 == 2, "Etwa").otherwise(F.substring("text", 1, 4)), 256).alias("range_hash"), F.lit("keep").alias("decision"))
    return review.bound(approvals, docs.withColumn("text", F.when(F.col("doc_id") % 4 == 3, "anders").otherwise(F.col("text"))))


@query("WITH o AS (SELECT l_orderkey AS doc_id, l_returnflag AS value, l_linenumber AS start FROM lineitem), r AS (SELECT o_orderkey AS doc_id, 'R' AS value FROM orders) SELECT r.doc_id, r.value, CASE WHEN count(o.start) = 1 THEN min(o.start) END AS start, CASE WHEN count(o.start) = 1 THEN 'unique' WHEN count(o.start) > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM r LEFT JOIN o USING (doc_id, value) GROUP BY 1, 2")
def source_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrences = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("start"))
    return review.source_places(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("R").alias("value")), occurrences)


@query("SELECT o_custkey AS doc_id, o_orderkey AS ambiguity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'keep' END AS decision FROM orders")
def replayed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ambiguity_id"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 5).alias("end"))
    return review.replayed(rows.filter("ambiguity_id % 2 = 0").withColumn("decision", F.lit("keep")), rows)


_PROFILE = "'# Werdegang' || chr(10) || 'Arbeitgeber: ' || o || chr(10) || 'Wohnort: Ulm' || chr(10) || '# Projekte' || chr(10) || 'NORDBANK' || chr(10) || '## ' || o || ' – Umbau' || chr(10) || 'Kunde: Nordbank' || chr(10) || 'Python'"


@query(f"WITH d AS ({_sql_docs(_PROFILE)}) SELECT doc_id, (i - 1)::INTEGER AS line_no, (['# Werdegang', 'Arbeitgeber: [ARBEITGEBER_001]', 'Wohnort: [LOCATION_REDACTED]', '# Projekte', '[KUNDE_001]', '## [KUNDE_002] – Umbau', 'Kunde: [KUNDE_001]', 'Python'])[i] AS text FROM d, (SELECT unnest(range(1, 9)) AS i)")
def anonymised_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personnel.anonymise_profiles(_docs(spark, sf_dir, _PROFILE))


@query("WITH m AS (SELECT 'person' AS kind, c_name AS name, min(o_orderkey) AS seen, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2, 4), r AS (SELECT kind, name, c_custkey AS number FROM m WHERE c_custkey <= 50), n AS (SELECT kind, name, (row_number() OVER (ORDER BY seen, name) + (SELECT max(number) FROM r))::INTEGER AS number FROM m WHERE c_custkey > 50) SELECT kind, name, number::INTEGER AS number FROM r UNION ALL SELECT * FROM n")
def registry_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    mentions = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("kind", F.lit("person"))
    known = mentions.filter("c_custkey <= 50").select("kind", "name", F.col("c_custkey").cast("int").alias("number")).distinct()
    return identity.extend_registry(known, mentions, "kind", "name", "o_orderkey")


_PARTED = "'Steuer-' || chr(10) || 'ID: ' || k || chr(10) || 'Kunden' || chr(10) || 'nummer: K' || k || chr(10) || 'Datum'"


@query(f"WITH d AS ({_sql_docs(_PARTED)}) SELECT doc_id, 'Steuer-ID: ' || k || chr(10) || 'Kundennummer: K' || k || chr(10) || 'Datum' AS text FROM d")
def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _PARTED).select("doc_id", tx.join_labels(F.col("text")).alias("text"))


_MADE_UP = "'| Spalte 1 | Spalte 2 |' || chr(10) || '| --- | --- |' || chr(10) || CASE WHEN k % 2 = 0 THEN '| Ort | Passwort |' ELSE '| Ort | Farbe |' END || chr(10) || '| Ulm | x' || k || ' |'"


@query(f"WITH d AS ({_sql_docs(_MADE_UP)}) SELECT doc_id, CASE WHEN k % 2 = 0 THEN '| Ort | Passwort |' || chr(10) || '| --- | --- |' || chr(10) || '| Ulm | x' || k || ' |' ELSE text END AS text FROM d")
def promoted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _MADE_UP).select("doc_id", tx.promote_headers(F.col("text")).alias("text"))


_NOTICE = " || chr(10) || ".join(["'<!--'", "'Profil: ' || profile", "'Quelle: DOCX'", "'Unterstützte Restprüfung: keine weiteren Treffer'", "'Datenschutz-Pässe: 2'", "'Ersetzte/erfasste Identifikatoren: ' || k", "'Automatisch freigegebene visuelle Assets: 0'", "'Auf ausdrücklichen Wunsch entfernte visuelle Assets: 0'", "'Lokale visuelle Review-Items: 0'", "'Re-Identifikationsrisiko: ' || CASE profile WHEN 'personnel_profile' THEN 'high' ELSE 'context_dependent' END", "'Hinweis: De-Identifizierung garantiert keine rechtliche Anonymität.'", f"'EU AI Act: ' || CASE profile WHEN 'applicant' THEN '{tx.AI_NOTES['applicant']}' WHEN 'personnel_profile' THEN '{tx.AI_NOTES['personnel_profile']}' ELSE '{tx.AI_NOTE}' END", "'-->'", "''"])


@query(f"WITH d AS (SELECT c_custkey AS k, c_name, CASE c_custkey % 3 WHEN 0 THEN 'applicant' WHEN 1 THEN 'contract' ELSE 'personnel_profile' END AS profile FROM customer) SELECT k AS doc_id, {_NOTICE} || chr(10) || c_name AS text FROM d")
def noticed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").withColumn("profile", F.element_at(F.array(F.lit("applicant"), F.lit("contract"), F.lit("personnel_profile")), (F.col("c_custkey") % 3).cast("int") + 1))
    return rows.select(F.col("c_custkey").alias("doc_id"), tx.with_notice(F.col("c_name"), F.col("profile"), F.lit("docx"), passes=F.lit(2), edits=F.col("c_custkey")).alias("text"))


_CODE = "'Ein `wert' || k || '` und' || chr(10) || '```' || chr(10) || 'block ' || k || chr(10) || '```' || chr(10) || 'Ende Gut Alles ' || l"


@query(f"WITH d AS ({_sql_docs(_CODE)}) SELECT doc_id, 4 AS start, '`wert' || k || '`' AS text FROM d UNION ALL SELECT doc_id, strpos(text, '```') - 1, '```' || chr(10) || 'block ' || k || chr(10) || '```' FROM d")
def markdown_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.hold(_docs(spark, sf_dir, _CODE), s=sp.find("text", tx.MARKDOWN_LITERAL))
    return rows.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.start", "s.text")


@query(f"WITH d AS ({_sql_docs(_CODE)}) SELECT doc_id, 'Ende Gut Alles ' || l AS text FROM d")
def capitalised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.hold(_docs(spark, sf_dir, _CODE), s=sp.find("text", tx.CAPITALISED_RUN))
    return rows.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.text")


# --- files -------------------------------------------------------------------------------------------------


@query("SELECT 'f' || c_custkey || '.txt' AS path, CASE WHEN c_custkey % 4 < 2 THEN c_name || chr(10) || 'Å' END AS text, CASE c_custkey % 4 WHEN 2 THEN 'TEXT_CONTROL_INVALID' WHEN 3 THEN 'TEXT_ENCODING_INVALID' END AS reason_code FROM customer")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.encode("c_name", "UTF-8")
    body = F.concat(name, F.expr("CASE c_custkey % 4 WHEN 2 THEN X'00' WHEN 3 THEN X'FF' ELSE X'' END"), F.expr("CASE c_custkey % 2 WHEN 0 THEN X'0D0A' ELSE X'0D' END"), F.expr("X'E284AB'"))
    content = F.when(F.col("c_custkey") % 4 == 1, F.concat(F.expr("X'EFBBBF'"), body)).otherwise(body)
    files = _table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"), content.alias("content"))
    return csv_source.text_documents(files)


@query("SELECT 'f' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.png' ELSE '.txt' END AS path, CASE c_custkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'cfb' ELSE 'text' END AS format, CASE WHEN c_custkey % 5 = 2 THEN 'SOURCE_ENCRYPTED' WHEN (c_custkey % 4 = 0 AND c_custkey % 5 = 0) OR (c_custkey % 4 = 1 AND c_custkey % 5 = 1) OR (c_custkey % 4 = 3 AND c_custkey % 5 > 2) THEN 'ok' ELSE 'SOURCE_TYPE_MISMATCH' END AS verdict FROM customer")
def sniffed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("'f' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.png' ELSE '.txt' END")
    content = F.expr("CASE c_custkey % 5 WHEN 0 THEN X'255044462D' WHEN 1 THEN X'504B030414' WHEN 2 THEN X'D0CF11E0A1B11AE1' ELSE X'616263' END")
    return csv_source.sniffed(_table(spark, sf_dir, "customer").select(path.alias("path"), content.alias("content"))).select("path", "format", "verdict")


def _archives(rows: DataFrame) -> DataFrame:
    """Small office files (path, content) made of names: documents of words, and sheets."""

    def make(batches):
        import io
        import zipfile

        import pandas as pd

        word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        for pdf in batches:
            out = []
            for number, name in zip(pdf["n_nationkey"], pdf["n_name"]):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    if number % 2:
                        z.writestr("word/document.xml", f'<w:document {word}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:p><w:r><w:t>no {number}</w:t></w:r></w:p></w:body></w:document>')
                    else:
                        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
                        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
                        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="inlineStr"><is><t>{name}</t></is></c><c r="B1"><v>{number}</v></c></row></sheetData></worksheet>')
                out.append((f"{number}.{'docx' if number % 2 else 'xlsx'}", raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.select("n_nationkey", "n_name").mapInPandas(make, "path string, content binary")


@query("SELECT n_nationkey || CASE WHEN n_nationkey % 2 = 1 THEN '.docx' ELSE '.xlsx' END AS path, CASE WHEN n_nationkey % 2 = 1 THEN '# ' || n_name || chr(10) || chr(10) || 'no ' || n_nationkey ELSE '## S' || chr(10) || chr(10) || '| ' || n_name || ' | ' || n_nationkey || ' |' || chr(10) || '| --- | --- |' END AS markdown, NULL::VARCHAR AS reason_code FROM nation")
def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.office_documents(_archives(_table(spark, sf_dir, "nation"))).select("path", "markdown", "reason_code")


# --- single functions -----------------------------------------------------------------------------------------

_ODD = "CASE p_partkey % 6 WHEN 0 THEN 'ＡＢ－１' WHEN 1 THEN 'a' || chr(7) WHEN 2 THEN '  Viel   Raum ' WHEN 3 THEN 'Nordwind Technik GmbH' WHEN 4 THEN 'ANNA von BERGER' ELSE '31.02.1990' END"


@query(r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'AB-1' ELSE n END AS folded, p_partkey % 6 = 1 AS controls, CASE p_partkey % 6 WHEN 2 THEN 'Viel Raum' ELSE n END AS squeezed, lower(CASE p_partkey % 6 WHEN 2 THEN 'Viel Raum' ELSE n END) AS key,
  CASE p_partkey % 6 WHEN 2 THEN 'Viel   Raum' WHEN 3 THEN 'Nordwind Technik' ELSE n END AS alias, CASE p_partkey % 6 WHEN 4 THEN 'Anna von Berger' ELSE n END AS titled, false AS date FROM (SELECT p_partkey, """ + _ODD + r" AS n FROM part)")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_ODD).alias("n"))
    titled = F.when(F.col("p_partkey") % 6 == 0, n).otherwise(tx.title_case(n))
    return rows.select("p_partkey", tx.fold_identifiers(n).alias("folded"), tx.has_controls(n).alias("controls"), tx.squeeze(n).alias("squeezed"), tx.key(n).alias("key"), tx.organisation_alias(n).alias("alias"), titled.alias("titled"), tx.calendar_date(n).isNotNull().alias("date"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS word_no, (sum(length(l_shipdate::VARCHAR) + 1) OVER w - length(l_shipdate::VARCHAR) - 1)::INTEGER AS start FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'ab' ELSE 'abcd' END AS l_shipdate FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)")
def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.word_ranges(_words(spark, sf_dir)).select("doc_id", "word_no", "start")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "lineitem").withColumn("word_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "word_no", F.when(F.col("l_partkey") % 2 == 0, "ab").otherwise("abcd").alias("text"), F.concat_ws(",", F.col("word_no").cast("string"), F.lit("7")).alias("box"))


@query("WITH w AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS word_no, CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 4 END AS n FROM lineitem), p AS (SELECT *, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY word_no ROWS UNBOUNDED PRECEDING) - n - 1 AS start FROM w) SELECT DISTINCT doc_id, word_no || ',7' AS box FROM p WHERE start + n > 3 AND start < 9")
def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ocr.word_ranges(_words(spark, sf_dir))
    spans = words.select("doc_id").distinct().select("doc_id", F.lit(3).alias("start"), F.lit(9).alias("end"))
    return ocr.span_boxes(words, spans)


_SECTIONED = "'Kopf' || chr(10) || '# Projekte' || chr(10) || 'a' || chr(10) || '# Ende' || chr(10) || 'b'"


@query(f"WITH d AS ({_sql_docs(_SECTIONED)}) SELECT doc_id, (i - 1)::INTEGER AS line_no, ([NULL, 'projects', 'projects', 'end', 'end'])[i] AS section FROM d, (SELECT unnest(range(1, 6)) AS i)")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.sections(lines.lines(_docs(spark, sf_dir, _SECTIONED)), {"projects": r"^# Projekte$", "end": r"^# Ende$"}).select("doc_id", "line_no", "section")


"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm.chat import format_conversations, read_back, trained_text
from quillveil.llm.classifier import score_quality
from quillveil.llm.common import crc_fold, table
from quillveil.llm.embeddings import near_vectors
from quillveil.llm.langid import fit_languages, predict_languages
from quillveil.llm.licenses import scan_licenses
from quillveil.llm.media import UNIT, decode_media, encode_media
from quillveil.llm.middle import fill_in_middle, restored
from quillveil.llm.mixing import mix_sources
from quillveil.llm.neardup import near_duplicates
from quillveil.llm.packing import pack_documents
from quillveil.llm.rules import quality_rules
from quillveil.llm.toxicity import score_toxicity
from quillveil.llm.trie import prefix_trie


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files lie; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def learnable_labels(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: one fold of the ids is held out."""
    mod, held = {"quality": (3, 1), "toxic": (5, 0)}[kind]
    return table(spark, sf_dir, "labels").filter(crc_fold("doc_id", mod) != held).select("doc_id", F.col(kind).alias("label"))


def _predicted(scored: DataFrame, mod: int, held: int) -> DataFrame:
    return scored.select("doc_id", (crc_fold("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op2_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    formatted = format_conversations(rows.unionByName(more))
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), trained_text(F.col("formatted"), F.col("loss_runs")).alias("trained"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = score_quality(table(spark, sf_dir, "documents"), learnable_labels(spark, sf_dir, "quality"))
    return _predicted(scored, 3, 1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), learnable_labels(spark, sf_dir, "toxic"))
    return _predicted(scored, 5, 0)


def op7_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decode_media(encode_media(table(spark, sf_dir, "documents")))
    payload = F.expr("substring(pixels, 1, cast(payload_bytes as int))")
    return read.withColumn("payload", payload).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, length(payload) - {UNIT - 1}, {UNIT})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(crc_fold("doc_id", 3) != 1), tokenizer_path("piece_bpe_32k.model"))
    found = predict_languages(docs, model)
    return found.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_format_chat": op2_format_chat,
    "op3_quality_rules": op3_quality_rules,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_webp_media": op7_webp_media,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_pack": op10_pack,
    "op11_near_vectors": op11_near_vectors,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_format_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS previous FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, 13 + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l'))
    + CASE WHEN i = 1 OR role <> previous
      THEN CASE WHEN i = 1 THEN 0 ELSE 1 END + 5 + length(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l')) ELSE 0 END AS chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op12_prefix_trie": r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t
), turns AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), sized AS (SELECT conv, count(*) AS n, conv::VARCHAR AS s FROM turns GROUP BY conv
), hashed AS (
  SELECT conv, n, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 9 AS h,
    conv - conv % 5 AS base FROM sized, tab
), convs AS (
  SELECT c.conv, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM hashed c LEFT JOIN hashed b ON b.conv = c.base
), joined AS (
  SELECT c.conv, t.place - c.h + c.taken AS depth, role, text FROM convs c JOIN turns t ON t.conv = c.conv AND t.place > c.h
  UNION ALL SELECT c.conv, t.place, role, text FROM convs c JOIN turns t ON t.conv = c.base AND t.place <= c.h
), members AS (
  SELECT conv, depth, octet_length(encode(text)) AS bytes,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY depth) OVER (PARTITION BY conv ORDER BY depth) AS key FROM joined
  UNION ALL SELECT conv, 0, 0, '' FROM convs
), nodes AS (
  SELECT depth, key, min(conv) AS node, count(*) AS n_convs, any_value(bytes) AS bytes FROM members GROUP BY depth, key
), placed AS (
  SELECT m.conv, m.depth, n.node, n.key, max(m.depth) OVER (PARTITION BY m.conv) AS last, lag(n.node) OVER (PARTITION BY m.conv ORDER BY m.depth) AS parent
  FROM members m JOIN nodes n ON n.depth = m.depth AND n.key = m.key
), named AS (
  SELECT n.*, p.parent, coalesce(c.n_children, 0) AS n_children FROM nodes n JOIN placed p ON p.conv = n.node AND p.depth = n.depth
  LEFT JOIN (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM (SELECT DISTINCT node, parent, depth FROM placed WHERE depth > 0) GROUP BY 1, 2) c ON c.node = n.node AND c.depth = n.depth
), sums AS (
  SELECT p.node, p.depth, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM named n JOIN placed p ON p.conv = n.node AND p.depth <= n.depth GROUP BY p.node, p.depth
), ends AS (
  SELECT node, depth, string_agg(conv::VARCHAR, ',' ORDER BY conv) AS ends FROM placed WHERE depth = last GROUP BY node, depth
)
SELECT n.node::BIGINT AS conv_id, n.depth::BIGINT AS depth, n.parent::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM named n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN ends e ON e.node = n.node AND e.depth = n.depth
""",
    "op13_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digits FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || digits[1:8])::BIGINT AS h1, ('0x' || digits[9:16])::BIGINT AS h2, ('0x' || digits[17:24])::BIGINT AS h3, ('0x' || digits[25:32])::BIGINT AS h4 FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
}

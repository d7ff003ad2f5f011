"""One behaviour a case, with plain and full-width forms."""

import pytest
from pyspark.sql import functions as F

from quillveil.functions import spans as sp
from quillveil.functions.text import fold_identifiers
from quillveil.operators.detect import findings, redact, release, residual

CASES = [
    ("EMAIL", "", "p.fink@see-haus.example", "[EMAIL_REDACTED]"),
    ("PHONE", "", "+49 221 9876501", "[PHONE_REDACTED]"),
    ("PHONE", "Telefon: ", "0221 98 76 50 1", "[PHONE_REDACTED]"),
    ("IBAN", "", "AT61 1904 3002 3457 3201", "[BANK_DATA_REDACTED]"),
    ("CONTACT_URI", "", "tel:02219876501", "[CONTACT_REDACTED]"),
    ("CONTACT_URI", "", "mailto:fink@see.example", "[CONTACT_REDACTED]"),
    ("CREDIT_CARD", "", "5500 0000 0000 0004", "[BANK_DATA_REDACTED]"),
    ("DE_TAX_ID", "Steuer-ID: ", "48036952716", "[ID_REDACTED]"),
    ("DE_SOCIAL_SECURITY", "", "65 170839 J 003", "[ID_REDACTED]"),
    ("REFERENCE_ID", "Kundennummer: ", "KD-2023/88", "[ID_REDACTED]"),
    ("DATE_OF_BIRTH", "Geburtsdatum: ", "17.08.1963", "[DATE_REDACTED]"),
    ("VEHICLE_PLATE", "Kennzeichen: ", "K-XY 77", "[ID_REDACTED]"),
    ("IP", "", "10.20.30.40", "[IP_REDACTED]"),
    ("IPV6", "", "fe80::12:7", "[IP_REDACTED]"),
    ("CREDENTIAL", "Passwort: ", "offen sesam", "[CREDENTIAL_REDACTED]"),
    ("STREET_ADDRESS", "", "Birkenallee 7", "[LOCATION_REDACTED]"),
    ("STREET_ADDRESS", "", "8 avenue de Lyon", "[LOCATION_REDACTED]"),
    ("POSTAL_ADDRESS", "", "50667 Köln", "[LOCATION_REDACTED]"),
]
KEPT = ["☕ ﬂ km³ ② ㏒ ＮＡＳ ｛Ｘｙ｝", "25000 Euro", "v7.1.2.3.9", "0221 98 76 50 1", "5500 0000 0000 0005", "03/2019 – 11/2021", 'y secret = "q7"', "Im Juni 2021", "[EMAIL_REDACTED] [PERSON_001]"]


def _wide(text):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


def test_each_type(spark):
    rows = [(i, label + value) for i, (_, label, value, _) in enumerate(CASES)]
    got = {r.doc_id: r for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kind, label, _, placeholder) in enumerate(CASES):
        assert got[i].redacted == label + placeholder, CASES[i]
        assert [s.type for s in got[i].resolved] == [kind]


def test_full_width_forms(spark):
    chosen = [c for c in CASES if c[0] in ("EMAIL", "IBAN", "CREDIT_CARD", "IP", "PHONE", "DE_SOCIAL_SECURITY")]
    rows = [(i, label + _wide(value)) for i, (_, label, value, _) in enumerate(chosen)]
    got = {r.doc_id: r.redacted for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: label + p for i, (_, label, _, p) in enumerate(chosen)}


def test_what_stays(spark):
    got = redact(spark.createDataFrame(list(enumerate(KEPT)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.redacted for r in got] == KEPT


def test_credential_takes_its_line_and_carries_no_hash(spark):
    out = redact(spark.createDataFrame([(1, "API-Key: q@see.example x\nq@see.example")], "doc_id long, text string"))
    assert out.first().redacted == "API-Key: [CREDENTIAL_REDACTED]\n[EMAIL_REDACTED]"
    assert {(r.type, r.value_hash is None) for r in findings(out).collect()} == {("CREDENTIAL", True), ("EMAIL", False)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, "")]])
def test_empty(spark, rows):
    got = redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.redacted for r in got] == [t for _, t in rows]


def test_release_is_clean_and_stable(spark):
    text = "\n".join(label + value for _, label, value, _ in CASES)
    row = release(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.verdict, row.reason_code) == ("released", None)


def test_table_headers_are_labels(spark):
    text = "Liste\n| Name | **Passwort** | Kundennummer | Telefon | Geburtsdatum |\n|---|---|:--|---|---|\n| 😀 | geheim\\|x [EMAIL_REDACTED] y | AB-12345 | 030 12345678 | 01.01.1980 |\n| b |  | 77 | - | - |\nAB-12345\n\n| Token\n---\n| abc def |\n---\n"
    want = "Liste\n| Name | **Passwort** | Kundennummer | Telefon | Geburtsdatum |\n|---|---|:--|---|---|\n| 😀 | [CREDENTIAL_REDACTED] | [ID_REDACTED] | [PHONE_REDACTED] | [DATE_REDACTED] |\n| b |  | [ID_REDACTED] | - | - |\nAB-12345\n\n| Token\n---\n| [CREDENTIAL_REDACTED] |\n---\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.type for r in residual(df, "text").collect()} == {"CREDENTIAL", "REFERENCE_ID", "PHONE", "DATE_OF_BIRTH"}
    row = release(df).first()
    assert (row.redacted, row.verdict) == (want, "released")


def test_account_numbers_end_where_their_country_says(spark):
    texts = ["FR14 2004 1010 0505 0001 3M02 606 UND MEHR", "CH93-0076-2011-6238-5295-7 ABC", "NO9386011117947 X", "ZZ12 3456 7890 1234 5678", "DE12 5001 0517 0648 4898"]
    got = [r.redacted for r in redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["IBAN"]).orderBy("doc_id").collect()]
    assert got == ["[BANK_DATA_REDACTED] UND MEHR", "[BANK_DATA_REDACTED] ABC", "[BANK_DATA_REDACTED] X", "[BANK_DATA_REDACTED]", "[BANK_DATA_REDACTED]"]


def test_cards_beside_addresses(spark):
    """A card takes no octet of an address and no local part beside it, whether or not the longer number would pass, so that a second run changes nothing."""
    card, lucky = "4665471787434696", "4495589438270767"
    texts = [f"{card} 42.73.240.87 an", f"an 38.211.12.42 {card}", f"{lucky} 42.73.240.87", f"{card} 70.x@mail.example.com", f"{card}.5 Punkte"]
    rows = redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r.redacted for r in rows.orderBy("doc_id").collect()]
    assert got == ["[BANK_DATA_REDACTED] [IP_REDACTED] an", "an [IP_REDACTED] [BANK_DATA_REDACTED]", "[BANK_DATA_REDACTED] [IP_REDACTED]", "[BANK_DATA_REDACTED] [EMAIL_REDACTED]", "[BANK_DATA_REDACTED].5 Punkte"]


def test_cards_beside_addresses_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quillveil.catalog import ORACLE_SQL, identifier_spans

    texts = ["4495589438270767 42.73.240.87", "4495589438270767 42.73.240.87 4665471787434696", "38.211.12.42 4366089147969128 und 4665471787434696 70.x@mail.example.com", "1.2.3.4 4665471787434696-5.6.7.8"]
    spark.createDataFrame([(i, "de", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = sorted(tuple(r) for r in db.sql(ORACLE_SQL["identifier_spans"]).fetchall())
    assert sorted(tuple(r) for r in identifier_spans(spark, str(tmp_path)).collect()) == expected
    assert len(expected) >= 10


def test_numbers_beside_addresses_under_a_label_of_dates(spark):
    """Neither a date nor a telephone number takes octets of an address, so that a second run finds no number that lost to a date."""
    texts = ["geben +1 (045) 555-3286 12.34.56.78 an", "geb. 9.12.34.56", "geb. 12.03.1980", "+49 221 98.76.50.12", "Tel 0221 98 76 50 1 10.20.30.40"]
    once = redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "redacted").orderBy("doc_id").collect()
    assert [r.redacted for r in once] == ["geben [PHONE_REDACTED] [IP_REDACTED] an", "geb. [IP_REDACTED]", "geb. [DATE_REDACTED]", "[PHONE_REDACTED]", "Tel [PHONE_REDACTED] [IP_REDACTED]"]
    again = redact(spark.createDataFrame([(r.doc_id, r.redacted) for r in once], "doc_id long, text string"))
    assert again.filter("redacted <> text").count() == 0


def test_records_of_many_customers_have_postcodes(spark, tmp_path):
    from quillveil.catalog_entities import further_identifiers

    spark.createDataFrame([(5,), (104999,), (5400000,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    rows = further_identifiers(spark, str(tmp_path)).filter("type = 'POSTAL_ADDRESS'").collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(5, "10005 Neustadt"), (104999, "24999 Neustadt"), (5400000, "10000 Neustadt")]


def test_scans_and_lines_are_the_same_below_and_above_their_bounds(spark):
    """Short arrays are scanned at once and few lines compared with all spans; longer ones take the parts and the sweep."""
    for n in (0, 1, 127, 128, 129, 300):
        sizes = list(range(n))
        rows = spark.createDataFrame([(sizes,)], "sizes array<int>")
        assert rows.select(sp.sums_before("sizes").alias("x")).first().x == [sum(sizes[:i]) for i in range(n)]
    for lines, spans in ((1, 3), (16, 16), (16, 17), (40, 60)):
        starts, places = [7 * i for i in range(lines)], [5 * i for i in range(spans)]
        rows = spark.createDataFrame([(starts, [(a, a + 1) for a in places])], "starts array<int>, spans array<struct<start:int,end:int>>")
        assert rows.select(sp.line_numbers("`spans`", "`starts`").alias("x")).first().x == [sum(s <= a for s in starts) for a in places]


def test_only_full_width_texts_are_folded(spark):
    rows = spark.createDataFrame([("a＠ｂ․de ～",), ("äß €",), ("",), (None,)], "t string")
    assert [r.x for r in rows.select(fold_identifiers(F.col("t")).alias("x")).collect()] == ["a@b.de ~", "äß €", "", None]


def test_texts_without_what_a_match_holds_are_not_searched(spark, monkeypatch):
    from quillveil.operators import detect

    for d in detect.DETECTORS:
        for _, label, value, _ in [c for c in CASES if c[0] == d.type]:
            assert not d.holds or set(d.holds[1:-1].replace("0-9", "0123456789")) & set(label + value)
    monkeypatch.setattr(detect, "DETECTORS", [detect.Detector("IP", "abc", "[IP]", 78, holds=detect.DIGIT), detect.Detector("IBAN", "xyz", "[IBAN]", 88, holds=detect.COLON)])
    rows = redact(spark.createDataFrame([(0, "abc xyz"), (1, "abc xyz 1"), (2, "abc xyz ："), (3, "abc xyz １:"), (4, None)], "doc_id long, text string"))
    assert [r.redacted for r in rows.orderBy("doc_id").collect()] == ["abc xyz", "[IP] xyz 1", "abc [IBAN] ：", "[IP] [IBAN] １:", None]

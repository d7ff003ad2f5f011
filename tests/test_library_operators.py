import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillveil.functions import spans as sp
from quillveil.functions import text as tx
from quillveil.operators import batch, evaluate, identity, lines, ocr
from quillveil.sources import csv_source, office
from quillveil.streaming import runner

KIND = "array<struct<type:string,start:int,end:int,text:string,replacement:string,priority:int,rank:int>>"


def _spans(spark, spans):
    return spark.createDataFrame([("0123456789abcdef", spans)], f"text string, spans {KIND}")


def test_positions_are_code_points(spark):
    df = spark.createDataFrame([("😀 a1 é22 3",)], "text string")
    got = df.select(sp.find(F.col("text"), r"\d+").alias("s")).first().s
    assert [(x.start, x.end, x.text) for x in got] == [(3, 4, "1"), (6, 8, "22"), (9, 10, "3")]


def test_resolution_prefers_priority_then_length_then_place(spark):
    spans = [("a", 0, 4, "", "A", 5, 0), ("b", 2, 8, "", "B", 9, 1), ("c", 8, 10, "", "C", 1, 2), ("d", 9, 12, "", "D", 1, 3), ("e", 12, 13, "", "E", 1, 4)]
    row = _spans(spark, spans).select(sp.resolve(F.col("spans"), KIND).alias("r"), "text").select("r", sp.rewrite(F.col("text"), F.col("r")).alias("t"), sp.moved(F.col("r")).alias("m"), sp.mask(F.col("text"), F.col("r")).alias("k")).first()
    assert [x.type for x in row.r] == ["b", "d", "e"]
    assert row.t == "01B8DEdef"
    assert [(x.out_start, x.out_end) for x in row.m] == [(2, 3), (4, 5), (5, 6)]
    assert len(row.k) == 16


def test_merged_ranges(spark):
    spans = [("a", 5, 7, "", "", 1, 0), ("b", 0, 3, "", "", 1, 1), ("c", 3, 4, "", "", 1, 2)]
    assert [(x.start, x.end) for x in _spans(spark, spans).select(sp.merged(F.col("spans")).alias("m")).first().m] == [(0, 4), (5, 7)]


def test_text_functions(spark):
    df = spark.createDataFrame([("SVEA vom ROTBACH", "Kupferhof Logistik GmbH", "31.02.2020", "1.2.80", "<p>A&amp;B</p><!-- x --><b>c</b> **d**")], "t string, o string, d string, e string, h string")
    row = df.select(tx.title_case(F.col("t")).alias("t"), tx.organisation_alias(F.col("o")).alias("o"), tx.calendar_date(F.col("d")).alias("d"), tx.calendar_date(F.col("e")).alias("e"), tx.visible_text(F.col("h")).alias("h")).first()
    assert tuple(row) == ("Svea vom Rotbach", "Kupferhof Logistik", None, date(1980, 2, 1), "A&B c d")


def test_sections_and_cells(spark):
    text = "# Kunde\n| a | b |\n|---|---|\n| 1 | x\\|y |\n| 2 |  |\nend\n# Projekt\nz"
    df = lines.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [tuple(r) for r in lines.cells(df).orderBy("line_no", "col").select("header", "value").collect()] == [("a", "1"), ("b", "x|y"), ("a", "2"), ("b", "")]
    got = lines.sections(df, {"customer": "Kunde", "project": "Projekt"}).orderBy("line_no").collect()
    assert [r.section for r in got] == ["customer"] * 6 + ["project"] * 2


def test_collisions_widen_pseudonyms(spark):
    out = identity.collision_free(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "name string"), "name", "s", "PERSON", (1, 8)).collect()
    assert len({r.pseudonym for r in out}) == 2


def test_nested_predictions_go(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 5), (1, 8, 12), (1, 0, 10), (2, 2, 5)], "d long, start int, end int")
    assert sorted(tuple(r) for r in evaluate.drop_nested(df, ["d"]).collect()) == [(1, 0, 10), (1, 0, 10), (1, 8, 12), (2, 2, 5)]


def test_remaining_time_needs_three_samples(spark):
    df = spark.createDataFrame([(1, "pending", None), (1, "released", 10), (1, "released", 20), (2, "pending", 1000), (2, "pending", 5000), (2, "released", 3000), (2, "released", 4000)], "batch_id long, status string, duration_ms long")
    assert sorted(tuple(r) for r in batch.remaining_seconds(df).collect()) == [(1, 1, None), (2, 2, 8)]


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        batch.page(spark.range(1), "id", "id", F.lit(True), 0, 21)


def test_boxes(spark):
    words = ocr.word_ranges(spark.createDataFrame([(1, 1, "ab", "A"), (1, 2, "cd", "B"), (1, 3, "ef", "C")], "doc_id long, word_no int, text string, box string"))
    spans = spark.createDataFrame([(1, 1, 4), (1, 3, 4)], "doc_id long, start int, end int")
    assert sorted(r.box for r in ocr.span_boxes(words, spans).collect()) == ["A", "B"]


@pytest.mark.parametrize("text, expected", [("a;b\n1;2", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("a\tb\n1\t2", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ('a,a,\n"x\ny",2,3', "| a | a (2) | Spalte 3 |\n| --- | --- | --- |\n| x<br>y | 2 | 3 |"), ("", "")])
def test_csv(text, expected):
    assert csv_source.to_markdown(text) == expected


@pytest.mark.parametrize("text, code", [("rot,blau;gelb", "CSV_DELIMITER_AMBIGUOUS"), ('a,b\n"x"y,1', "CSV_QUOTE_INVALID"), ('a,b\nx"y,1', "CSV_QUOTE_INVALID"), ("a,b\n1", "CSV_ROW_WIDTH_INVALID")])
def test_csv_fails_closed(text, code):
    with pytest.raises(csv_source.CsvError, match=code):
        csv_source.to_markdown(text)


def _zip(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    word = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Titel</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = _zip({"xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'})
    got = {x.path: x for x in office.office_documents(spark.createDataFrame([("a.docx", word), ("b.xlsx", sheet), ("c.docx", b"no"), ("d.txt", b"")], "path string, content binary")).collect()}
    assert got["a.docx"].markdown == "# Titel\n\n| a |\n| --- |"
    assert got["b.xlsx"].markdown == "## S\n\n| x |  | 2 |\n| --- | --- | --- |" and got["b.xlsx"].warnings == ["FORMULA_CELLS:1"]
    assert (got["c.docx"].reason_code, got["d.txt"].reason_code) == ("SOURCE_CORRUPT", "SOURCE_TYPE_UNSUPPORTED")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx\r\ny")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_bytes(b"a\x00b")
    got = {r.path[-5:]: (r.text, r.reason_code) for r in csv_source.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("x\ny", None), "b.txt": (None, "TEXT_ENCODING_INVALID"), "c.txt": (None, "TEXT_CONTROL_INVALID")}


def test_stream_gives_what_the_batch_gives_and_resumes(spark, tmp_path):
    rows = [(1, "a@example.de", "2024-01-01 10:00:00"), (2, "nothing", "2024-01-01 11:00:00")]
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1)
    make(rows).write.parquet(src)
    for more in (None, [(3, "10.0.0.1", "2024-01-01 12:00:00")]):
        if more:
            make(more).write.mode("append").parquet(src)
        runner.release_stream(runner.document_stream(spark, src), out, check).awaitTermination()
    got = sorted((r.doc_id, r.redacted) for r in spark.read.parquet(out).collect())
    assert got == [(1, "[EMAIL_REDACTED]"), (2, "nothing"), (3, "[IP_REDACTED]")]


def test_stream_stops_what_has_residuals(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@example.de"), (2, "nothing"), (3, None)], "doc_id long, text string").withColumn("at", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    # without a pass all findings are residuals
    runner.release_stream(runner.document_stream(spark, str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "check"), passes=0).awaitTermination()
    got = {r.doc_id: (r.redacted, r.verdict, r.reason_code) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == (None, "stopped", "RESIDUAL_PII") and got[2] == ("nothing", "released", None)


def test_long_aliases_are_found(spark):
    docs = spark.createDataFrame([(1, "Die Nord-Ost Bank für Handel & Gewerbe AG zahlt; nord ost bank für handel gewerbe ag."), (2, "nord ost bank"), (3, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([("nord ost bank für handel gewerbe ag",), ("ost bank",), ("...",), (None,)], "alias string")
    got = sorted(tuple(r) for r in identity.known_aliases(docs, aliases).collect())
    assert got == [(1, "nord ost bank für handel gewerbe ag", 2), (1, "ost bank", 2), (2, "ost bank", 1)]
    assert identity.known_aliases(docs, aliases.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 10_000])
def test_tokens_are_shuffled_for_many_aliases_only(spark, monkeypatch, small):
    monkeypatch.setattr(identity, "SMALL", small)
    docs = spark.createDataFrame([(1, "eins zwei drei zwei drei"), (2, "drei")], "doc_id long, text string")
    found = identity.known_aliases(docs, spark.createDataFrame([("zwei drei",), ("eins",)], "alias string"))
    assert sorted(map(tuple, found.collect())) == [(1, "eins", 1), (1, "zwei drei", 2)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert ("SortMergeJoin" in plan) == (not small)


def test_equal_intervals_are_one_island(spark):
    """Which of equal intervals comes first is open, so it decides nothing."""
    rows = [(1, 5, 3), (1, 5, 3), (1, 9, 12), (1, 9, 12), (1, 11, 20)]
    got = lines.merge_intervals(spark.createDataFrame(rows, "k int, s int, e int"), "k", "s", "e").collect()
    assert sorted((r.s, r.e, r.parts) for r in got) == [(5, 3, 2), (9, 20, 3)]


def test_profile_reads_a_text_once(spark):
    """A text is put in small letters once for its profile, and once for all of its lines that ask for it."""
    from quillveil.operators import seeds

    docs = spark.createDataFrame([("Mitarbeiterprofil\nRolle: x\nAusbildung: y\nTeam\tAnna Berger", 1), ("Vertrag mit Haftung", 2), (None, 3)], "text string, n int")
    profiles = docs.select("n", tx.profile_of(F.col("text")).alias("p"))
    assert [r.p for r in profiles.orderBy("n").collect()] == ["personnel_profile", "contract", "general"]
    times = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lower(text")
    assert times(profiles) == 1
    found = docs.select(seeds.person_seeds(F.col("text"), seeds.empty("struct<start:int,end:int,header:string,line:int,stack:string>")).alias("s"))
    assert times(found) == 1
    assert "Anna Berger" in [s.name for s in found.first().s]

"""Signed cursors, alignments with their operations, fixed values and the notes of Word files."""

import hashlib
import hmac
import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.functions import mac, names, text
from quillveil.operators import alignment, batch, lifecycle
from quillveil.sources import office


def test_digests_equal_those_of_the_standard_library(spark):
    for secret in (b"", b"key", b"k" * 64, b"long " * 40):
        got = [r[0] for r in spark.createDataFrame([("",), ("x",), ("Grüße",)], "m string").select(mac.hmac_sha256(secret, F.col("m"))).collect()]
        assert got == [hmac.new(secret, m.encode(), hashlib.sha256).hexdigest() for m in ("", "x", "Grüße")]


def test_pages_follow_one_another_and_changed_cursors_are_refused(spark):
    items = spark.createDataFrame([(b, i, "released" if i % 2 else "stopped") for b in (1, 2) for i in range(12)], "b long, i long, status string")
    released, seen, cursor = F.col("status") == "released", [], None
    ask = lambda cursor, size=2, key=1, secret=b"s", name="released": batch.signed_pages(items, spark.createDataFrame([(key, cursor)], "b long, cursor string"), secret, "b", "i", released, name, size).collect()
    for _ in range(3):
        rows = ask(cursor)
        seen += [r.i for r in rows]
        last, cursor = cursor, rows[0].next_cursor
    assert seen == [1, 3, 5, 7, 9, 11] and cursor is None
    for other in ({"size": 3}, {"key": 2}, {"secret": b"t"}, {"name": "all"}):
        assert [(r.status, r.i) for r in ask(last, **other)] == [("INVALID_CURSOR", None)]
    for bad in ("", "?", "A" + last[1:], last[:-4], last + last):
        assert [(r.status, r.i) for r in ask(bad)] == [("INVALID_CURSOR", None)]
    assert [(r.status, r.i) for r in ask(None, key=9)] == [("ok", None)]
    with pytest.raises(ValueError):
        ask(None, size=21)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.sampled_from([40, 300, 1 << 22]))
def test_alignments_cost_the_edit_distance_in_any_memory(a, b, cells):
    equal, replaced, deleted, inserted = alignment.operations(np.array(a, np.int64), np.array(b, np.int64), cells).tolist()
    assert replaced + deleted + inserted == _distance(a, b)
    assert equal + replaced + deleted == len(a) and equal + replaced + inserted == len(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30)), max_size=12), st.sampled_from([60, 1 << 18]), st.sampled_from([300, 1 << 22]))
def test_pairs_aligned_together_count_as_one_by_one(pairs, short, cells):
    pairs = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs]
    assert alignment.counts(pairs, short, cells).tolist() == [alignment.operations(a, b).tolist() if (len(a) + 1) * (len(b) + 1) <= short else alignment.operations(a, b, cells).tolist() for a, b in pairs]


def test_short_pairs_take_no_band_of_their_own(monkeypatch):
    monkeypatch.setattr(alignment, "operations", None)
    pairs = [(np.arange(40) * k % 11, np.arange(50) * (k + 1) % 13) for k in range(2000)]
    for (a, b), (equal, replaced, deleted, inserted) in zip(pairs, alignment.counts(pairs).tolist()):
        assert equal + replaced + deleted == len(a) and equal + replaced + inserted == len(b)


def test_rates_by_split_and_stage(spark):
    rows = [("dev", "a", "eins zwei drei", "eins drei vier"), ("dev", "a", "[PERSON_001] kam", "Anna kam"), ("dev", "b", None, None), ("hold", "a", "", "neu"), ("hold", "b", "x " * 3000, "x " * 2999 + "y")]
    got = {(r.split, r.stage): r for r in alignment.quality_summary(spark.createDataFrame(rows, "split string, stage string, reference string, output string"), ["split", "stage"]).collect()}
    a = got["dev", "a"]
    assert (a.documents, a.words_equal, a.words_replaced, a.words_deleted, a.words_inserted, a.wer) == (2, 2, 3, 0, 0, 0.6)  # of equal costs pairs are preferred
    assert (got["dev", "b"].wer, got["dev", "b"].cer, got["hold", "a"].wer, got["hold", "a"].words_inserted) == (0.0, 0.0, None, 1)
    assert got["hold", "b"].words_replaced == 1 and got["hold", "b"].wer == pytest.approx(1 / 3000, abs=1e-6)


def test_fixed_values(spark):
    files = [(1, 1, "TXT", 8_000_000), (1, 2, "md", 8_000_001), (1, 3, "csv", 1_500_001), (1, 4, "docx", 64 << 20), (1, 5, "png", (25 << 20) + 1), (1, 6, "exe", 1)]
    got = {r.file_no: r.reason_code for r in lifecycle.admission(spark.createDataFrame(files, "batch_id long, file_no long, format string, bytes long")).collect()}
    assert got == {1: None, 2: "FILE_TOO_LARGE", 3: "FILE_TOO_LARGE", 4: None, 5: "FILE_TOO_LARGE", 6: "FORMAT_UNSUPPORTED"}
    states = [(1, "released"), (1, "stopped"), (2, "released"), (2, "deferred_review"), (3, "deferred_review"), (3, "retryable"), (4, "pending"), (5, "odd"), (5, "deferred_review")]
    acts = {r.batch_id: (r.review_ready, r.next_action) for r in lifecycle.next_action(batch.status_counts(spark.createDataFrame(states, "batch_id long, status string"))).collect()}
    assert acts == {1: (False, "none"), 2: (True, "review"), 3: (False, "batch"), 4: (False, "batch"), 5: (False, "batch")}
    texts = [("Beraterprofil, Rolle: x, Ausbildung: y", "personnel_profile"), ("Lebenslauf, Bewerbung", "applicant"), ("Vertrag nach §", "contract"), ("Ticket für Support", "customer"), ("Vertrag und Rechnung", "general"), ("", "general")]
    df = spark.createDataFrame(texts, "t string, want string").select("want", text.profile_of(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    brands = spark.createDataFrame([("Atlassian Ltd",), ("TÜV",), ("Apple Inc",), ("Amazon Web Services Inc",)], "n string").select(names.is_allowed_organisation(F.col("n")).alias("a"))
    assert [r.a for r in brands.collect()] == [True, True, False, True]


def _file(**parts):
    raw = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    with zipfile.ZipFile(raw, "w") as z:
        for name, (root, body) in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", f"<w:{root} {w}>{body}</w:{root}>")
        z.writestr("word/charts/chart1.xml", "<c/>")
        z.writestr("word/media/image1.png", b"x")
    return raw.getvalue()


def test_word_files_lose_no_text_without_a_word(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    box = lambda t: f"<w:txbxContent>{p(t)}</w:txbxContent>"
    body = (
        f'<w:p><w:r><w:t>Siehe</w:t><w:footnoteReference w:id="2"/></w:r></w:p><w:sdt><w:sdtPr/><w:sdtContent>{p("im Feld")}</w:sdtContent></w:sdt>'
        f'<w:p><w:r><w:t>vor </w:t><mc:AlternateContent><mc:Choice>{box("Kasten")}</mc:Choice><mc:Fallback>{box("Kasten")}</mc:Fallback></mc:AlternateContent><w:t>nach</w:t></w:r></w:p>'
        f"<w:tbl><w:tr><w:sdt><w:sdtContent><w:tc>{p('Zelle')}</w:tc></w:sdtContent></w:sdt><w:tc>{p('b')}</w:tc></w:tr></w:tbl><w:neu>{p('fremd')}</w:neu><w:sectPr/>"
    )
    notes = f'<w:footnote w:type="separator" w:id="0">{p("-")}</w:footnote><w:footnote w:id="2">{p("Note von Wilma")}</w:footnote>'
    raw = _file(word__document=("document", f"<w:body>{body}</w:body>"), word__footnotes=("footnotes", notes), word__endnotes=("endnotes", f'<w:endnote w:id="1">{p("Ende")}</w:endnote>'))
    got = {r.path: r for r in office.office_documents(spark.createDataFrame([("a.docx", raw), ("b.docx", None), (None, raw)], "path string, content binary")).collect()}
    assert got["a.docx"].markdown == "Siehe[^2]\n\nim Feld\n\nvor nach\n\nKasten\n\n| Zelle | b |\n| --- | --- |\n\nfremd\n\n[^1]: Ende\n\n[^2]: Note von Wilma"
    assert got["a.docx"].warnings == ["UNKNOWN_CONSTRUCT:neu", "UNREAD_PART:word/charts/chart1.xml", "UNREAD_PART:word/media/image1.png"]
    assert (got["b.docx"].reason_code, got[None].reason_code) == ("SOURCE_EMPTY", "SOURCE_TYPE_UNSUPPORTED")

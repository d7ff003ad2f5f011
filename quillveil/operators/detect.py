"""Detectors: one declarative table that both the rewriting and the residual gate use.

A detector is a pattern, an optional test of the match and an optional label
that must stand before it, on its line, in the nearest short line above, or in
the header of its table cell. All detectors of a document run in one projection and give one array of spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillveil.functions import spans as sp
from quillveil.functions.text import calendar_date, fold_identifiers, luhn_valid, short_hash
from quillveil.lineage import settle
from quillveil.operators.lines import CELL, placed_cells

SPAN = "struct<type:string,start:int,end:int,text:string,replacement:string,priority:int,rank:int>"

_B, _A = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_IBAN = r"[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}"
# Neither the first nor the last octet of an address beside a card, nor the local part of a mail address, is part of its number.
_CARD = r"(?!(?<=\d\.\d{1,3}\.\d{1,3}\.)\d{1,3}[ -])\d(?:[ -]?\d){12,18}"
_CARD_END = r"(?!(?<=[ -]\d{1,3})\.\d{1,3}\.\d{1,3}\.\d)(?![\p{L}\p{N}._%+-]*@)"
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|January|February|March|May|June|July|October|December|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|noviembre|diciembre"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP_END = r"(?![\p{N}]|\.\d)"
_IP = rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}{_IP_END}"
# A date is no part of an address, and a number that is long enough does not go on into one: else what wins tears it, and what loses is found in a second run.
_DATE = rf"(?!{_IP}|(?<=(?<![\p{{N}}.]){_OCTET}\.)(?:{_OCTET}\.){{2}}{_OCTET}{_IP_END})"
_PHONE = rf"\d(?:[ ()/.-]{{0,2}}\d){{6}}(?:[ ()/.-]{{0,2}}(?!{_IP})\d){{0,10}}"
_H = "[0-9A-Fa-f]{1,4}"
# How an at sign and a full stop are written as references.
_AT, _DOT = r"(?:@|&#0*64;|&#x0*40;|&commat;)", r"(?:\.|&#0*46;|&#x0*2e;|&period;)"
# Endings of bare domains, and domains that a profile may name.
_ENDINGS = "com|de|org|net|io|eu|at|ch|fr|es|nl|info"
_PROTECTED = r"(?:[\w-]+\.)*(?:github|gitlab|linkedin|xing|stackoverflow)\.com"

# Labels that give a value its meaning, by language.
_LABELS = {
    "tax": r"(?:Steuer-?(?:ID|Identifikationsnummer|nummer)|Tax ID|IdNr)\.?",
    "birth": r"(?:Geburtsdatum|geb(?:oren)?\.?(?: am)?|Date of birth|DOB|Born|Date de naissance|Né(?:e)? le|Fecha de nacimiento|Geboortedatum|Data di nascita)",
    "plate": r"(?:Kennzeichen|Kfz-Kennzeichen|License plate|Plaque|Matrícula)",
    "phone": r"(?:Tel(?:efon|ephone|éfono|\.)?|Phone|Mobil(?:e)?|Handy|Fax|Téléphone|Rufnummer)",
    "bank": r"(?:BIC|SWIFT(?:-Code)?)",
    "id": r"(?:(?:Kunden|Mitarbeiter|Personal|Vertrags|Rechnungs|Ausweis|Versicherungs)(?:nummer|-?Nr\.?|-ID)|Customer (?:ID|number)|Employee (?:ID|number)|Reference(?: ID| number)?|Référence|Aktenzeichen)",
    "secret": r"(?:Passwor[dt]|Kennwort|API[ _-]?Key|Secret|Token|Zugangsdaten)",
}
# Units after which five digits are no postcode, and standards before which they are none.
_UNITS = r"(?:Euro|EUR|kg|km|Stück|Personen|USD|Liter|Tonnen|Meter)"
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _headed(name: str) -> str:
    """The pattern of a table header that is the label, whatever marks emphasis around it."""
    return rf"(?i)\A[\s*_`]*{_LABELS[name]}[\s*_`]*[:：]?[\s*_`]*\z"


#: Lines above that are looked at for a label, beside the span's own.
ABOVE = 8


def _label_pattern(name: str) -> str:
    return rf"(?i)(?<![\p{{L}}\p{{N}}]){_LABELS[name]}[^\n]*$"


def _labelled(c: Column, name: str) -> Column:
    """Whether the label stands before a span: on its line, in the nearest short line above where nothing else is before it, or in the header of its cell."""
    pattern = F.lit(_label_pattern(name))
    return c["headed"] | F.regexp_like(c["left"], pattern) | ((F.trim(c["left"]) == "") & F.regexp_like(F.regexp_extract(c["before"], r"([^\n]{1,80})\n[\s]*\z", 1), pattern))


def _with_context(spans: str, window: int) -> Column:
    """The spans of a column, each with whether its cell has the header (``{spans}_headed``), what of its line stands before it, its line, and up to ``window`` characters before it, over ``ABOVE`` lines at most."""

    def one(s: Column, headed: Column, number: Column) -> Column:
        begins = F.element_at("_starts", number)
        line = F.element_at("_rows", number)
        skipped = F.greatest(s["start"] - window - begins, F.lit(0))
        left = F.substring(line, skipped + 1, s["start"] - begins - skipped)
        first = F.greatest(number - ABOVE, F.lit(1))
        above = F.concat(F.array_join(F.slice("_rows", first, number - first), "\n"), F.when(number > 1, F.lit("\n")).otherwise(F.lit("")), left)
        return F.struct(s.alias("span"), headed.alias("headed"), line.alias("line"), left.alias("left"), F.when(F.trim(left) == "", F.right(above, F.lit(window))).otherwise(F.lit("")).alias("before"))

    return F.zip_with(F.arrays_zip(F.col(spans).alias("s"), F.col(f"{spans}_headed").alias("h")), f"{spans}_line", lambda x, number: one(x["s"], x["h"], number))


def _card(span: Column) -> Column:
    return luhn_valid(span["text"])


def _plus(c: Column) -> Column:
    return F.startswith(c["span"]["text"], F.lit("+"))


def _no_date(span: Column) -> Column:
    return calendar_date(span["text"]).isNull()


def _by_iban(c: Column) -> Column:
    return F.regexp_like(c["line"], F.lit(_B + _IBAN))


@dataclass(frozen=True)
class Detector:
    type: str
    pattern: str
    placeholder: str
    priority: int
    #: A test of the match itself.
    accept: Callable[[Column], Column] | None = None
    needs: str | None = None
    folded: bool = True
    #: The label that must stand before it, how far off, and what does instead.
    label: str | None = None
    window: int = 40
    instead: Callable[[Column], Column] | None = None
    #: Characters, as a class, of which a match must hold one; texts without them are not searched.
    holds: str | None = None


#: What most texts have none of, so that most patterns pass them by.
DIGIT, COLON = "[0-9]", "[:=：＝]"


# Types, placeholders and priorities of the span model, in the order in which equal spans win.
DETECTORS = [
    Detector("CREDENTIAL", rf"(?im)(?<=^(?:[ \t]{{0,8}}(?:[-*] )?){_LABELS['secret']}[ \t]{{0,4}}[:=][ \t]{{0,4}})[^\s][^\n]*", "[CREDENTIAL_REDACTED]", 96, holds=COLON),
    Detector("CONTACT_URI", rf"(?i){_B}(?:tel|sms):(?:\+|%2b)?\(?(?:\d|%3\d)(?:(?:[./ \t()-]|%2[0def])*(?:\d|%3\d)\)?)*(?:[;?][^\s<>()\[\]\"']+)?", "[CONTACT_REDACTED]", 91, needs=":"),
    Detector("CONTACT_URI", rf"(?i){_B}(?:mailto|callto|sip|xmpp|(?:tel|sms)(?!:[+(\d%])):[^\s<>()\[\]\"']+", "[CONTACT_REDACTED]", 91, needs=":"),
    Detector("EMAIL", r"(?:[\p{L}\p{N}._%+-]|\\_)+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}", "[EMAIL_REDACTED]", 90, needs="@"),
    Detector("EMAIL", r'"[^"\n@]{1,64}"@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}', "[EMAIL_REDACTED]", 90, needs='"@'),
    Detector("EMAIL", rf"(?i)[\p{{L}}\p{{N}}._+-]+{_AT}[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]+)*{_DOT}\p{{L}}{{2,}}", "[EMAIL_REDACTED]", 90, needs="&"),
    Detector("EMAIL", r"(?i)[\p{L}\p{N}._+-]+%40[\p{L}\p{N}-]+(?:(?:\.|%2e)[\p{L}\p{N}-]+)*(?:\.|%2e)\p{L}{2,}", "[EMAIL_REDACTED]", 90, needs="%40"),
    Detector("IBAN", _B + _IBAN + _A, "[BANK_DATA_REDACTED]", 88, holds=DIGIT),
    Detector("CREDIT_CARD", _B + _CARD + _A + _CARD_END, "[BANK_DATA_REDACTED]", 87, _card, holds=DIGIT),
    Detector("BIC", _B + r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?" + _A, "[BANK_DATA_REDACTED]", 86, label="bank", instead=_by_iban),
    Detector("DE_SOCIAL_SECURITY", _B + r"\d{2} ?\d{6} ?[A-Z] ?\d{2} ?\d" + _A, "[ID_REDACTED]", 84, holds=DIGIT),
    Detector("DE_TAX_ID", _B + r"\d{2} ?\d{3} ?\d{3} ?\d{3}" + _A, "[ID_REDACTED]", 83, label="tax", holds=DIGIT),
    Detector("REFERENCE_ID", _B + r"(?=[\p{L}\p{N}/-]{0,20}\d)[\p{L}\p{N}]+(?:[-/.][\p{L}\p{N}]+){0,3}" + _A, "[ID_REDACTED]", 82, label="id", holds=DIGIT),
    Detector("DATE_OF_BIRTH", _B + _DATE + rf"(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}})|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.? (?:{_MONTHS}) \d{{4}}|(?:{_MONTHS}) \d{{1,2}}, \d{{4}})" + _A, "[DATE_REDACTED]", 81, label="birth", holds=DIGIT),
    Detector("VEHICLE_PLATE", _B + r"[A-ZÄÖÜ]{1,3}-[A-Z]{1,2} \d{1,4}[EH]?" + _A, "[ID_REDACTED]", 81, label="plate", holds=DIGIT),
    Detector("PHONE", r"(?<![\p{L}\p{N}_+])(?:\+|\(?0)" + _PHONE + _A, "[PHONE_REDACTED]", 80, _no_date, label="phone", window=256, instead=_plus, holds=DIGIT),
    Detector("PHONE", r"(?<![\p{L}\p{N}_+])(?:\+33[ .-]?|0)\d(?:[ .-]?\d{2}){4}" + _A, "[PHONE_REDACTED]", 80, _no_date, label="phone", window=256, instead=_plus, holds=DIGIT),
    Detector("IP", _IP, "[IP_REDACTED]", 78, needs=".", holds=DIGIT),
    Detector("IPV6", rf"(?<![0-9A-Fa-f:.])(?:(?:(?:{_H}:){{6}}|(?:{_H}(?::{_H}){{0,5}})?::(?:{_H}:){{0,5}})(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)|(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{1,6}}|::(?:{_H}:){{0,6}}{_H})(?![0-9A-Fa-f:])", "[IP_REDACTED]", 78, needs=":"),
    Detector("STREET_ADDRESS", _B + rf"(?!Im (?:{_MONTHS}) \d{{4}})(?:[\p{{Lu}}][\p{{L}}-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)|(?:Am|Im|An der|Auf der) [\p{{Lu}}][\p{{L}}-]+) \d{{1,4}}[a-z]?" + _A, "[LOCATION_REDACTED]", 77, folded=False, holds=DIGIT),
    Detector("STREET_ADDRESS", _B + r"\d{1,4}(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse) (?:de |du |des |de la |d'|l')?[\p{L}'-]+(?: [\p{Lu}][\p{L}'-]+)*", "[LOCATION_REDACTED]", 77, folded=False, holds=DIGIT),
    Detector("POSTAL_ADDRESS", r"(?<!(?:ISO|IEC|DIN|EN)[ -])" + _B + rf"\d{{5}} (?!{_UNITS}\b)[\p{{Lu}}][\p{{L}}-]+(?: [\p{{Lu}}][\p{{L}}-]+){{0,3}}", "[LOCATION_REDACTED]", 76, folded=False, holds=DIGIT),
]
_PATH = r"[^\s<>()\[\]\"']"
URL = Detector("URL", rf"(?i)(?:https?://|www\.)(?!{_PROTECTED}(?![\w.-])){_PATH}+|(?<![\p{{L}}\p{{N}}@./_-])(?!{_PROTECTED}(?![\w.-]))(?:[\p{{L}}\p{{N}}-]+\.)+(?:{_ENDINGS})(?![\p{{L}}\p{{N}}.-])(?:/{_PATH}*)?", "[URL_REDACTED]", 58)
PLACEHOLDER = r"\[(?:(?:CREDENTIAL|CONTACT|EMAIL|BANK_DATA|ID|DATE|PHONE|IP|LOCATION|URL|ORGANISATION)_(?:REDACTED|UNKLAR)|(?:PERSON|UNTERNEHMEN|ARBEITGEBER|KUNDE|PROJEKT)_(?:UNKLAR_)?\d{3,})\]"


def _typed(found: Column, detector: Detector, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(detector.type).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(detector.placeholder).alias("replacement"), F.lit(detector.priority).alias("priority"), F.lit(rank).alias("rank")))


def _trim_iban(found: Column) -> Column:
    """An account number ends where its country's length says; letters and digits count, separators do not."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def cut(s: Column) -> Column:
        want = F.try_element_at(lengths, F.substring(s["text"], 1, 2))
        # so many letters and digits from the beginning on
        whole = F.call_function("regexp_extract", s["text"], F.concat(F.lit(r"\A(?:[A-Z0-9][ -]?){"), (want - 1).cast("string"), F.lit("}[A-Z0-9]")), F.lit(0))
        text = F.when(want.isNotNull() & (whole != ""), whole).otherwise(s["text"])
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(text)).alias("end"), text.alias("text"))

    return F.transform(found, cut)


def _under(label: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_like(c["header"], F.lit(_headed(label)))


def _told(d: Detector) -> Callable[[Column], Column]:
    return lambda c: _labelled(c, d.label) | d.instead(c) if d.instead else _labelled(c, d.label)


def detect(docs: DataFrame, types: list[str] | None = None, urls: bool = False) -> DataFrame:
    """``docs`` (with a text column) and all their spans, before overlaps are resolved.

    Placeholders of an earlier run are reserved: no span may overlap them. A
    credential drops every other span that overlaps it. The whole cell under a
    header that is a credential label is one, placeholders in it included, until
    it holds nothing but the placeholder of a credential. Null texts have null
    spans.
    """
    chosen = [d for d in [*DETECTORS, *([URL] if urls else [])] if types is None or d.type in types]
    folded = sp.hold(docs, _folded=fold_identifiers(F.col("text")))
    secrets = [(i, d) for i, d in enumerate(chosen) if d.type == "CREDENTIAL"]
    labelled = bool(secrets) or any(d.label for d in chosen)
    # folding makes more of these characters and takes none away
    held = {kind: f"_holds{i}" for i, kind in enumerate(dict.fromkeys(d.holds for d in chosen if d.holds))}
    folded = sp.hold(folded, **{name: F.regexp_like("_folded", F.lit(kind)) for kind, name in held.items()}) if held else folded
    if labelled:
        named = F.transform(placed_cells(F.col("text")), lambda c: c.withField("header", fold_identifiers(c["header"])))
        folded = sp.hold(folded, _cells=F.filter(named, lambda c: F.regexp_like(c["header"], F.lit("|".join(_headed(name) for name in _LABELS)))))
    else:
        folded = sp.hold(folded, _cells=F.expr(f"cast(array() as array<{CELL}>)"))
    found, headed, tested = {}, {}, {}
    for i, d in enumerate(chosen):
        spans = sp.find(F.col("_folded") if d.folded else F.col("text"), d.pattern, d.needs)
        if d.holds:
            spans = F.when(~F.col(held[d.holds]), F.expr(f"cast(array() as {sp.FOUND})")).otherwise(spans)
        if d.type == "IBAN":
            spans = _trim_iban(spans)
        if d.accept:
            spans = F.filter(spans, d.accept)
        found[f"_s{i}"] = spans
        if d.label:
            headed[f"_h{i}"] = F.filter("_cells", _under(d.label))
    out = sp.hold(folded, **found, _reserved=sp.find(F.col("text"), PLACEHOLDER, "["))
    with_label = [(f"_s{i}", f"_h{i}", d) for i, d in enumerate(chosen) if d.label]
    if with_label:
        out = sp.hold(out, **headed, _rows=F.split("_folded", "\n", -1), _starts=sp.sums_before("transform(split(`_folded`, '\\n', -1), t -> length(t) + 1)"))
        out = sp.hold(out, **{f"{s}_headed": sp.inside(f"`{s}`", f"`{h}`") for s, h, _ in with_label}, **{f"{s}_line": sp.line_numbers(f"`{s}`", "`_starts`") for s, _, _ in with_label})
        for s, _, d in with_label:
            tested[s] = F.transform(F.filter(_with_context(s, d.window), _told(d)), lambda c: c["span"])
        out = sp.hold(out, **tested).drop("_rows", "_starts", *headed, *[f"{s}_{x}" for s, _, _ in with_label for x in ("headed", "line")])
    out = sp.hold(out, **{f"_s{i}": _typed(F.col(f"_s{i}"), d, i) for i, d in enumerate(chosen)})
    spans = sp.without_overlap(F.concat(*[F.col(c) for c in found]), F.col("_reserved"))
    for i, d in secrets:
        # no placeholder of another kind vouches for the rest of such a cell
        value = lambda c: F.substring(F.col("text"), c["start"] + 1, c["end"] - c["start"])
        under = F.filter(F.col("_cells"), lambda c: F.regexp_like(c["header"], F.lit(_headed("secret"))) & (value(c) != d.placeholder))
        spans = F.concat(spans, F.when(F.col("text").isNotNull(), _typed(F.transform(under, lambda c: c.withField("text", value(c))), d, i)))
    secret = lambda s: s["type"] == "CREDENTIAL"
    with_secrets = sp.let(spans, lambda x: F.struct(x.alias("all"), F.filter(x, secret).alias("secrets")))
    safe = sp.let(with_secrets, lambda b: F.filter(b["all"], lambda s: secret(s) | ~F.exists(b["secrets"], lambda c: sp.overlaps(c, s))))
    return sp.hold(out, spans=safe).drop("_folded", "_reserved", "_cells", *held.values(), *found)


def exploded(rows: DataFrame, spans: str, *keep: str) -> DataFrame:
    """One row a span (in ``s``). The outer form, as the inner one would compute the spans a second time to see whether there are any."""
    return rows.select(*keep, F.explode_outer(spans).alias("s")).filter(F.col("s").isNotNull())


def redact(docs: DataFrame, types: list[str] | None = None, urls: bool = False) -> DataFrame:
    """``docs`` with resolved spans and the rewritten text in ``redacted``."""
    found = sp.hold(detect(docs, types, urls), resolved=sp.resolve(F.col("spans"), f"array<{SPAN}>"))
    return sp.hold(found, redacted=sp.rewrite(F.col("text"), F.col("resolved")))


def findings(redacted: DataFrame) -> DataFrame:
    """(doc_id, type, value_hash) of the resolved spans; credentials carry no hash."""
    spans = exploded(redacted, "resolved", "doc_id")
    return spans.select("doc_id", F.col("s.type").alias("type"), F.when(F.col("s.type") != "CREDENTIAL", short_hash(F.col("s.text"))).alias("value_hash"))


def residual(docs: DataFrame, text_col: str = "redacted") -> DataFrame:
    """What the same detectors still find in a released text: (doc_id, type, start, end); credentials show no text."""
    again = detect(docs.select("doc_id", F.col(text_col).alias("text")))
    return exploded(again, "spans", "doc_id").select("doc_id", "s.type", F.when(F.col("s.type") == "CREDENTIAL", "").otherwise(F.col("s.text")).alias("text"), "s.start", "s.end")


def release(docs: DataFrame, passes: int = 3) -> DataFrame:
    """Rewrites until nothing is found, three passes at most; what still has residuals is not released.

    (doc_id, redacted, verdict, reason_code, classes). Only texts with residuals
    change in later passes, as a text without spans is rewritten to itself.
    """
    current = docs.select("doc_id", "text")
    for _ in range(passes):
        # each pass is a plan of its own: the expressions of several do not nest
        current = settle(redact(current).select("doc_id", F.col("redacted").alias("text")))
    left = detect(current).select("doc_id", "text", F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["type"]))), ", ").alias("classes"))
    clean = F.col("classes") == ""
    return left.select("doc_id", F.when(clean, F.col("text")).alias("redacted"), F.when(clean, "released").otherwise("stopped").alias("verdict"), F.when(~clean, "RESIDUAL_PII").alias("reason_code"), "classes")

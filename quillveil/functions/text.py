"""Normalisation and tests of text columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "․"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)) + "."


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def normalize_text(text: Column) -> Column:
    """NFC; soft hyphens and zero-width joiners go, bidirectional controls and all space separators become blanks.

    ASCII texts are left out of the only Python step.
    """
    return visible_spaces(composed(text))


def composed(text: Column) -> Column:
    """NFC of the text."""
    return F.coalesce(_nfc(F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text)), text)


def visible_spaces(text: Column) -> Column:
    gone = F.regexp_replace(text, "[­​-‍⁠﻿]", "")
    return F.regexp_replace(gone, r"[؜‎‏‪-‮⁦-⁩\p{Zs}]", " ")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def fold_identifiers(text: Column) -> Column:
    """Full-width ASCII to ASCII, one for one, so that offsets hold. Texts without any are left as they are, as looking for it takes less."""
    return F.when(F.regexp_like(text, F.lit("[\uff01-\uff5e\u2024]")), F.translate(text, _FULL_WIDTH, _ASCII)).otherwise(text)


def has_controls(text: Column) -> Column:
    """C0 and C1 controls other than tab and line ends, or a replacement character."""
    return F.regexp_like(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def key(text: Column) -> Column:
    return F.lower(squeeze(text))


def short_hash(text: Column) -> Column:
    """The first ten hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 10)


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits with a right Luhn digit; other characters are passed over."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def calendar_date(text: Column) -> Column:
    """The date of d.m.y or y-m-d texts from 1850 to 2100, else null; two-digit years are of the 1900s."""
    parts = F.split(F.regexp_replace(F.trim(text), r"[./]", "-"), "-")
    first, middle, last = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    year = F.when(F.length(first) == 4, first).when(F.length(last) == 2, F.concat(F.lit("19"), last)).otherwise(last)
    day = F.when(F.length(first) == 4, last).otherwise(first)
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(middle, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when((F.size(parts) == 3) & F.year(date).between(1850, 2100), date)


def title_case(text: Column) -> Column:
    """Words in capitals get an initial capital only; mixed case stays."""
    word = lambda w: F.when((F.length(w) > 1) & (w == F.upper(w)), F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))).otherwise(w)
    return F.array_join(F.transform(F.split(text, " ", -1), word), " ")


# Legal forms that end an organisation's name.
LEGAL_FORMS = r"(?:GmbH(?: & Co\. KG)?|AG|SE|KG|OHG|UG|e\. ?V\.|Ltd\.?|LLC|Inc\.?|PLC|S\.A\.|SARL|SAS|B\.V\.|S\.L\.)"


def organisation_alias(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, rf"[ ,]+{LEGAL_FORMS}\s*$", ""))


# Words that speak for a profile, in the order in which profiles win ties.
PROFILE_WORDS = {
    "personnel_profile": [
        "mitarbeiterprofil", "beraterprofil", "kompetenzprofil", "consultant profile", "employee profile", "professional profile", "profil consultant", "perfil profesional", "consultantprofiel",
        "projekterfahrung", "berufserfahrung", "work experience", "expérience professionnelle", "experiencia profesional", "werkervaring", "skillset",
        "zertifizierungen", "certifications", "certification", "certificación", "certificaciones", "certificering",
        "unternehmen:", "company:", "entreprise:", "empresa:", "bedrijf:", "ausbildung:", "education:", "rolle im projekt", "rolle:", "role:", "rôle:", "rol:", "funktion:",
        "| rolle |", "| role |", "| rôle |", "| rol |", "| unternehmen |", "| company |", "| entreprise |", "| empresa |", "| bedrijf |", "| certifications |", "| certification |", "| certificación |", "| certificaciones |", "| certificering |",
    ],
    "applicant": ["bewerbung", "anschreiben", "lebenslauf", "curriculum vitae", "bewerber", "motivation", "arbeitszeugnis"],
    "contract": ["vertrag", "vertragspartei", "kündigung", "haftung", "vertragslaufzeit", "präambel", "zahlungspflicht", "vereinbarung", "§"],
    "customer": ["kundennummer", "kunde:", "rechnung", "bestellung", "ticket", "support", "crm", "lieferadresse", "auftragsnummer", "reklamation"],
}


def profile_of(text: Column) -> Column:
    """The profile with the most of its words in the text: personnel from three, another from two, else general."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    others = ["applicant", "contract", "customer"]

    def scores(low: Column) -> Column:
        return F.struct(*[sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias(p) for p, words in PROFILE_WORDS.items()])

    def verdict(score: Column) -> Column:
        best = F.greatest(*[F.struct(score[p].alias("score"), F.lit(-i).alias("order"), F.lit(p).alias("profile")) for i, p in enumerate(others)])
        return F.when(score["personnel_profile"] >= 3, "personnel_profile").when(best["score"] >= 2, best["profile"]).otherwise("general")

    # the text is put in small letters once, not for each word, and each word is looked for once
    return once(once(F.lower(text), scores), verdict)


def size_class(size: Column) -> Column:
    mib = 1 << 20
    return F.when(size <= mib, "tiny").when(size <= 10 * mib, "small").when(size <= 50 * mib, "medium").otherwise("large")


# Named character references that are decoded.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def visible_text(html: Column) -> Column:
    """What a reader sees of Markdown or HTML: comments, scripts and tags go (block tags leave a blank), references are decoded, emphasis marks go."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|body|html|head|title|main|blockquote|pre)\b[^>]*>", " ")
    out = F.regexp_replace(out, r"</?[A-Za-z][^>]*>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"(\*\*\*|\*\*|\*|___|__|~~)(?=\S)(.+?)(?<=\S)\1", "$2")
    return squeeze(out)


# Beginnings and ends of labels that a line break may part.
_LABEL_STARTS, _LABEL_ENDS = "Steuer|Kunden|Geburts|Versicherungs|Personal|Ausweis|Vertrags|Mitarbeiter", "ID|Identifikationsnummer|nummer|datum|Nr\\.?"


def join_labels(text: Column) -> Column:
    """Labels whose words a line break parts as one word."""
    return F.regexp_replace(text, rf"(?iu)\b({_LABEL_STARTS})(-?)[ \t]*\n[ \t]*({_LABEL_ENDS})(?![\p{{L}}])", "$1$2$3")


def promote_headers(text: Column) -> Column:
    """Tables with made-up headers (Spalte 1 and so on) whose first row is one of labels: that row is the header."""
    made = r"(?m)^\|(?: Spalte \d+ \|)+\n(\|(?: ?:?-+:? ?\|)+)\n(\|[^\n]*?"
    return F.regexp_replace(text, made + rf"(?:Passwort|Kennwort|(?:{_LABEL_STARTS})-?(?:ID|nummer|datum|Nr)|IBAN|Telefon|E-Mail)[^\n]*\|)(?=\n|\z)", "$2\n$1")


#: Fenced blocks and code spans of Markdown.
MARKDOWN_LITERAL = r"(?s)```.*?```|`[^`\n]+`"
CAPITALISED_RUN = r"(?u)(?<![\p{L}\p{N}])\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*)+"

# What the law on artificial intelligence may ask for, and the risk that persons are recognised, by profile.
AI_NOTES = {
    "applicant": "Bewerberanalyse/-filterung/-bewertung für Auswahlentscheidungen kann Annex III Beschäftigung betreffen. Kein automatisches Ranking oder Entscheiden ohne freigegebenen Governance-Prozess.",
    "personnel_profile": "Bei Beschäftigten können insbesondere Bewertung, Beförderung, Kündigung, Überwachung oder bestimmte auf Verhalten/Persönlichkeitsmerkmalen basierende Aufgabenzuweisungen Annex III betreffen. Kompetenzbeschreibung allein ist nicht automatisch High-Risk; Zweck separat klassifizieren.",
}
AI_NOTE = "Die AI-Act-Risikoklasse hängt vom nachgelagerten Verwendungszweck ab; Privacy-Verarbeitung ist keine Konformitätszertifizierung."
#: Fields of the notice: label, and the column that it shows.
NOTICE_FIELDS = [("Datenschutz-Pässe", "passes"), ("Ersetzte/erfasste Identifikatoren", "edits"), ("Automatisch freigegebene visuelle Assets", "included"), ("Auf ausdrücklichen Wunsch entfernte visuelle Assets", "removed"), ("Lokale visuelle Review-Items", "review")]


def with_notice(text: Column, profile: Column, extension: Column, **counts: Column) -> Column:
    """The text behind a comment that tells its profile, its source's format, the counts of NOTICE_FIELDS (0 where none is given), the risk and the note of its profile."""
    note = F.coalesce(*[F.when(profile == k, F.lit(v)) for k, v in AI_NOTES.items()], F.lit(AI_NOTE))
    risk = F.when(profile == "personnel_profile", "high").otherwise("context_dependent")
    fields = [F.concat(F.lit("Profil: "), profile), F.concat(F.lit("Quelle: "), F.upper(extension)), F.lit("Unterstützte Restprüfung: keine weiteren Treffer")]
    fields += [F.concat(F.lit(f"{label}: "), F.coalesce(counts.get(c, F.lit(0)), F.lit(0)).cast("string")) for label, c in NOTICE_FIELDS]
    fields += [F.concat(F.lit("Re-Identifikationsrisiko: "), risk), F.lit("Hinweis: De-Identifizierung garantiert keine rechtliche Anonymität."), F.concat(F.lit("EU AI Act: "), note)]
    return F.concat(F.lit("<!--\n"), F.concat_ws("\n", *fields), F.lit("\n-->\n\n"), text)

"""Tests of names of persons and organisations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillveil.functions.text import LEGAL_FORMS, organisation_alias, squeeze

# Words that stand before a name, by kind; academic titles stay in a text.
SALUTATIONS = r"(?:Herrn?|Frau|Mr|Mrs|Ms|Madame|Monsieur|Mme|Señora?)\.?"
TITLES = r"(?:Dr|Prof|Dipl|Ing|Mag|med|h\.c|PhD)\.?"
# Small words inside names.
PARTICLES = ["von", "van", "de", "der", "den", "zu", "zur", "la", "le", "di", "da", "dos", "el", "al", "bin"]
# Words of roles and forms of address, which are no part of a name.
STOP_WORDS = ["herr", "herrn", "frau", "mr", "mrs", "ms", "dr", "prof", "team", "leiter", "leiterin", "manager", "managerin", "entwickler", "entwicklerin", "berater", "beraterin", "kunde", "kundin", "projekt", "abteilung", "director", "engineer", "consultant", "assistant", "vertrag", "rechnung", "lebenslauf", "anschreiben", "datum", "seite", "telefon", "adresse", "contact", "name"]
# Words that make a line the title of a document.
DOCUMENT_WORDS = r"(?iu)\b(?:Lebenslauf|Curriculum Vitae|Vertrag|Rechnung|Angebot|Bericht|Protokoll|Konzept|Handbuch|Invoice|Contract|Report|Agenda|Summary)\b"
# Endings of abstract nouns.
ABSTRACT = r"(?iu)(?:ung|heit|keit|schaft|tion|tät|ment|ness|ismus)$"
# Brands that are named in the open, as upper-case names.
ALLOWED_BRANDS = ["SCRUM.ORG", "MICROSOFT", "SAP", "ATLASSIAN", "JIRA", "CONFLUENCE", "MIRO", "SAFE", "IHK", "TÜV", "ISO", "PMI", "AWS", "AMAZON WEB SERVICES", "GOOGLE", "ORACLE", "IBM", "SALESFORCE", "SERVICENOW", "GITHUB", "GITLAB", "DOCKER", "KUBERNETES", "LINUX", "WINDOWS"]

_TOKEN = r"^\p{Lu}[\p{L}'’.-]*$"


def is_stop_token(token: Column) -> Column:
    """Roles and forms of address, whatever their case and a full stop."""
    return F.lower(F.regexp_replace(token, r"\.$", "")).isin(STOP_WORDS)


def looks_name(text: Column) -> Column:
    """At most 80 characters, two to four capitalised words beside particles, none of them a role."""
    tokens = F.split(squeeze(text), " ")
    own = F.filter(tokens, lambda t: ~F.lower(t).isin(PARTICLES))
    return (F.length(text) <= 80) & (F.size(tokens) <= 7) & F.size(own).between(2, 4) & F.forall(own, lambda t: F.regexp_like(t, F.lit(_TOKEN)) & ~is_stop_token(t))


def looks_surname(text: Column) -> Column:
    """One capitalised word of two letters at least, no role."""
    return F.regexp_like(text, F.lit(r"^\p{Lu}[\p{L}'’-]+$")) & ~is_stop_token(text)


def is_document_title(text: Column) -> Column:
    return F.regexp_like(text, F.lit(DOCUMENT_WORDS))


def has_abstract_shape(text: Column) -> Column:
    """A word of the text ends as abstract nouns do."""
    return F.exists(F.split(text, " "), lambda t: (F.length(t) > 6) & F.regexp_like(t, F.lit(ABSTRACT)))


def is_allowed_organisation(name: Column) -> Column:
    return F.upper(name).isin(ALLOWED_BRANDS) | F.upper(organisation_alias(name)).isin(ALLOWED_BRANDS)


def clean_person(value: Column) -> Column:
    """The name in a labelled value: tags, links, emphasis, salutations, titles and role suffixes go, and ``Last, First`` is turned."""
    out = F.regexp_replace(value, r"<[^>]*>", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"[*_`]+", "")
    out = F.regexp_replace(out, rf"^\s*(?:{SALUTATIONS}\s+)?(?:{TITLES}\s+)*", "")
    out = F.regexp_replace(out, r"\s*[(;|].*$", "")
    turned = F.regexp_replace(out, r"^(\p{Lu}[\p{L}'’-]+), (\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?)\s*$", "$2 $1")
    return squeeze(F.regexp_replace(turned, r",.*$", ""))


_WORD = rf"(?!{LEGAL_FORMS}(?![\p{{L}}\p{{N}}]))\p{{Lu}}[\p{{L}}\p{{N}}&.-]*[ ]"
#: Up to eight capitalised words, with small words between them, and a legal form.
COMPANY = rf"(?:{_WORD}(?:(?:und|and|et|y|&)[ ](?={_WORD}))?){{1,8}}{LEGAL_FORMS}(?![\p{{L}}\p{{N}}])"

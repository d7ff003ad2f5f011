"""Fill-in-the-middle: texts cut at two unit ends and put in another order, as a transformation that can be undone.

An Arrow-batched pandas UDF goes over whole texts. The units of a text are found
by one pass of the regex library, which leaves nothing but their end offsets in
a compact array of numbers; two lookups in it give the cuts, and the pieces are
slices of the text. Where a text is cut and which form it takes follows from a
digest of the seed and the document's id, so reruns agree on any cluster.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A run of ASCII letters, or one code point of any other kind.
UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Plan:
    """Of 100 documents, ``cut`` are rearranged, and of 100 of those ``suffix_first`` put the suffix before the prefix."""

    seed: int = 1
    cut: int = 90
    suffix_first: int = 20


def unit_ends(text: str) -> array:
    """The offset at which each unit ends."""
    return array("L", (m.end() for m in UNIT.finditer(text)))


def draws(seed: int, doc_id: str) -> list[int]:
    """Four 32-bit numbers of a document: the first groups of eight digits of the digest of ``seed:doc_id``."""
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, doc_id: str, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(plan.seed, doc_id)
    if not text or h3 % 100 >= plan.cut or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    if h4 % 100 < plan.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def original(output: str, form: str) -> str:
    """The text that ``rearranged`` was given; no mark stands inside a piece, so the first one of each kind parts them."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    one, _, rest = output[len(marks[0]) :].partition(marks[1])
    two, _, middle = rest.partition(marks[2])
    return two + middle + one if form == "spm" else one + middle + two


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) of each row.

    ``n`` counts the units of the whole text. ``form`` is ``psm`` (prefix,
    suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``, where the
    text is empty, holds a mark, or is one of the share that is left as it is;
    then the two lengths are null. A null text counts as empty, a null id as an
    empty one. Repeated rows are each returned and equal, as are texts of any
    length; other columns play no part. An empty table gives no rows.
    """

    @F.pandas_udf(_FIELDS)
    def rearrange(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [rearranged(t, i, plan) for t, i in zip(texts, ids)]
        out = pd.DataFrame(found, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
        return out.assign(output_sha256=[_digest(t) for t in out["output"]])

    empty = F.lit("")
    made = docs.select(F.col(id_col).alias("doc_id"), rearrange(F.coalesce(F.col(id_col).cast("string"), empty), F.coalesce(F.col(text_col), empty)).alias("made"))
    return made.select("doc_id", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    @F.pandas_udf("string")
    def restore(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([original(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return restore(output, form)

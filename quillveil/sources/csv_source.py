"""A strict CSV source: the dialect is inferred, ragged rows and stray quotes stop the file, and the result is a Markdown table.

Spark's own reader is lenient, so files come in as whole texts and a parser
with states reads them, in pandas batches; each file is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t")


class CsvError(ValueError):
    """Carries a reason code."""


def parse(source: str, delimiter: str) -> list[list[str]]:
    """Records of a text; blank records are dropped, a quoted field may span lines."""
    rows: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    quoted = closed = False
    i, n = 0, len(source)
    while i < n:
        c = source[i]
        if quoted:
            if c != '"':
                field.append(c)
            elif source[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            else:
                quoted, closed = False, True
        elif c == delimiter or c == "\n":
            row.append("".join(field))
            field, closed = [], False
            if c == "\n":
                rows.append(row)
                row = []
        elif c == '"':
            if field or closed:
                raise CsvError("CSV_QUOTE_INVALID")
            quoted = True
        elif closed:
            raise CsvError("CSV_QUOTE_INVALID")
        else:
            field.append(c)
        i += 1
    if quoted:
        raise CsvError("CSV_QUOTE_INVALID")
    if field or row or closed:
        rows.append([*row, "".join(field)])
    # a blank line is no record; one that holds delimiters is
    return [r for r in rows if len(r) > 1 or r[0].strip()]


def dialect(source: str) -> tuple[str, list[list[str]]]:
    """The delimiter by which all rows have one width over 1, the widest; equal ones are ambiguous; without any a single column."""
    found, broken = [], None
    for delimiter in DELIMITERS:
        try:
            rows = parse(source, delimiter)
        except CsvError as e:
            broken = e
            continue
        widths = {len(r) for r in rows}
        if len(widths) == 1 and max(widths) > 1:
            found.append((max(widths), delimiter, rows))
    if found:
        top = max(w for w, _, _ in found)
        best = [x for x in found if x[0] == top]
        if len(best) > 1:
            raise CsvError("CSV_DELIMITER_AMBIGUOUS")
        return best[0][1], best[0][2]
    if broken:
        raise broken
    rows = parse(source, ",")
    if len({len(r) for r in rows}) > 1:
        raise CsvError("CSV_ROW_WIDTH_INVALID")
    return ",", rows


def _cell(value: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")):
        value = value.replace(a, b)
    return value.strip()


def to_markdown(source: str) -> str:
    """A Markdown table; empty headers are numbered, repeated ones get a count."""
    source = source.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    _, rows = dialect(source)
    if not rows:
        return ""
    seen: dict[str, int] = {}
    head = []
    for i, name in enumerate(rows[0], 1):
        name = name.strip() or f"Spalte {i}"
        seen[name] = seen.get(name, 0) + 1
        head.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    line = lambda cells: "| " + " | ".join(_cell(c) for c in cells) + " |"
    return "\n".join([line(head), "|" + " --- |" * len(head), *[line(r) for r in rows[1:]]])


def csv_documents(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows with raw bytes to (keep, markdown, reason_code); a file that fails has a reason and no text."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*keep).schema), "markdown string, reason_code string"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, reasons = [], []
            for raw in pdf[content]:
                text = reason = None
                try:
                    text = to_markdown(bytes(raw).decode("utf-8"))
                except UnicodeDecodeError:
                    reason = "TEXT_ENCODING_INVALID"
                except CsvError as e:
                    reason = str(e)
                texts.append(text)
                reasons.append(reason)
            yield pdf[list(keep)].assign(markdown=texts, reason_code=reasons)

    return files.select(*keep, content).mapInPandas(read, schema)


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    return csv_documents(spark.read.format("binaryFile").load(path))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """The texts of the files at a path, as ``text_documents`` gives them."""
    return text_documents(spark.read.format("binaryFile").load(path))


def text_documents(raw: DataFrame) -> DataFrame:
    """UTF-8 texts (path, text, reason_code) of files (path, content): the byte order mark goes, line ends are unified, texts are composed, and controls and broken bytes stop a file."""
    from quillveil.functions.text import composed, has_controls, unix_lines

    valid = F.call_function("is_valid_utf8", F.col("content"))
    text = F.regexp_replace(unix_lines(F.call_function("try_validate_utf8", F.col("content").cast("string"))), "^\ufeff", "")
    reason = F.when(~valid, "TEXT_ENCODING_INVALID").when(has_controls(text), "TEXT_CONTROL_INVALID")
    out = raw.select("path", text.alias("text"), reason.alias("reason_code"))
    return out.withColumn("text", F.when(F.col("reason_code").isNull(), composed(F.col("text"))))


# First bytes of formats, in hexadecimal.
MAGICS = {"25504446": "pdf", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "424D": "bmp", "504B0304": "zip", "D0CF11E0A1B11AE1": "cfb"}


def sniffed(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with the format of the first bytes and whether it fits the extension."""
    head = F.hex(F.expr("substring(content, 1, 8)"))
    kind = F.coalesce(*[F.when(F.startswith(head, F.lit(m)), F.lit(k)) for m, k in MAGICS.items()], F.lit("text"))
    extension = F.lower(F.regexp_extract("path", r"\.([^.\/]+)$", 1))
    expected = F.when(extension.isin("docx", "xlsx", "pptx"), "zip").when(extension.isin("jpg", "jpeg"), "jpeg").when(extension.isin("pdf", "png", "bmp"), extension).otherwise("text")
    out = files.withColumn("format", kind).withColumn("extension", extension)
    return out.withColumn("verdict", F.when(kind == "cfb", "SOURCE_ENCRYPTED").when(kind != expected, "SOURCE_TYPE_MISMATCH").otherwise("ok"))

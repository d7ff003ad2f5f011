"""Word, spreadsheet and presentation files to Markdown, in pandas batches over a binary column.

Archives are read within limits on entries and expanded bytes. A formula cell
or an unknown part does not stop a file but is told as a warning.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Entries of an archive, and bytes that they expand to.
MAX_ENTRIES, MAX_EXPANDED = 20_000, 300 << 20

# Namespaces of the file formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


class OfficeError(ValueError):
    """Carries a reason code."""


def open_archive(raw: bytes) -> dict[str, bytes]:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            entries = z.infolist()
            if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_EXPANDED:
                raise OfficeError("PARSER_RESOURCE_LIMIT")
            if any(e.flag_bits & 1 for e in entries):
                raise OfficeError("SOURCE_ENCRYPTED")
            return {e.filename: z.read(e) for e in entries if not e.is_dir()}
    except (zipfile.BadZipFile, zlib_error()) as e:
        raise OfficeError("SOURCE_CORRUPT") from e


def zlib_error() -> type[Exception]:
    import zlib

    return zlib.error


def _xml(parts: dict[str, bytes], name: str) -> ElementTree.Element:
    if name not in parts:
        raise OfficeError("SOURCE_CORRUPT")
    if b"<!DOCTYPE" in parts[name] or b"<!ENTITY" in parts[name]:
        raise OfficeError("XML_INVALID")
    try:
        return ElementTree.fromstring(parts[name])
    except ElementTree.ParseError as e:
        raise OfficeError("XML_INVALID") from e


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in cells) + " |"


def table(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    full = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join([_row(full[0]), "|" + " --- |" * width, *[_row(r) for r in full[1:]]])


#: Elements that are no text of the paragraph that they stand in: text boxes, which are blocks of their own, and what repeats them for older programs.
_APART, _AGAIN = W + "txbxContent", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
#: Elements between blocks that hold no text.
_SILENT = {"sectPr", "bookmarkStart", "bookmarkEnd", "proofErr", "permStart", "permEnd", "commentRangeStart", "commentRangeEnd", "sdtPr", "sdtEndPr", "tblPr", "tblGrid", "trPr", "tcPr", "pPr", "customXmlPr"}
#: Elements that only hold blocks.
_HOLDERS = {"sdt", "sdtContent", "customXml", "footnote", "endnote", "ins", "moveTo", "body", "hdr", "ftr"}
#: Parts that are told as unread.
_UNREAD = re.compile(r"(?:word|xl|ppt)/(?:embeddings|charts|diagrams|media|activeX)/.+\.(?!rels$)\w+|(?:word|ppt|xl)/comments\w*\.xml|(?:word|xl|ppt)/vbaProject\.bin")


def _inside(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """All elements below, but for those of text boxes."""
    for x in node:
        if x.tag not in (_APART, _AGAIN):
            yield x
            yield from _inside(x)


def _boxes(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for x in node:
        if x.tag == _APART:
            yield x
        elif x.tag != _AGAIN:
            yield from _boxes(x)


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for x in _inside(p):
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag in (W + "tab", W + "ptab"):
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif x.tag == W + "noBreakHyphen":
            out.append("-")
        elif x.tag in (W + "footnoteReference", W + "endnoteReference"):
            out.append(f"[^{x.get(W + 'id', '')}]")
    text = "".join(out)
    style = p.find(f"{W}pPr/{W}pStyle")
    level = re.fullmatch(r"(?:Heading|berschrift|heading ?)(\d)", style.get(W + "val", "")) if style is not None else None
    if level and text:
        return "#" * int(level[1]) + " " + text
    return "- " + text if text and p.find(f"{W}pPr/{W}numPr") is not None else text


def _blocks(node: ElementTree.Element, warnings: set[str]) -> list[str]:
    """The paragraphs, tables and text boxes below an element; text in anything else is read, too, and told."""
    out: list[str] = []
    for x in node:
        name = x.tag.rpartition("}")[2]
        if x.tag == W + "p":
            out.append(_paragraph(x))
            for box in _boxes(x):
                out += _blocks(box, warnings)
        elif x.tag == W + "tbl":
            out.append(table([["\n".join(_blocks(c, warnings)) for c in _held(r, W + "tc")] for r in _held(x, W + "tr")]))
        elif name in ("footnote", "endnote") and x.get(W + "type") in ("separator", "continuationSeparator", "continuationNotice"):
            continue
        elif name in ("footnote", "endnote"):
            own = [b for b in _blocks(x, warnings) if b.strip()]
            out += [f"[^{x.get(W + 'id', '')}]: " + own[0], *own[1:]] if own else []
        elif name in _HOLDERS:
            out += _blocks(x, warnings)
        elif name not in _SILENT and any(t.tag == W + "t" for t in x.iter()):
            warnings.add(f"UNKNOWN_CONSTRUCT:{name}")
            out += _blocks(x, warnings) or [_paragraph(x)]
    return out


def _held(node: ElementTree.Element, tag: str) -> Iterator[ElementTree.Element]:
    """Rows or cells, also those that content controls hold."""
    for x in node:
        if x.tag == tag:
            yield x
        elif x.tag.rpartition("}")[2] in _HOLDERS:
            yield from _held(x, tag)


def unread(parts: dict[str, bytes]) -> list[str]:
    return ["UNREAD_PART:" + n for n in sorted(parts) if _UNREAD.fullmatch(n)]


def docx(parts: dict[str, bytes]) -> tuple[str, list[str]]:
    names = sorted(n for n in parts if re.fullmatch(r"word/header\d*\.xml", n)) + ["word/document.xml"] + sorted(n for n in parts if re.fullmatch(r"word/(?:footer\d*|footnotes|endnotes)\.xml", n))
    warnings: set[str] = set()
    blocks = [b for name in names for b in _blocks(_xml(parts, name), warnings)]
    return "\n\n".join(b for b in blocks if b.strip()), sorted(warnings) + unread(parts)


def xlsx(parts: dict[str, bytes]) -> tuple[str, list[str]]:
    shared = []
    if "xl/sharedStrings.xml" in parts:
        shared = ["".join(t.text or "" for t in s.iter(S + "t")) for s in _xml(parts, "xl/sharedStrings.xml").findall(S + "si")]
    targets = {r.get("Id"): r.get("Target", "") for r in _xml(parts, "xl/_rels/workbook.xml.rels")}
    sections, formulas = [], 0
    for sheet in _xml(parts, "xl/workbook.xml").iter(S + "sheet"):
        target = targets.get(sheet.get(R + "id"), "")
        root = _xml(parts, target.lstrip("/") if target.startswith("/") else "xl/" + target)
        rows = []
        for r in root.iter(S + "row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(r.findall(S + "c")):
                formulas += c.find(S + "f") is not None
                place = re.match(r"[A-Z]+", c.get("r", ""))
                col = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(place[0]))) - 1 if place else i
                v = c.find(S + "v")
                kind = c.get("t")
                if kind == "inlineStr":
                    cells[col] = "".join(t.text or "" for t in c.iter(S + "t"))
                elif v is not None:
                    cells[col] = shared[int(v.text)] if kind == "s" else v.text or ""
            if cells and max(cells) >= 16_384:
                raise OfficeError("PARSER_RESOURCE_LIMIT")
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        sections.append(f"## {sheet.get('name')}\n\n{table([r for r in rows if r])}".strip())
    return "\n\n".join(sections), ([f"FORMULA_CELLS:{formulas}"] if formulas else []) + unread(parts)


def pptx(parts: dict[str, bytes]) -> tuple[str, list[str]]:
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    out = []
    for name in sorted((n for n in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        root = _xml(parts, name)
        inside = {id(p) for t in root.iter(A + "tbl") for p in t.iter(A + "p")}
        text = lambda p: "".join(t.text or "" for t in p.iter(A + "t"))
        blocks = [text(p) for p in root.iter(A + "p") if id(p) not in inside]
        blocks += [table([["\n".join(text(p) for p in c.iter(A + "p")) for c in r.findall(A + "tc")] for r in t.findall(A + "tr")]) for t in root.iter(A + "tbl")]
        notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
        if notes in parts:
            blocks += [text(p) for p in _xml(parts, notes).iter(A + "p")]
        out.append("\n\n".join([f"## Folie {number(name)}", *[b for b in blocks if b.strip()]]))
    return "\n\n".join(out), unread(parts)


def metadata(parts: dict[str, bytes]) -> str:
    """Document properties as lines, so that names in them are found too."""
    out = []
    for name in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"):
        if name in parts:
            out += [f"{x.tag.rpartition('}')[2]}: {x.text.strip()}" for x in _xml(parts, name).iter() if x.text and x.text.strip()]
    return "\n".join(out)


def to_markdown(raw: bytes, extension: str) -> tuple[str, list[str]]:
    parts = open_archive(raw)
    text, warnings = {"docx": docx, "xlsx": xlsx, "pptx": pptx}[extension](parts)
    more = metadata(parts)
    return f"{text}\n\n{more}".strip() if more else text, warnings


def office_documents(files: DataFrame) -> DataFrame:
    """(path, content) to (path, markdown, warnings, reason_code); a file that fails, or has no content, has a reason and no text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                extension = (path or "").rpartition(".")[2].lower()
                if raw is None:
                    rows.append((path, None, None, "SOURCE_EMPTY"))
                    continue
                if extension not in ("docx", "xlsx", "pptx"):
                    rows.append((path, None, None, "SOURCE_TYPE_UNSUPPORTED"))
                    continue
                try:
                    text, warnings = to_markdown(bytes(raw), extension)
                    rows.append((path, text, warnings, None))
                except (OfficeError, IndexError, ValueError) as e:
                    rows.append((path, None, None, str(e) if isinstance(e, OfficeError) else "SOURCE_CORRUPT"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "warnings", "reason_code"])

    return files.select("path", "content").mapInPandas(read, "path string, markdown string, warnings array<string>, reason_code string")

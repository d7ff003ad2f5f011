"""Lines and table cells of documents, and what follows from their order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillveil.functions.spans import sums_before


def _by_line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, end, text) of docs (doc_id, text); null texts have none.

    Offsets come with the lines of one text, so no shuffle is needed for them.
    """
    starts = sums_before("transform(split(text, '\\n', -1), t -> length(t) + 1)")
    placed = F.arrays_zip(F.split("text", "\n", -1).alias("text"), starts.alias("start"))
    return docs.select("doc_id", F.posexplode(placed).alias("line_no", "l")).select("doc_id", "line_no", F.col("l.start").alias("start"), (F.col("l.start") + F.length("l.text")).alias("end"), F.col("l.text").alias("text"))


def with_offsets(rows: DataFrame) -> DataFrame:
    """Offsets of lines that come as rows (doc_id, line_no, text): a running sum."""
    before = F.sum(F.length("text") + 1).over(_by_line().rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("int")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def setext_headings(rows: DataFrame) -> DataFrame:
    """Lines whose next line is an underline of = or -."""
    below = F.lead("text").over(_by_line())
    return rows.withColumn("is_heading", F.coalesce((F.trim("text") != "") & F.regexp_like(below, F.lit(r"^ {0,3}(?:=+|-+)[ \t]*$")), F.lit(False)))


def label_line_above(rows: DataFrame) -> DataFrame:
    """The nearest line with text above, at most three lines up."""
    text = F.when(F.trim("text") != "", F.col("text"))
    return rows.withColumn("above", F.last_value(text, True).over(_by_line().rowsBetween(-3, -1)))


def neighbours(rows: DataFrame, reach: int) -> DataFrame:
    """The lines up to ``reach`` before and after, joined."""
    before = F.collect_list("text").over(_by_line().rowsBetween(-reach, -1))
    after = F.collect_list("text").over(_by_line().rowsBetween(1, reach))
    return rows.withColumn("context", F.array_join(F.concat(before, after), "\n"))


def first_lines(rows: DataFrame, count: int) -> DataFrame:
    """The first ``count`` lines with text of each document, numbered."""
    found = rows.filter(F.trim("text") != "").withColumn("nth", F.row_number().over(_by_line()))
    return found.filter(F.col("nth") <= count)


def sections(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The section that each line is in: the last heading before it that one of the patterns names."""
    flag = F.coalesce(*[F.when(F.regexp_like("text", F.lit(p)), F.lit(name)) for name, p in patterns.items()])
    return rows.withColumn("section", F.last_value(flag, True).over(_by_line().rowsBetween(Window.unboundedPreceding, 0)))


def split_row(line: Column) -> Column:
    """The cells of a Markdown table row; pipes behind a backslash do not part cells."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


_SEPARATOR = r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$"


def cells(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, col, header, value) of the data rows of Markdown tables.

    A table begins with the line above a separator line and ends at the first
    line without a pipe; its rows are found by running counts of both.
    """
    piped = F.contains("text", F.lit("|"))
    below = F.lead("text").over(_by_line())
    marked = rows.withColumn("is_separator", piped & F.regexp_like("text", F.lit(_SEPARATOR)))
    is_header = piped & ~F.col("is_separator") & F.coalesce(F.regexp_like(below, F.lit(_SEPARATOR)) & F.contains(below, F.lit("|")), F.lit(False))
    marked = marked.withColumn("is_header", is_header).withColumn("island", F.sum(F.when(~piped | F.col("is_header"), 1).otherwise(0)).over(_by_line().rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("doc_id", "island")
    headers = F.max(F.when(F.col("is_header"), split_row(F.col("text")))).over(own)
    data = marked.withColumn("headers", headers).filter(piped & ~F.col("is_header") & ~F.col("is_separator") & F.col("headers").isNotNull())
    exploded = data.select("doc_id", "line_no", "headers", F.posexplode(split_row(F.col("text"))).alias("col", "value"))
    return exploded.select("doc_id", "line_no", "col", F.try_element_at("headers", F.col("col") + 1).alias("header"), "value")


#: ``stack`` is the header with what stands in its column in up to two header rows above.
CELL = "struct<start:int,end:int,header:string,line:int,stack:string>"
_BAR = re.compile(r"(?<!\\)\|")
_RULE = re.compile(_SEPARATOR)


def _placed(line: str) -> list[tuple[int, int]]:
    """Start and end of each cell of a table row, without the blanks around it."""
    begin, end = len(line) - len(line.lstrip()), len(line.rstrip())
    bars = [m.start() for m in _BAR.finditer(line, begin, end)]
    begin += bars[:1] == [begin]
    end -= len(bars) > 0 and bars[-1] == end - 1 and end > begin
    inner = [b for b in bars if begin <= b < end]
    out = []
    for a, b in zip([begin, *[x + 1 for x in inner]], [*inner, end]):
        raw = line[a:b]
        out.append((a + len(raw) - len(raw.lstrip()), max(a + len(raw.rstrip()), a + len(raw) - len(raw.lstrip()))))
    return out


def _cells_of(text: str) -> list[tuple[int, int, str, int, str]]:
    out, at, headers, stacks, head = [], 0, None, None, []
    rows = text.split("\n")
    rule = [("|" in x or "-" in x) and _RULE.match(x) is not None for x in rows]
    for i, row in enumerate(rows):
        if "|" not in row and not rule[i]:
            headers, head = None, []
        elif not rule[i]:
            found = _placed(row)
            # the last row over a rule is both: a value of the table that it ends, and the header of the next
            if headers is not None:
                out += [(at + a, at + b, h, i, s) for (a, b), h, s in zip(found, headers, stacks) if b > a]
                head = []
            head.append([row[a:b] for a, b in found])
            if i + 1 < len(rows) and rule[i + 1]:
                headers = head[-1]
                stacks = [" ".join(x[k] for x in head[-3:] if k < len(x) and x[k]) for k in range(len(headers))]
        at += len(row) + 1
    return out


def placed_cells(text: Column) -> Column:
    """The cells of ``cells`` that have a header and a value, in one text: array<CELL>.

    Offsets are those of spans. No shuffle is needed, so this can stand in a
    stream. A separator line of one column may do without pipes.
    """

    @F.pandas_udf(f"array<{CELL}>")
    def place(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _cells_of(t))

    empty = F.expr(f"cast(array() as array<{CELL}>)")
    return F.coalesce(place(F.when(F.contains(text, F.lit("|")), text)), empty)


def merge_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping intervals of a key as one: an island begins where the start is past every end before it; equal intervals are of one island."""
    ordered = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(F.col(start) > reach, 1).otherwise(0))
    # over ranges, as the first of equal intervals, which alone begins the island, may come later in this window
    island = fresh.withColumn("island", F.sum("fresh").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("island")

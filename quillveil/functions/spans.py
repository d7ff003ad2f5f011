"""Span algebra on one array of structs for each document: positions, order, overlap, rewriting.

Intervals never cross documents, so all of this is narrow: no shuffle, and
expressions only. Offsets are code points, from 0, the end exclusive. Arrays
are never grown one by one over their whole length: scans go over parts of
``PART`` elements, and then over the parts, so that the work is nearly linear.

Expressions with many lambdas are written in SQL, which is parsed at once where
the same built from column objects takes a call a node. Columns are given by
plain reference or as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a part of a scan.
PART = 128
#: Pairs of spans and lines up to which all are compared, as that takes less than sorting them.
FEW = 256


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where a lambda in ``use`` runs for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often later expressions name them."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _sql(value: Column | str) -> str:
    return value if isinstance(value, str) else f"`{value._jc.toString()}`"


def _text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Steps of a fold, of what is reached so far and the next value.
_SUM, _MOST = "{0} + x", "greatest({0}, x)"


def _fold(values: str, step: str) -> str:
    return f"aggregate({values}, 0, (reached, x) -> {step.format('reached')})"


def _scan(values: str, start: str, step: str) -> str:
    """For each value the fold of the values before it."""
    grown = step.format("acc.at")
    return f"aggregate({values}, struct({start} as at, cast(array() as array<int>) as done), (acc, x) -> struct({grown} as at, concat(acc.done, array(acc.at)) as done), acc -> acc.done)"


def _parts(values: str) -> str:
    """The array in slices of ``PART`` elements; an empty one has one empty slice."""
    return _let(values, "whole", f"transform(sequence(0, cast(floor(greatest(size(whole) - 1, 0) / {PART}) as int)), i -> slice(whole, i * {PART} + 1, {PART}))")


def _before(values: str, step: str) -> str:
    """The same over any length: where there are more than ``PART``, parts are folded, the folds scanned, and each part from there."""
    starts = _scan(f"transform(parts, p -> {_fold('p', step)})", "0", step)
    parted = _let(_parts("each"), "parts", f"flatten(zip_with(parts, {starts}, (p, s) -> {_scan('p', 's', step)}))")
    return _let(values, "each", f"if(size(each) <= {PART}, {_scan('each', '0', step)}, {parted})")


def sums_before(sizes: Column | str) -> Column:
    """For each of the integers the sum of all before it."""
    return F.expr(_before(_sql(sizes), _SUM))


def _cut(text: str, sizes: str) -> str:
    """The text in consecutive pieces of these lengths.

    A part's stretch is cut out first and then its pieces, so that no piece is searched from the beginning of a long text.
    """
    starts = _scan(f"transform(parts, p -> {_fold('p', _SUM)})", "0", _SUM)
    pieces = f"zip_with(p, {_scan('p', '0', _SUM)}, (n, o) -> substring(stretch, o + 1, n))"
    stretch = f"substring(t, s + 1, {_fold('p', _SUM)})"
    return _let(text, "t", _let(_parts(sizes), "parts", f"flatten(zip_with(parts, {starts}, (p, s) -> {_let(stretch, 'stretch', pieces)}))"))


def cut(text: Column | str, sizes: Column | str) -> Column:
    return F.expr(_cut(_sql(text), _sql(sizes)))


#: Noncharacters that mark the matches of a pattern; texts that hold one are searched in another way.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
FOUND = "array<struct<start:int,end:int,text:string>>"


def find(text: Column | str, pattern: str, needs: str | None = None) -> Column:
    """All matches of a Java pattern with their positions: array<struct<start, end, text>>.

    The matches are marked in one pass and the text is split at the marks, so the
    lengths of the parts give the positions. ``needs`` is a literal that a match
    must hold; texts without it are not searched.
    """
    return F.expr(_find(_sql(text), _text(pattern), needs))


def find_by(text: Column | str, pattern: Column | str) -> Column:
    """The same with a pattern of its own for each row, in a column; none where it is null."""
    p = _sql(pattern)
    return F.expr(f"if({p} is null, cast(array() as {FOUND}), {_find(_sql(text), p, None)})")


def _find(t: str, p: str, needs: str | None) -> str:
    sizes = "zip_with(gaps, hits, (g, h) -> length(g) + length(h))"
    starts = f"zip_with(gaps, {_before(sizes, _SUM)}, (g, b) -> b + length(g))"
    placed = f"zip_with({starts}, hits, (b, h) -> struct(b as start, b + length(h) as `end`, h as text))"
    # all pieces but the first are a match, a mark, and the gap to the next
    hits = f"transform(slice(pieces, 2, size(pieces)), y -> substring_index(y, '{_CLOSE}', 1))"
    gaps = f"transform(slice(pieces, 1, size(hits)), y -> element_at(split(y, '{_CLOSE}', -1), -1))"
    marked = _let(f"split(marked, '{_OPEN}', -1)", "pieces", _let(hits, "hits", _let(gaps, "gaps", placed)))
    found = _let(f"regexp_replace({t}, {p}, '{_OPEN}$0{_CLOSE}')", "marked", f"if(contains(marked, '{_OPEN}'), {marked}, cast(array() as {FOUND}))")
    plain = _let(f"regexp_extract_all({t}, {p}, 0)", "hits", _let(f"slice(split({t}, {p}, -1), 1, size(hits))", "gaps", placed))
    out = f"if(contains({t}, '{_OPEN}') or contains({t}, '{_CLOSE}'), {plain}, {found})"
    return f"if(contains({t}, {_text(needs)}), {out}, cast(array() as {FOUND}))" if needs else out


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def without_overlap(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: an interval anti join inside the row."""
    both = F.struct(spans.alias("spans"), others.alias("others"))
    return let(both, lambda b: F.when(F.size(b["others"]) == 0, b["spans"]).otherwise(F.filter(b["spans"], lambda s: ~F.exists(b["others"], lambda o: overlaps(s, o)))))


def _swept(points: str, spans: str, value: str, step: str) -> str:
    """For each of the spans, in order of their starts, the fold over the points (structs with a place ``a`` first) up to its start; both are sorted together, so no span looks through all points."""
    events = f"array_sort(concat(transform({points}, p -> struct(p.a as a, 0 as k, p.b as b)), transform({spans}, y -> struct(y.start as a, 1 as k, y.`end` as b))))"
    folded = _before(f"transform(events, e -> if(e.k = 0, {value}, 0))", step)
    return _let(events, "events", f"transform(filter(zip_with(events, {folded}, (e, r) -> struct(e.k as k, r as r)), z -> z.k = 1), z -> z.r)")


def inside(spans: str, covers: str) -> Column:
    """For each of the spans, which are disjoint and in order as the covers are, whether one of the covers holds it."""
    reach = _swept("transform(covers, c -> struct(c.start as a, c.`end` as b))", "spans", "e.b", _MOST)
    held = f"zip_with(spans, {reach}, (y, r) -> y.`end` <= r)"
    return F.expr(_let(_sql(spans), "spans", _let(_sql(covers), "covers", f"if(size(covers) = 0, transform(spans, y -> false), {held})")))


def line_numbers(spans: str, starts: str) -> Column:
    """For each of the spans, in order of their starts, the number of its line from 1; ``starts`` are those of the lines."""
    swept = _swept("transform(starts, a -> struct(a as a, 0 as b))", "spans", "1", _SUM)
    count = f"if(size(spans) * size(starts) <= {FEW}, transform(spans, y -> size(filter(starts, a -> a <= y.start))), {swept})"
    return F.expr(_let(_sql(spans), "spans", _let(_sql(starts), "starts", f"if(size(spans) = 0, cast(array() as array<int>), {count})")))


def within(spans: Column, covers: Column) -> Column:
    """The spans that one of the covers contains: an interval semi join inside the row."""
    both = F.struct(spans.alias("spans"), covers.alias("covers"))
    return let(both, lambda b: F.filter(b["spans"], lambda s: F.exists(b["covers"], lambda c: (s["start"] >= c["start"]) & (s["end"] <= c["end"]))))


def _islands(ordered: str, each: str) -> str:
    """``each`` of the islands of spans in order of their starts: one begins where a start is not before any end before it."""
    reach = _before("transform(spans, y -> y.`end`)", _MOST)
    firsts = _let(reach, "reach", "filter(sequence(1, size(spans)), k -> k = 1 or element_at(spans, k).start >= element_at(reach, k))")
    slices = "transform(firsts, (a, k) -> slice(spans, a, coalesce(try_element_at(firsts, k + 2), size(spans) + 1) - a))"
    return _let(ordered, "spans", f"if(size(spans) = 0, array(), {_let(firsts, 'firsts', f'transform({slices}, island -> {each})')})")


def resolve(spans: Column | str, kind: str) -> Column:
    """Disjoint spans in text order: the higher priority, then the longer, the earlier, the earlier detector wins.

    ``kind`` is the type of the array; its structs have priority, start, end and
    rank. Only spans of one island are compared.
    """
    ordered = f"transform(array_sort(transform({_sql(spans)}, y -> struct(y.start as a, y.`end` as b, y.rank as r, y as span))), y -> y.span)"
    ranked = "transform(array_sort(transform(island, y -> struct(-y.priority as p, y.start - y.`end` as l, y.start as a, y.rank as r, y as span))), y -> y.span)"
    kept = f"aggregate({ranked}, cast(array() as {kind}), (kept, y) -> if(exists(kept, k -> k.start < y.`end` and y.start < k.`end`), kept, concat(kept, array(y))))"
    winners = f"if(size(island) = 1, cast(island as {kind}), transform(array_sort(transform({kept}, y -> struct(y.start as a, y as span))), y -> y.span))"
    return F.expr(f"cast(flatten({_islands(ordered, winners)}) as {kind})")


def _rewrite(text: str, spans: str) -> str:
    sizes = "concat(flatten(transform(spans, (y, k) -> array(y.start - element_at(ends, k + 1), y.`end` - y.start))), array(length(text) - element_at(ends, -1)))"
    ends = "concat(array(0), transform(spans, y -> y.`end`))"
    joined = "array_join(concat(flatten(transform(spans, (y, k) -> array(element_at(pieces, 2 * k + 1), y.replacement))), array(element_at(pieces, -1))), '')"
    rewritten = _let(ends, "ends", _let(_cut("text", sizes), "pieces", joined))
    whole = _let(text, "text", _let(spans, "spans", f"if(size(spans) = 0, text, {rewritten})"))
    return f"if({text} is not null and {spans} is not null, {whole}, null)"


def rewrite(text: Column | str, spans: Column | str) -> Column:
    """The text with each of the disjoint, ordered spans replaced by its ``replacement``."""
    return F.expr(_rewrite(_sql(text), _sql(spans)))


def mask(text: Column | str, spans: Column | str) -> Column:
    """The text with the spans blanked, of the same length."""
    blanks = f"transform({_sql(spans)}, y -> struct(y.start as start, y.`end` as `end`, repeat(' ', y.`end` - y.start) as replacement))"
    return F.expr(_rewrite(_sql(text), blanks))


def merged(spans: Column | str) -> Column:
    """Overlapping or touching ranges as one each: array<struct<start, end>>."""
    # a range that begins where another ends touches it, so ends reach one further here
    ranges = f"array_sort(transform({_sql(spans)}, y -> struct(y.start as start, y.`end` + 1 as `end`)))"
    return F.expr(_islands(ranges, "struct(element_at(island, 1).start as start, array_max(transform(island, y -> y.`end`)) - 1 as `end`)"))


def moved(spans: Column | str) -> Column:
    """Each span with its place in the rewritten text: out_start, out_end."""
    shifts = _before("transform(spans, y -> length(y.replacement) - (y.`end` - y.start))", _SUM)
    placed = f"zip_with(spans, {shifts}, (y, b) -> struct(y.start as start, y.`end` as `end`, y.start + b as out_start, y.start + b + length(y.replacement) as out_end))"
    return F.expr(_let(_sql(spans), "spans", placed))

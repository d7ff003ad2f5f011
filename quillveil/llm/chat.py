"""Chat formatting in DataFrame expressions only.

A conversation's turns are collected as structs and sorted, neighbouring turns
of a role are merged into one block with an array aggregation over the block's
slice of them, and the blocks are concatenated. A text stands between turn marks, and the characters that
marks are made of are escaped in texts and roles, so the output reads back to
the very turns it was made of:

    ### user
    <turn>Hi</turn><turn>are you there?</turn>
    ### assistant
    <turn>Yes.</turn>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillveil.functions.spans import let

HEAD, OPEN, CLOSE = "### ", "<turn>", "</turn>"
#: The role whose texts the loss counts.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    r"""``\`` becomes ``\\``, ``#`` becomes ``\h`` and ``<`` becomes ``\l``."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    # between doubled backslashes, taken from the left, a single one begins an escape
    between = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(between, lambda s: F.replace(F.replace(s, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))), "\\")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_runs) of each conversation.

    ``loss_runs`` is the loss mask over the characters of ``formatted`` in runs
    (chars, trained): the texts of the trained role, without their marks, are
    under the mask. Null roles and texts count as empty; an empty turn keeps its
    marks. Turns are in the order of their numbers, null first; equal numbers
    and repeated rows follow role and text, and all stay. A null id is a
    conversation of its own. An empty table gives no rows.
    """
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    grouped = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # a block begins where the role differs from that of the turn before
    role_at = lambda i: F.element_at("turns", i.cast("int"))["role"]
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (role_at(i) != role_at(F.greatest(i - 1, F.lit(1)))))
    starts = grouped.select("conv_id", "turns", first.alias("starts"))

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("starts", k + 2), F.size("turns") + 1)
        own = F.slice("turns", start, end - start)
        return F.struct(role_at(start).alias("role"), F.aggregate(own, empty, lambda acc, t: F.concat(acc, F.lit(OPEN), escaped(t["text"]), F.lit(CLOSE))).alias("body"), F.transform(own, lambda t: F.length(escaped(t["text"]))).alias("chars"))

    blocks = starts.select("conv_id", F.transform("starts", block).alias("blocks"))
    head = lambda b, k: F.concat(F.when(k == 0, empty).otherwise(F.lit("\n")), F.lit(HEAD), escaped(b["role"]), F.lit("\n"))
    whole = F.array_join(F.transform("blocks", lambda b, k: F.concat(head(b, k), b["body"])), "")
    run = lambda chars, trained: F.struct(chars.cast("long").alias("chars"), trained.alias("trained"))

    def runs_of(b: Column, k: Column) -> Column:
        texts = F.transform(b["chars"], lambda n: F.array(run(F.lit(len(OPEN)), F.lit(False)), run(n, b["role"] == TRAINED), run(F.lit(len(CLOSE)), F.lit(False))))
        return F.concat(F.array(run(F.length(head(b, k)), F.lit(False))), F.flatten(texts))

    return blocks.select("conv_id", whole.alias("formatted"), F.flatten(F.transform("blocks", runs_of)).alias("loss_runs"))


#: Runs that are cut out of one part of a text, so that long conversations are not searched from their beginning for each.
_PART = 128


def _begins(sizes: Column) -> Column:
    """The sum of the sizes before each."""
    none = F.expr("cast(array() as array<bigint>)")
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["done"], F.array(acc["at"])).alias("done"))
    return F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("at"), none.alias("done")), step, lambda acc: acc["done"])


def _cut(text: Column, parts: Column, sizes: Column) -> Column:
    """Each part with its text: array<struct<part, text>>; the texts follow one another and are so long."""
    both = F.struct(text.alias("text"), parts.alias("parts"), sizes.alias("sizes"))

    def use(x: Column) -> Column:
        placed = F.arrays_zip(x["parts"].alias("part"), x["sizes"].alias("size"), _begins(x["sizes"]).alias("begin"))
        return F.transform(placed, lambda p: F.struct(p["part"].alias("part"), F.substring(x["text"], p["begin"].cast("int") + 1, p["size"].cast("int")).alias("text")))

    return let(both, use)


def trained_text(formatted: Column, loss_runs: Column) -> Column:
    """The text under the loss mask, unescaped, one turn after the other."""
    total = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["chars"])
    parts = let(loss_runs, lambda runs: F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / _PART).cast("int")), lambda i: F.slice(runs, i * _PART + 1, F.lit(_PART))))
    cut = let(parts, lambda p: _cut(formatted, p, F.transform(p, total)))
    texts = F.transform(cut, lambda c: F.transform(F.filter(_cut(c["text"], c["part"], F.transform(c["part"], lambda r: r["chars"])), lambda r: r["part"]["trained"]), lambda r: unescaped(r["text"])))
    return F.array_join(F.flatten(texts), "")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, HEAD, -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, f"\n{OPEN}", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block))
        texts = F.split(body, CLOSE, -1)
        texts = F.slice(texts, 1, F.size(texts) - 1)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(F.substring(t, F.lit(len(OPEN) + 1), F.length(t))).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))

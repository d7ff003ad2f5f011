"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. It is found by its depth and a
128-bit fingerprint, the exclusive or of the hashes of place, role and text, so
that fingerprints of all prefixes are running totals; a node's name is its
smallest member and its depth, which no other node shares.

Of each node the child with most members goes on its path, and the other
children begin paths of their own. Those have at most half of the members, so
that no way from the root changes path more than log2(conversations) times.
Sums over subtrees are taken path by path, deepest level of paths first: a
running total from a path's end to its top, and the total at the top is added to
the node that the path hangs from, which is on a path of the level above. Every
node takes part in one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.common import discard, written
from quillveil.llm.ordered import running

#: Conversations of one node whose numbers are joined into one string.
CHUNK = 1 << 16


def rebuilt(turns: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """(conv, depth, r1, r2, bytes) of each turn of the rebuilt conversations, and a row of depth 0 for each conversation.

    A conversation begins with the first h turns of the first of its family of
    ``family`` numbers, all of them if there are fewer and none if there is no
    such conversation, and goes on with its own turns after its first h; h is
    the crc32 of its decimal number, modulo ``shared``. Turns are ordered by
    number, null first, then by role and text; null roles and texts are empty.
    Rows without a conversation's number belong to none and are left out.
    """
    empty = F.lit("")
    named = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.lit(1).cast("long").alias("one"))
    numbered, sorted_ = running(named, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {"place": ("sum", "one")})
    short = written(numbered.select("conv", "place", F.xxhash64("role", "text").alias("r1"), F.xxhash64(F.lit(1), "role", "text").alias("r2"), F.octet_length("text").cast("long").alias("bytes")))
    discard(sorted_)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).alias("h")
    convs = short.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), h)
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = written(convs.join(sizes, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    own = short.join(convs, "conv").filter("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "r1", "r2", "bytes")
    heads = short.filter(F.col("place") < shared).withColumnRenamed("conv", "base")
    head = convs.join(heads, "base").filter("place <= h").select("conv", F.col("place").alias("depth"), "r1", "r2", "bytes")
    zero = F.lit(0).cast("long")
    top = convs.select("conv", zero.alias("depth"), zero.alias("r1"), zero.alias("r2"), zero.alias("bytes"))
    out = written(own.unionByName(head).unionByName(top))
    discard(short, convs)
    return out


def _joined(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of ends (node, depth, conv): the digest of the conversations' numbers, ascending, joined by commas.

    Numbers are joined in chunks, and the chunks of a node go through one digest
    in their order, one after the other, so no task holds all of a node.
    """
    placed, sorted_ = running(ends.withColumn("one", F.lit(1).cast("long")), ["node", "depth"], [F.col("conv")], {"place": ("sum", "one")})
    chunk = F.floor((F.col("place") - 1) / CHUNK).alias("chunk")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = written(placed.groupBy("node", "depth", chunk).agg(text.alias("text")))
    discard(sorted_)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, so_far = None, None
        names = ["node", "depth", "ends_sha256"]
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for node, depth, text in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "text"))):
                if at != (node, depth):
                    if at:
                        out.append((*at, so_far.hexdigest()))
                    at, so_far = (node, depth), hashlib.sha256()
                else:
                    so_far.update(b",")
                so_far.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, so_far.hexdigest())], names=names)

    in_order = chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk")
    out = written(in_order.select("node", "depth", "text").mapInArrow(digest, "node long, depth long, ends_sha256 string"))
    discard(chunks)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``conv_id`` is the smallest member, ``n_leaves`` counts the childless nodes
    of the subtree, ``saved_tokens`` sums over it the UTF-8 bytes of each node's
    last text for all members but one, and ``ends_sha256`` is the digest of the
    members that end at the node. What becomes of nulls and of equal turns is
    told at ``rebuilt``; a repeated row is a turn of its own. A conversation
    that has no turns once it is rebuilt ends at the root. Without
    conversations there is no root either.
    """
    turns_ = rebuilt(turns)
    hashed = turns_.withColumn("x1", F.when(F.col("depth") > 0, F.xxhash64("depth", "r1", "r2")).otherwise(F.lit(0).cast("long"))).withColumn("x2", F.when(F.col("depth") > 0, F.xxhash64(F.lit(2), "depth", "r1", "r2")).otherwise(F.lit(0).cast("long")))
    keyed, sorted_ = running(hashed.select("conv", "depth", "bytes", "x1", "x2"), ["conv"], [F.col("depth")], {"k1": ("xor", "x1"), "k2": ("xor", "x2")})
    members = written(keyed.select("conv", "depth", "bytes", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2")))
    discard(turns_, sorted_)

    key = ["depth", "k1", "k2"]
    found = written(members.groupBy(*key).agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2")))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"))
    linked = written(found.join(above, ["depth", "p1", "p2"], "left").select(*key, "node", "parent", "n_convs", "bytes"))
    # the child with most members goes on the path
    heavy = F.max(F.struct("n_convs", (-F.col("node")).alias("first")))["first"]
    children = linked.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), (-heavy).alias("heavy"))
    children = written(children)
    chosen = children.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), "heavy")
    nodes = linked.join(children.select("node", "depth", "n_children"), ["node", "depth"], "left").join(chosen, ["parent", "depth"], "left")
    nodes = written(nodes.select(*key, "node", "parent", "n_convs", "bytes", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce(F.col("node") != F.col("heavy"), F.lit(True)).alias("top")))
    discard(found, linked, children)

    # along the way from the root to a node: the last top, and how many there are
    named = members.join(nodes.select("node").distinct(), F.col("conv") == F.col("node"), "left_semi")
    way = named.join(nodes.select(*key, "node", "top"), key).select("conv", "depth", "node", F.when(F.col("top"), F.struct("depth", "node")).alias("begins"), F.col("top").cast("long").alias("tops"))
    placed, sorted_ = running(way, ["conv"], [F.col("depth")], {"path": ("max", "begins"), "level": ("sum", "tops")})
    # a node is on the way of its smallest member
    placed = placed.filter("conv = node").select("node", "depth", F.col("path.node").alias("path"), F.col("path.depth").alias("path_depth"), "level")
    zero = F.lit(0).cast("long")
    paths = nodes.join(placed, ["node", "depth"]).select("node", "depth", "parent", "path", "path_depth", "level", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    paths = written(paths)
    discard(sorted_)

    # one number
    deepest = paths.agg(F.max("level")).first()[0]
    summed: list[DataFrame] = []
    hanging = None
    for level in range(deepest or 0, 0, -1):
        here = paths.filter(F.col("level") == level)
        if hanging is not None:
            here = here.join(hanging, ["node", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        sums, sorted_ = running(here, ["path", "path_depth"], [F.col("depth").desc()], {"n_leaves": ("sum", "leaves"), "saved_tokens": ("sum", "saved")})
        done = written(sums.select("node", "depth", "parent", "path_depth", "n_leaves", "saved_tokens"))
        discard(sorted_)
        hanging = done.filter("depth = path_depth and depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        summed.append(done.select("node", "depth", "n_leaves", "saved_tokens"))

    last = members.groupBy("conv").agg(F.max("depth").alias("depth"))
    ends = members.join(last, ["conv", "depth"]).select("conv", *key).join(nodes.select(*key, "node"), key).select("node", "depth", "conv")
    digests = _joined(ends)
    discard(members, paths)
    totals = reduce(DataFrame.unionByName, summed) if summed else nodes.select("node", "depth", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    whole = nodes.join(totals, ["node", "depth"]).join(digests, ["node", "depth"], "left")
    nothing = hashlib.sha256().hexdigest()
    return whole.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))

"""Identities across documents: dictionaries, pseudonyms, and the overview of what was replaced."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillveil.lineage import settle

#: Aliases up to which they are sent to the documents.
SMALL = 10_000


def first_seen_numbers(mentions: DataFrame, kind: str, name: str, order: str) -> DataFrame:
    """Numbers of the identities of each kind in the order in which they are first seen: (kind, name, number).

    Only the first place of each identity is ranked; equal places go by name. The
    identities are sorted over all partitions, numbered inside each, and moved on
    by what the partitions before hold, so no task sees all of a kind.
    """
    first = mentions.groupBy(kind, name).agg(F.min(order).alias("first_seen"))
    # which partition a row is in must hold for both uses below
    placed = settle(first.repartitionByRange(kind, "first_seen", name).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(kind, "part").orderBy("first_seen", name))
    # one row a kind and partition
    sizes = placed.groupBy(kind, "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(kind).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("inside", inside).join(sizes.select(kind, "part", earlier.alias("earlier")), [kind, "part"])
    return numbered.select(kind, name, (F.col("inside") + F.col("earlier")).cast("int").alias("number"))


def readable_pseudonyms(numbered: DataFrame, kind: str) -> DataFrame:
    """[KIND_001] and so on; wider numbers keep all their digits."""
    digits = F.greatest(F.lit(3), F.length(F.col("number").cast("string")))
    return numbered.withColumn("pseudonym", F.concat(F.lit("["), F.upper(kind), F.lit("_"), F.lpad(F.col("number").cast("string"), digits, "0"), F.lit("]")))


def keyed_pseudonym(value: Column, seed: str, kind: str, size: int = 10) -> Column:
    """A base32 prefix of HMAC-SHA-256 over kind and value; the seed is an input, never drawn here."""

    @F.pandas_udf(StringType())
    def digest(values: pd.Series) -> pd.Series:
        import base64
        import hashlib
        import hmac

        def one(v: str | None) -> str | None:
            if v is None:
                return None
            raw = hmac.new(seed.encode(), f"{kind}\0{v}".encode(), hashlib.sha256).digest()
            return base64.b32encode(raw).decode()[:size]

        return values.map(one)

    return digest(value)


def collision_free(values: DataFrame, name: str, seed: str, kind: str, sizes: tuple[int, ...] = (10, 12, 14)) -> DataFrame:
    """(name, pseudonym) of distinct values, wider by two where prefixes collide."""
    distinct = values.select(name).distinct().filter(F.col(name).isNotNull())
    full = distinct.withColumn("code", keyed_pseudonym(F.col(name), seed, kind, sizes[-1]))
    chosen = F.lit(None).cast("string")
    for size in reversed(sizes):
        alone = F.count(F.lit(1)).over(Window.partitionBy(F.substring("code", 1, size))) == 1
        full = full.withColumn(f"alone_{size}", alone)
        chosen = F.when(F.col(f"alone_{size}"), F.substring("code", 1, size)).otherwise(chosen)
    return full.select(name, F.concat(F.lit(f"[{kind}_"), F.coalesce(chosen, F.col("code")), F.lit("]")).alias("pseudonym"))


def alias_table(identities: DataFrame, name: str, alias: Column, pseudonym: str, kind: str, least: int = 3) -> DataFrame:
    """Aliases of identities; one that several identities share is ambiguous: (alias, pseudonym, identities)."""
    rows = identities.select(alias.alias("alias"), F.col(pseudonym).alias("p"), name).filter(F.length("alias") >= least)
    out = rows.groupBy("alias").agg(F.count_distinct("p").alias("identities"), F.min("p").alias("only"))
    return out.select("alias", F.when(F.col("identities") == 1, F.col("only")).otherwise(F.lit(f"[{kind}_UNKLAR]")).alias("pseudonym"), "identities")


def overview(occurrences: DataFrame, key: str, replacement: str, identity: str, original: str) -> DataFrame:
    """Each replacement of a document that stands for exactly one identity, with its originals, and how many do not."""
    grouped = occurrences.groupBy(key, replacement).agg(F.count_distinct(identity).alias("identities"), F.array_join(F.array_sort(F.collect_set(original)), "|").alias("originals"), F.count(F.lit(1)).alias("occurrences"))
    ambiguous = F.count_if(F.col("identities") != 1).over(Window.partitionBy(key))
    return grouped.withColumn("ambiguous", ambiguous).filter(F.col("identities") == 1).drop("identities")


def aligned(originals: DataFrame, outputs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th occurrence of a value in the source with the n-th in the output, where both have as many."""
    own = Window.partitionBy(*keys).orderBy(order)
    number = lambda d, name: d.select(*keys, F.col(order).alias(name), F.row_number().over(own).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(f"n_{name}"))
    joined = number(originals, "source_start").join(number(outputs, "output_start"), [*keys, "nth"])
    return joined.filter("n_source_start = n_output_start").drop("n_source_start", "n_output_start")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """For each left row the right row of its key that is nearest, the earlier of two; null without any.

    Both sides are merged in order, so the nearest before and after come from
    running windows and no pairs of a key are made.
    """
    both = left.select(key, F.col(at).alias("at"), F.lit(1).alias("side")).unionByName(right.select(key, F.col(at).alias("at"), F.lit(0).alias("side")))
    value = F.when(F.col("side") == 0, F.col("at"))
    ordered = Window.partitionBy(key).orderBy("at", "side")
    before = F.last_value(value, True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # the same running frame in the opposite order, as a frame that ends at the end is searched anew for each row
    backwards = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("side"))
    after = F.last_value(value, True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    out = both.select(key, "at", "side", before.alias("before"), after.alias("after")).filter("side = 1")
    near = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col("at") - F.col("before") <= F.col("after") - F.col("at"), F.col("before")).otherwise(F.col("after"))
    return out.select(key, "at", near.alias("nearest"))


def known_aliases(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that documents name: token n-grams equal to an alias: (doc_id, alias, occurrences).

    N-grams are made inside a document, as long as the longest alias, and meet
    the aliases by an equi-join; the first token of an alias prunes them before.
    An alias is cut into tokens as the documents are. Up to ``SMALL`` aliases
    are sent to the documents, of which only what was found is shuffled then;
    more of them are met by shuffles of the tokens.
    """
    cut = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    named = aliases.select("alias", cut("alias").alias("tokens")).filter(F.size("tokens") > 0).distinct()
    longest, count = named.agg(F.max(F.size("tokens")), F.count(F.lit(1))).first()
    longest = longest or 0
    if count <= SMALL:
        # a table made in Python tells Spark no size
        named = F.broadcast(named)
    tokens = docs.select("doc_id", cut("text").alias("tokens"))
    firsts = named.select(F.element_at("tokens", 1).alias("first")).distinct()
    if count <= SMALL:
        firsts = F.broadcast(firsts)
    # each token with the few that follow it, not with the whole text
    windows = F.transform("tokens", lambda t, i: F.slice("tokens", i + 1, F.lit(longest)))
    placed = tokens.select("doc_id", F.explode_outer(windows).alias("window")).filter(F.col("window").isNotNull()).withColumn("first", F.try_element_at("window", F.lit(1))).join(firsts, "first", "left_semi")
    grams = F.transform(F.sequence(F.lit(1), F.size("window")), lambda n: F.array_join(F.slice("window", F.lit(1), n), " "))
    return placed.select("doc_id", F.explode(grams).alias("gram")).join(named.select("alias", F.array_join("tokens", " ").alias("gram")), "gram").groupBy("doc_id", "alias").agg(F.count(F.lit(1)).alias("occurrences"))


def extend_registry(registry: DataFrame, mentions: DataFrame, kind: str, name: str, order: str) -> DataFrame:
    """(kind, name, number): the registry as it is, and new identities of the mentions numbered on from its highest."""
    new = mentions.join(registry.select(kind, name), [kind, name], "left_anti")
    highest = registry.groupBy(kind).agg(F.max("number").alias("highest"))
    numbered = first_seen_numbers(new, kind, name, order).join(highest, kind, "left")
    return registry.select(kind, name, "number").unionByName(numbered.select(kind, name, (F.col("number") + F.coalesce("highest", F.lit(0))).cast("int").alias("number")))

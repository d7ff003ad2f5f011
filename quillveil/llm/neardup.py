"""Near-duplicate groups by circulant MinHash, with links confirmed on full sets.

Two permutations make all coordinates of a signature. The first maps a shingle
to a place on a ring of 2**32 places, the second ranks the places, and
coordinate k is the least rank after the ring was turned k steps. Coordinates
are cut into bands, and documents that share a band are candidates.

Texts with equal sets are one class from the start. Of each band's bucket the
class with the smallest random priority is the hub, and every other class of it
is compared with the hub on full sets, which keeps the candidates linear in a
bucket's size. What a class lacks of its hub and has beyond it is kept, so
classes under a hub that ended up in different components are compared with
each other exactly too, from those differences, in tiles of bounded size: every
pair that shares a bucket is either in one component already or compared.

A link of two sets with a Jaccard similarity of 0.8 is missed by all bands with
a probability of about 3e-6 at the default 32 bands of 5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm import textkernel as tk
from quillveil.llm.common import column, discard, free_names, grows, row_key, settle, written
from quillveil.llm.components import connected_components

BANDS, ROWS = 32, 5
#: Classes of a hub in one tile, on either side.
TILE = 512
#: Rows with sets in one Arrow batch.
SET_ROWS = 512
#: Parts that the classes of one hub are dealt to where they meet what is known of it.
SALT = 32

_U32 = np.uint32


def rank32(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the 32-bit numbers, in place."""
    x ^= x >> _U32(16)
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def circulant_signature(hashes: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """(texts, size) signatures of the sets hashes[bounds[i]:bounds[i + 1]]; empty sets have zeros."""
    texts = len(bounds) - 1
    out = np.zeros((texts, size), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        places = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = bounds[full]
        for k in range(size):
            out[full, k] = np.minimum.reduceat(rank32(places + _U32(k * 0x9E3779B1 % (1 << 32))), starts)
    return out


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(tk.mix64(hashes ^ np.uint64(salt)), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) bucket keys; keys of different bands differ."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = tk.mix64(key * np.uint64(0x9FB21C651E98DF25) + signature[:, b * rows + r].astype(np.uint64))
        out[:, b] = key
    return out.view(np.int64)


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def signatures(docs: DataFrame, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, n_shingles, f1, f2, keys) of each row of docs (doc_id, row, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch.column("text")):
                hashes, bounds = tk.shingle_sets(tk.words(part, lower=True), shingle_words)
                f1, f2 = fingerprints(hashes, bounds)
                keys = band_keys(circulant_signature(hashes, bounds, bands * rows), bands, rows)
                sizes = np.diff(bounds)
                full = sizes > 0
                ends = np.concatenate([[0], np.cumsum(full * bands)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, len(part)), batch.column("row").slice(part.first, len(part)), pa.array(sizes.astype(np.int64)), pa.array(f1), pa.array(f2), _lists(keys[full].reshape(-1), ends)], names=["doc_id", "row", "n_shingles", "f1", "f2", "keys"])

    return docs.mapInArrow(sign, "doc_id long, row long, n_shingles long, f1 long, f2 long, keys array<long>")


def full_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(id, shingles) of docs (text, id, f1, f2): the sorted 64-bit shingle hashes, where the set is the one of these sums."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, want1, want2 = (batch.column(c).to_numpy() for c in ("id", "f1", "f2"))
            for part in tk.slices(batch.column("text")):
                hashes, bounds = tk.shingle_sets(tk.words(part, lower=True), shingle_words)
                f1, f2 = fingerprints(hashes, bounds)
                here = slice(part.first, part.first + len(part))
                own = ids[here]
                at = np.flatnonzero((f1 == want1[here]) & (f2 == want2[here]))
                raw = [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(raw, pa.binary())], names=["id", "shingles"])

    return docs.select("text", "id", "f1", "f2").mapInArrow(collect, "id long, shingles binary")


def _compare(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, hub_sizes, lacks, extra = [], [], [], [], []
            for x, y in zip(batch.column("shingles"), batch.column("hub_shingles")):
                own, hub = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                shared = hub[at] == own
                both = int(shared.sum())
                linked.append(100 * both >= percent * (len(own) + len(hub) - both))
                sizes.append(len(own))
                hub_sizes.append(len(hub))
                without = np.ones(len(hub), bool)
                without[at[shared]] = False
                lacks.append(hub[without].tobytes())
                extra.append(own[~shared].tobytes())
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip((linked, sizes, hub_sizes, lacks, extra), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hub"), *cols], names=["id", "hub", "linked", "size", "hub_size", "lacks", "extra"])

    return compare


def _incidence(differences: list[np.ndarray]) -> np.ndarray:
    """Rows of 0 and 1 over the values that at least two of the differences have."""
    flat = np.concatenate(differences) if differences else np.zeros(0, np.uint64)
    values, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(differences)), [len(d) for d in differences])
    keep = times[inverse] > 1
    out = np.zeros((len(differences), int((times > 1).sum())), np.float32)
    out[row[keep], column[inverse[keep]]] = 1
    return out


def _match_tile(percent: int):
    """Compares the strays of a tile with its other classes; gives links that join components, a spanning set of them."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        stray = pdf[pdf["side"] == 1].drop_duplicates("id")
        other = pdf[pdf["side"] == 0].drop_duplicates("id")
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        # sets of differences: what is lacking and what is extra never mix, as one is in the hub and the other is not
        read = lambda f: [np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]) for a, b in zip(f["lacks"], f["extra"])]
        hub_size = int(pdf["hub_size"].max()) if len(pdf) else 0
        size_s, size_o = stray["size"].to_numpy(float), other["size"].to_numpy(float)
        lack_s = np.array([len(x) // 8 for x in stray["lacks"]], float)
        lack_o = np.array([len(x) // 8 for x in other["lacks"]], float)
        ids_s, ids_o = stray["id"].tolist(), other["id"].tolist()
        comp_s, comp_o = stray["component"].tolist(), other["component"].tolist()
        diff_s, diff_o = read(stray), read(other)
        step = 64
        for i in range(0, len(ids_s), step):
            for j in range(0, len(ids_o), step):
                m = _incidence(diff_s[i : i + step] + diff_o[j : j + step])
                k = min(step, len(ids_s) - i)
                # both have the hub but for what either lacks, and what both have beyond it
                both = hub_size - lack_s[i : i + step, None] - lack_o[None, j : j + step] + m[:k] @ m[k:].T
                union = size_s[i : i + step, None] + size_o[None, j : j + step] - both
                for p, q in zip(*np.nonzero(100 * both >= percent * union)):
                    a, b = root(comp_s[i + p]), root(comp_o[j + q])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        found.append((comp_s[i + p], comp_o[j + q]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return match


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of every node; those without links are their own."""
    roots = connected_components(links)
    return nodes.join(grows(roots), nodes["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Words are lower-cased in A-Z. Documents are linked when their sets of
    distinct shingles have at least ``percent`` of their union in common. A text
    with fewer words than a shingle has its whole sequence as one; null texts
    and those without words have none and are linked with nothing. The
    component is the smallest id reachable, itself included, and a row is kept
    if that is its own. Repeated rows are each returned. A row without an id
    takes part, has the component of its group, null if no row of it has an id,
    and is kept only then. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    grouped = _grouped(named, shingle_words, percent, bands, rows).withColumn("component_id", F.col("first.doc_id"))
    return grouped.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _grouped(named: DataFrame, shingle_words: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, n_shingles, first) of each row of ``named`` (doc_id, row, text).

    ``row`` is a key of the row that it has in every run. ``first`` (no_id,
    doc_id, row) names the row of the component with the smallest id, or with
    the smallest key if none has an id. Texts without shingles name themselves.
    """
    own_first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    signed = written(signatures(named, shingle_words, bands, rows))
    # classes of equal sets; f1 names a class, or both sums where several classes have it
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("f1", "f2").agg(F.min(own_first).alias("first"), F.first("keys").alias("keys"))
    shared = full.groupBy("f1").agg(F.min("f2").alias("least"), F.max("f2").alias("most")).filter("least <> most").select("f1", F.lit(True).alias("shared"))
    classes = written(classes.join(shared, "f1", "left").withColumn("id", F.when(F.col("shared"), F.xxhash64("f1", "f2")).otherwise(F.col("f1"))).drop("shared"))
    banded = classes.select("id", F.explode("keys").alias("key"))
    priority = F.struct(F.xxhash64("id").alias("p"), "id")
    hubs = banded.groupBy("key").agg(F.min(priority)["id"].alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub")
    edges = written(banded.join(grows(hubs), "key").filter("id <> hub").select("id", "hub").distinct())
    nodes = written(edges.select("id").union(edges.select(F.col("hub").alias("id"))).distinct())
    needed = grows(nodes).join(classes.select("id", "f1", "f2", F.col("first.row").alias("row")), "id")
    sets = written(full_sets(named.select("row", "text").join(grows(needed), "row"), shingle_words).dropDuplicates(["id"]), SET_ROWS)
    pairs = edges.join(grows(sets), "id").join(grows(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("hub_shingles"))), "hub")
    compared = written(pairs.mapInArrow(_compare(percent), "id long, hub long, linked boolean, size long, hub_size long, lacks binary, extra binary"), SET_ROWS)
    discard(edges, sets)
    found = written(_components(compared.filter("linked").select(F.col("id").alias("a"), F.col("hub").alias("b")), nodes))

    # hubs whose classes are in more than one component
    under = compared.select("id", "hub").join(grows(found), "id").unionByName(found.withColumn("hub", F.col("id")))
    split = under.groupBy("hub").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"))
    of_hub = found.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    split = split.filter("least <> most").join(grows(of_hub), "hub").select("hub", "hub_component", "n")
    strays = compared.select("id", "hub").join(grows(found), "id").join(grows(of_hub), "hub").groupBy("hub").agg(F.count_if(F.col("component") != F.col("hub_component")).alias("n_strays"))
    # the classes of one hub are dealt to parts, and what is known of the hub goes to all of them
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("part")
    split = written(split.join(grows(strays), "hub")).select("*", parts)
    rows_ = compared.drop("linked").join(grows(found), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALT).cast("long")))
    rows_ = rows_.join(grows(split), ["hub", "part"]).withColumn("stray", F.col("component") != F.col("hub_component"))
    # a stray meets every class of its hub: classes in slots of one kind, strays also in slots of the other
    slots, stray_slots = F.ceil(F.col("n") / TILE), F.ceil(F.col("n_strays") / TILE)
    slot = lambda n: F.pmod(F.xxhash64("id"), n)
    base = ["hub", "id", "component", "size", "hub_size", "lacks", "extra"]
    as_other = rows_.select(*base, F.lit(0).alias("side"), slot(slots).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), stray_slots - 1)).alias("j"))
    as_stray = rows_.filter("stray").select(*base, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("i"), slot(stray_slots).alias("j"))
    tiles = as_other.unionByName(as_stray).groupBy("hub", "i", "j")
    joined = written(tiles.applyInPandas(_match_tile(percent), "a long, b long"), SET_ROWS)
    discard(compared)
    merged = connected_components(joined)
    final = written(found.join(grows(merged), found["component"] == merged["node"], "left").select("id", F.coalesce("root", "component").alias("component")))
    discard(joined, merged, found, nodes)

    # the first row of each component, by class
    placed = classes.select("id", "f1", "f2", "first").join(grows(final), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("first"))
    by_class = placed.drop("first").join(grows(smallest), "component").select("f1", "f2", "first")
    narrow = signed.select("doc_id", "row", "n_shingles", "f1", "f2")
    grouped = narrow.filter("n_shingles > 0").join(grows(by_class), ["f1", "f2"]).select("doc_id", "row", "n_shingles", "first")
    alone = narrow.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", own_first.alias("first"))
    return grouped.unionByName(alone)


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, in all its columns.

    Rows are told by all their columns, so different rows that share an id are
    judged each. A row without an id stays only if no row of its group has one,
    and then that with the smallest key of them. Rows that are equal in all
    columns stay once. Texts without words are groups of their own. Columns of
    any name may follow. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), "text")
    kept = _grouped(keyed, shingle_words, percent).filter("row = first.row and doc_id <=> first.doc_id")
    id_, row, times = free_names(docs, "id", "row", "times")
    chosen = settle(kept.groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.count(F.lit(1)).alias(times)))
    out = docs.join(grows(chosen), (row_key(docs) == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi").select([column(c) for c in docs.columns])
    if not chosen.filter(F.col(times) > 1).isEmpty():
        out = out.dropDuplicates()
    return out

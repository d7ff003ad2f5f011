"""Near duplicates among vectors: a small-world graph per shard, and every vector searched for in every shard.

Equal vectors are one class from the start. Classes are dealt to shards by
chance, and each shard's graph is built in one task and audited there: its beam
is widened until searches at the edge of the range find what a full comparison
finds. Then the classes go, in blocks, to every shard's graph. What a search
finds is confirmed in double precision and counted where it is found; of the
links only one goes on for each group that hangs together inside the shard, so
that a crowd of near copies makes as many rows as it has vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm import hnsw
from quillveil.llm.common import discard, written
from quillveil.llm.components import connected_components

#: Bytes of vectors in a shard, and vectors that a shard has at least where there are fewer shards than cores.
SHARD_BYTES, SHARD_ROWS = 1 << 26, 1024
#: Vectors of a shard that its audit turns into probes, and the share of their links that a search must find.
PROBES, RECALL = 256, 0.995
#: A graph goes in rows of so many bytes, and so many rows go to Python at once: one row with all of it is held by the JVM of an executor many times over.
PIECE_BYTES, BATCH_ROWS = 1 << 16, 256


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as the bytes of its doubles; null where it is null, empty, zero, or has a component that is null or no number."""
    for batch in batches:
        column = batch.column("embedding")
        raw: list[bytes | None] = []
        for x in column:
            if not x.is_valid or not len(x.values) or x.values.null_count:
                raw.append(None)
                continue
            v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
            raw.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "vec"])


def _units(raw: pa.ChunkedArray) -> np.ndarray:
    """Rows of length one."""
    x = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(least: float, probes: int, wanted: float):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        seed = table.column("shard")[0].as_py() + 1
        g = hnsw.build(table.column("id").to_numpy(), _units(table.column("vec")), table.column("n").to_numpy(), least, probes, wanted, seed)
        dim, shard, raw = table.column("dim")[0].as_py(), table.column("shard")[0].as_py(), g.packed()
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]

        def batch(a: int) -> pa.RecordBatch:
            some = pieces[a : a + BATCH_ROWS]
            n = len(some)
            return pa.record_batch({"dim": [dim] * n, "shard": [shard] * n, "beam": [g.beam] * n, "recall": [g.recall] * n, "piece": list(range(a, a + n)), "graph": pa.array(some, pa.binary())})

        return pa.Table.from_batches([batch(a) for a in range(0, len(pieces), BATCH_ROWS)])

    return build


def _searched(g: hnsw.Graph, queries: pa.Table, least: float, schema: pa.Schema) -> pa.Table:
    ids = queries.column("id").to_numpy()
    order = np.argsort(g.ids)
    at = order[np.minimum(np.searchsorted(g.ids[order], ids), len(order) - 1)]
    own = np.where(g.ids[at] == ids, at, -1)
    found, q, node = hnsw.links(g, _units(queries.column("vec")), own, least)
    label = g.labels[node]
    # its own group, whichever side found the link
    here = np.flatnonzero(own >= 0)
    q = np.concatenate([q, here])
    label = np.concatenate([label, g.labels[np.searchsorted(g.starts, own[here], "right") - 1]])
    apart = label != ids[q]
    pairs = np.unique(np.stack([q[apart], label[apart]], 1), axis=0)
    rows = np.flatnonzero((found > 0) | np.isin(np.arange(len(ids)), pairs[:, 0]))
    ends = np.searchsorted(pairs[:, 0], np.append(rows, len(ids)))
    near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs[:, 1], pa.int64()))
    return pa.table([pa.array(ids[rows]), pa.array(found[rows]), near], schema=schema)


def _search(least: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("near", pa.list_(pa.int64()))])

    def search(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        if not len(queries) or not len(graphs):
            return schema.empty_table()
        g = hnsw.Graph.unpacked(b"".join(graphs.sort_by("piece").column("graph").to_pylist()))
        del graphs
        return pa.concat_tables([_searched(g, queries.slice(i, hnsw.QUERIES), least, schema) for i in range(0, len(queries), hnsw.QUERIES)])

    return search


def shards(classes: DataFrame, least: float, probes: int = PROBES, wanted: float = RECALL) -> DataFrame:
    """(dim, shard, beam, recall, piece, graph) of classes (id, vec, n, dim, shard); a graph is in pieces."""
    return classes.groupBy("dim", "shard").applyInArrow(_build(least, probes, wanted), "dim long, shard long, beam long, recall double, piece long, graph binary")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors are linked when their cosine is at least ``least``, in double
    precision; ``n_links`` counts the other rows linked directly, as found from
    the row's own side. ``component_id`` is the smallest id reachable by links,
    the row's own included, and a row is kept if that is its own. Vectors that
    are null, empty or zero or hold a null or a component that is no finite
    number are linked with nothing, and vectors of different lengths are not
    linked. Repeated rows are each returned and are linked with each other,
    whatever their ids. A row without an id takes part, has the component of its
    group, null if none of it has an id, and is kept only then. An empty table
    gives no rows.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    packed = written(named.mapInArrow(_unit_rows, "vec_id long, vec binary"))
    grouped = packed.filter("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    grouped = grouped.select(F.monotonically_increasing_id().alias("id"), "vec", "n", "first", (F.octet_length("vec") / 8).cast("long").alias("dim"))
    classes = written(grouped)
    # two numbers
    count, widest = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(SHARD_ROWS, SHARD_BYTES // (8 * widest))
    parts = max(1, -(-count // most), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-count // SHARD_ROWS)))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(parts)))
    graphs = written(shards(dealt, least), BATCH_ROWS)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    asking = dealt.select("id", "vec", "dim", F.col("shard").alias("block"), every.alias("shard"))
    asked = graphs.select("dim", "shard", "piece", "graph", every.alias("block"))
    keys = ["dim", "shard", "block"]
    found = written(asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(least), "id long, links long, near array<long>"), BATCH_ROWS)
    discard(graphs)
    roots = connected_components(found.select(F.col("id").alias("a"), F.explode("near").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    placed = classes.select("id", "vec", "n", "first").join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = placed.join(smallest, "root").select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = packed.filter("vec is not null").join(by_class, "vec").select("vec_id", "n_links", "component_id")
    alone = packed.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))

"""The registry as the state of a stream, and traces of several steps."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillveil.operators import identity, trace
from quillveil.streaming import registry

MENTION = "batch string, kind string, name string, at timestamp, action string"


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", registry.PROVIDER)

    def put(rows):
        stamped = [(b, k, n, f"2024-01-01 {at}", a) for b, k, n, at, a in rows]
        spark.createDataFrame(stamped, MENTION.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))

    def run(restored=None, check="check"):
        source = spark.readStream.schema(MENTION).parquet(str(tmp_path / "src"))
        out = registry.register(source, keep_seconds=3600, restored=restored)
        out.writeStream.option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start(str(tmp_path / f"out-{check}")).awaitTermination()
        return spark.read.parquet(str(tmp_path / f"out-{check}"))

    yield put, run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _named(df):
    return sorted(map(tuple, df.select("batch", "kind", "name", "number").collect()))


def test_numbers_go_on_over_restarts_and_equal_the_table_form(spark, stream):
    put, run = stream
    first = [("a", "P", "Bert", "10:00:00", None), ("a", "P", "Anna", "10:01:00", None), ("a", "P", "Bert", "10:02:00", None), (None, "P", "X", "10:00:00", None), ("a", None, "X", "10:00:00", None)]
    second = [("a", "P", "Anna", "10:20:00", None), ("a", "P", "Carl", "10:21:00", "seen"), ("a", "O", "Firm", "10:22:00", None)]
    put(first)
    run()
    put(second)
    got = _named(run())
    rows = [(k, n, at) for b, k, n, at, _ in first + second if b and k]
    known = identity.extend_registry(spark.createDataFrame([], "kind string, name string, number int"), spark.createDataFrame(rows, "kind string, name string, at string"), "kind", "name", "at")
    assert got == sorted(("a", r.kind, r.name, r.number) for r in known.select("kind", "name", "number").collect())
    # what came out begins another stream
    put([("a", "P", "Dora", "10:30:00", None)])
    restored = spark.createDataFrame([("a", "P", "Emil", 7, None)], "batch string, kind string, name string, number int, at timestamp").withColumn("at", F.to_timestamp(F.lit("2024-01-01 09:30:00")))
    assert ("a", "P", "Bert", 8) in _named(run(restored, "again"))


class _Map(dict):
    """A state of the store that counts the calls."""

    calls = 0

    def _count(self):
        self.calls += 1
        return self

    def exists(self):
        return bool(self._count())

    def containsKey(self, key):
        return key in self._count()

    def getValue(self, key):
        return self._count()[key]

    def updateValue(self, key, value):
        self._count()[key] = value


def test_the_store_is_asked_by_page_not_by_name():
    numbers = registry.Numbers(3600)
    numbers.known, numbers.highest = _Map(), _Map()
    numbers._wait_until, numbers.until = lambda ms: None, _Map()

    def seen(names):
        rows = pd.DataFrame({"kind": "P", "name": names, "at": pd.Timestamp("2024-01-01"), "action": "seen"})
        return pd.concat(numbers.handleInputRows(("a",), iter([rows[:700], rows[700:]]), None))

    first = seen([f"n{i:06}" for i in range(60_000)])
    assert first["number"].tolist() == list(range(1, 60_001)) and first["name"].is_monotonic_increasing
    again = seen([f"n{i:06}" for i in range(30_000, 90_000)])
    assert again["name"].tolist() == [f"n{i:06}" for i in range(60_000, 90_000)] and again["number"].tolist() == list(range(60_001, 90_001))
    assert numbers.known.calls + numbers.highest.calls <= 5 * registry.PAGES


def test_expired_and_discarded_batches_begin_anew(stream):
    put, run = stream
    put([("a", "P", "Anna", "10:00:00", None), ("a", "P", "Bert", "10:05:00", None), ("b", "P", "Zoe", "10:00:00", None)])
    run()
    put([("b", "P", "Yan", "12:00:00", None)])
    run()
    put([("a", "P", "Carl", "12:10:00", None), ("b", "P", "Xaver", "12:10:00", None), ("b", "P", "-", "12:11:00", "discard")])
    run()
    put([("b", "P", "Will", "12:12:00", None), ("a", "P", "Anna", "12:12:00", None)])
    assert _named(run()) == [("a", "P", "Anna", 1), ("a", "P", "Anna", 2), ("a", "P", "Bert", 2), ("a", "P", "Carl", 1), ("b", "P", "Will", 1), ("b", "P", "Yan", 1), ("b", "P", "Zoe", 1)]


EDIT = "array<struct<start:int,end:int,type:string,replacement:string>>"


def _steps(rng, text, count):
    """Random disjoint edits of a text, step by step, and the place in the first text of each character that is left."""
    origin = [(i, i + 1) for i in range(len(text))]
    owner = [None] * len(text)
    steps = []
    for step in range(1, count + 1):
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 3)) // 2 * 2))
        edits = [(a, b, f"T{rng.randint(0, 2)}", "#" * rng.randint(1, 5)) for a, b in zip(cuts[::2], cuts[1::2])]
        steps.append((step, edits))
        for a, b, kind, put in reversed(edits):
            whole = (min(o[0] for o in origin[a:b]), max(o[1] for o in origin[a:b]))
            # an edit that takes a part of an earlier one has all that it came from
            origin[a:b] = [whole] * len(put)
            owner[a:b] = [(step, kind, put, whole, a)] * len(put)
            text = text[:a] + put + text[b:]
    return steps, owner


def test_places_after_several_steps_equal_those_of_a_replay(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for doc in range(60):
        steps, owner = _steps(rng, "x" * rng.randint(0, 60), 3)
        rows += [(doc, n, [(a, b, k, r) for a, b, k, r in e]) for n, e in steps]
        k = 0
        while k < len(owner):
            size = 1
            if owner[k]:
                while k + size < len(owner) and owner[k + size] is owner[k]:
                    size += 1
                step, kind, put, (start, end), _ = owner[k]
                if size == len(put):
                    want.add((doc, step, kind, put, start, end, k, k + size))
            k += size
    rows += [(1000, 1, None), (1001, 1, [])]
    df = spark.createDataFrame(rows, f"doc_id long, step int, edits {EDIT}")
    got = trace.composed(df.unionByName(df.filter("doc_id = 3"))).select("doc_id", "step", "type", "replacement", "start", "end", "out_start", "out_end").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 100


def test_traces_are_made_on_all_cores(spark):
    from quillveil import catalog_entities

    docs, made = catalog_entities._traced(spark, "/root/testdata/sf0.001")
    cores = spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() >= cores and made.rdd.getNumPartitions() >= cores

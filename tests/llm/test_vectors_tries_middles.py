"""Vectors, tries and fill-in-the-middle against brute force, with nulls, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillveil.llm import hnsw
from quillveil.llm.embeddings import PIECE_BYTES, _search, near_vectors, shards
from quillveil.llm.middle import Plan, fill_in_middle, original, rearranged, restored
from quillveil.llm.ordered import running
from quillveil.llm.trie import prefix_trie

CLASH = "id long, n long, vec binary, shard long, block long, dim long, root long, first long, links long, node long, conv long, depth long, place long, level long, kept boolean, _part long, form string, output string"


def _clashing(df):
    return df.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASH.split(", ")])


# vectors


def _turned(rng, x, angle):
    u = rng.standard_normal(len(x))
    u -= (u @ x) * x
    return math.cos(angle) * x + math.sin(angle) * u / np.linalg.norm(u)


def _vectors(seed=5, width=24):
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(width))
    out = [unit() for _ in range(500)]
    centre = unit()
    out += [_turned(rng, centre, 0.05) for _ in range(300)]  # a crowd in one ball
    other = unit()
    out += [_turned(rng, other, math.radians(20)) for _ in range(150)]  # about one middle, most of them not linked with each other
    chain = [unit()]
    for _ in range(40):  # each linked with its neighbours only
        chain.append(_turned(rng, chain[-1], math.radians(24)))
    out += chain
    pair = unit()
    out += [pair, _turned(rng, pair, math.radians(25.8)), _turned(rng, pair, math.radians(25.9))]
    rows = [(i, (3.0 * v).tolist()) for i, v in enumerate(out)]
    rows += [(2000 + i, rows[3][1]) for i in range(50)]  # exact copies
    rows += [(3000, [2 * x for x in rows[4][1]]), (3001, rows[5][1]), (3001, rows[5][1]), (3002, rows[5][1]), (None, rows[6][1]), (None, unit().tolist())]
    rows += [(4000, None), (4001, [0.0] * width), (4002, []), (4003, [float("nan")] * width), (4004, [float("inf")] + [0.0] * (width - 1)), (4005, [None] + [1.0] * (width - 1)), (4006, [1.0, 1.0]), (4007, [2.0, 2.0]), (4008, [1e300] * 2 + [0.0])]
    return rows


def _expected(rows, least=0.9):
    n = len(rows)
    units = []
    for _, v in rows:
        ok = bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.array(v if ok else [0.0])
        a = a / np.abs(a).max() if ok else a
        units.append(a / np.linalg.norm(a) if ok else None)
    group, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= least:
                links[i] += 1
                links[j] += 1
                x, y = group[i], group[j]
                group = [x if g == y else g for g in group] if x != y else group
    ids = defaultdict(list)
    for g, (i, _) in zip(group, rows):
        ids[g] += [] if i is None else [i]
    out = []
    for g, m, (i, _) in zip(group, links, rows):
        c = min(ids[g], default=None)
        out.append((i, m, c, i == c if i is not None else c is None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    return _clashing(spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>"))


def test_vectors_equal_brute_force(vectors):
    got = near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == _expected(_vectors())


def test_vectors_of_floats_and_of_an_empty_table(spark, vectors):
    few = vectors.selectExpr("vec_id", "cast(embedding as array<float>) as embedding").filter("vec_id between 500 and 520")
    rows = [(r[0], r[1]) for r in few.collect()]
    assert sorted(map(tuple, near_vectors(few).collect()), key=str) == _expected(rows)
    assert near_vectors(vectors.limit(0)).count() == 0
    assert near_vectors(vectors.filter("vec_id = 4000")).collect()[0][1:] == (0, 4000, True)


def test_a_beam_that_misses_is_widened():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(np.arange(len(x)), x, np.ones(len(x), int))
    assert g.recall >= 0.995
    g.beam = 1
    hnsw.audit(g, 0.9, 200, 0.999, 3)
    assert g.beam > 1 and g.recall >= 0.999
    for layer in g.layers:  # a graph that leads nowhere ends with a full comparison
        layer[:] = -1
    hnsw.audit(g, 0.9, 200, 0.999, 3)
    assert g.beam >= len(g.nodes) and g.recall == 1


def test_a_ball_inside_the_range_is_counted_whole():
    rng = np.random.default_rng(4)
    c = np.eye(16)[0]
    x = np.array([_turned(rng, c, 0.03) for _ in range(2000)])
    g = hnsw.build(np.arange(2000), x, np.full(2000, 3))
    assert len(g.nodes) == 1
    found, _, _ = hnsw.links(g, g.units, np.arange(2000), 0.9)
    assert (found == 3 * 1999).all()


def test_a_graph_goes_in_small_pieces_and_comes_back_whole(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 16))
    rows = spark.createDataFrame([(i, v.tobytes(), 1, 16, 0) for i, v in enumerate(x)], "id long, vec binary, n long, dim long, shard long")
    pieces = sorted(shards(rows, 0.9).select("piece", "graph").collect())
    assert len(pieces) > 1 and max(len(p.graph) for p in pieces) <= PIECE_BYTES
    g = hnsw.build(np.arange(700), x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True), np.ones(700, int))
    back = hnsw.Graph.unpacked(b"".join(p.graph for p in pieces))
    assert (back.ids == g.ids).all() and (back.nodes == g.nodes).all() and (back.labels == g.labels).all()
    assert len(back.layers) == len(g.layers) and all((a == b).all() for a, b in zip(back.layers, g.layers))


def test_groups_and_searches_are_the_same_in_parts(monkeypatch):
    rows = [r for r in _vectors() if r[0] is not None and r[0] < 2000]
    x = np.array([v for _, v in rows]) / 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = pa.table({"id": np.arange(len(x)), "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    seen = []
    for n in (1 << 12, 7):
        monkeypatch.setattr(hnsw, "QUERIES", n)
        g = hnsw.build(np.arange(len(x)), x, np.ones(len(x), int))
        seen.append((g.labels.tolist(), _search(0.9)(queries, pa.table({"piece": [0], "graph": pa.array([g.packed()], pa.binary())})).to_pylist()))
    assert seen[0] == seen[1] and len(set(seen[0][0])) > 1


# running totals


def test_running_totals_go_over_partitions(spark):
    rows = [(1 if i % 4 else i, i, i % 7, None if i % 3 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, at long, v long, m long")
    got, _ = running(df, ["k"], [F.col("at")], {"s": ("sum", "v"), "x": ("xor", "v"), "last": ("max", "m")})
    assert got.columns == ["k", "at", "v", "m", "s", "x", "last"]
    want = []
    state = defaultdict(lambda: (0, 0, None))
    for k, at, v, m in rows:
        s, x, last = state[k]
        state[k] = s + v, x ^ v, last if m is None else m
        want.append((k, at, v, m, *state[k]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# tries


def _conversations():
    hello = ("user", "Hello, ünd wie geht es?")
    rows = []
    for c in range(60):
        body = [hello, ("assistant", f"Fine {c % 3}"), ("user", f"And {c % 2}?")][: c % 4] if c % 7 else [(f"r{c}", f"only {c}")] * 12
        rows += [(c, i if i != 2 or c % 5 else None, r, t) for i, (r, t) in enumerate(body)]
    for c in (101, 102, 103):  # the first of their family is missing
        rows += [(c, i, "user", f"x{i}") for i in range(10)]
    rows += [(200, 0, None, None), (200, 1, "user", ""), (201, 0, "", ""), (203, 0, "user", "t"), (203, 0, "user", "t"), (203, 0, "assistant", "t")]
    rows += [(300, i, "user", f"long {i}") for i in range(120)]
    rows += [(None, 0, "user", "nobody's")]
    return rows


def _trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    made = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        sort = lambda k: [x[1:] for x in sorted(convs.get(k, []))]
        made[c] = tuple(sort(c - c % 5)[:h] + sort(c)[h:])
    nodes = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(nodes, key=len, reverse=True):
        m = sorted(nodes[p])
        leaves = sum(out[k][5] for k in children[p]) or 1
        saved = sum(out[k][6] for k in children[p]) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in m if made[c] == p)
        out[p] = (m[0], len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("quillveil.llm.trie.CHUNK", 3)
    rows = _conversations()
    df = _clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = prefix_trie(df.repartition(5)).select(TRIE).collect()
    assert sorted(map(tuple, got), key=str) == _trie(rows)


def test_trie_without_turns_or_rows(spark):
    df = spark.createDataFrame([(7, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in prefix_trie(df).select(TRIE).collect()] == _trie([(7, 0, "user", "a")])
    assert prefix_trie(df.limit(0)).count() == 0


# fill in the middle


def _texts():
    rows = [(i, " ".join(f"w{k}é\n" for k in range(i % 40))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(["a", "<P>", "x <S> y", "<", "<M", "one two 3", "日本語 text", "😀😀", "a" * 50_000, "é\r\n\t ", "x y" * 60_000])]
    return rows + [(1, "repeated"), (1, "repeated"), (None, "no id"), (5000, None), (5001, ""), (-3, "minus three")]


def test_middles_equal_the_rule(spark):
    rows = _texts()
    df = _clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    made = fill_in_middle(df)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", restored(F.col("output"), F.col("form")).alias("back")).collect()
    want = []
    for i, text in rows:
        t = text or ""
        units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", t)
        digits = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        plain = t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((i, len(units), form, None if plain else len(p), None if plain else len(m), out, hashlib.sha256(out.encode()).hexdigest(), t))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


def test_pieces_with_parts_of_marks_come_back():
    for i in range(400):
        text = "<P" * (i % 5) + ">" + "<S" * (i % 7) + "M>" * (i % 3) + "<" * (i % 4) + "P>" * (i % 2)
        n, form, _, _, out = rearranged(text, str(i), Plan(cut=100))
        assert original(out, form) == text


# what earlier operators hold beyond one image, and letters that look alike


def test_long_payloads_take_several_images(spark):
    from quillveil.llm import media, webp

    payload = np.random.default_rng(1).integers(97, 123, 64 * 50, dtype=np.uint8)
    raw = media.encode_payload(payload, most=1024)
    files = media.files_of(raw)
    assert len(files) == 4 and b"".join(webp.decode(f).tobytes() for f in files)[: len(payload)] == payload.tobytes()
    rows = spark.createDataFrame([(1, raw), (2, raw[:-7]), (3, b""), (4, b"RIFFxx")], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.decode_media(rows).collect()}
    assert bytes(got[1].pixels)[: len(payload)] == payload.tobytes() and got[1].feature.count(";") == 3 and got[1].media_error is None
    assert all(got[i].pixels is None and got[i].media_error for i in (2, 3, 4))


def test_letters_that_look_alike_are_folded_by_their_case():
    from quillveil.llm import toxicity

    want = {"\u041c\u041eR\u041eN": "moron", "\u0397\u0391\u03a4\u0395": "hate", "\u03b2itch": "bitch", "i\u0501i\u043et": "idiot", "s\u03c4\u03c5p1d": "stupid", "\u03b7it\u0448it": "nitwit", "\u0130diot": "idiot", "id\u200bi\u0301ot": "idiot"}
    for text, folded in want.items():
        plain, got = toxicity.fold(text)
        assert got == folded and len(plain) == len(got), text

"""A navigable small-world graph over the vectors of one shard, searched by many queries at once.

Vectors within ``BALL`` of a node are members of its ball instead of nodes of
their own, so a crowd of near copies is one node, and a query counts a ball that
lies wholly inside its range without a look at its members. Layers of a node
are drawn so that each layer has a 16th of the nodes of the one below. Links
are chosen so that none leads to a place that another one already leads near.

All angles are decided in double precision; single precision, with slack, only
guides the search.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np

#: Links of a node in the upper layers; twice as many in the lowest.
LINKS = 16
#: Candidates that a new node's links are chosen from.
BUILD_BEAM = 48
#: The widest angle between a node and a member of its ball, in radians.
BALL = np.deg2rad(10.0)
#: Queries are taken in groups for which marks of visited nodes take so many bytes at most.
SEEN_BYTES = 1 << 25
#: Queries whose pairs with nodes are held at once.
QUERIES = 1 << 12
#: Vectors compared with members of balls at once.
PAIRS = 1 << 15
_SLACK = 1e-4


@dataclass
class Graph:
    """Nodes are rows 0 to n of ``nodes``; the members of ball i are rows ``starts[i]`` to ``starts[i + 1]`` of ``units``, its node first."""

    nodes: np.ndarray
    layers: list[np.ndarray]
    entry: int
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    units: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    beam: int = 16
    recall: float = 0.0

    def packed(self) -> bytes:
        """Without what follows from the rest: the nodes in single precision, and rows of the upper layers that hold no links."""
        out = io.BytesIO()
        layers = {"layer0": self.layers[0]} if self.layers else {}
        for i, x in enumerate(self.layers[1:], 1):
            at = np.flatnonzero((x >= 0).any(1))
            layers |= {f"at{i}": at, f"layer{i}": x[at]}
        np.savez(out, entry=self.entry, ids=self.ids, units=self.units, weights=self.weights, starts=self.starts, radius=self.radius, labels=self.labels, beam=self.beam, recall=self.recall, **layers)
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes) -> Graph:
        z = np.load(io.BytesIO(raw))
        nodes = z["units"][z["starts"][:-1]].astype(np.float32)
        layers = [z["layer0"]] if "layer0" in z.files else []
        for i in range(1, sum(k.startswith("layer") for k in z.files)):
            layers.append(np.full((len(nodes), z[f"layer{i}"].shape[1]), -1, np.int32))
            layers[i][z[f"at{i}"]] = z[f"layer{i}"]
        return Graph(nodes, layers, int(z["entry"]), z["ids"], z["units"], z["weights"], z["starts"], z["radius"], z["labels"], int(z["beam"]), float(z["recall"]))


def best_first(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, cosines) of each query, the nearest first: a best-first search with a beam, all queries in step. Missing ones are -1."""
    count, n = len(queries), len(vectors)
    every = np.arange(count)
    seen = np.zeros((count, n + 1), bool)
    seen[every, entry] = True
    seen[:, n] = True
    ids = np.full((count, beam), -1, np.int32)
    near = np.full((count, beam), -np.inf, np.float32)
    open_ = np.zeros((count, beam), bool)
    ids[:, 0], near[:, 0], open_[:, 0] = entry, np.einsum("qd,qd->q", vectors[entry], queries), True
    active = every
    while len(active):
        at = np.where(open_[active], near[active], -np.inf).argmax(1)
        found = open_[active, at]
        active, at = active[found], at[found]
        if not len(active):
            break
        open_[active, at] = False
        around = links[ids[active, at]]  # -1 marks the unused column of seen
        new = ~seen[active[:, None], around]
        some = new.any(1)
        if not some.any():
            continue
        rows, around, new = active[some], around[some], new[some]
        seen[rows[:, None], around] = True
        cosines = np.full(around.shape, -np.inf, np.float32)
        q, k = np.nonzero(new)
        cosines[q, k] = np.einsum("pd,pd->p", vectors[around[q, k]], queries[rows[q]])
        all_near = np.concatenate([near[rows], cosines], 1)
        all_ids = np.concatenate([ids[rows], around], 1)
        all_open = np.concatenate([open_[rows], new], 1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[rows] = np.take_along_axis(all_near, order, 1)
        ids[rows] = np.where(np.isfinite(near[rows]), np.take_along_axis(all_ids, order, 1), -1)
        open_[rows] = np.take_along_axis(all_open, order, 1) & np.isfinite(near[rows])
    return ids, near


def _diverse(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the candidates of each row, nearest first, none of which is nearer to one chosen before than to the row; -1 beyond."""
    rows, count = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = own @ own.transpose(0, 2, 1)
    chosen = np.zeros((rows, count), bool)
    for i in range(count):
        crowded = (chosen[:, :i] & (between[:, i, :i] > near[:, i : i + 1])).any(1)
        chosen[:, i] = (ids[:, i] >= 0) & ~crowded & (chosen[:, :i].sum(1) < most)
    out = np.full((rows, most), -1, np.int32)
    r, c = np.nonzero(chosen)
    out[r, np.cumsum(chosen, 1)[r, c] - 1] = ids[r, c]
    return out


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds to each chosen node the link back; where it then has too many, those that lead to different places stay."""
    most = links.shape[1]
    r, c = np.nonzero(chosen >= 0)
    to, from_ = chosen[r, c], new[r]
    near = np.einsum("pd,pd->p", vectors[to], vectors[from_])
    order = np.lexsort((-near, to))
    to, from_ = to[order], from_[order]
    nodes, first, times = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, times)
    keep = rank < most
    more = np.full((len(nodes), min(most, int(times.max(initial=1)))), -1, np.int32)
    more[np.repeat(np.arange(len(nodes)), times)[keep], rank[keep]] = from_[keep]
    both = np.sort(np.concatenate([links[nodes], more], 1), 1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # two may have chosen each other
    cosines = np.einsum("nkd,nd->nk", vectors[np.maximum(both, 0)], vectors[nodes])
    cosines[both < 0] = -np.inf
    order = np.argsort(-cosines, axis=1, kind="stable")
    both, cosines = np.take_along_axis(both, order, 1), np.take_along_axis(cosines, order, 1)
    full = (both >= 0).sum(1) > most
    out = both[:, :most].copy()
    if full.any():
        out[full] = _diverse(vectors, both[full], cosines[full], most)
    links[nodes] = out


def _peers(vectors: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the other new nodes."""
    cosines = vectors[new] @ vectors[new].T
    np.fill_diagonal(cosines, -np.inf)
    order = np.argsort(-cosines, axis=1, kind="stable")[:, :most]
    near = np.take_along_axis(cosines, order, 1)
    return np.where(np.isfinite(near), new[order], -1).astype(np.int32), near


def grow(units: np.ndarray, seed: int = 1, batch: int = 512) -> tuple[Graph, np.ndarray]:
    """The graph over unit vectors, and the node whose ball each vector is in."""
    total, width = units.shape
    single = units.astype(np.float32)
    levels = np.floor(np.random.default_rng(seed).exponential(1 / np.log(LINKS), total)).astype(int)
    vectors = np.zeros((total, width), np.float32)
    layers = [np.full((total, LINKS * (1 if k else 2)), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
    node_level = np.full(total, -1)
    owner = np.full(total, -1, np.int64)
    exact = np.zeros((total, width))
    tight = np.cos(BALL)
    n, top, entry, at = 0, -1, 0, 0
    while at < total:
        these = np.arange(at, min(total, at + min(batch, max(64, n))))
        at = these[-1] + 1
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        entries = np.full(len(these), entry, np.int64)
        for level in range(top, -1, -1):
            ids, near = best_first(vectors[:n], layers[level][:n], single[these], entries, BUILD_BEAM if level == 0 else 8)
            found[level], entries = (ids, near), ids[:, 0].astype(np.int64)
        # a vector close to a node is a member of its ball; of those left, the first ones are nodes
        fresh = np.ones(len(these), bool)
        if n:
            close = np.einsum("qd,qd->q", exact[entries], units[these]) >= tight
            owner[these[close]] = entries[close]
            fresh &= ~close
        among = units[these] @ units[these].T
        first = []
        for i in np.flatnonzero(fresh):
            if fresh[i]:
                mine = fresh & (among[i] >= tight)
                mine[i] = True
                owner[these[mine]] = n + len(first)
                fresh &= ~mine
                first.append(i)
        if not first:
            continue
        new = np.arange(n, n + len(first))
        vectors[new], exact[new], node_level[new] = single[these[first]], units[these[first]], levels[these[first]]
        for level in range(int(node_level[new].max()), -1, -1):
            on = node_level[new] >= level
            ids, near = _peers(vectors, new[on], BUILD_BEAM // 2)
            if level in found:
                rows = np.array(first)[on]
                ids, near = np.concatenate([ids, found[level][0][rows]], 1), np.concatenate([near, found[level][1][rows]], 1)
            order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
            chosen = _diverse(vectors, np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), LINKS)
            layers[level][new[on], :LINKS] = chosen
            if (chosen >= 0).any():
                _link_back(vectors, layers[level], new[on], chosen)
        n += len(first)
        if node_level[new].max() > top:
            top = int(node_level[new].max())
            entry = int(new[node_level[new].argmax()])
    return Graph(vectors[:n], [x[:n] for x in layers[: top + 1]], entry), owner


def _reach(g: Graph, angle: float) -> np.ndarray:
    """The least cosine of a query with each node at which the ball may hold a vector in range."""
    return np.cos(np.minimum(np.pi, angle + g.radius))


def candidates(g: Graph, queries: np.ndarray, angle: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs whose ball may hold a vector in range; a beam that is full of them is widened for its queries."""
    reach = _reach(g, angle) - _SLACK
    loosest = reach.min(initial=1.0)
    single = queries.astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, min(512, SEEN_BYTES // (len(g.nodes) + 1)))
    for a in range(0, len(single), step):
        rows, width = np.arange(a, min(len(single), a + step)), beam
        entries = np.full(len(rows), g.entry, np.int64)
        for level in range(len(g.layers) - 1, 0, -1):
            entries = best_first(g.nodes, g.layers[level], single[rows], entries, 4)[0][:, 0].astype(np.int64)
        while len(rows):
            width = min(width, len(g.nodes))
            if width == len(g.nodes):
                # as wide as the graph: all nodes are compared
                cosines = single[rows] @ g.nodes.T
                q, node = np.nonzero(cosines >= reach)
                out.append((rows[q], node))
                break
            ids, near = best_first(g.nodes, g.layers[0], single[rows], entries, width)
            more = near[:, -1] >= loosest
            q, k = np.nonzero((ids >= 0) & (near >= reach[np.maximum(ids, 0)]) & ~more[:, None])
            out.append((rows[q], ids[q, k].astype(np.int64)))
            rows, entries, width = rows[more], entries[more], width * 2
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def links(g: Graph, queries: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total weight of the vectors linked with each query, and the (query, node) pairs whose ball holds one.

    ``own`` is the row of ``g.units`` that a query is itself, or -1; that one is left out.
    """
    angle = float(np.arccos(least))
    q, node = candidates(g, queries, angle, g.beam)
    found = np.zeros(len(queries), np.int64)
    if not len(q):
        return found, q, node
    sizes = np.diff(g.starts)
    total = np.add.reduceat(g.weights, g.starts[:-1])
    cosines = np.empty(len(q))
    for i in range(0, len(q), PAIRS):
        cosines[i : i + PAIRS] = np.einsum("pd,pd->p", queries[q[i : i + PAIRS]], g.units[g.starts[node[i : i + PAIRS]]])
    one = sizes[node] == 1
    whole = ~one & (np.arccos(np.clip(cosines, -1, 1)) + g.radius[node] <= angle - 1e-7)
    inside = (own[q] >= g.starts[node]) & (own[q] < g.starts[node + 1])
    linked = one & (cosines >= least) & ~inside
    np.add.at(found, q[linked], total[node[linked]])
    mine = np.where(inside, g.weights[np.maximum(own[q], 0)], 0)
    np.add.at(found, q[whole], (total[node] - mine)[whole])
    linked |= whole
    # the other balls, member by member
    rest = np.flatnonzero(~one & ~whole)
    many = np.cumsum(sizes[node[rest]])
    begin = 0
    while begin < len(rest):
        end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + PAIRS, "right")))
        part = rest[begin:end]
        pair = np.repeat(part, sizes[node[part]])
        member = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[node[part]]) - sizes[node[part]], sizes[node[part]]) + g.starts[node[pair]]
        for i in range(0, len(pair), PAIRS):
            p, m = pair[i : i + PAIRS], member[i : i + PAIRS]
            hit = (np.einsum("pd,pd->p", queries[q[p]], g.units[m]) >= least) & (own[q[p]] != m)
            np.add.at(found, q[p[hit]], g.weights[m[hit]])
            linked[p[hit]] = True
        begin = end
    return found, q[linked], node[linked]


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each is joined with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def audit(g: Graph, least: float, probes: int, wanted: float, seed: int) -> None:
    """Widens the beam until searches for vectors at the very edge of the range find what a full comparison finds.

    A probe is a vector of the shard turned by the whole angle into a random
    direction; at most ``probes`` are made, spread over the shard.
    """
    rng = np.random.default_rng(seed)
    angle = float(np.arccos(least))
    at = np.unique(np.linspace(0, len(g.units) - 1, min(probes, len(g.units))).astype(int))
    x = g.units[at]
    aside = rng.standard_normal(x.shape)
    aside -= np.einsum("pd,pd->p", aside, x)[:, None] * x
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.where(size > 1e-9, aside / np.maximum(size, 1e-9), 0)
    turn = angle * 0.999
    turned = np.where(size > 1e-9, np.cos(turn) * x + np.sin(turn) * aside, x)
    truth = (turned.astype(np.float32) @ g.nodes.T) >= _reach(g, angle)
    while True:
        q, node = candidates(g, turned, angle, g.beam)
        hit = int(truth[q, node].sum())
        g.recall = hit / max(1, int(truth.sum()))
        if g.recall >= wanted or g.beam >= len(g.nodes):
            return
        g.beam *= 2


def build(ids: np.ndarray, units: np.ndarray, weights: np.ndarray, least: float = 0.9, probes: int = 256, wanted: float = 0.995, seed: int = 1) -> Graph:
    """The audited graph of a shard's vectors, which are in the order of their ids."""
    g, owner = grow(units, seed)
    # the node of a ball is the first vector that it was given
    order = np.lexsort((np.arange(len(ids)), owner))
    g.ids, g.units, g.weights = ids[order], units[order], weights[order]
    g.starts = np.searchsorted(owner[order], np.arange(len(g.nodes) + 1))
    angles = np.arccos(np.clip(np.einsum("pd,pd->p", g.units, g.units[g.starts[owner[order]]]), -1, 1))
    g.radius = np.maximum.reduceat(angles, g.starts[:-1])
    g.radius[np.diff(g.starts) == 1] = 0
    audit(g, least, probes, wanted, seed)
    firsts = g.starts[:-1]
    label = np.arange(len(g.nodes))
    for i in range(0, len(firsts), QUERIES):
        some = firsts[i : i + QUERIES]
        _, q, node = links(g, g.units[some], some, least)
        grouped = np.flatnonzero(label != np.arange(len(label)))
        label = _groups(len(label), np.concatenate([grouped, i + q]), np.concatenate([label[grouped], node]))
    g.labels = g.ids[firsts][label]
    return g

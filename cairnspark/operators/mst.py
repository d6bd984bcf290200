"""Minimum spanning trees of the mutual reachability graph: exact from blocks of points, exact for small clouds by Prim, approximate over a neighbour graph.

The weight of an edge is max(core_u, core_v, squared distance); of equal weights, the smaller (u, v) comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.frame import dimension, matrix
from cairnspark.functions.hierarchy import prim
from cairnspark.operators.blocks import Blocks, Side, deal, exactly, gaps, meet, roughly
from cairnspark.operators.components import connected_components, hook
from cairnspark.operators.knn import knn_blocks, knn_graph, knn_join
from cairnspark.plans.scratch import materialise

PRIM_ROWS, BORUVKA_DIMS, EXACT_DIMS, EXTRA_NEIGHBOURS = 16_384, 16, 60, 10
#: Edges that one task holds: candidates of a pair of blocks, and of the whole tree; above that it is found in rounds of joins.
HELD, ONE_TREE = 2_000_000, 4_000_000
TREE, LEVEL = range(2)
EDGES = "u long, v long, w double"


def core_distances(graph: DataFrame, k: int) -> DataFrame:
    """``(id, core)``: the squared distance to the k-th nearest other point, from a neighbour table."""
    return graph.where(F.col("rank") == k).select("id", F.col("d2").alias("core"))


def mrd_edges(graph: DataFrame, core: DataFrame) -> DataFrame:
    """``(u, v, w)``: the edges of a neighbour table, each once, by mutual reachability."""
    pairs = graph.select(F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v"), "d2").groupBy("u", "v").agg(F.min("d2").alias("d2"))
    a, b = core.select(F.col("id").alias("u"), F.col("core").alias("cu")), core.select(F.col("id").alias("v"), F.col("core").alias("cv"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", F.greatest("cu", "cv", "d2").alias("w"))


def lightest(candidates: DataFrame) -> DataFrame:
    """Of each component, the first edge by (w, u, v) that leaves it; ``candidates``: (component, w, u, v)."""
    return candidates.groupBy("component").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("component", "e.*")


def _forest(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boruvka over an edge list: (tree edges, (id, component)); ``nodes`` may have components already."""
    labels, tree = nodes if "component" in nodes.columns else nodes.select("id", F.col("id").alias("component")), None
    edges = materialise(edges)
    while True:
        a, b = labels.select(F.col("id").alias("u"), F.col("component").alias("cu")), labels.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        edges = materialise(edges.select("u", "v", "w").join(a, "u").join(b, "v").where("cu <> cv"))
        both = edges.select(F.col("cu").alias("component"), "w", "u", "v").unionByName(edges.select(F.col("cv").alias("component"), "w", "u", "v"))
        chosen = materialise(lightest(both).select("u", "v", "w").distinct())
        if not chosen.take(1):
            return (chosen if tree is None else tree), labels
        tree = chosen if tree is None else materialise(tree.unionByName(chosen))
        labels = _merged(labels, chosen)


def _merged(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labels after the components at both ends of each chosen edge become one."""
    a, b = labels.select(F.col("id").alias("u"), F.col("component").alias("src")), labels.select(F.col("id").alias("v"), F.col("component").alias("dst"))
    joined = connected_components(chosen.join(a, "u").join(b, "v").select("src", "dst"))
    moved = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return materialise(moved.select("id", F.coalesce("to", "component").alias("component")))


def spanning(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Which edges of places 0 to n - 1 are in the minimum spanning forest by (w, u, v); ``root`` names what is one already."""
    order = np.lexsort((v, u, w))
    root, alive, chosen = np.arange(n) if root is None else root.copy(), np.arange(len(order)), []
    u, v = u[order], v[order]
    while True:
        a, b = root[u[alive]], root[v[alive]]
        apart = a != b
        alive, a, b = alive[apart], a[apart], b[apart]
        if not len(alive):
            return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)
        first = np.full(n, len(order))
        for ends in (a, b):
            np.minimum.at(first, ends, alive)
        picked = np.unique(first[first < len(order)])
        chosen.append(picked)
        hook(root, root[u[picked]], root[v[picked]])


def _levels(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, hub: int) -> np.ndarray:
    """The heaviest edge of a tree on the way from each place to the hub."""
    ends, far, weight = np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((w, w))
    order = np.argsort(ends, kind="stable")
    begins = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    far, weight = far[order].tolist(), weight[order].tolist()
    level, stack = [-1.0] * n, [(hub, -1)]
    while stack:
        at, before = stack.pop()
        for k in range(begins[at], begins[at + 1]):
            if far[k] != before:
                level[far[k]] = max(level[at], weight[k])
                stack.append((far[k], at))
    return np.array(level)


def _rough_tree(w: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning tree of a matrix of weights by Prim's rounds, in no order of ties."""
    n = len(w)
    best, source, left = w[at].copy(), np.full(n, at), np.ones(n, bool)
    left[at], best[at] = False, np.inf
    ends = np.zeros((n - 1, 2), np.int64)
    for k in range(n - 1):
        at = int(best.argmin())
        if not left[at]:  # what is left has no weight: numbers beyond the range of single precision
            at = int(np.flatnonzero(left)[0])
        ends[k] = source[at], at
        left[at] = False
        better = (w[at] < best) & left
        best[better], source[better] = w[at][better], at
        best[at] = np.inf
    return ends[:, 0], ends[:, 1]


class _Edges:
    """Edges between two blocks, or within one, that may be in the tree: only the lightest forest of them is kept."""

    def __init__(self, a: Side, b: Side, same: bool):
        self.a, self.b, self.shift = a, b, 0 if same else len(a.ids)
        self.ids = a.ids if same else np.concatenate((a.ids, b.ids))
        self.rank = np.argsort(np.argsort(self.ids))
        comp = a.extra["component"] if same else np.concatenate((a.extra["component"], b.extra["component"]))
        _, first, inverse = np.unique(comp, return_index=True, return_inverse=True)
        self.root = np.full(len(comp), len(comp))
        np.minimum.at(self.root, self.rank, self.rank[first][inverse])
        self.contracted = len(first) < len(comp)
        self.edges: list[tuple] = []
        self.held = 0

    def matrix(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray | None, float, float]:
        """Weights of a leaf and another, -1 within a component; which are that, by how much weights may be wrong, and their unit."""
        s, t = self.a.leaves[p], self.b.leaves[q]
        w, margin, unit = roughly(self.a, p, self.b, q)
        ca, cb = self.a.extra["core"][s] / unit, self.b.extra["core"][t] / unit
        np.maximum(w, ca.astype(np.float32)[:, None], out=w)
        np.maximum(w, cb.astype(np.float32)[None, :], out=w)
        one = None
        if self.contracted:
            one = self.a.extra["component"][s][:, None] == self.b.extra["component"][t][None, :]
            w[one] = -1
        return w, one, float(margin) + 1e-6 * max(ca.max(), cb.max()), unit

    def weigh(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d2 = exactly(self.a.x, self.b.x, i, j)
        return np.maximum(np.maximum(self.a.extra["core"][i], self.b.extra["core"][j]), d2)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        u, v = self.rank[i], self.rank[j + self.shift]
        self.edges.append((np.minimum(u, v), np.maximum(u, v), self.weigh(i, j)))
        self.held += len(i)
        if self.held > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, w = (np.concatenate(c) for c in zip(*self.edges, strict=True)) if self.edges else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        kept = spanning(len(self.ids), u, v, w, self.root)
        self.edges, self.held = [(u[kept], v[kept], w[kept])], 0
        return self.edges[0]

    def across(self, p: int, q: int, level_a: np.ndarray, level_b: np.ndarray, between: float) -> float:
        """Adds the edges of two leaves that may be in the tree; returns a bound of the way between the hubs.

        An edge heavier than the heaviest on some way between its ends isn't in the tree; a way leads over both hubs.
        """
        s, t = self.a.leaves[p], self.b.leaves[q]
        w, one, margin, unit = self.matrix(p, q)
        la, lb = (level_a[s] / unit).astype(np.float32), (level_b[t] / unit).astype(np.float32)
        margin += 1e-6 * max(abs(la).max(), abs(lb).max())
        limit = np.maximum(la[:, None], lb[None, :])
        between = min(between, (float(np.maximum(w, limit).min()) + margin) * unit)
        may = w <= np.maximum(limit, np.float32(between / unit), out=limit) + np.float32(margin + 1e-6 * abs(between) / unit)
        if one is not None:
            may &= ~one
        i, j = np.nonzero(may)
        if len(i):
            self.add(i + s.start, j + t.start)
        return between

    def columns(self) -> tuple:
        u, v, w = self.settle()
        ids = np.sort(self.ids)
        return ids[u], ids[v], w


def _inner(a: Side, b: Side, same: bool) -> Iterator:
    """TREE (u, v, w): a minimum spanning tree of the components within a block; LEVEL (id, -, w): the heaviest edge on a way from the point to the block's hub."""
    edges, level = _Edges(a, a, True), np.zeros(len(a.ids))
    for p, s in enumerate(a.leaves):
        w, one, margin, unit = edges.matrix(p, p)
        np.fill_diagonal(w, np.inf)
        n, hub = len(w), int(a.extra["core"][s].argmin())
        i, j = _rough_tree(w, hub)
        exact = edges.weigh(i + s.start, j + s.start)
        if one is not None:
            exact[one[i, j]] = -1
        level[s] = _levels(n, i, j, exact, hub)
        limit = (level[s] / unit).astype(np.float32)
        may = np.triu(w <= np.maximum(limit[:, None], limit[None, :]) + np.float32(margin + 1e-6 * abs(limit).max()), 1)
        if one is not None:
            may &= ~one
        i, j = np.nonzero(may)
        edges.add(i + s.start, j + s.start)
    for p in range(len(a.leaves)):
        for q in range(p + 1, len(a.leaves)):
            edges.across(p, q, level, level, np.inf)
    u, v, w = edges.settle()
    ids = np.sort(a.ids)
    yield np.full(len(u), TREE, np.int32), ids[u], ids[v], w
    # a component is one place: its points hang on its first one
    hub, n = int(edges.rank[a.extra["core"].argmin()]), len(ids)
    hung = np.flatnonzero(edges.root != np.arange(n))
    whole = _levels(n, np.concatenate((u, edges.root[hung])), np.concatenate((v, hung)), np.concatenate((w, np.full(len(hung), -1.0))), hub)
    yield np.full(n, LEVEL, np.int32), ids, ids, whole


def _outer(a: Side, b: Side, between: float) -> Iterator:
    """(u, v, w): the edges between two blocks that may be in the tree."""
    edges = _Edges(a, b, False)
    level_a, level_b = a.extra["level"], b.extra["level"]
    apart = gaps(a.low, a.high, b.low, b.high)
    most = np.maximum(np.array([level_a[s].max() for s in a.leaves])[:, None], np.array([level_b[s].max() for s in b.leaves]))
    for place in np.argsort(apart, axis=None, kind="stable").tolist():
        p, q = divmod(place, len(b.leaves))
        if apart[p, q] <= max(most[p, q], between):
            between = edges.across(p, q, level_a, level_b, between)
    yield edges.columns()


def _ways(n: int, found: list) -> np.ndarray:
    """For each pair of blocks a bound of the heaviest edge between their hubs: the least over ways through other blocks."""
    out = np.full((n, n), np.inf)
    for r in found:
        out[r.i, r.j] = min(out[r.i, r.j], r.w)
        out[r.j, r.i] = out[r.i, r.j]
    for k in range(n):
        np.minimum(out, np.maximum(out[:, k][:, None], out[k]), out=out)
    return out


def joining_edges(dealt: Blocks, core: DataFrame, graph: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(u, v, w)``: the minimum spanning tree of the components, of all pairs of points; without ``labels``, each point is one.

    A tree within each block comes first.  It and the neighbour table bound the heaviest edge on some way between two
    points; the pairs of blocks, and of leaves and points in them, that are farther apart are left out.  What remains, about
    as many edges as points, holds the tree.
    """
    rows = dealt.rows.join(core, "id")
    rows = materialise(rows.withColumn("component", F.col("id")) if labels is None else rows.join(labels, "id"))
    own = np.repeat(np.flatnonzero(dealt.sizes)[:, None], 2, axis=1)
    inner = materialise(meet(rows, own, dealt, lambda a, b, same, _: _inner(a, b, same), "kind int, u long, v long, w double", extra=("core", "component")))
    tree = inner.where(F.col("kind") == TREE).select("u", "v", "w")
    if len(own) == 1:
        return materialise(tree)
    rows = materialise(rows.join(inner.where(F.col("kind") == LEVEL).select(F.col("u").alias("id"), F.col("w").alias("level")), "id"))
    most = np.zeros(len(dealt.sizes))
    for r in rows.groupBy("block").agg(F.max("level").alias("w")).collect():  # a row per block
        most[r.block] = r.w
    a, b = (rows.select(F.col("id").alias(c), F.col("block").alias(f"b_{c}"), F.greatest("level", *([F.col("core")] if labels is None else [])).alias(f"l_{c}")) for c in ("id", "nbr"))
    way = F.greatest("l_id", "l_nbr", *([F.col("d2")] if labels is None else []))
    steps = graph.select("id", "nbr", "d2").join(a, "id").join(b, "nbr").where("b_id <> b_nbr")
    steps = steps.groupBy(F.least("b_id", "b_nbr").alias("i"), F.greatest("b_id", "b_nbr").alias("j")).agg(F.min(way).alias("w")).collect()  # a row per pair of blocks
    between = _ways(len(most), steps)
    pairs = dealt.pairs(np.maximum(np.maximum(most[:, None], most), between))
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    given = between[pairs[:, 0], pairs[:, 1]]
    outer = meet(rows, pairs, dealt, lambda a, b, same, bound: _outer(a, b, bound), "u long, v long, w double", extra=("core", "component", "level"), given=given)
    edges = materialise(tree.unionByName(outer))
    nodes = rows.select("id", "component")
    if edges.count() > ONE_TREE:
        return _forest(edges, nodes)[0]
    if labels is not None:
        ends = [nodes.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")) for c in "uv"]
        edges = edges.join(ends[0], "u").join(ends[1], "v")
    else:
        edges = edges.withColumns({"c_u": F.col("u"), "c_v": F.col("v")})

    def run(group: pa.Table) -> pa.Table:
        u, v, w, cu, cv = (group.column(c).to_numpy() for c in ("u", "v", "w", "c_u", "c_v"))
        ids, place = np.unique(np.concatenate((u, v, cu, cv)), return_inverse=True)
        pu, pv, pcu, pcv = np.split(place, 4)
        root = np.arange(len(ids))
        hook(root, np.concatenate((pu, pv)), np.concatenate((pcu, pcv)))
        kept = spanning(len(ids), pu, pv, w, root)
        return pa.table({"u": u[kept], "v": v[kept], "w": w[kept]})

    return materialise(edges.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, EDGES))


def boruvka_mst(cloud: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact ``(u, v, w)`` and ``(id, core)``; edges come by (w, u, v)."""
    d, n = dimension(cloud), cloud.count()
    if not 1 <= k < n:
        raise ValueError(f"k must be from 1 to {n - 1}")
    dealt = deal(cloud, d)
    graph = materialise(knn_blocks(dealt, k))
    core = materialise(core_distances(graph, k))
    return joining_edges(dealt, core, graph), core


def prim_mst(cloud: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact, in one task, for at most PRIM_ROWS points; of more, the exact tree of :func:`boruvka_mst`, which differs by ties only."""
    if cloud.count() > PRIM_ROWS:
        return boruvka_mst(cloud, k)
    core = materialise(core_distances(knn_join(cloud, k), k))

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy())
        ids = group.column("id").to_numpy()[order]
        edges = prim(matrix(group.column("features"))[order], group.column("core").to_numpy()[order])
        return pa.table({"u": ids[edges["u"]], "v": ids[edges["v"]], "w": edges["w"]})

    rows = cloud.select("id", "features").join(core, "id").withColumn("one", F.lit(1))
    return materialise(rows.groupBy("one").applyInArrow(run, EDGES)), core


def neighbour_graph_mst(cloud: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Approximate: the spanning forest of an approximate graph of k + EXTRA_NEIGHBOURS neighbours, joined by exact bridges."""
    width = k + EXTRA_NEIGHBOURS
    if not width < cloud.count():
        raise ValueError(f"needs more than {width} points")
    graph = materialise(knn_graph(cloud, width, seed=seed))
    core = materialise(core_distances(graph, k))
    tree, labels = _forest(mrd_edges(graph, core), cloud.select("id"))
    if labels.select("component").distinct().limit(2).count() > 1:
        tree = materialise(tree.unionByName(joining_edges(deal(cloud, dimension(cloud)), core, graph, labels)))
    return tree, core


def pick_backend(n: int, d: int) -> str:
    if d <= BORUVKA_DIMS:
        return "boruvka"
    if d <= EXACT_DIMS:
        return "prim" if n <= PRIM_ROWS else "boruvka"
    return "nn_descent"


def spanning_tree(cloud: DataFrame, k: int, backend: str = "auto", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    if backend == "auto":
        backend = pick_backend(cloud.count(), dimension(cloud))
    if backend == "nn_descent":
        return neighbour_graph_mst(cloud, k, seed)
    if backend not in ("prim", "boruvka"):
        raise ValueError(f"unknown backend {backend}")
    return prim_mst(cloud, k) if backend == "prim" else boruvka_mst(cloud, k)


def cut(tree: DataFrame, ids: DataFrame, t: float) -> DataFrame:
    """``(id, component)``: components of the tree without the edges above ``t``."""
    light = tree.where(F.col("w") <= t).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return ids.select("id").join(connected_components(light), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

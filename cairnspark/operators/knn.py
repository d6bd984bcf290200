"""Nearest-neighbour joins: exact by blocks, and an approximate graph refined by local joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.frame import dimension, matrix
from cairnspark.operators.blocks import Blocks, Side, deal, exact_in_single, exactly, gaps, meet, roughly
from cairnspark.operators.components import connected_components
from cairnspark.plans.scratch import materialise

#: Points whose lists are joined in one task, about.
PIVOTS = 4096


def best(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each ``id``, ranked from 1 by distance, then smaller neighbour."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "nbr", "d2")


def _top(row: np.ndarray, nbr: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by (d2, nbr) of each row, row after row."""
    order = np.lexsort((nbr, d2, row))
    ranked = row[order]
    begins = np.append(True, ranked[1:] != ranked[:-1]).nonzero()[0] if len(ranked) else np.zeros(0, int)
    rank = np.arange(len(ranked)) - np.repeat(begins, np.diff(np.append(begins, len(ranked))))
    return order[rank < k]


class _Nearest:
    """The k nearest found so far of each point of a block, and the distance that a further one may have at most."""

    def __init__(self, side: Side, k: int, bound: np.ndarray):
        self.side, self.k, self.bound = side, k, bound
        self.found: list[tuple] = []
        self.held = 0

    def take(self, s: slice, d2: np.ndarray, margin: np.float32, unit: float, other: Side, t: slice) -> None:
        """``d2``: from the points ``s`` to the points ``t`` of the other block, roughly."""
        limit = (self.bound[s] / unit).astype(np.float32)
        wide = limit == np.inf
        if wide.any() and d2.shape[1] > self.k:
            limit[wide] = np.partition(d2[wide], self.k, axis=1)[:, self.k] + margin  # the point itself may be among them
        i, j = np.nonzero(d2 <= (limit + margin)[:, None])
        x, y = self.side.x[s], other.x[t]
        keep = self.side.ids[s][i] != other.ids[t][j]
        i, j = i[keep], j[keep]
        exact = exactly(x, y, i, j)
        keep = exact <= self.bound[s][i]
        i, j, exact = i[keep], j[keep], exact[keep]
        first = _top(i, other.ids[t][j], exact, self.k)
        self.found.append((i[first] + s.start, other.ids[t][j[first]], exact[first]))
        self.held += len(first)
        if self.held > 4 * self.k * len(self.side.ids) + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, nbr, d2 = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        first = _top(row, nbr, d2, self.k)
        row, nbr, d2 = row[first], nbr[first], d2[first]
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, int)
        full = np.bincount(row, minlength=len(self.side.ids))[row[last]] == self.k
        self.bound[row[last][full]] = np.minimum(self.bound[row[last][full]], d2[last][full])
        self.found, self.held = [(row, nbr, d2)], len(row)
        return row, nbr, d2


def _within(a: Side, b: Side, same: bool, k: int) -> Iterator:
    """The k nearest of each point within its block: its own leaf first, then the leaves that may hold nearer ones."""
    near = _Nearest(a, k, np.full(len(a.ids), np.inf))
    for p, s in enumerate(a.leaves):
        near.take(s, *roughly(a, p, a, p), a, s)
    near.settle()
    apart = gaps(a.low, a.high, a.low, a.high)
    for p, s in enumerate(a.leaves):
        for q in np.argsort(apart[p], kind="stable").tolist():
            if q != p and apart[p, q] <= near.bound[s].max():
                near.take(s, *roughly(a, p, a, q), a, a.leaves[q])
        if len(a.leaves) > 1:
            near.settle()
    row, nbr, d2 = near.settle()
    yield a.ids[row], nbr, d2


def _beyond(a: Side, b: Side, k: int) -> Iterator:
    """What the other block has for each point that is no farther than the k-th within its own."""
    sides = [_Nearest(s, k, s.extra["bound"].copy()) for s in (a, b)]
    apart = gaps(a.low, a.high, b.low, b.high)
    far = [np.array([n.bound[s].max() for s in n.side.leaves]) for n in sides]
    for p, q in np.argwhere(apart <= np.maximum(far[0][:, None], far[1])).tolist():
        s, t = a.leaves[p], b.leaves[q]
        d2, margin, unit = roughly(a, p, b, q)
        if apart[p, q] <= far[0][p]:
            sides[0].take(s, d2, margin, unit, b, t)
        if apart[p, q] <= far[1][q]:
            sides[1].take(t, d2.T, margin, unit, a, s)
    for n in sides:
        row, nbr, d2 = n.settle()
        yield n.side.ids[row], nbr, d2


def knn_blocks(dealt: Blocks, k: int) -> DataFrame:
    """As :func:`knn_join`, of points that are dealt."""
    schema = "id long, nbr long, d2 double"
    own = np.repeat(np.flatnonzero(dealt.sizes)[:, None], 2, axis=1)
    within = materialise(meet(dealt.rows, own, dealt, lambda a, b, same, _: _within(a, b, same, k), schema))
    if len(own) == 1:
        return best(within, k)
    bound = within.groupBy("id").agg(F.when(F.count("*") == k, F.max("d2")).otherwise(float("inf")).alias("bound"))
    rows = materialise(dealt.rows.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    far = np.zeros(len(dealt.sizes))
    for r in rows.groupBy("block").agg(F.max("bound").alias("far")).collect():  # a row per block
        far[r.block] = r.far
    pairs = dealt.pairs(np.maximum(far[:, None], far))
    beyond = meet(rows, pairs[pairs[:, 0] < pairs[:, 1]], dealt, lambda a, b, same, _: _beyond(a, b, k), schema, extra=("bound",))
    return best(within.unionByName(beyond), k)


def knn_join(cloud: DataFrame, k: int) -> DataFrame:
    """``(id, rank, nbr, d2)``: the k nearest other points of each, ascending, ties to the smaller id; needs 1 <= k < n.

    The k nearest of its own block bound how far a point looks: only blocks and leaves within that distance are compared,
    which are few in few dimensions and may be all in many.
    """
    d, n = dimension(cloud), cloud.count()
    if not 1 <= k < n:
        raise ValueError(f"k must be from 1 to {n - 1}")
    return knn_blocks(deal(cloud, d), k)


def k_distance(cloud: DataFrame, k: int) -> DataFrame:
    """``(id, d2)``: the squared distance to the k-th nearest other point."""
    return knn_join(cloud, k).where(F.col("rank") == k).select("id", "d2")


def _pairs_in(ids: np.ndarray, x: np.ndarray, k: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of all pairs among the points of one bucket; with ``fresh``, pairs with at least one fresh point."""
    every, (ids, first) = ids, np.unique(ids, return_index=True)
    x = x[first]
    d2 = np.maximum(0, ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) if len(x) <= 64 else _dense(x)
    np.fill_diagonal(d2, np.inf)
    if fresh is not None:
        new = np.zeros(len(ids), bool)
        new[np.searchsorted(ids, every[fresh])] = True
        d2[~(new[:, None] | new[None, :])] = np.inf
    order = np.argsort(d2, axis=1, kind="stable")[:, :k]  # columns are in order of id, so ties go to the smaller one
    row = np.repeat(np.arange(len(ids)), order.shape[1])
    value = d2[row, order.ravel()]
    keep = np.isfinite(value)
    return ids[row][keep], ids[order.ravel()][keep], value[keep]


def _found(columns: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"id": pa.array(columns[0], pa.int64()), "nbr": pa.array(columns[1], pa.int64()), "d2": pa.array(columns[2], pa.float64())})


def _local_join(lists: pa.Table, points: pa.Table, k: int) -> pa.Table:
    """Of the lists of one block's pivots, the k best pairs of each that are no farther than the k-th neighbour of a point so far."""
    order = np.argsort(points.column("id").to_numpy())
    ids, bound, x = points.column("id").to_numpy()[order], points.column("bound").to_numpy()[order], matrix(points.column("features"))[order]
    members, held, whole = lists.column("members").combine_chunks(), [], []
    fresh, flat = (members.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("fresh", "id"))
    place, ends = np.searchsorted(ids, flat), np.cumsum(members.value_lengths().to_numpy())

    def settle() -> None:
        row, nbr, d2 = (np.concatenate(c) for c in zip(*held, strict=True))
        own = np.lexsort((d2, nbr, row))
        row, nbr, d2 = row[own], nbr[own], d2[own]
        first = np.append(True, (row[1:] != row[:-1]) | (nbr[1:] != nbr[:-1])) if len(row) else np.zeros(0, bool)
        held[:] = [(row[first], nbr[first], d2[first])]

    size = 0
    for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        row, nbr, d2 = _pairs_in(flat[begin:end], x[place[begin:end]], k, fresh[begin:end])
        near = d2 <= bound[np.searchsorted(ids, row)]
        held.append((row[near], nbr[near], d2[near]))
        size += int(near.sum())
        if size > 1_000_000:
            settle()
            whole, held, size = [*whole, held[0]], [], 0
    if held:
        settle()
        whole.append(held[0])
    return _found(tuple(np.concatenate(c) for c in zip(*whole, strict=True)) if whole else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))


def _dense(x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(x)))
    for a in range(0, len(x), 64):
        out[a : a + 64] = ((x[a : a + 64, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return out


def knn_graph(cloud: DataFrame, k: int, max_iter: int = 10, delta: float = 1e-3, seed: int = 0, trees: int = 4) -> DataFrame:
    """An approximate ``(id, rank, nbr, d2)``, refined until fewer than delta * n * k entries change in a round.

    Start: ``trees`` forests of random hyperplanes split the points into leaves of about max(2k, 8); all pairs of a leaf
    are candidates.  A round: the neighbours of a point, forward and reverse, are candidates of each other if one of them
    is new to the point; reverse lists are thinned, by a hash, to the length of the forward ones.  Pivots go to the task of
    their block of near points, so that a point travels once for each block that has it on a list, not for each list; pairs
    farther apart than the k-th neighbour so far stay behind.
    """
    d, n = dimension(cloud), cloud.count()
    if not 1 <= k < n:
        raise ValueError(f"k must be from 1 to {n - 1}")
    leaf = max(2 * k, 8)
    depth = max(0, int(np.ceil(np.log2(max(1.0, n / leaf)))))
    rng = np.random.Generator(np.random.PCG64(seed))
    planes = rng.standard_normal((trees, depth, d))
    centre = np.array([r or 0.0 for r in cloud.agg(*[F.avg(F.get("features", F.lit(j))).alias(f"m{j}") for j in range(d)]).first()])
    schema = "id long, nbr long, d2 double"

    def leaves(batches):
        for batch in batches:
            x = matrix(batch.column(1)) - centre
            for t in range(trees):
                code = ((x @ planes[t].T) > 0) @ (1 << np.arange(depth)) if depth else np.zeros(len(x), np.int64)
                yield pa.record_batch([pa.array(np.full(len(x), t)), pa.array(code.astype(np.int64)), batch.column(0), batch.column(1)], names=["tree", "leaf", "id", "features"])

    single = exact_in_single(cloud)
    kind = "array<float>" if single else "array<double>"
    cloud = cloud.select("id", "features")
    homes = deal(cloud, d, single=single, most=PIVOTS).rows.select("id", "block")
    cloud = materialise(cloud.select("id", F.col("features").cast(kind).alias("features")))
    rows = cloud.mapInArrow(leaves, f"tree long, leaf long, id long, features {kind}")
    # a leaf that came out large is cut into parts of bounded size; what that parts, later rounds join
    sizes = rows.groupBy("tree", "leaf").agg(F.count("*").alias("g"))
    rows = rows.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("g") / 1024)))
    found = rows.groupBy("tree", "leaf", "part").applyInArrow(lambda g: _found(_pairs_in(g.column("id").to_numpy(), matrix(g.column("features")), k)), schema)
    ids = cloud.select("id")
    chance = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")).withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "id", "j"), F.lit(n)))
    numbered = _numbered(ids)
    random = chance.join(numbered.select(F.col("id").alias("nbr"), "slot"), "slot").where("id <> nbr").select("id", "nbr").distinct()
    random = _measured(random, cloud)
    graph = materialise(best(found.unionByName(random).dropDuplicates(["id", "nbr"]), k).withColumn("fresh", F.lit(True)))
    for _ in range(max_iter):
        forward = graph.select(F.col("id").alias("pivot"), F.col("nbr").alias("id"), "fresh")
        reverse = graph.select(F.col("nbr").alias("pivot"), "id", "fresh").withColumn("r", F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64(F.lit(seed), "pivot", "id")))).where(F.col("r") <= 2 * k).drop("r")
        lists = forward.unionByName(reverse).groupBy("pivot").agg(F.collect_list(F.struct("id", "fresh")).alias("members")).where(F.exists("members", lambda m: m["fresh"]))
        lists = materialise(lists.join(homes.withColumnRenamed("id", "pivot"), "pivot").select("block", "members"))
        bound = graph.groupBy("id").agg(F.when(F.count("*") == k, F.max("d2")).otherwise(float("inf")).alias("bound"))
        listed = lists.select(F.col("block").alias("home"), F.explode("members.id").alias("id")).distinct()
        points = listed.join(cloud.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "id")
        near = lists.groupBy("block").cogroup(points.groupBy("home")).applyInArrow(lambda a, b: _local_join(a, b, k), schema)
        old = graph.select("id", "nbr", "d2", F.lit(False).alias("fresh"))
        # by id at once, for both the pairs and their ranks
        merged = old.unionByName(near.withColumn("fresh", F.lit(True))).repartition("id").groupBy("id", "nbr").agg(F.min("d2").alias("d2"), F.min("fresh").alias("fresh"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr"))
        graph = materialise(merged.withColumn("rank", rank).where(F.col("rank") <= k))
        if graph.where("fresh").count() < delta * n * k:
            break
    return graph.select("id", "rank", "nbr", "d2")


def _numbered(ids: DataFrame) -> DataFrame:
    """Ids with distinct slots 0, 1, ...: the order is that of a hash, by partitions of it."""
    parts = materialise(ids.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(256))))
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("p").count().select("p", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    return parts.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1).join(base, "p").select("id", (F.col("r") + F.col("base")).alias("slot"))


def _measured(pairs: DataFrame, cloud: DataFrame) -> DataFrame:
    from cairnspark.functions.distance import sq_euclidean

    a, b = (cloud.select(F.col("id").alias(c), F.col("features").alias(f"f_{c}")) for c in ("id", "nbr"))
    return pairs.join(a, "id").join(b, "nbr").select("id", "nbr", sq_euclidean(*(F.col(f"f_{c}").cast("array<double>") for c in ("id", "nbr"))).alias("d2"))


def is_connected(graph: DataFrame, n: int) -> bool:
    """Whether the graph, undirected, joins all ``n`` points."""
    parts = connected_components(graph.select(F.col("id").alias("src"), F.col("nbr").alias("dst")))
    row = parts.agg(F.count("*").alias("n"), F.countDistinct("component").alias("c")).first()
    return n <= 1 or (row.n == n and row.c == 1)

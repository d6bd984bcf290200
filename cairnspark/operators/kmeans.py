"""k-means: seeding, Lloyd iterations, restarts.

Only what has k rows reaches the driver; a pass over the points is one job of a projection and a partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.frame import dimension, matrix
from cairnspark.operators.nearest import assign, closest, mean_variance
from cairnspark.operators.sampling import generator, prefix_pick

#: A seeder: (cloud, k, seed, n, d) -> k x d centroids.
Seeder = Callable[[DataFrame, int, int, int, int], np.ndarray]

AFK_ROWS, AFK_K, CHAIN = 500_000, 100, 64
BEST_ROWS, BEST_DIMS, BEST_K, BEST_CELLS = 5000, 8, 16, 80_000


@dataclass
class KMeansResult:
    labels: DataFrame
    centroids: np.ndarray
    inertia: float
    n_iter: int
    converged: bool

    def centroid_frame(self) -> DataFrame:
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(self.centroids)]
        return self.labels.sparkSession.createDataFrame(rows, "label int, centroid array<double>")


def _fetch(cloud: DataFrame, ids: list[int]) -> dict[int, np.ndarray]:
    return {r.id: np.array(r.features, dtype=float) for r in cloud.where(F.col("id").isin(ids)).collect()}


def _uniform(cloud: DataFrame, draws: list[float]) -> list[int]:
    return prefix_pick(cloud.select("id", F.lit(1.0).alias("w")), draws)


def local_trials(k: int) -> int:
    """Candidates of each greedy round."""
    return 1 if k <= 1 else 2 + int(math.log(k))


def greedy_seeds(cloud: DataFrame, k: int, seed: int, n: int, d: int) -> np.ndarray:
    """Greedy k-means++: the first uniform; then, of a few candidates drawn by squared distance, the one that leaves the least; uniform where all distances are 0."""
    rng = generator(seed)
    bounds = tuple(cloud.agg(F.min("id"), F.max("id")).first())
    ids = _uniform(cloud, [float(rng.integers(n))])
    chosen = np.array([_fetch(cloud, ids)[ids[0]]])
    total = None
    for _ in range(1, k):
        weights = assign(cloud, chosen).select("id", F.col("d2").alias("w"))
        if total is None:
            total = weights.agg(F.sum("w")).first()[0]
        draws = rng.random(local_trials(k))
        ids = prefix_pick(weights, (draws * total).tolist(), bounds=bounds) if total > 0 else _uniform(cloud, (draws * n).tolist())
        found = _fetch(cloud, list(set(ids)))
        candidates = np.array([found[i] for i in ids])
        potential = _potentials(cloud, chosen, candidates)
        best = int(np.argmin(potential))
        chosen, total = np.vstack((chosen, candidates[best])), potential[best]
    return chosen


def _potentials(cloud: DataFrame, chosen: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The sum of squared distances that would be left with each candidate."""
    shared = cloud.sparkSession.sparkContext.broadcast((chosen, candidates))

    def run(batches):
        own, more = shared.value
        total = np.zeros(len(more))
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                least = closest(x, own)[1]
                total += [np.minimum(least, ((x - c) ** 2).sum(axis=1)).sum() for c in more]
        yield pa.record_batch([pa.array(np.arange(len(more))), pa.array(total)], names=["k", "s"])

    rows = cloud.select("id", "features").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(candidates))
    for r in rows:
        out[r.k] = r.s
    return out


def afkmc2_seeds(cloud: DataFrame, k: int, seed: int, n: int, d: int) -> np.ndarray:
    """AFK-MC2: a Metropolis chain of CHAIN proposals for each centroid, drawn by half the squared distance to the first and half uniform."""
    rng = generator(seed)
    ids = _uniform(cloud, [float(rng.integers(n))])
    chosen = np.array([_fetch(cloud, ids)[ids[0]]])
    if k == 1:
        return chosen
    weights = assign(cloud, chosen)
    total = weights.agg(F.sum("d2")).first()[0]
    q = F.col("d2") / (2 * total) + 1 / (2 * n) if total > 0 else F.lit(1 / n)
    proposals = weights.select("id", q.alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
    draws = rng.random((k - 1) * (CHAIN + 1))
    ids = []
    for a in range(0, len(draws), 512):
        ids += prefix_pick(proposals, draws[a : a + 512].tolist())
    share = {r.id: r.w for r in proposals.where(F.col("id").isin(list(set(ids)))).collect()}
    proposals.unpersist()
    found = _fetch(cloud, list(set(ids)))
    accept = rng.random((k - 1) * CHAIN)
    for j in range(k - 1):
        own = ids[j * (CHAIN + 1) : (j + 1) * (CHAIN + 1)]
        x = np.array([found[i] for i in own])
        d2 = closest(x, chosen)[1]
        at = 0
        for t in range(1, CHAIN + 1):
            numerator, denominator = d2[t] * share[own[at]], d2[at] * share[own[t]]
            if denominator <= 0 or accept[j * CHAIN + t - 1] * denominator < numerator:
                at = t
        chosen = np.vstack((chosen, x[at]))
    return chosen


def pick_seeder(n: int, d: int, k: int, best_of: bool = False) -> Seeder:
    """AFK-MC2 where greedy rounds would cost too many passes, else greedy."""
    if (n >= AFK_ROWS and k >= AFK_K) or (best_of and n >= BEST_ROWS and d >= BEST_DIMS and k >= BEST_K and n * d >= BEST_CELLS):
        return afkmc2_seeds
    return greedy_seeds


def _pass(cloud: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and counts by nearest centroid, and the inertia: partial in each task, then added."""
    k, d = centroids.shape
    shared = cloud.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        sums, counts, inertia = np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                label, d2 = closest(x, shared.value)
                order = np.argsort(label, kind="stable")
                there, first = np.unique(label[order], return_index=True)
                sums[there] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(label, minlength=k)
                inertia += np.bincount(label, d2, k)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held), pa.array(counts[held]), pa.array(inertia[held]), pa.array(list(sums[held]), pa.list_(pa.float64()))], names=["label", "n", "inertia", "sums"])

    rows = cloud.select("id", "features").mapInArrow(run, "label long, n double, inertia double, sums array<double>")
    added = rows.groupBy("label").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(d)]).alias("sums")).collect()
    sums, counts, inertia = np.zeros((k, d)), np.zeros(k), 0.0
    for r in sorted(added, key=lambda r: r.label):
        sums[r.label], counts[r.label] = r.sums, r.n
        inertia += r.inertia
    return sums, counts, inertia


def lloyd(cloud: DataFrame, centroids: np.ndarray, max_iter: int = 300, tol: float = 1e-4, mean_var: float | None = None) -> tuple[np.ndarray, float, int, bool]:
    """Centroids, inertia, iterations, converged.

    Stops when the summed squared shift is at most tol times the mean variance of the coordinates.  Empty groups, by
    number, take the points farthest from their centroids, by distance and then id; a donor keeps counting for its old
    group in that round.
    """
    centroids = np.array(centroids, dtype=float)
    limit = tol * (mean_variance(cloud, centroids.shape[1]) if mean_var is None else mean_var)
    n_iter, converged = 0, False
    for n_iter in range(1, max_iter + 1):
        sums, counts, _ = _pass(cloud, centroids)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = assign(cloud, centroids).orderBy(F.desc("d2"), "id").limit(len(empty)).collect()
            found = _fetch(cloud, [r.id for r in far])
            for label, r in zip(empty, far, strict=False):
                sums[label], counts[label] = found[r.id], 1
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        shift = float(((new - centroids) ** 2).sum())
        centroids = new
        if shift <= limit:
            converged = True
            break
    return centroids, _pass(cloud, centroids)[2], n_iter, converged


def kmeans(cloud: DataFrame, k: int, max_iter: int = 300, tol: float = 1e-4, seed: int = 0, n_init: int = 1, init: np.ndarray | None = None, seeder: Seeder | None = None) -> KMeansResult:
    """The best of ``n_init`` runs with seeds seed, seed + 1, ...; the first of equally good ones.  ``init`` gives the centroids to start from."""
    d, n = dimension(cloud), cloud.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be from 1 to the number of points, {n}")
    if d == 0:
        raise ValueError("points need a dimension")
    if max_iter < 1 or n_init < 1 or not tol >= 0:
        raise ValueError("max_iter and n_init must be at least 1, tol at least 0")
    cloud = cloud.select("id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    variance, best = mean_variance(cloud, d), None
    for run in range(n_init if init is None else 1):
        start = np.array(init, dtype=float) if init is not None else (seeder or pick_seeder(n, d, k, n_init > 1))(cloud, k, seed + run, n, d)
        found = lloyd(cloud, start, max_iter, tol, variance)
        if best is None or found[1] < best[1]:
            best = found
    labels = assign(cloud, best[0])
    return KMeansResult(labels, *best)

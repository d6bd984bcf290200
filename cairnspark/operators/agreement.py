"""Agreement of groupings: contingency, adjusted Rand index, alignment of labels, disagreement, elbow of k-distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.operators.knn import knn_join


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(a, b, n)`` of two frames (id, label)."""
    joined = a.select("id", F.col("label").alias("a")).join(b.select("id", F.col("label").alias("b")), "id")
    return joined.groupBy("a", "b").agg(F.count("*").alias("n"))


def adjusted_rand_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``ari``; 1 where both sides are a single group, or all groups are single points."""
    cells = contingency(a, b)
    two = lambda c: c * (c - 1) / 2
    both = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    joined = both.crossJoin(rows).crossJoin(cols)  # a row each
    expected = F.col("sa") * F.col("sb") / F.when(two(F.col("n")) > 0, two(F.col("n")))
    most = (F.col("sa") + F.col("sb")) / 2
    return joined.select(F.when(F.coalesce(most == expected, F.lit(True)), F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def hungarian(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost matrix with no more rows than columns, the column of a cheapest assignment (shortest augmenting paths with potentials)."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            reduced = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            step = np.where(used[1:], np.inf, least[1:])
            nxt = int(np.argmin(step)) + 1
            delta = step[nxt - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def align_labels(truth: DataFrame, found: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``found`` with the names of ``truth`` where groups overlap most, noise aside; unmatched groups keep their names, or take new ones where those are taken."""
    cells = contingency(truth, found).where("a >= 0 AND b >= 0").collect()  # groups by groups
    names_a, names_b = sorted({r.a for r in cells}), sorted({r.b for r in cells})
    counts = np.zeros((len(names_b), max(len(names_a), len(names_b))))
    for r in cells:
        counts[names_b.index(r.b), names_a.index(r.a)] = r.n
    remap: dict[int, int] = {}
    if cells:
        for k, j in enumerate(hungarian(-counts)):
            if j < len(names_a) and counts[k, j] > 0:
                remap[names_b[k]] = names_a[j]
    every = [r.label for r in found.where("label >= 0").select("label").distinct().collect()]
    taken, fresh = set(remap.values()), max([*names_a, *every, -1]) + 1
    for b in sorted(every):
        if b not in remap:
            if b in taken:
                remap[b], fresh = fresh, fresh + 1
            else:
                remap[b] = b
            taken.add(remap[b])
    if not remap:
        return found.select("id", "label"), remap
    lookup = F.create_map(*[F.lit(x) for pair in remap.items() for x in pair])
    return found.select("id", F.coalesce(lookup[F.col("label")], F.col("label")).cast("int").alias("label")), remap


def disagreement(truth: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, differs)``: whether either grouping differs from the truth."""
    joined = truth.select("id", F.col("label").alias("t")).join(a.select("id", F.col("label").alias("a")), "id").join(b.select("id", F.col("label").alias("b")), "id")
    return joined.select("id", ((F.col("a") != F.col("t")) | (F.col("b") != F.col("t"))).alias("differs"))


def noise_fraction(labels: DataFrame) -> DataFrame:
    return labels.agg(F.avg((F.col("label") == -1).cast("double")).alias("noise_fraction"))


def knee(distances: DataFrame, value: str = "d") -> float | None:
    """The elbow of a convex ascending curve: the largest fall of the normalised curve below the diagonal that comes back afterwards; the first of equal ones.

    ``distances`` is (id, d).  Ranks are taken within ranges of the value, then over them.
    """
    row = distances.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count("*").alias("n")).first()
    if row.n < 3 or row.b <= row.a:
        return None
    part = F.least(F.lit(255), F.floor((F.col(value) - row.a) / (row.b - row.a) * 256))
    ranged = distances.select("id", F.col(value).alias("v"), part.alias("part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    ranked = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("v", "id")) - 1).join(base, "part")
    gap = (F.col("r") + F.col("base")) / (row.n - 1) - (F.col("v") - row.a) / (row.b - row.a)
    best = ranked.select(gap.alias("gap"), "v", "id").agg(F.max(F.struct("gap", (-F.col("v")).alias("v"))).alias("m")).first().m
    return -best.v if best.gap > 0 else None


def knee_eps(cloud: DataFrame, k: int) -> float:
    """The radius at the elbow of distances to the k-th nearest point, the point itself counted; their median where there is no elbow."""
    if k < 2:
        return 0.0
    curve = knn_join(cloud, k - 1).where(F.col("rank") == k - 1).select("id", F.sqrt("d2").alias("d"))
    found = knee(curve)
    return found if found is not None else curve.agg(F.percentile("d", 0.5)).first()[0]


def resolve_eps(policy: str, base: float, cloud: DataFrame, d: int, min_samples: int) -> float:
    """``fixed``: base; ``sqrt_d``: base * sqrt(d / 2); ``knee``: from the data."""
    if policy == "fixed":
        return base
    if policy == "sqrt_d":
        return base * (d / 2) ** 0.5
    if policy == "knee":
        return knee_eps(cloud, min_samples)
    raise ValueError(f"unknown policy {policy}")

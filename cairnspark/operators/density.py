"""Density-based grouping: cores, their components, borders and noise."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.frame import dimension
from cairnspark.operators.blocks import Side, deal, hits, meet, tiles
from cairnspark.operators.components import connected_components, hook
from cairnspark.operators.range_join import check_radius, raise_if_any
from cairnspark.plans.scratch import materialise

LINK, OWN, RIM = range(3)
LINKS = "kind int, x long, y long"


@dataclass
class Grouping:
    """``labels``: (id, label), -1 for noise; ``points``: (id, degree, is_core); the number of groups."""

    labels: DataFrame
    points: DataFrame
    n_clusters: int


def numbered(components: DataFrame) -> DataFrame:
    """``(id, label)`` from ``(id, component)``: labels from 0 in the order of the smallest id of each component.

    Components are named by that id, so only the names are ranked: over ranges of them first, then within each.
    """
    names = materialise(components.select("component").distinct())
    n = names.count()
    ranges = max(1, n // 100_000)
    if ranges == 1:
        ranked = names.withColumn("label", F.row_number().over(Window.orderBy("component")) - 1)
    else:
        cuts = names.agg(F.percentile_approx("component", [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
        part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("component")))
        parts = materialise(names.withColumn("part", part))
        before = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}  # one row per range
        base, total = {}, 0
        for p in sorted(before):
            base[p], total = total, total + before[p]
        lookup = F.create_map(*[F.lit(v) for p, b in base.items() for v in (p, b)])
        ranked = parts.withColumn("label", F.row_number().over(Window.partitionBy("part").orderBy("component")) - 1 + lookup[F.col("part")]).drop("part")
    return components.join(ranked, "component").select("id", F.col("label").cast("int").alias("label"))


def _degrees(a: Side, b: Side, same: bool, limit: float) -> Iterator:
    """(id, n): how many points of the other block are around each."""
    counts = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    for p, q in tiles(a, b, limit, same):
        hit = hits(a, p, b, q, limit)
        counts[0][a.leaves[p]] += np.add.reduce(hit.view(np.int8), axis=1, dtype=np.int32)
        if not (same and p == q):
            counts[0 if same else 1][b.leaves[q]] += np.add.reduce(hit.view(np.int8), axis=0, dtype=np.int32)
    for side, n in zip((a,) if same else (a, b), counts):
        yield side.ids[n > 0], n[n > 0]


def _links(a: Side, b: Side, same: bool, limit: float) -> Iterator:
    """(kind, x, y): LINK, groups x and y of cores are one; OWN, core x is in group y of its block; RIM, y is the group of a core around x, no core."""
    sides = (a,) if same else (a, b)
    core = [s.extra["is_core"] for s in sides]
    names, place = np.unique(np.concatenate([s.extra["own"] for s in sides]), return_inverse=True)
    place = np.split(place, [len(a.ids)])
    root = np.arange(len(names))
    core_a, core_b, own_a, own_b = core[0], core[-1], place[0], place[0] if same else place[1]
    for p, q in tiles(a, b, limit, same):
        s, t = a.leaves[p], b.leaves[q]
        ra, rb = root[own_a[s]], root[own_b[t]]
        ca, cb = core_a[s], core_b[t]
        linked = not ca.any() or not cb.any() or (len(np.unique(np.concatenate((ra[ca], rb[cb])))) == 1)
        rims = (ca.any() and not cb.all()) or (cb.any() and not ca.all())
        if linked and not rims:
            continue
        hit = hits(a, p, b, q, limit)
        if not linked:
            i, j = np.nonzero(hit & ca[:, None] & cb[None, :] & (ra[:, None] != rb[None, :]))
            hook(root, *np.divmod(np.unique(ra[i] * len(root) + rb[j]), len(root)))
        for rim, other, ids, groups, found in ((~ca, cb, a.ids[s], own_b[t], hit), (~cb, ca, b.ids[t], own_a[s], hit.T)):
            if rim.any() and other.any():
                rows = np.flatnonzero(rim)
                i, j = np.nonzero(found[rows] & other[None, :])
                yield np.full(len(i), RIM, np.int32), ids[rows[i]], names[groups[j]]
            if same and p == q:
                break
    moved = np.flatnonzero(root != np.arange(len(root)))
    yield np.full(len(moved), LINK, np.int32), names[moved], names[root[moved]]
    if same:
        ids = a.ids[core_a]
        yield np.full(len(ids), OWN, np.int32), ids, names[root[own_a[core_a]]]


def dbscan(cloud: DataFrame, eps: float, min_pts: int, strategy: str = "auto") -> Grouping:
    """Groups of ``(id, features)``.

    A core has ``min_pts`` points or more, itself included, within ``eps`` (inclusive).  Cores within ``eps`` of each
    other are one group, numbered by their smallest core; another point takes the lowest group among the cores around it.
    Pairs of near points are counted and linked in the tasks that find them and never written: first the groups within each
    block, then what links those.  ``strategy`` "block" compares all pairs of blocks, else those whose boxes are near.
    """
    if min_pts < 1:
        raise ValueError("min_pts must be at least 1")
    check_radius(eps)
    d = dimension(cloud)
    if not d:  # no points, or points without coordinates, which can't be told apart
        raise_if_any(cloud)
        points = cloud.select("id", F.lit(0).cast("long").alias("degree"), F.lit(False).alias("is_core"))
        return Grouping(cloud.select("id", F.lit(-1).alias("label")), points, 0)
    limit = eps * eps
    dealt = deal(cloud, d)
    pairs = dealt.pairs(np.inf if strategy == "block" else limit)
    counts = meet(dealt.rows, pairs, dealt, lambda a, b, same, _: _degrees(a, b, same, limit), "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("degree"))
    points = materialise(cloud.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("degree", F.lit(0)) >= min_pts).alias("is_core")))
    run = lambda a, b, same, _: _links(a, b, same, limit)
    flagged = dealt.rows.join(points.select("id", "is_core"), "id").withColumn("own", F.col("id"))
    within = materialise(meet(flagged, pairs[pairs[:, 0] == pairs[:, 1]], dealt, run, LINKS, extra=("is_core", "own")))
    own = within.where(F.col("kind") == OWN).select(F.col("x").alias("id"), F.col("y").alias("own"))
    flagged = dealt.rows.join(points.select("id", "is_core"), "id").join(own, "id", "left").withColumn("own", F.coalesce("own", "id"))
    across = materialise(meet(flagged, pairs[pairs[:, 0] < pairs[:, 1]], dealt, run, LINKS, extra=("is_core", "own")))
    links = across.where(F.col("kind") == LINK).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    joined = connected_components(links).withColumnRenamed("id", "own")
    merged = own.join(joined, "own", "left").select("id", F.coalesce("component", "own").alias("component"))
    groups = materialise(numbered(merged))
    n = groups.agg(F.max("label")).first()[0]
    # within a block a rim names cores, across blocks the groups of cores, which are cores too
    rim = points.where("NOT is_core").select("id")
    near = within.unionByName(across).where(F.col("kind") == RIM).select(F.col("x").alias("src"), F.col("y").alias("id")).join(groups, "id").groupBy("src").agg(F.min("label").alias("label"))
    border = rim.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
    return Grouping(groups.unionByName(border), points, 0 if n is None else n + 1)

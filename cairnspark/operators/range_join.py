"""Similarity joins: pairs of points within a radius, exactly, each pair once.

Points are dealt to blocks (:mod:`cairnspark.operators.blocks`), and a task compares two of them.  ``grid`` and ``auto``
compare the blocks and leaves whose boxes are within the radius, ``block`` compares all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.frame import dimension
from cairnspark.functions.distance import sq_euclidean
from cairnspark.operators.blocks import Side, deal, exact_in_single, exactly, hits, meet, tiles

PAIRS = "src long, dst long, d2 double"


def check_radius(radius: float) -> None:
    if not radius >= 0:
        raise ValueError("the radius must be a number of at least 0")


def raise_if_any(cloud: DataFrame) -> None:
    if cloud.take(1):
        raise ValueError("points need coordinates")


def _near(a: Side, b: Side, same: bool, limit: float, alone: bool) -> Iterator:
    for p, q in tiles(a, b, limit, same):
        s, t = a.leaves[p], b.leaves[q]
        i, j = np.nonzero(hits(a, p, b, q, limit))
        src, dst, d2 = a.ids[s][i], b.ids[t][j], exactly(a.x[s], b.x[t], i, j)
        if same and p == q:
            keep = src <= dst
            src, dst, d2 = src[keep], dst[keep], d2[keep]
        yield (np.minimum(src, dst), np.maximum(src, dst), d2) if alone else (src, dst, d2)


def range_join(a: DataFrame, b: DataFrame, radius: float, strategy: str = "auto") -> DataFrame:
    """``(src, dst, d2)``: pairs of a point of ``a`` and one of ``b``, without nulls, with d2 <= radius^2."""
    check_radius(radius)
    d = dimension(a)
    if not d:
        raise_if_any(a)
        return a.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"))
    limit = radius * radius
    b = b.where(F.col("id").isNotNull() & (F.size("features") == d) & F.forall("features", lambda x: x.isNotNull()))
    single = exact_in_single(a) and exact_in_single(b)
    left = deal(a, d, single=single)
    right = deal(b, d, left, single)
    pairs = left.pairs(np.inf if strategy == "block" else limit, right)
    return meet(left.rows, pairs, left, lambda x, y, same, _: _near(x, y, False, limit, False), PAIRS, right.rows)


def range_self_join(cloud: DataFrame, radius: float, strategy: str = "auto") -> DataFrame:
    """``(src, dst, d2)`` with src <= dst, every point with itself included."""
    check_radius(radius)
    d = dimension(cloud)
    if not d:  # no points, or points without coordinates, which can't be told apart
        raise_if_any(cloud)
        return cloud.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"))
    limit, dealt = radius * radius, deal(cloud, d)
    pairs = dealt.pairs(np.inf if strategy == "block" else limit)
    return meet(dealt.rows, pairs, dealt, lambda x, y, same, _: _near(x, y, same, limit, True), PAIRS)


def radius_query(cloud: DataFrame, q: list[float], radius: float, limit: int | None = None) -> DataFrame:
    """``(id, d2)`` of the points within the radius of one place, at most ``limit`` of them."""
    check_radius(radius)
    hits = cloud.select("id", sq_euclidean(F.col("features"), F.array(*[F.lit(float(v)) for v in q])).alias("d2")).where(F.col("d2") <= radius * radius)
    return hits if limit is None else hits.limit(limit)


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of the pairs of a self-join, a point as its own neighbour once."""
    return pairs.select("src", "dst").unionByName(pairs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(pairs: DataFrame, min_pts: int) -> DataFrame:
    """``(id, degree, is_core)``; the degree counts the point itself."""
    return neighbours(pairs).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).withColumn("is_core", F.col("degree") >= min_pts)

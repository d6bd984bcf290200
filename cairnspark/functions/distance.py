"""Distances as Column expressions over arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def sq_euclidean(a: Column, b: Column) -> Column:
    """Sum of squared differences; 0 for empty arrays."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of absolute differences."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm_sq(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x * x))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 if either side has no length."""
    na, nb = norm_sq(a), norm_sq(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - dot(a, b) / F.sqrt(na * nb))


METRICS: dict[str, Metric] = {"sq_euclidean": sq_euclidean, "manhattan": manhattan, "cosine": cosine}


def register_metric(name: str, metric: Metric, spark: SparkSession | None = None) -> None:
    """Adds a metric; with ``spark``, also the Python function of two arrays ``metric.sql`` (if it has one) to SQL."""
    if name in METRICS:
        raise ValueError(f"metric {name} exists")
    METRICS[name] = metric
    function = getattr(metric, "sql", None)
    if spark is not None and function is not None:
        spark.udf.register(name, function)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {', '.join(sorted(METRICS))}")
    return METRICS[metric](a, b)


def _boxes(gap: Callable[[Column, Column, Column], Column], p: Column, low: Column, high: Column) -> Column:
    three = F.zip_with(F.zip_with(p, low, lambda x, a: F.struct(x.alias("x"), a.alias("a"))), high, lambda s, b: gap(s["x"], s["a"], b))
    return _sum(F.transform(three, lambda g: g * g))


def point_box_gap_sq(p: Column, low: Column, high: Column) -> Column:
    """Squared distance from a point to a box, 0 inside."""
    return _boxes(lambda x, a, b: F.greatest(a - x, x - b, F.lit(0.0)), p, low, high)


def point_box_farthest_sq(p: Column, low: Column, high: Column) -> Column:
    """Largest squared distance from a point to a point of a box."""
    return _boxes(lambda x, a, b: F.greatest(F.abs(x - a), F.abs(x - b)), p, low, high)


def box_box_gap_sq(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Squared distance between two boxes, 0 where they meet."""
    ab = F.zip_with(low_b, high_a, lambda lb, ha: lb - ha)
    ba = F.zip_with(low_a, high_b, lambda la, hb: la - hb)
    return _sum(F.zip_with(ab, ba, lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), F.lit(2))))


def nearest(p: Column, centroids: Column, metric: Metric = sq_euclidean) -> Column:
    """Struct (distance, label) of the nearest of an array of arrays; ties go to the lowest label."""
    return F.array_min(F.transform(centroids, lambda c, i: F.struct(metric(p, c).alias("distance"), i.cast("int").alias("label"))))

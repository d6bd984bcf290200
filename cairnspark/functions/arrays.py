"""Views of point clouds and arrays: slices, transposition, reshaping, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row(cloud: DataFrame, i: int) -> DataFrame:
    return cloud.where(F.col("id") == i)


def column(cloud: DataFrame, j: int) -> DataFrame:
    """Coordinate ``j`` (from 0) of every point as ``value``."""
    return cloud.select("id", F.get("features", F.lit(j)).alias("value"))


def slice_rows(cloud: DataFrame, begin: int, end: int, step: int = 1) -> DataFrame:
    """Points with ids begin, begin + step, ... below end; the step must be positive."""
    if step <= 0:
        raise ValueError("step must be positive")
    return cloud.where((F.col("id") >= begin) & (F.col("id") < end) & (F.pmod(F.col("id") - begin, F.lit(step)) == 0))


def slice_columns(cloud: DataFrame, begin: int, end: int, step: int = 1) -> DataFrame:
    """Coordinates begin, begin + step, ... below end, which is clamped to the dimension."""
    if step <= 0:
        raise ValueError("step must be positive")
    return cloud.withColumn("features", F.filter("features", lambda x, i: (i >= begin) & (i < end) & (F.pmod(i - begin, F.lit(step)) == 0)))


def transpose(cloud: DataFrame) -> DataFrame:
    """Row j of the result has coordinate j of all points, by id.  A result row is as long as the cloud has points."""
    cells = cloud.select("id", F.posexplode("features").alias("j", "x"))
    rows = cells.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("r"))
    return rows.select(F.col("j").cast("long").alias("id"), F.transform("r", lambda s: s["x"]).alias("features"))


def permute(cloud: DataFrame, axes: tuple[int, int]) -> DataFrame:
    if sorted(axes) != [0, 1]:
        raise ValueError("axes must be a permutation of (0, 1)")
    return cloud if axes == (0, 1) else transpose(cloud)


def reshape(values: Column, width: int) -> Column:
    """A flat array as an array of arrays of ``width``; null where the length isn't a multiple of it."""
    n = F.size(values)
    rows = F.transform(F.sequence(F.lit(0), (n / width).cast("int") - 1), lambda i: F.slice(values, i * width + 1, F.lit(width)))
    return F.when(n % width != 0, F.lit(None)).when(n == 0, F.array().cast("array<array<double>>")).otherwise(rows)


def flatten(values: Column) -> Column:
    return F.flatten(values)


def array_equal(a: Column, b: Column) -> Column:
    """Same length and equal elements; NaN equals nothing; two empty arrays are equal."""
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] == p["b"]) & ~F.isnan(p["a"]))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b| for all elements; false with any NaN or unequal lengths."""
    close = lambda p: (F.abs(p["a"] - p["b"]) <= atol + rtol * F.abs(p["b"])) & ~F.isnan(p["a"]) & ~F.isnan(p["b"])
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), close)


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same points with the same features, NaN unequal to itself."""
    joined = a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"), "full")
    same = F.coalesce(array_equal(F.col("a.features"), F.col("b.features")), F.lit(False))
    return not joined.where(~same).take(1)


def dump(cloud: DataFrame, n: int = 20) -> str:
    """The first ``n`` points by id, one JSON line each."""
    return "\n".join(r.line for r in cloud.orderBy("id").limit(n).select(F.to_json(F.struct("id", "features")).alias("line")).collect())

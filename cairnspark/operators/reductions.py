"""Sums, extremes, top-k, products: reductions over rows ``(id, x)`` or points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.distance import sq_euclidean


def total(rows: DataFrame, value: str = "x") -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("sum"))


def argmin(rows: DataFrame, value: str = "x") -> DataFrame:
    """``(id)`` of the least value, the first of equal ones."""
    return rows.agg(F.min(F.struct(value, "id")).alias("m")).where("m IS NOT NULL").select("m.id")


def argmax(rows: DataFrame, value: str = "x") -> DataFrame:
    """``(id)`` of the greatest value, the first of equal ones."""
    return rows.agg(F.max(F.struct(value, (-F.col("id")).alias("k"))).alias("m")).where("m IS NOT NULL").select((-F.col("m.k")).alias("id"))


def top_k(rows: DataFrame, k: int, value: str = "x") -> DataFrame:
    """The ``k`` largest values, descending, ties by id."""
    return rows.orderBy(F.desc(value), "id").limit(k)


def bottom_k_per_group(rows: DataFrame, group: str, k: int, value: str = "x") -> DataFrame:
    """The ``k`` smallest values of each group, ties by id, as arrays: kept bounded in every task, then merged."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(value, "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


#: Points of the side that :func:`pairwise` broadcasts, at most.
PAIRWISE_ROWS = 10_000


def pairwise(x: DataFrame, y: DataFrame) -> DataFrame:
    """``(i, j, d2)`` of all pairs; ``y`` has PAIRWISE_ROWS points at most, more raise (range and neighbour joins take any number)."""
    if len(y.take(PAIRWISE_ROWS + 1)) > PAIRWISE_ROWS:
        raise ValueError(f"pairwise takes at most {PAIRWISE_ROWS} points on its second side")
    return x.select(F.col("id").alias("i"), F.col("features").alias("a")).crossJoin(F.broadcast(y.select(F.col("id").alias("j"), F.col("features").alias("b")))).select("i", "j", sq_euclidean(F.col("a"), F.col("b")).alias("d2"))


def to_cells(cloud: DataFrame) -> DataFrame:
    """``(i, j, v)`` of a matrix whose rows are points."""
    return cloud.select(F.col("id").alias("i"), F.posexplode("features").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


def gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """alpha * A * B + beta * C of cells (i, j, v); with beta 0, C isn't looked at, NaN or not."""
    product = a.select("i", F.col("j").alias("k"), F.col("v").alias("av")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("bv")), "k").groupBy("i", "j").agg((F.sum(F.col("av") * F.col("bv")) * alpha).alias("v"))
    if c is None or beta == 0:
        return product
    scaled = c.select("i", "j", (F.col("v") * beta).alias("v"))
    return product.unionByName(scaled).groupBy("i", "j").agg(F.sum("v").alias("v"))


def affine(value: Column, p: float, b: float) -> Column:
    return value * p + b


def inclusive_scan(rows: DataFrame, value: str = "x") -> DataFrame:
    from cairnspark.operators.sampling import prefix_sums

    return prefix_sums(rows, value).select("id", "prefix")


def bounds(points: DataFrame, block: str, d: int) -> DataFrame:
    """``(block, low, high)``: the box of each block of points."""
    low, high = (F.array(*[f(F.get("features", F.lit(j))) for j in range(d)]) for f in (F.min, F.max))
    return points.groupBy(block).agg(low.alias("low"), high.alias("high"))


def with_blocks(points: DataFrame, d: int, blocks: int = 64) -> DataFrame:
    """``points`` with ``block``: ranges of the coordinate that spreads most."""
    row = points.agg(*[F.max(F.get("features", F.lit(j))) - F.min(F.get("features", F.lit(j))) for j in range(d)]).first()
    j = max(range(d), key=lambda k: (row[k] or 0, -k))
    value = F.get("features", F.lit(j))
    cuts = points.agg(F.percentile_approx(value, [b / blocks for b in range(1, blocks)], 1000)).first()[0] or []
    return points.withColumn("block", F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= value)) if cuts else F.lit(0))

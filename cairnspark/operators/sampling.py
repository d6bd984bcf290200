"""Seeded sampling over distributed weights; the draws come from PCG64 on the driver, so results don't depend on partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of ids over which weights are summed before the prefix within a range is taken.
RANGES = 1024


def generator(seed: int, stream: int = 0) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed, stream] if stream else seed))


def unit_hash(seed: int, *columns: str):
    """A uniform number in (0, 1) from a hash of columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), 11).cast("double") + 0.5) / float(1 << 53)


def prefix_sums(rows: DataFrame, value: str = "w", order: str = "id", bounds: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` with ``prefix``, the inclusive prefix sum of ``value`` by ``order``: within ranges of the order, then over them.  ``bounds``: its least and greatest value, where known."""
    low, high = bounds or rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn("prefix", F.col(value))
    width = max(1, -(-(high - low + 1) // RANGES))
    ranged = rows.withColumn("_range", F.floor((F.col(order) - low) / width))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_range").agg(F.sum(value).alias("s")).select("_range", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("_base"))
    inner = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inner", inner).join(base, "_range").withColumn("prefix", F.col("_base") + F.col("_inner")).drop("_range", "_base", "_inner")


def prefix_pick(rows: DataFrame, draws: list[float], value: str = "w", order: str = "id", bounds: tuple[int, int] | None = None) -> list[int]:
    """For each draw, an amount of weight, the first id whose prefix sum exceeds it; draws beyond the total give the last id of positive weight."""
    cumulated = prefix_sums(rows, value, order, bounds).where(F.col(value) > 0)
    picks = [F.min(F.when(F.col("prefix") > u, F.col(order))).alias(f"p{k}") for k, u in enumerate(draws)]
    row = cumulated.agg(F.max(order).alias("last"), *picks).first()
    return [row.last if row[f"p{k}"] is None else row[f"p{k}"] for k in range(len(draws))]


def weighted_pick(rows: DataFrame, n: int, seed: int, value: str = "w") -> list[int]:
    """``n`` ids drawn with replacement in proportion to their weights."""
    total = rows.agg(F.sum(value)).first()[0] or 0.0
    if total <= 0:
        raise ValueError("the weights sum to nothing")
    return prefix_pick(rows, (generator(seed).random(n) * total).tolist(), value)


def weighted_reservoir(rows: DataFrame, k: int, seed: int, value: str = "w") -> DataFrame:
    """``k`` rows without replacement: the largest log(u) / w, ties to the smaller id; rows without weight are never drawn."""
    key = F.log(unit_hash(seed, "id")) / F.col(value)
    return rows.where(F.col(value) > 0).withColumn("key", key).orderBy(F.desc("key"), "id").limit(k)


def subsample(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows, always the same for a seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vose's table: accept place i with the first array's probability, else take the second array's place."""
    n = len(weights)
    scaled = np.asarray(weights, dtype=float) * n / np.sum(weights)
    accept, other = np.ones(n), np.arange(n)
    small, large = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    while small and large:
        s, g = small.pop(), large.pop()
        accept[s], other[s] = scaled[s], g
        scaled[g] -= 1 - scaled[s]
        (small if scaled[g] < 1 else large).append(g)
    return accept, other


def alias_sample(table: tuple[np.ndarray, np.ndarray], n: int, rng: np.random.Generator) -> np.ndarray:
    accept, other = table
    at = rng.integers(0, len(accept), n)
    return np.where(rng.random(n) < accept[at], at, other[at])

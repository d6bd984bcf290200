"""Nearest centroids and what is aggregated by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.frame import matrix
from cairnspark.functions.distance import nearest, sq_euclidean

#: Products of centroids and dimensions up to which the assignment is one expression; above, it runs in numpy.
EXPRESSION = 256


def closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and exact squared distance of the nearest row of c; ties to the lowest label."""
    label, d2 = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
    nc = (c * c).sum(axis=1)
    for a in range(0, len(x), 8192):
        part = x[a : a + 8192]
        approx = nc[None, :] - 2 * (part @ c.T)
        low = approx.min(axis=1)
        scale = 1e-9 * (1 + (part * part).sum(axis=1) + nc.max(initial=0))
        row, col = np.nonzero(approx <= (low + scale)[:, None])
        exact = ((part[row] - c[col]) ** 2).sum(axis=1)
        order = np.lexsort((col, exact, row))
        first = order[np.append(True, row[order][1:] != row[order][:-1])]
        label[a : a + 8192], d2[a : a + 8192] = col[first], exact[first]
    return label, d2


def assign(cloud: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, label, d2)``: the nearest of a few centroids.  Works on streaming frames too."""
    centroids = np.asarray(centroids, dtype=float)
    if centroids.size <= EXPRESSION:
        array = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])
        return cloud.select("id", nearest(F.col("features"), array).alias("n")).select("id", F.col("n.label").alias("label"), F.col("n.distance").alias("d2"))
    shared = cloud.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            label, d2 = closest(matrix(batch.column(1)), shared.value)
            yield pa.record_batch([batch.column(0), pa.array(label), pa.array(d2)], names=["id", "label", "d2"])

    return cloud.select("id", "features").mapInArrow(run, "id long, label int, d2 double")


def min_distance(cloud: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, d2)``: the least squared distance to a set of places."""
    return assign(cloud, centroids).select("id", "d2")


def group_sums(labelled: DataFrame, d: int) -> DataFrame:
    """``(label, n, sums)`` of ``(label, features)``."""
    sums = F.array(*[F.sum(F.get("features", F.lit(j))) for j in range(d)])
    return labelled.groupBy("label").agg(F.count("*").alias("n"), sums.alias("sums"))


def group_means(labelled: DataFrame, d: int, old: DataFrame | None = None) -> DataFrame:
    """``(label, centroid)``; with ``old`` (label, centroid), groups without points keep theirs."""
    means = group_sums(labelled, d).select("label", F.transform("sums", lambda s: s / F.col("n")).alias("centroid"))
    if old is None:
        return means
    return old.withColumnRenamed("centroid", "old").join(means, "label", "left").select("label", F.coalesce("centroid", "old").alias("centroid"))


def centroid_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(label, shift)``: squared movement of each centroid."""
    joined = old.select("label", F.col("centroid").alias("a")).join(new.select("label", F.col("centroid").alias("b")), "label")
    return joined.select("label", sq_euclidean(F.col("a"), F.col("b")).alias("shift"))


def mean_variance(cloud: DataFrame, d: int) -> float:
    """Population variance of each coordinate, averaged."""
    row = cloud.agg(*[F.var_pop(F.get("features", F.lit(j))).alias(f"v{j}") for j in range(d)]).first()
    return float(np.mean([v or 0.0 for v in row])) if d else 0.0


def column_statistics(cloud: DataFrame) -> DataFrame:
    """``(j, n, sum, sum_sq, variance)`` of each coordinate."""
    cells = cloud.select(F.posexplode("features").alias("j", "x"))
    return cells.groupBy("j").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sum_sq"), F.var_pop("x").alias("variance"))

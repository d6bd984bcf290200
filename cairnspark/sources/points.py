"""Reading, writing and generating point clouds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.functions.arrays import slice_columns
from cairnspark.plans.scratch import materialise


def read_csv(spark: SparkSession, path: str, dimensions: int, num_points: int | None = None) -> DataFrame:
    """Points from a header-less CSV: the first ``dimensions`` columns (0 where missing) of the first ``num_points`` rows; ids are line numbers from 0."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("place"))
    # files and splits are numbered in order, and places ascend within each: two levels give line numbers
    parts = materialise(lines.withColumn("part", F.shiftright("place", 33)))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    ids = parts.join(F.broadcast(base), "part").select((F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"), F.split("value", ",").alias("c"))
    if num_points is not None:
        ids = ids.where(F.col("id") < num_points)
    cells = [F.coalesce(F.get("c", F.lit(j)).try_cast("float").cast("double"), F.lit(0.0)) for j in range(dimensions)]
    return ids.select("id", F.array(*cells).alias("features"))


def write_csv(cloud: DataFrame, path: str, digits: int = 6) -> None:
    """Header-less CSV files, in order of the id."""
    line = F.array_join(F.transform("features", lambda v: F.format_string(f"%.{digits}f", v)), ",")
    cloud.orderBy("id").select(line).write.mode("overwrite").text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """One label a line, in order of the id."""
    labels.orderBy("id").select(F.col("label").cast("string")).write.mode("overwrite").text(path)


def from_numpy(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """Points from a matrix in memory, of any strides; ids are row numbers."""
    values = np.ascontiguousarray(values, dtype=np.float64)
    if values.ndim != 2:
        raise ValueError("needs a matrix")
    table = pa.table({"id": pa.array(np.arange(len(values))), "features": pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)[: len(values) + 1], values.ravel())})
    return spark.createDataFrame(table)


def to_numpy(frame: DataFrame, column: str = "label") -> np.ndarray:
    """A column by id."""
    return np.array([r[0] for r in frame.orderBy("id").select(column).collect()])


def as_float32(cloud: DataFrame) -> DataFrame:
    return cloud.withColumn("features", F.col("features").cast("array<float>").cast("array<double>"))


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def _generated(spark: SparkSession, n: int, rows) -> DataFrame:
    """``rows`` of a block of ids, seeded by the block, so that partitions don't matter."""
    block = 4096

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                ids = np.arange(b * block, min(n, (b + 1) * block))
                x, y = rows(int(b), ids)
                yield pd.DataFrame({"id": ids, "features": list(x.astype(np.float32).astype(float)), "label": y.astype(np.int32)})

    return spark.range(-(-n // block)).mapInPandas(run, SCHEMA)


def make_blobs(spark: SparkSession, n: int, d: int = 2, centers: int = 20, box: float = 150.0, std: float = 3.0, seed: int = 42) -> DataFrame:
    """``(id, features, label)``: isotropic Gaussian groups of near-equal size around uniform centers."""
    means = np.random.default_rng(seed).uniform(-box, box, (centers, d))

    def rows(b: int, ids: np.ndarray):
        label = ids % centers
        return means[label] + np.random.default_rng([seed, b]).normal(0, std, (len(ids), d)), label

    return _generated(spark, n, rows)


def _directions(rng: np.random.Generator, n: int, d: int, kappa: float) -> np.ndarray:
    """Unit vectors of a von Mises-Fisher law around the first axis: the cosine by rejection, the rest uniform."""
    b = (d - 1) / (2 * kappa + np.sqrt(4 * kappa**2 + (d - 1) ** 2))
    x0 = (1 - b) / (1 + b)
    c = kappa * x0 + (d - 1) * np.log(1 - x0**2)
    cosine = np.zeros(0)
    while len(cosine) < n:
        z = rng.beta((d - 1) / 2, (d - 1) / 2, n)
        w = (1 - (1 + b) * z) / (1 - (1 - b) * z)
        cosine = np.append(cosine, w[kappa * w + (d - 1) * np.log(1 - x0 * w) - c >= np.log(rng.random(n))])
    cosine = cosine[:n]
    rest = rng.standard_normal((n, d - 1))
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    return np.hstack((cosine[:, None], np.sqrt(1 - cosine**2)[:, None] * rest))


def make_vmf(spark: SparkSession, n: int, d: int, centers: int = 20, kappa: float = 20.0, seed: int = 42) -> DataFrame:
    """``(id, features, label)``: groups of near-equal size on the unit sphere, the first ones a point larger."""
    means = np.random.default_rng(seed).standard_normal((centers, d))
    means /= np.linalg.norm(means, axis=1, keepdims=True)

    def rows(b: int, ids: np.ndarray):
        label = ids % centers
        x = _directions(np.random.default_rng([seed, b]), len(ids), d, kappa)
        axis = -means[label]  # the reflection that takes the first axis to the mean
        axis[:, 0] += 1
        norm = (axis * axis).sum(axis=1, keepdims=True)
        return x - 2 * axis * ((x * axis).sum(axis=1, keepdims=True) / np.where(norm > 0, norm, 1)), label

    return _generated(spark, n, rows)


def make_data(spark: SparkSession, n: int, d: int, vmf_switch_dim: int = 16, **options) -> DataFrame:
    """Sphere groups above ``vmf_switch_dim`` dimensions, else blobs."""
    return make_vmf(spark, n, d, **options) if d > vmf_switch_dim else make_blobs(spark, n, d, **options)


def first_dims(cloud: DataFrame, d: int) -> DataFrame:
    return slice_columns(cloud, 0, d)


def gram(cloud: DataFrame) -> DataFrame:
    """``(i, j, v)`` of the product of the transposed matrix with itself: partial in each task, then added."""
    from cairnspark.frame import matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                held = x.T @ x if held is None else held + x.T @ x
        if held is not None:
            i, j = np.indices(held.shape)
            yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(held.ravel())], names=["i", "j", "v"])

    return cloud.select("features").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def project_2d(cloud: DataFrame, d: int) -> DataFrame:
    """``(id, features)`` in two dimensions: as it is for d = 2, principal components below 16, the leading singular vectors above."""
    if d == 2:
        return cloud.select("id", "features")
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if d < 16:
        mean = [v or 0.0 for v in cloud.agg(*[F.avg(F.get("features", F.lit(j))).alias(f"m{j}") for j in range(d)]).first()]
        centred = cloud.select("id", array_to_vector(F.zip_with("features", F.array(*[F.lit(m) for m in mean]), lambda x, m: x - m)).alias("v"))
        return PCA(k=2, inputCol="v", outputCol="p").fit(centred).transform(centred).select("id", vector_to_array("p").alias("features"))
    g = np.zeros((d, d))
    for r in gram(cloud).collect():  # d by d cells
        g[r.i, r.j] = r.v
    axes = np.linalg.eigh(g)[1][:, ::-1][:, :2]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)
    sides = [F.aggregate(F.zip_with("features", F.array(*[F.lit(float(v)) for v in axes[:, k]]), lambda x, a: x * a), F.lit(0.0), lambda s, v: s + v) for k in range(2)]
    return cloud.select("id", F.array(*sides).alias("features"))

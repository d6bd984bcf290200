"""Point clouds as DataFrames: ``(id long, features array<double>)``.

The id is the identity of a point and its place: ties always go to the smaller id, so results don't depend on how rows are
partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points(df: DataFrame, id_column: str = "id", features: str | Sequence[str] = "features", dims: int | None = None) -> DataFrame:
    """``df`` as points: ``features`` is an array column or a list of numeric columns, of which the first ``dims`` are taken."""
    value = F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    value = value.cast("array<double>")
    if dims is not None:
        value = F.slice(value, 1, dims)
    return df.select(F.col(id_column).cast("long").alias("id"), value.alias("features"))


def dimension(cloud: DataFrame) -> int:
    """The common length of all feature arrays (0 for an empty cloud); raises ValueError on nulls or unequal lengths."""
    row = cloud.agg(
        F.min(F.size("features")).alias("low"),
        F.max(F.size("features")).alias("high"),
        F.count(F.when(F.col("id").isNull() | F.col("features").isNull() | F.exists("features", lambda x: x.isNull()), 1)).alias("nulls"),
    ).first()
    if row.nulls:
        raise ValueError("points need an id and features without nulls")
    if row.low is None:
        return 0
    if row.low != row.high:
        raise ValueError(f"features have {row.low} to {row.high} dimensions")
    return row.low


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a dense float64 matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], column.type)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 0))


def collected(cloud: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a cloud that is known to be small, by id."""
    table = cloud.select("id", "features").orderBy("id").toArrow()
    return table.column("id").to_numpy(), matrix(table.column("features"))

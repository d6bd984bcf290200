"""Labels for a stream of points from fitted centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from cairnspark.operators.nearest import assign


def assign_stream(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, label, d2)`` of a streaming ``(id, features)``; it keeps no state, so any output mode that appends works."""
    if not points.isStreaming:
        raise ValueError("needs a streaming frame")
    return assign(points, centroids)

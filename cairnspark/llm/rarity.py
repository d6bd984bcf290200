"""How common tokens are: counts of all tokens of a corpus in a fixed number of hashed cells.

The cells give every token an upper bound of its document frequency, at a size that doesn't depend on the corpus.  They
serve only to order tokens, the same way everywhere, and to tell common ones, so results don't depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialise

CELL_BITS = 20
CELLS = 1 << CELL_BITS


def cell_of(tokens: np.ndarray) -> np.ndarray:
    """Cells of 64-bit hashes: their upper bits."""
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Counter:
    """Counts of one task, as rows of the ``cells`` column."""

    def __init__(self):
        self.cells = np.zeros(CELLS, dtype=np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.cells += np.bincount(cell_of(tokens), minlength=CELLS)

    def value(self) -> bytes:
        return packed(self.cells)


def packed(cells: np.ndarray) -> bytes:
    return np.minimum(cells, np.iinfo(np.uint32).max).astype("<u4").tobytes()


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            total += np.frombuffer(value.as_buffer(), dtype="<u4")
    yield pa.record_batch([pa.array([packed(total)], pa.binary())], names=["cells"])


FAN_IN = 16


def total(rows: DataFrame) -> np.ndarray:
    """The sum of a binary column ``cells`` of one row per task, added up by a tree of tasks; the driver gets one row of 4 MiB."""
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = materialise(rows.coalesce(parts).mapInArrow(summed, "cells binary"))
    out = np.zeros(CELLS, dtype=np.int64)
    for row in rows.collect():
        out += np.frombuffer(row.cells, dtype="<u4")
    return out


def common_from(cells: np.ndarray) -> int:
    """The cell count from which a token is common: well above what rare tokens that share a cell add up to."""
    mean = cells.mean()
    return int(mean + 10 * math.sqrt(mean) + 512)


def shared_cells(spark, cells: np.ndarray):
    return spark.sparkContext.broadcast(np.minimum(cells, np.iinfo(np.uint32).max).astype(np.uint32))


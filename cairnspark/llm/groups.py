"""Exact comparison of the sets within candidate components, shared by the set joins.

Sets travel once, to the task of their component.  A component of more than MOST sets is cut into blocks and compared
block by block in as many tasks as there are pairs of blocks, so that no task gathers it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, BLOCK = 1000, 500
#: Entries, of some 100 bytes at most, that are broadcast at most; above, the join shuffles.
BROADCAST_ROWS = 500_000


def similar(n_a: np.ndarray, n_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Jaccard of at least 0.8, in integers: 100 * both >= 80 * (n_a + n_b - both)."""
    return 9 * both >= 4 * (n_a + n_b)


class Overlaps:
    """Sizes of the intersections of each set with all sets, from an inverted index of the tokens that several sets have."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        often = np.diff(np.append(begins, len(ranked)))
        code = np.cumsum(new) - 1
        shared = often[code] > 1
        self.owners = owner[order]
        self.begins, self.often = begins, often
        # the shared tokens of each set
        by_set = np.argsort(self.owners[shared], kind="stable")
        self.codes = code[shared][by_set]
        self.ends = np.searchsorted(self.owners[shared][by_set], np.arange(len(sets) + 1))

    def of(self, k: int) -> np.ndarray:
        codes = self.codes[self.ends[k] : self.ends[k + 1]]
        often = self.often[codes]
        at = np.repeat(self.begins[codes] - np.cumsum(often) + often, often) + np.arange(int(often.sum()))
        out = np.bincount(self.owners[at], minlength=len(self.n))
        out[k] = self.n[k]
        return out


def numbers(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def dealt(rows: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    """Structured ``rows`` as one blob for each range ``to``."""
    order = np.argsort(to, kind="stable")
    there, begin = np.unique(to[order], return_index=True)
    return pa.record_batch([pa.array(there.astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows[order], begin[1:])] if len(rows) else [], pa.binary())], names=["range", "postings"])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the edges (a, b): repeated hooking of larger to smaller roots."""
    ids, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]]


def blocks(members: DataFrame, component: str = "component", node: str = "sid") -> DataFrame:
    """``members`` with ``parts``: the names of the tasks, within the component, that compare each of its sets."""
    sizes = members.groupBy(component).agg(F.count("*").alias("_g"))
    large = sizes.where(F.col("_g") > MOST).withColumn("_b", F.ceil(F.col("_g") / BLOCK).cast("int")).drop("_g")  # at most one per MOST rows
    own = F.pmod(F.xxhash64(node), F.col("_b")).cast("int")
    rows = members.join(large, component, "left").withColumn("_own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: F.concat_ws("-", F.least("_own", j), F.greatest("_own", j)))
    return rows.withColumn("parts", F.when(F.col("_b").isNull(), F.array(F.lit(""))).otherwise(pairs)).drop("_own", "_b")


def beside(docs: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", lists: str | None = None) -> DataFrame:
    """``docs`` joined with the materialised ``few`` by ``keys``: by broadcast if ``few`` has few entries, those of the column ``lists`` or else its rows; else by shuffle."""
    entries = few.agg(F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.count("*")).first()[0]
    return docs.join(F.broadcast(few) if entries <= BROADCAST_ROWS else few, keys, how)

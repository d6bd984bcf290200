"""Clouds dealt to blocks of near points, and tasks that compare pairs of blocks.

A tree of cuts, fitted to a sample, deals points to blocks; a block that came out large is dealt on by a hash.  No result
depends on the cuts: boxes of blocks, and of the leaves within them, only rule out pairs that are too far apart.  A point
travels once for each block that its own one meets, in single precision where that loses nothing.  A task holds two blocks
of at most about MOST points and compares them tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.frame import matrix
from cairnspark.plans.scratch import materialise

SAMPLE, FEW, LEAST, MOST, LEAF, TASKS = 20_000, 512, 16, 16_384, 1024, 1000
#: Coordinates that a task gathers at once for exact differences.
GATHERED = 1 << 22


def fit(x: np.ndarray, blocks: int, first: int = 0):
    """A tree of cuts (axis, value, below, from there on) at quantiles of the widest axis; its leaves are numbers of blocks."""
    width = np.fmax.reduce(x, axis=0) - np.fmin.reduce(x, axis=0) if blocks > 1 and len(x) > 1 else np.zeros(1)
    axis = int(np.argmax(np.where(np.isfinite(width), width, 0)))
    if not 0 < width[axis] < np.inf:
        return first
    half = blocks // 2
    values = np.sort(x[:, axis])
    cut = values[len(values) * half // blocks]
    if not cut > values[0]:
        cut = values[values > values[0]][0]
    below = x[:, axis] < cut
    return axis, float(cut), fit(x[below], half, first), fit(x[~below], blocks - half, first + half)


def place(tree, x: np.ndarray) -> np.ndarray:
    out, stack = np.zeros(len(x), np.int32), [(tree, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if isinstance(node, int):
            out[rows] = node
        else:
            below = x[rows, node[0]] < node[1]
            stack += [(node[2], rows[below]), (node[3], rows[~below])]
    return out


def coordinates(column: pa.Array | pa.ChunkedArray, d: int, single: bool) -> np.ndarray:
    """A column of packed points as a matrix of doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    kind, parts = np.dtype(np.float32 if single else np.float64), []
    for chunk in chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            flat = np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            parts.append(flat.view(kind).reshape(len(chunk), d).astype(np.float64))
    return np.concatenate(parts) if parts else np.zeros((0, d))


def gaps(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Squared gaps of boxes a x b, rounded down."""
    out = np.zeros((len(low_a), len(low_b)))
    for j in range(low_a.shape[1]):
        with np.errstate(invalid="ignore"):
            apart = np.maximum(low_a[:, j][:, None] - high_b[:, j], low_b[:, j] - high_a[:, j][:, None])
            out += np.fmax(apart, 0) ** 2
    return out * (1 - 1e-9)


@dataclass
class Blocks:
    """``rows``: (block, id, x), x packed; the size and box of each block."""

    rows: DataFrame
    d: int
    single: bool
    tree: object
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def pairs(self, limit: float | np.ndarray = np.inf, other: Blocks | None = None) -> np.ndarray:
        """Pairs of blocks (i, j), i <= j within one cloud, whose boxes are at most ``limit`` apart, squared."""
        b = other or self
        near = (gaps(self.low, self.high, b.low, b.high) <= limit) & (self.sizes[:, None] > 0) & (b.sizes > 0)
        return np.argwhere(near if other else np.triu(near))


def deal(cloud: DataFrame, d: int, like: Blocks | None = None, single: bool | None = None, most: int = MOST) -> Blocks:
    """``cloud`` in blocks of about ``most`` points at most, cut as those of ``like``."""
    cloud = cloud.select("id", "features")
    if single is None:
        single = exact_in_single(cloud)
    n, tree = cloud.count(), like.tree if like else None
    most = max(1024, min(most, (1 << 20) // max(1, d)))
    if tree is None:
        blocks = max(1, min(LEAST, n // FEW), -(-n // most))
        tree = 0
        if blocks > 1:
            share = max(1, n // SAMPLE)
            sample = cloud.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(share)) == 0).select("features").limit(2 * SAMPLE).toArrow()
            tree = fit(matrix(sample.column("features")), blocks)
    kind = np.float32 if single else np.float64

    def pack(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                flat = np.ascontiguousarray(x, kind)
                offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(d * flat.itemsize))
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(flat.tobytes())])
                yield pa.record_batch([pa.array(place(tree, x)), batch.column(0), packed], names=["leaf", "id", "x"])

    rows = materialise(cloud.mapInArrow(pack, "leaf int, id long, x binary"))
    counts = {r.leaf: r["count"] for r in rows.groupBy("leaf").count().collect()}  # a row per block
    shares, first, total = [], [], 0
    for leaf in range(max(counts, default=0) + 1):
        first.append(total)
        shares.append(max(1, -(-counts.get(leaf, 0) // (2 * most))))
        total += shares[-1]
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("leaf"))
    rows = rows.select((at(first) + F.pmod(F.xxhash64("id"), at(shares))).cast("int").alias("block"), "id", "x")

    def box(group: pa.Table) -> pa.Table:
        x = coordinates(group.column("x"), d, single)
        return pa.table({"block": group.column("block")[:1], "n": pa.array([len(x)]), "low": pa.array([np.fmin.reduce(x)]), "high": pa.array([np.fmax.reduce(x)])})

    sizes, low, high = np.zeros(total, np.int64), np.full((total, d), np.nan), np.full((total, d), np.nan)
    for r in rows.groupBy("block").applyInArrow(box, "block int, n long, low array<double>, high array<double>").collect():  # a row per block
        sizes[r.block], low[r.block], high[r.block] = r.n, r.low, r.high
    return Blocks(rows, d, single, tree, sizes, low, high)


def exact_in_single(cloud: DataFrame) -> bool:
    wide = F.exists("features", lambda v: v != v.cast("float").cast("double"))
    return not cloud.agg(F.max(wide)).first()[0]


class Side:
    """One block within a task: ids, coordinates and further columns, leaf after leaf."""

    def __init__(self, table: pa.Table, d: int, single: bool, extra: list[str]):
        x = coordinates(table.column("x"), d, single)
        tree = fit(x, max(1, -(-len(x) // LEAF)))
        leaf = place(tree, x)
        order = np.lexsort((table.column("id").to_numpy(), leaf))
        self.ids, self.x = table.column("id").to_numpy()[order], x[order]
        self.extra = {c: table.column(c).to_numpy()[order] for c in extra}
        starts = np.append(True, np.diff(leaf[order]) != 0).nonzero()[0] if len(x) else np.zeros(0, int)
        ends = np.append(starts[1:], len(x))
        # a leaf of equal points can't be cut, and is dealt as it lies
        self.leaves = [slice(s, min(s + LEAF, e)) for a, e in zip(starts, ends, strict=True) for s in range(a, e, LEAF)]
        self.low = np.array([np.fmin.reduce(self.x[s]) for s in self.leaves]).reshape(len(self.leaves), d)
        self.high = np.array([np.fmax.reduce(self.x[s]) for s in self.leaves]).reshape(len(self.leaves), d)
        middle = (self.low + self.high) / 2
        self.middle = np.where(np.isfinite(middle), middle, 0)


def tiles(a: Side, b: Side, limit: float | np.ndarray = np.inf, same: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs of leaves at most ``limit`` apart, squared; once each within one block."""
    near = gaps(a.low, a.high, b.low, b.high) <= limit
    yield from np.argwhere(np.triu(near) if same else near).tolist()


def roughly(a: Side, p: int, b: Side, q: int) -> tuple[np.ndarray, np.float32, float]:
    """Squared distances of a leaf and another in some unit, by one product in single precision; by how much they may be wrong, and the unit."""
    x, y, centre = a.x[a.leaves[p]], b.x[b.leaves[q]], a.middle[p]
    u, v = x - centre, y - centre
    nu, nv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    unit = float(max(np.fmax.reduce(nu, initial=0), np.fmax.reduce(nv, initial=0)))
    if not 1e-280 < unit < np.inf:
        unit = 1.0
    one = np.ones((1, 1))
    u = np.hstack((u / unit**0.5, nu[:, None] / unit, np.broadcast_to(one, (len(u), 1)))).astype(np.float32)
    v = np.hstack((v * (-2 / unit**0.5), np.broadcast_to(one, (len(v), 1)), nv[:, None] / unit)).astype(np.float32)
    # products and sums of numbers up to 2 in single precision, and what moving to the centre rounded off
    moved = float(np.abs(centre).max(initial=0)) ** 2 / unit
    return u @ v.T, np.float32(1e-6 * (x.shape[1] + 16) + 1e-13 * moved), unit


def exactly(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[i], y[j])."""
    step = max(1, GATHERED // max(1, x.shape[1]))
    parts = [((x[i[s : s + step]] - y[j[s : s + step]]) ** 2).sum(axis=1) for s in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def hits(a: Side, p: int, b: Side, q: int, limit: float) -> np.ndarray:
    """Which pairs of two leaves are at most ``limit`` apart, squared; exact."""
    d2, margin, unit = roughly(a, p, b, q)
    hit, sure = d2 <= np.float32(limit / unit) + margin, d2 <= np.float32(limit / unit) - margin
    if np.count_nonzero(hit) != np.count_nonzero(sure):
        i, j = np.nonzero(hit ^ sure)
        hit[i, j] = exactly(a.x[a.leaves[p]], b.x[b.leaves[q]], i, j) <= limit
    return hit


def meet(left: DataFrame, pairs: np.ndarray, of: Blocks, run: Callable, schema: str, right: DataFrame | None = None, extra: tuple[str, ...] = (), given: np.ndarray | None = None) -> DataFrame:
    """``run(a, b, same, given)`` for each pair of blocks, in a task of its own: it yields columns of ``schema``.

    ``left`` has (block, id, x) and the columns ``extra``; without ``right`` its blocks meet each other.  ``given`` is a
    number for each pair.
    """
    spark = left.sparkSession
    given = np.zeros(len(pairs)) if given is None else given
    i, j = (np.asarray(pairs)[:, c].astype(np.int32) for c in (0, 1)) if len(pairs) else (np.zeros(0, np.int32),) * 2
    first, second = (pa.table({"block": pa.array(own), "i": pa.array(i), "j": pa.array(j), "side": pa.array(np.full(len(i), k, np.int32)), "given": pa.array(given)}) for k, own in enumerate((i, j)))
    if right is None:
        rows = left.join(F.broadcast(spark.createDataFrame(pa.concat_tables((first, second.filter(pa.array(i != j)))))), "block")
    else:
        rows = left.join(F.broadcast(spark.createDataFrame(first)), "block").unionByName(right.join(F.broadcast(spark.createDataFrame(second)), "block"))
    rows = rows.select("i", "j", "side", "given", "id", "x", *extra).repartition(max(1, min(len(i), TASKS)), "i", "j")
    d, single, alone = of.d, of.single, right is None
    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[part.split()[1]] for part in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("side").to_numpy()
        same = alone and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        a = Side(table.filter(pa.array(side == 0)), d, single, list(extra))
        b = a if same else Side(table.filter(pa.array(side == 1)), d, single, list(extra))
        for columns in run(a, b, same, table.column("given")[0].as_py()) if len(a.ids) and len(b.ids) else ():
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.groupBy("i", "j").applyInArrow(task, schema)

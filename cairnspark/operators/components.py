"""Connected components of an edge list, as a loop of joins and minimum aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.plans.scratch import materialise

#: Distinct edges up to which one task finds the components, in a few MB and without rounds.
ONE_TASK = 500_000


def hook(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the groups of x and of y in ``root``, which names the smallest member of each place's group, pair by pair."""
    while True:
        a, b = root[x], root[y]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


def _roots(group: pa.Table) -> pa.Table:
    """Components of a bounded edge list."""
    ids, inverse = np.unique(np.concatenate((group.column("x").to_numpy(), group.column("r").to_numpy())), return_inverse=True)
    x, y = np.split(inverse, 2)
    root = np.arange(len(ids))
    hook(root, x, y)
    return pa.table({"id": ids, "component": ids[root]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = ONE_TASK) -> DataFrame:
    """``(id, component)`` for every id on an edge; ``component`` is the smallest id of its component.

    Every edge points from the larger to the smaller end.  A round keeps, for each node, the edge to its smallest
    neighbour, links its other neighbours to that one (hooking), and lets every edge skip a node that points further down
    (pointer jumping); it ends when neither changes anything, after about log(diameter) rounds.  Each round is written to
    the shared folder.  Loops and repeated edges do no harm; ids must not be null.  At most ``one_task`` distinct edges go
    to one task instead.
    """
    a, b = F.col(src), F.col(dst)
    every = materialise(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("r")).distinct())
    if one_task and every.count() <= one_task:
        return materialise(every.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_roots, "id long, component long"))
    loops, pairs = every.where("x = r").select(F.col("x").alias("id")), every.where("x <> r")
    while True:
        least = materialise(pairs.groupBy("x").agg(F.min("r").alias("m")))
        hooks = pairs.join(least, "x").where("r <> m").select(F.col("r").alias("x"), F.col("m").alias("r"), F.lit(True).alias("changed"))
        kept = least.select("x", F.col("m").alias("r"), F.lit(False).alias("changed"))
        below = least.select(F.col("x").alias("r"), F.col("m").alias("below"))
        moved = kept.unionByName(hooks).join(below, "r", "left").select("x", F.coalesce("below", "r").alias("r"), (F.col("changed") | F.col("below").isNotNull()).alias("changed"))
        pairs = materialise(moved.groupBy("x", "r").agg(F.max("changed").alias("changed")))
        if not pairs.agg(F.max("changed")).first()[0]:
            break
        pairs = pairs.select("x", "r")
    roots = pairs.select(F.col("r").alias("id")).unionByName(loops).distinct()
    members = pairs.select(F.col("x").alias("id"), F.col("r").alias("component"))
    return members.unionByName(roots.join(members, "id", "left_anti").select("id", F.col("id").alias("component")))

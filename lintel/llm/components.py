"""Connected components of an edge table by hooking and contraction.

Each round hooks every node to its smallest neighbour, follows the new parents
once more and replaces the edges by edges between parents; what is left after
a few rounds is empty.  A node of very high degree meets only partial minima
and joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame | None:
    """(a, b) of longs to (node, root), root the smallest node of its component; None without edges. Self loops and repeated edges change nothing."""
    live = scratch.keep(edges.where("a <> b").select("a", "b").distinct(), f"{label}-e0")
    parents: list[DataFrame] = []
    while not live.isEmpty():
        k = len(parents)
        both = live.union(live.select("b", "a"))
        hook = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), f"{label}-h{k}")
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = scratch.keep(hook.join(over, "up").select("node", F.col("top").alias("root")), f"{label}-p{k}")
        parents.append(parent)
        pa, pb = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        live = scratch.keep(moved.distinct(), f"{label}-e{k + 1}")
    if not parents:
        return None
    out = parents[0]
    for k, step in enumerate(parents[1:]):
        step = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = scratch.keep(out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{label}-l{k}")
    return out

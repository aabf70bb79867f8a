"""Connected components as joins, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component.

    Each round points every node to its smallest neighbour (or itself), jumps one pointer further, and replaces both
    ends of each edge by what they point to; edges inside a contracted node vanish. Nodes shrink geometrically, each
    round is written to the shared folder, and nothing of the graph is collected. An empty edge table gives no rows.
    """
    e = scratch.write(_clean(edges), f"{name}-e0")
    labels, k = None, 0
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        step = step.select("node", F.least("node", "low").alias("to"))
        step = scratch.write(step, f"{name}-p{k}")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = step.join(jump, "to", "left").select("node", F.coalesce("further", "to").alias("root"))
        step = scratch.write(step, f"{name}-s{k}")
        if labels is None:
            labels = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            labels = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            labels = scratch.write(labels, f"{name}-l{k}")
            scratch.drop(f"{name}-s0" if k == 1 else f"{name}-l{k - 1}")
        left = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = e.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        k += 1
        e = scratch.write(_clean(moved), f"{name}-e{k}")
        scratch.drop(f"{name}-e{k - 1}")
        scratch.drop(f"{name}-p{k - 1}")
        if k > 1:  # the first round's step is the first labels
            scratch.drop(f"{name}-s{k - 1}")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels


def _clean(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.select(low.alias("a"), high.alias("b")).filter("a < b").distinct()

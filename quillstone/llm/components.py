"""Connected components by contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b): the label is the smallest node reachable.

    Each round a node points to the smallest node around it, pointers jump until they reach the top of their tree, and edges
    are drawn between tops, once each: what is left shrinks every round. Edges of a hub are combined before the shuffle. Only
    whether something changed reaches the driver.

    Edge cases: loops and repeated edges are harmless (a node with loops only is its own component); nulls are dropped; no edges, no rows.
    """
    ends = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left = written(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*ends("a", "b")).distinct(), "edges")
    rounds = []
    while True:
        around = left.select(F.col("a").alias("node"), F.col("a").alias("to")).union(left.select("b", "a"))  # a is the smaller end
        step = written(around.groupBy("node").agg(F.min("to").alias("up")), "up")
        while True:
            over = step.select(F.col("node").alias("up"), F.col("up").alias("far"))
            jumped = written(step.join(over, "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "up")
            step = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(step)
        top = lambda c: step.select(F.col("node").alias(c), F.col("up").alias(f"{c}_top"))  # noqa: B023, E731
        met = left.join(top("a"), "a").join(top("b"), "b").where("a_top <> b_top")
        left = written(met.select(*ends("a_top", "b_top")).distinct(), "edges")
        if left.isEmpty():
            break
    out = rounds.pop()
    while rounds:
        above = out.select(F.col("node").alias("up"), F.col("up").alias("top"))
        out = rounds.pop().join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return out.select("node", F.col("up").alias("label"))

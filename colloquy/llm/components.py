"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Each round sends every node to the smallest node next to it and keeps the edges between the results, so all nodes
    but local minima vanish: a star takes one round. Rows are aggregates and joins; nothing is gathered per node.
    Null ends and loops are ignored; an empty table gives no rows.
    """
    live = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    steps: list[DataFrame] = []
    while True:
        both = materialize(live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        if both.isEmpty():
            break
        step = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")))
        steps.append(step)
        live = (both.filter("a < b").join(step.withColumnRenamed("p", "pa"), "a")
                .join(step.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
                .filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    if not steps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[-1].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for step in reversed(steps[:-1]):
        after = found.select(F.col("node").alias("p"), F.col("component").alias("c"))
        found = step.join(after, "p", "left").select(F.col("a").alias("node"), F.coalesce("c", "p").alias("component"))
    return found

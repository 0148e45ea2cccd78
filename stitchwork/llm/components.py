"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchwork.llm import common


def connected(links: DataFrame, work: str) -> DataFrame:
    """node, component (its smallest node) for each node of links (a, b); work: a folder for steps.

    Every node hooks to its smallest neighbour, if that is smaller; hooks are followed to their ends by jumps that double in length; the
    graph shrinks to these ends, and so on until no link is left. Null ends are left out.
    """
    both = links.select("a", "b").where("a is not null and b is not null and a != b")
    edges = common.stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{work}/edges-0")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = common.stored(edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), f"{work}/labels-0")
    step = 0
    while not edges.isEmpty():
        step += 1
        hooks = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least")).select("n", F.least("n", "least").alias("to"))
        hooks = common.stored(hooks, f"{work}/hooks-{step}")
        jump, moved = 0, True
        while moved:
            jump += 1
            further = hooks.select(F.col("n").alias("m"), F.col("to").alias("beyond"))
            hooks = hooks.join(further, F.col("to") == F.col("m")).select("n", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved"))
            hooks = common.stored(hooks, f"{work}/hooks-{step}-{jump}")
            moved = not hooks.where("moved").isEmpty()
        labels = common.stored(
            labels.join(hooks, F.col("component") == F.col("n"), "left").select("node", F.coalesce("to", "component").alias("component")), f"{work}/labels-{step}"
        )
        ends = edges.join(hooks, F.col("a") == F.col("n")).select(F.col("to").alias("x"), "b")
        ends = ends.join(hooks, F.col("b") == F.col("n")).select(F.col("x").alias("a"), F.col("to").alias("b"))
        edges = common.stored(ends.where("a != b").distinct(), f"{work}/edges-{step}")
    return labels

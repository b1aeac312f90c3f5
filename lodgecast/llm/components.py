"""Connected components of an edge table by contraction: all tables stay in Spark, only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for every node of the columns ``a`` and ``b``.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends, and replaces the edges by
    those between ends that still differ. Minima are taken before rows move, so a node with very many edges costs each
    task one row.
    """
    open_edges = written(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while not open_edges.isEmpty():
        hooks = (
            open_edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
            .union(open_edges.select(F.col("a").alias("node"), F.col("a").alias("to")))
            .groupBy("node")
            .agg(F.min("to").alias("to"))
        )
        hooks = written(hooks, "hooks")
        while True:
            ends = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = hooks.join(ends, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            jumped = written(jumped, "hooks")
            hooks = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            further = hooks.select(F.col("node").alias("to"), F.col("to").alias("end"))
            labels = labels.join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
            labels = written(labels, "labels")
        left = hooks.select(F.col("node").alias("a"), F.col("to").alias("left"))
        right = hooks.select(F.col("node").alias("b"), F.col("to").alias("right"))
        open_edges = written(
            open_edges.join(left, "a").join(right, "b").filter("left <> right")
            .select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels.select("node", F.col("to").alias("component"))

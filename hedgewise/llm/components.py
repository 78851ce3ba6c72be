"""Connected components of an edge table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hedgewise.session import materialise


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for every node of the edges (columns a, b).

    In each round every component hooks to its smallest neighbour if that is smaller; chains of hooks are
    shortened by pointer jumping, and edges inside a component vanish. Every component but the local minima
    disappears in a round, so the rounds are logarithmic in the number of nodes. All tables are written to
    the shared folder; nothing but emptiness tests reaches the driver. Hubs are pre-aggregated before shuffles.
    """
    between = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both(between).select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while not between.isEmpty():
        hooks = both(between).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        hooks = materialise(hooks.withColumn("parent", F.least("node", "parent")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = materialise(hooks.join(above, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "hooks")
            hooks = jumped.select("node", "parent")
            if jumped.filter("moved").isEmpty():
                break
        to = lambda column: hooks.select(F.col("node").alias(column), F.col("parent").alias(f"_{column}"))
        found = materialise(
            found.join(to("component"), "component", "left").select("node", F.coalesce("_component", "component").alias("component")), "components"
        )
        between = materialise(
            between.join(to("a"), "a").join(to("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct(), "edges"
        )
    return found

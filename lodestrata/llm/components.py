"""Connected components of a link table, by contraction: every round each node points to its smallest neighbour.

Each round writes its tables to the scratch folder, so lineage stays short and lost executors cost one round at most.
Rounds are logarithmic in the number of nodes; no node's links come together in one task (minima are combined on the map
side, and joins on a hub read written tables, whose partitions AQE splits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.runtime import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of links (a, b); root is one of the component's nodes, the same for all of them."""
    edges = written(links.select("a", "b").filter("a <> b").distinct(), f"{name}-links")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        up = written(least.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-up")
        for _ in range(2):  # pointers of pointers
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next")).hint("shuffle_merge")
            up = written(up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-up")
        if roots is None:
            roots = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next")).hint("shuffle_merge")
            roots = written(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-roots")
        to = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("shuffle_merge")  # noqa: E731, B023
        half = written(edges.join(to("a"), "a").select(F.col("a_root").alias("a"), "b"), f"{name}-half")
        edges = written(half.join(to("b"), "b").select("a", F.col("b_root").alias("b")).filter("a <> b").distinct(), f"{name}-links")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components of an edge table by contraction; every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import Saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b); root is one node of the component, the same for all its nodes.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their ends, and
    replaces the ends of edges by these.  Hooks only lead to smaller nodes, so they form trees; at least half of the
    nodes that still have an edge disappear in each round.  Loops and repeated edges do no harm.
    """
    edges = Saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mapping = None
    while not edges.df.isEmpty():
        both = edges.df.unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
        trees = Saved(hooks, "hooks")
        while True:
            # Two steps up at a time.
            up = trees.df.select(F.col("node").alias("root"), F.col("root").alias("old"))
            top = trees.df.select(F.col("node").alias("old"), F.col("root").alias("top"))
            moved = Saved(trees.df.select("node", "root").join(up, "root").join(top, "old").select("node", "old", F.col("top").alias("root")), "hooks")
            trees.drop()
            trees = moved
            if trees.df.filter("old <> root").isEmpty():
                break
        ends = trees.df.select("node", "root")
        if mapping is None:
            new_mapping = Saved(ends, "components")
        else:
            above = ends.select(F.col("node").alias("root"), F.col("root").alias("up"))
            new_mapping = Saved(mapping.df.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "components")
            mapping.drop()
        left = edges.df.join(ends.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        new_edges = Saved(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        edges.drop()
        edges, mapping = new_edges, new_mapping
        trees.drop()
    edges.drop()
    if mapping is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.spark.createDataFrame([], f"node {kind}, root {kind}")
    return mapping.df

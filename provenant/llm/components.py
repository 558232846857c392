"""Connected components of a table of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.shared import hold


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b): the smallest id reachable from it.

    Alternating star contraction (Kiveris et al., 2014): a large star links all larger neighbours of a node
    to the smallest one, a small star all smaller neighbours. The number of rounds is logarithmic, the rows
    never grow, and each group's minimum is a partial aggregate. A node with very many neighbours is never
    gathered: minima are joined back, not collected.
    """
    edges = hold(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # large star: both directions; every larger neighbour goes to the least of the neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = hold(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: the smaller neighbours of a node, and itself, go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = hold(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        # all stars: no node has two ways to go, and none leads to a node that goes on
        ways = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
        ways = ways.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if ways.filter("out > 1 or (out > 0 and in > 0)").isEmpty():
            break
    roots = edges.select(F.col("v").alias("u"), "v")
    return edges.union(roots).distinct().select(F.col("u").alias("id"), F.col("v").alias("component"))

"""Connected components by contraction: every round hooks each node to its smallest neighbour, follows the hooks to
their roots by pointer doubling, and contracts the links. At most half of the nodes of a component survive a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links: pairs of longs, any order, loops and repeats allowed. Gives node, root (smallest node of its component) for every node that has a link."""
    edges = stage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    labels = stage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "nodes")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "hooks")
        while True:
            up = hook.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            nxt = stage(hook.join(up, hook["p"] == up["_v"], "left").select("v", F.coalesce("_p", "p").alias("q"), "p"), "jumps")
            moved = not nxt.where("p <> q").isEmpty()
            hook = nxt.select("v", F.col("q").alias("p"))
            if not moved:
                break
        to = hook.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        labels = stage(labels.join(to, labels["root"] == to["_v"], "left").select("node", F.coalesce("_p", "root").alias("root")), "labels")
        ea = edges.join(to, edges["a"] == to["_v"]).select(F.col("_p").alias("a"), "b")
        eb = ea.join(to, ea["b"] == to["_v"]).select("a", F.col("_p").alias("b"))
        edges = stage(eb.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels

"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, store: Scratch, name: str) -> DataFrame:
    """node, root of every node of links (a, b); the root is the least node that it reaches.

    Each round takes the least root among a node and its neighbours and then the root of that root, so that roots spread
    over a chain in a number of rounds that grows with the logarithm of its length; rounds end when nothing changes. Each
    round's table is written, which cuts lineage."""
    both = store.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    roots = store.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        over = roots.select(F.col("node").alias("up"), F.col("root").alias("above"))
        next_ = store.save(lower.join(over, lower["root"] == over["up"]).select("node", "was", F.least("root", "above").alias("root")), f"{name}-{turn}")
        store.drop(f"{name}-{turn - 1}")
        roots = next_.select("node", "root")
        if not next_.filter("was <> root").limit(1).count():
            return roots

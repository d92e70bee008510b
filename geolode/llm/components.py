"""Connected components of a graph given as links, for any number of nodes.

Each round a tree's root hooks on to the least grandparent that any of its
nodes sees across a link, and every node moves up to its grandparent; trees
merge and flatten in about as many rounds as the logarithm of their size.
Everything is joins and aggregates with partial sums; a node with very many
links is one more skewed join key, which adaptive execution splits. Nothing is
collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node reachable) for every node in ``links`` (``a``, ``b``, comparable, no nulls)."""
    both = links.where("a != b").select("a", "b").unionByName(links.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct())
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        up = label.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        at = label.join(up, "root").select("node", "root", "grand")
        near = both.join(at.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        at = written(at.join(near, "node"))
        hook = at.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("hook"))
        step = written(at.join(hook, "node", "left").select("node", F.least("root", "grand", "near", "hook").alias("root"), F.col("root").alias("was")))
        if not step.where("root != was").limit(1).count():
            return label
        label = step.select("node", "root")

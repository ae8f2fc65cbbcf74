"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component: per node of `links` (a, b) the smallest node it can reach.

    Every turn a node takes the smallest label among its own, its neighbours' and that of the node
    its label names, so chains shrink by more than half a turn. No turn gathers a group: minima
    are partial aggregates.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").dropDuplicates())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        own = labels.select(F.col("node").alias("b"), F.col("component").alias("_near"))
        near = both.join(own, "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        turn = (
            labels.join(near, "node")
            .join(far, "component")
            .select("node", F.col("component").alias("_was"), F.least("component", "_near", "_far").alias("component"))
        )
        turn = stored(turn)
        labels = turn.select("node", "component")
        if turn.filter("component < _was").isEmpty():
            return labels

"""Connected components of a link table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node: the smallest node that links (a, b) reach, itself where none does.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so the number of
    rounds grows with the logarithm of a component's width. Rounds are checkpointed in ``spark.checkpoint.dir``.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().checkpoint()
    labels = nodes.select("node").distinct().withColumn("component", F.col("node")).checkpoint()
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("old"))
        up = least.select(F.col("node").alias("c"), F.col("c").alias("up"))
        step = least.join(up, "c", "left").select("node", F.least("c", F.coalesce("up", "c")).alias("component"), "old").checkpoint()
        if not step.filter("component <> old").limit(1).count():
            return step.select("node", "component")
        labels = step.drop("old")
    raise RuntimeError("components did not settle")

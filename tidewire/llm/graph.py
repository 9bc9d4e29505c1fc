"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch


#: Edges that are worth a task of their own.
EDGES_PER_TASK = 50_000


def _star(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """Hook neighbours to the smallest one: all larger neighbours (large star) or all smaller ones (small star)."""
    both = edges if small else edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    # ``hi`` is the centre, ``lo`` its neighbour.
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("c"), F.least("m", "hi").alias("m"))
    joined = both.join(least, both["hi"] == least["c"])
    if small:
        out = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("c").alias("hi"), F.col("m").alias("lo")))
    else:
        out = joined.filter(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return out.filter(F.col("hi") > F.col("lo")).coalesce(tasks)


def star_edges(links: DataFrame, scratch: Scratch, rounds: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(hi, lo), hi > lo: edges with the same components as ``links`` (a, b), after alternating star steps.

    Without ``rounds`` they go on until nothing changes: then every node has one edge, to the smallest of its
    component. Each round is written to ``scratch``, so the plan stays short and a lost executor costs a re-read; the
    number of rounds grows with the logarithm of a component's size. Few edges run in few tasks: a round has some eight
    stages, whose tasks would else cost more than the edges, however few these are.
    """
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // EDGES_PER_TASK))
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").coalesce(tasks).distinct().coalesce(tasks)
    before = None
    for _ in range(max_rounds if rounds is None else rounds):
        # Sums of hashes, taken as the rows are written, tell whether two rounds hold the same edges.
        seen = Observation()
        step = _star(_star(edges, False, tasks), True, tasks).distinct().coalesce(tasks)
        edges = scratch.write(step.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")), "edges")
        now = (seen.get["n"], seen.get["h"])
        if now == before:
            return edges
        before = now
    if rounds is None:
        raise RuntimeError("components did not settle")
    return edges


def labels(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest neighbour of each node of star_edges, itself where all are larger.

    Nodes with one label are in one component; once the edges have settled, nodes of one component have one label.
    """
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def connected_components(links: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node."""
    return labels(star_edges(links, Scratch(links.sparkSession, "components", scratch), max_rounds=max_rounds))

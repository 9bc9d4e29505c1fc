"""Splitting events whose articles fall apart (R14, R15): density clusters within one event's articles.

With two articles to a neighbourhood every article that has a neighbour is a core, so density clusters are the
connected components of the neighbour graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.config import DEFAULTS, Settings
from tidewire.functions.vectors import cosine_distance
from tidewire.operators.components import components


def _near(left: DataFrame, right: DataFrame, reach: str, most: Column, s: Settings) -> DataFrame:
    """Pairs of articles of one event, ``right``'s columns with _r, whose distance is at most ``most``.

    The penalty for hours alone bounds how far apart in time such a pair can lie: ``reach`` hours. Articles meet in
    time buckets of that width, so an event of very many articles is not paired out.
    """
    bucket = lambda shift: F.when(F.col(reach).isNull(), F.lit(0)).otherwise(F.floor(F.col("hours") / F.col(reach)) + shift)
    l = left.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(-1), bucket(0), bucket(1)))))
    r = right.withColumn("_bucket", bucket(0)).select(*[F.col(c).alias(f"{c}_r") for c in (*right.columns, "_bucket")])
    gap = F.abs(F.col("hours") - F.col("hours_r"))
    penalty = F.least(F.lit(s.split_hour_penalty) * gap / 24, F.lit(s.split_penalty_cap))
    met = l.join(r, (F.col("event_id") == F.col("event_id_r")) & (F.col("_bucket") == F.col("_bucket_r")) & (F.col("id") != F.col("id_r")))
    return met.withColumn("dist", F.round(cosine_distance(F.col("embedding"), F.col("embedding_r")) + penalty, 9)).filter(F.col("dist") <= most)


def split_events(articles: DataFrame, s: Settings = DEFAULTS, dimension: int = 768) -> DataFrame:
    """(event_id, id, group_no) of events that split, group 0 with the oldest article.

    ``articles``: event_id, id (unique), published_date, embedding. Vectors of another length are left out first, as
    are events of fewer than three articles. Distances are cosine plus a penalty for hours apart; two articles within
    eps, which shrinks as an event grows, are neighbours, and neighbours of neighbours one cluster. An article without
    neighbours joins the cluster whose oldest article is nearest, if near enough, else it stands alone. Events with
    one group, or without any cluster, stay whole.
    """
    hours = F.unix_micros(F.col("published_date").cast("timestamp")) / 3.6e9
    v = articles.filter(F.size("embedding") == dimension).select("event_id", "id", hours.alias("hours"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = v.groupBy("event_id").agg(F.count("*").alias("n")).filter("n > 2").select("event_id", F.least(s.split_eps_scale / F.col("n"), F.lit(s.split_eps_cap)).alias("eps"))
    n = n.withColumn("reach", F.when(F.col("eps") < s.split_penalty_cap, F.col("eps") * 24 / s.split_hour_penalty))
    v = v.join(n, "event_id")
    links = _near(v, v.select("event_id", "id", "hours", "embedding", "reach"), "reach", F.col("eps"), s).filter("id < id_r").select(F.col("id").alias("a"), F.col("id_r").alias("b")).distinct().checkpoint()
    touched = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = components(touched, links)
    dated = F.struct("hours", "id")
    placed = v.drop("embedding").join(found.withColumnRenamed("node", "id"), "id")
    firsts = placed.groupBy("event_id", "component").agg(F.min(dated).alias("first")).select("event_id", "component", F.col("first.id").alias("id"))
    firsts = v.join(firsts, ["event_id", "id"]).select("event_id", "id", "hours", "embedding", "component")
    lone = v.join(touched.withColumnRenamed("node", "id"), "id", "left_anti").join(firsts.select("event_id").distinct(), "event_id", "left_semi")
    noise_reach = F.lit(s.split_noise * 24 / s.split_hour_penalty) if s.split_noise < s.split_penalty_cap else F.lit(None).cast("double")
    lone, heads = lone.withColumn("noise_reach", noise_reach), firsts.withColumn("noise_reach", noise_reach)
    best = _near(lone, heads, "noise_reach", F.lit(s.split_noise), s).groupBy("id").agg(F.min_by("component_r", F.struct("dist", "hours_r", "id_r")).alias("component"))
    joined = lone.select("event_id", "id", "hours").join(best, "id", "left").select("event_id", "id", "hours", F.coalesce("component", "id").alias("component"))
    every = placed.select("event_id", "id", "hours", "component").unionByName(joined)
    groups = every.groupBy("event_id", "component").agg(F.min(dated).alias("first"))
    numbered = groups.withColumn("group_no", F.row_number().over(W.partitionBy("event_id").orderBy("first")) - 1).withColumn("m", F.count("*").over(W.partitionBy("event_id"))).filter("m > 1")
    return every.join(numbered.select("event_id", "component", "group_no"), ["event_id", "component"]).select("event_id", "id", F.col("group_no").cast("long").alias("group_no"))


@dataclass(frozen=True)
class Split:
    """articles: all, those that left with their new event_id; events, proposals and jobs: rows to add."""

    articles: DataFrame
    events: DataFrame
    proposals: DataFrame
    jobs: DataFrame


def apply_split(articles: DataFrame, groups: DataFrame, queue: DataFrame | None = None, new_id: Column | None = None) -> Split:
    """Of an event's groups (event_id, id, group_no) the largest stays, each other becomes an event of its own.

    Of equally large groups the one with the smallest number stays. A new event is seeded by the article of the best
    source rank (null counts as 999; then the oldest); ``new_id`` is an expression over event_id and seed_id. Children
    get a rejected proposal with their parent, so that they aren't merged back, and all are summarised again. Events
    whose enhancer job is being processed in ``queue`` stay whole.
    """
    if queue is not None:
        busy = queue.filter("queue_name = 'enhancer' and status = 'PROCESSING'").select("event_id")
        groups = groups.join(busy, "event_id", "left_anti")
    rank = F.struct(F.coalesce("source_rank", F.lit(999)).alias("r"), "published_date", "id")
    placed = articles.select("event_id", "id", "source_rank", "published_date").join(groups.select("event_id", "id", "group_no"), ["event_id", "id"])
    sizes = placed.groupBy("event_id", "group_no").agg(F.count("*").alias("article_count"), F.min_by("id", rank).alias("seed_id"))
    by_size = W.partitionBy("event_id").orderBy(F.desc("article_count"), "group_no")
    leaving = sizes.withColumn("_rn", F.row_number().over(by_size)).filter("_rn > 1").drop("_rn")
    leaving = leaving.withColumn("new_id", F.xxhash64("event_id", "seed_id") if new_id is None else new_id)
    moved = groups.join(leaving.select("event_id", "group_no", "new_id"), ["event_id", "group_no"]).select("event_id", "id", "new_id")
    after = articles.join(moved, ["event_id", "id"], "left").withColumn("event_id", F.coalesce("new_id", "event_id")).select(*articles.columns)
    events = leaving.select(F.col("new_id").alias("id"), F.col("event_id").alias("parent_id"), "seed_id", "article_count")
    proposals = events.select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit(0.0).alias("distance"), F.lit("REJECTED").alias("status"), F.lit("Split Origin Immunity").alias("reason"))
    jobs = events.select(F.explode(F.array("id", "parent_id")).alias("event_id")).distinct()
    return Split(after, events, proposals, jobs.withColumns({"queue_name": F.lit("enhancer"), "status": F.lit("PENDING"), "msg": F.lit("FORCE")}))

"""Entity views (outlets, articles, events, queues, proposals) over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the test views.
BIASES = ("far_left", "left", "leans_left", "center", "neutral", "mainstream", "leans_right", "right", "far_right")
OWNERS = ("independent", "corporate", "state")
START = "timestamp_ntz'2024-01-01 00:00:00'"
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.expr(f"timestamp_ntz'{AS_OF}'")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def minutes_after(start: str, minutes: str) -> Column:
    return F.expr(f"{start} + make_dt_interval(0, 0, cast({minutes} as int), 0)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newspapers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.substring("source", 4, 9).cast("int")
    names = table(spark, sf_dir, "documents").select("source").filter("source is not null").distinct()
    return names.select(F.col("source").alias("name"), i.cast("long").alias("newspaper_id"), pick(BIASES, i).alias("bias"), pick(OWNERS, i).alias("ownership_type"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles of the event that ``embeddings`` labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("event_id"))
    a = d.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), F.col("source").alias("newspaper"), F.col("lang"),
        minutes_after(START, "doc_id * 43 % 43200").alias("published_date"),
        F.when(F.col("doc_id") % 11 != 0, ((F.col("doc_id") * 37) % 201 - 100) / F.lit(100.0)).alias("stance"),
        (((F.col("doc_id") * 53) % 101) / F.lit(100.0)).alias("clickbait_score"),
        F.nullif(F.col("doc_id") % 12, F.lit(0)).alias("source_rank"),
        F.md5(F.col("doc_id").cast("string")).alias("url_hash"),
        F.array("lang", "source").alias("main_topics"), (F.col("doc_id") % 500).alias("vec"),
    )
    return a.join(e, a["vec"] == e["vec_id"]).drop("vec", "vec_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as events with a centroid and a life cycle."""
    v = table(spark, sf_dir, "embeddings")
    created = minutes_after(START, "vec_id * 83 % 43200")
    return v.select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"), F.col("label").cast("long").alias("label"),
        created.alias("created_at"), (created + F.expr("make_dt_interval(0, cast(vec_id % 48 as int), 0, 0)")).alias("last_updated_at"),
        (F.col("vec_id") % 10 != 0).alias("is_active"), pick(("PUBLISHED", "DRAFT", "ENHANCED", "ARCHIVED"), F.col("vec_id")).alias("status"),
        ((F.col("vec_id") * 7) % 101).cast("double").alias("hot_score"), (F.col("vec_id") % 17).alias("article_count"),
    )


def articles_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in (("click", "PENDING"), ("view", "PROCESSING"), ("purchase", "COMPLETED"), ("error", "FAILED"), ("signup", "WAITING")) for x in kv])[F.col("event_type")]
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("article_id"), status.alias("status"), pick(("filter", "enricher", "analyzer", "cluster"), F.col("event_id")).alias("queue_name"),
        F.col("ts").alias("updated_at"), (F.col("ts") - F.expr("make_dt_interval(0, cast(event_id % 72 as int), 0, 0)")).alias("created_at"), (F.col("event_id") % 4).alias("attempts"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "HTTP 403 Forbidden").otherwise("ok").alias("msg"), F.col("props"), F.col("value"),
    )


def events_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = articles_queue(spark, sf_dir).filter(F.col("id") % 2 == 0)
    return q.withColumn("queue_name", pick(("enhancer", "publisher"), (F.col("id") / 2).cast("long"))).withColumnRenamed("article_id", "event_id")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-by vectors with one label, as merge proposals."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = v.select("label", F.col("vec_id").alias("target_id")).join(v.select("label", F.col("vec_id").alias("source_id")), "label").filter("source_id < target_id and target_id - source_id <= 10")
    s = F.col("source_id") + F.col("target_id")
    return near.select("source_id", "target_id", pick(("PENDING", "PROCESSING", "APPROVED", "REJECTED", "FAILED"), s).alias("status"), (s % 100 / F.lit(100.0)).alias("distance"))

"""What an editor sees and does: event details, waiting lists, edits by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.analytics import waiting_reason
from tidewire.operators.queues import delete_where, marked, update_where

ACTIVE = ("PENDING", "PROCESSING", "WAITING")


def event_detail(events: DataFrame, articles: DataFrame, queue: DataFrame, proposals: DataFrame) -> DataFrame:
    """Events with ``articles`` (structs, newest first), ``queue_tag`` of an active job and ``proposal_tag``.

    Of several active jobs that with the smallest id is shown. Articles carry no texts; narrow ``events`` beforehand.
    """
    shown = F.struct("published_date", "id", "title", F.coalesce("newspaper", F.lit("Unknown")).alias("source"), F.coalesce("bias", F.lit("Unknown")).alias("bias"), "stance", "clickbait_score")
    lists = articles.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list(shown), asc=False).alias("articles"))
    tag = F.concat("queue_name", F.lit(" ("), "status", F.lit(")"))
    tags = queue.filter(F.col("status").isin(*ACTIVE)).groupBy(F.col("event_id").alias("id")).agg(F.min_by(tag, "id").alias("queue_tag"))
    named = proposals.filter("status = 'PENDING'").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    named = named.withColumn("proposal_tag", F.lit("Merge Proposed"))
    return events.join(lists, "id", "left").join(tags, "id", "left").join(named, "id", "left")


def article_detail(articles: DataFrame, newspapers: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked-for articles with texts and the name of their outlet, "Unknown" without one."""
    names = newspapers.select(F.col("name").alias("newspaper"), F.col("name").alias("source"))
    a = articles.join(ids.select("id").distinct(), "id", "left_semi").join(names, "newspaper", "left")
    return a.withColumn("source", F.coalesce("source", F.lit("Unknown"))).withColumn("content", F.coalesce("content", F.lit("")))


def waiting_events(events: DataFrame, queue: DataFrame) -> DataFrame:
    """Events with a job that waits for approval, newest first, and why; one row per such job."""
    waits = queue.filter("status = 'WAITING'").select(F.col("event_id").alias("id"))
    return events.join(waits, "id").withColumn("reason", waiting_reason(F.col("article_count"))).orderBy(F.desc("created_at"), "id")


def next_proposal(proposals: DataFrame) -> DataFrame:
    """The pending proposal of least distance."""
    return proposals.filter("status = 'PENDING'").orderBy("distance", "source_id", "target_id").limit(1)


def edit_events(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Columns of ``edits`` (id and others, one row per event) replace those of the event where they aren't null."""
    cols = [c for c in edits.columns if c != "id"]
    joined = events.join(edits.select("id", *[F.col(c).alias(f"_new_{c}") for c in cols]), "id", "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in cols}).select(*events.columns)


def boost(events: DataFrame, amounts: DataFrame) -> DataFrame:
    """Adds (id, amount) to the editorial score, demotes where it is negative; the score R10 is computed afterwards."""
    joined = events.join(amounts.select("id", "amount"), "id", "left")
    new = F.coalesce("editorial_score", F.lit(0.0)) + F.col("amount")
    return joined.withColumn("editorial_score", F.when(F.col("amount").isNotNull(), new).otherwise(F.col("editorial_score"))).select(*events.columns)


def archive_by_hand(events: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The events go to the archive and are no longer active."""
    return update_where(marked(events, ids, "id"), F.col("_hit"), as_of, status="ARCHIVED", is_active=False).select(*events.columns)


def approve(events: DataFrame, queue: DataFrame, ids: DataFrame, as_of: Column, note: str = "Approved by hand") -> tuple[DataFrame, DataFrame]:
    """(events, queue): the events are published as of now and their waiting jobs are done."""
    e = update_where(marked(events, ids, "id"), F.col("_hit"), as_of, status="PUBLISHED", published_at=as_of)
    q = update_where(marked(queue, ids, "event_id"), F.col("_hit") & (F.col("status") == "WAITING"), as_of, status="COMPLETED", msg=note)
    return e.select(*events.columns), q.select(*queue.columns)


@dataclass(frozen=True)
class Dissolved:
    events: DataFrame
    articles: DataFrame
    articles_queue: DataFrame
    events_queue: DataFrame
    proposals: DataFrame


#: Columns that enrichment fills; a dissolved event's articles lose them.
ENRICHED = ("event_id", "subtitle", "summary", "published_date", "stance", "stance_reasoning", "clickbait_score", "clickbait_reasoning", "main_topics", "key_points", "entities", "interests", "embedding")


def dissolve(events: DataFrame, articles: DataFrame, articles_queue: DataFrame, events_queue: DataFrame, proposals: DataFrame, ids: DataFrame, as_of: Column) -> Dissolved:
    """The events go with their jobs and proposals; their articles are emptied and wait for enrichment.

    ``articles_queue`` has one row per article_id; one that exists keeps its created_at and attempts.
    """
    a = marked(articles, ids, "event_id")
    freed = a.filter("_hit").select(F.col("id").alias("article_id"), F.concat(F.lit("Dissolved from Event "), F.col("event_id").cast("string")).alias("_msg"))
    empty = {c: F.lit(None).cast(articles.schema[c].dataType) for c in ENRICHED if c in articles.columns} | {"title": F.lit("Unknown")}
    empty |= {"summary_status": F.lit("PENDING")} if "summary_status" in articles.columns else {}
    a = a.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in empty.items()}).select(*articles.columns)
    q = articles_queue.join(freed, "article_id", "full")
    again = {"status": F.lit("PENDING"), "queue_name": F.lit("enricher"), "updated_at": as_of, "msg": F.col("_msg")}
    q = q.withColumns({c: F.when(F.col("_msg").isNotNull(), v).otherwise(F.col(c)) for c, v in again.items()})
    q = q.withColumns({"created_at": F.coalesce("created_at", as_of), "attempts": F.coalesce("attempts", F.lit(0))}).select(*articles_queue.columns)
    gone = ids.select(F.col("id").alias("_id")).distinct()
    p = proposals
    for side in ("source_id", "target_id"):
        p = p.join(gone, F.col(side) == F.col("_id"), "left_anti")
    left = delete_where(marked(events_queue, ids, "event_id"), F.col("_hit")).select(*events_queue.columns)
    return Dissolved(delete_where(marked(events, ids, "id"), F.col("_hit")).select(*events.columns), a, q, left, p)

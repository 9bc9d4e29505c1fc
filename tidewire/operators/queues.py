"""Queue and life-cycle transitions: each a function from state to state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ago(as_of: Column, **units: int) -> Column:
    u = {"days": 0, "hours": 0, "minutes": 0} | units
    return as_of - F.expr(f"make_dt_interval({u['days']}, {u['hours']}, {u['minutes']})")


def update_where(state: DataFrame, predicate: Column, as_of: Column, **values) -> DataFrame:
    """K5: rows that satisfy the predicate get new values (and updated_at); null predicates change nothing."""
    hit = F.coalesce(predicate, F.lit(False))
    new = values | ({"updated_at": as_of} if "updated_at" in state.columns else {})
    return state.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in new.items()})


def delete_where(state: DataFrame, predicate: Column) -> DataFrame:
    """K6: rows that satisfy the predicate go; null predicates keep."""
    return state.filter(~F.coalesce(predicate, F.lit(False)))


def marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` with a column _hit: whether ``key`` is one of the ``id`` of ``ids``."""
    chosen = ids.select(F.col("id").alias(key)).distinct().withColumn("_hit", F.lit(True))
    return rows.join(chosen, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def insert_new(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """K1, K2: state plus the rows whose key is new, each key once (the smallest row by all columns)."""
    once = rows.groupBy(*keys).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    return state.unionByName(once.join(state.select(*keys), keys, "left_anti").select(*state.columns))


def upsert(state: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """K3: latest row per key by version; of equal versions the incoming one."""
    both = state.withColumn("_new", F.lit(0)).unionByName(rows.select(*state.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "_new"]).select(*state.columns)


def rescue_stuck(queue: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Q1."""
    return update_where(queue, (F.col("status") == "PROCESSING") & (F.col("updated_at") < ago(as_of, minutes=minutes)), as_of, status="PENDING")


def retry_failed(queue: DataFrame, as_of: Column, queue_name: str | None = None) -> DataFrame:
    """Q2."""
    p = F.col("status") == "FAILED"
    return update_where(queue, p & (F.col("queue_name") == queue_name) if queue_name else p, as_of, status="PENDING")


def reset_processing(queue: DataFrame, as_of: Column) -> DataFrame:
    """Q3."""
    return update_where(queue, F.col("status") == "PROCESSING", as_of, status="PENDING")


def purge_done(queue: DataFrame, states: tuple[str, ...] = ("COMPLETED",)) -> DataFrame:
    """Q4."""
    return delete_where(queue, F.col("status").isin(*states))


def expire_pending(queue: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Q5."""
    return update_where(queue, (F.col("status") == "PENDING") & (F.col("created_at") < ago(as_of, days=days)), as_of, status="COMPLETED", msg="expired")


def untitled(title: Column) -> Column:
    """F15."""
    return F.lower(title).isin("no title", "unknown", "")


def title_decision(title: Column, published: Column, as_of: Column, days: int = 7) -> Column:
    """Too old is IGNORED, without a title FAILED, else KEEP; an unknown date is not old."""
    return F.when(published < ago(as_of, days=days), "IGNORED").when(F.coalesce(title, F.lit("")) == "", "FAILED").otherwise("KEEP")


def analysis_decision(content: Column, summary_status: Column, published: Column, as_of: Column, days: int = 7) -> Column:
    """F17, in this order: too short is FAILED, done before COMPLETED, too old IGNORED, without a date FAILED, else ANALYSE."""
    short = F.char_length(F.coalesce(content, F.lit(""))) < 50
    return F.when(short, "FAILED").when(summary_status == "COMPLETED", "COMPLETED").when(published < ago(as_of, days=days), "IGNORED").when(published.isNull(), "FAILED").otherwise("ANALYSE")


def requeue_untitled(queue: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Q6: untitled articles go to the enricher, one row per article."""
    rows = articles.filter(untitled(F.col("title"))).select(F.col("id").alias("article_id"), F.lit("PENDING").alias("status"), F.lit("enricher").alias("queue_name"), as_of.alias("updated_at"), as_of.alias("created_at"))
    return upsert(queue.select("article_id", "status", "queue_name", "updated_at", "created_at"), rows, ["article_id"], "updated_at")


def janitor(queue: DataFrame, as_of: Column, keep_days: int = 7, stuck_hours: int = 6) -> DataFrame:
    """Q8: terminal rows over keep_days old go (failed ones stay), long-running ones wait again."""
    old = F.col("status").isin("COMPLETED", "APPROVED", "REJECTED") & (F.col("updated_at") < ago(as_of, days=keep_days))
    return update_where(delete_where(queue, old), (F.col("status") == "PROCESSING") & (F.col("updated_at") < ago(as_of, hours=stuck_hours)), as_of, status="PENDING")


def latest_ticket(queue: DataFrame, key: str) -> DataFrame:
    """The newest pending row of each key; older siblings are superseded."""
    w = W.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    p = queue.filter("status = 'PENDING'").withColumn("rn", F.row_number().over(w))
    return p.withColumn("superseded", F.col("rn") > 1).drop("rn")


def claim(queue: DataFrame, name: str, n: int, order: list[Column]) -> DataFrame:
    """The next n pending rows of a queue."""
    return queue.filter((F.col("status") == "PENDING") & (F.col("queue_name") == name)).orderBy(*order, "id").limit(n)


def archive(events: DataFrame, as_of: Column) -> DataFrame:
    """Published and active, and either over 7 days old with a score below 50 or over 14 days old; is_active stays."""
    old = (F.col("created_at") < ago(as_of, days=7)) & (F.col("hot_score") < 50) | (F.col("created_at") < ago(as_of, days=14))
    hit = F.coalesce((F.col("status") == "PUBLISHED") & F.col("is_active") & old, F.lit(False))
    return events.withColumn("status", F.when(hit, "ARCHIVED").otherwise(F.col("status")))


def decay(events: DataFrame, scored: DataFrame, least: float = 0.01) -> DataFrame:
    """(id, hot_score) of published, active events whose new score differs by more than ``least``."""
    new = scored.select("id", F.col("hot_score").alias("new_score"))
    live = events.filter("status = 'PUBLISHED' and is_active").join(new, "id")
    return live.filter(F.abs(F.col("new_score") - F.coalesce("hot_score", F.lit(0.0))) > least).select("id", F.col("new_score").alias("hot_score"))


def stale_summaries(events: DataFrame, queue: DataFrame, as_of: Column, n: int = 50) -> DataFrame:
    """Active events that grew since a summary over 30 minutes old, without an open enhancer job."""
    busy = queue.filter((F.col("queue_name") == "enhancer") & F.col("status").isin("PENDING", "PROCESSING")).select(F.col("event_id").alias("id"))
    grown = events.filter(F.col("is_active") & (F.col("article_count") > F.coalesce("articles_at_last_summary", F.lit(0))) & (F.col("summarized_at") < ago(as_of, minutes=30)))
    return grown.join(busy, "id", "left_anti").orderBy("summarized_at", "id").limit(n)


def summary_due(events: DataFrame, as_of: Column, minutes: int = 15, backlog: int = 10) -> DataFrame:
    """Events whose last summary is older than the debounce, that are forced, or have a large backlog."""
    return events.filter(F.coalesce("forced", F.lit(False)) | (F.col("backlog") > backlog) | F.col("summarized_at").isNull() | (F.col("summarized_at") <= ago(as_of, minutes=minutes)))


def delta_articles(articles: DataFrame, proposals: DataFrame, size: int = 5) -> DataFrame:
    """An event's articles that are done and in no open proposal, oldest first, with ``batch_no`` from 0.

    ``articles``: event_id, id, published_date, summary_status and whatever the batches need.
    """
    busy = proposals.filter(F.col("status").isin("PENDING", "PROCESSING")).select(F.col("source_id").alias("id"))
    oldest = W.partitionBy("event_id").orderBy("published_date", "id")
    delta = articles.filter("summary_status = 'COMPLETED'").join(busy, "id", "left_anti").withColumn("rn", F.row_number().over(oldest).cast("long"))
    return delta.withColumn("batch_no", F.floor((F.col("rn") - 1) / size))


def batch_inputs(delta: DataFrame) -> DataFrame:
    """(event_id, batch_no, inputs): bias, key points and source of each article that has key points, in order."""
    one = F.struct("rn", "bias", "key_points", F.col("newspaper").alias("source"))
    per = delta.filter(F.size("key_points") > 0).groupBy("event_id", "batch_no").agg(F.array_sort(F.collect_list(one)).alias("i"))
    return per.select("event_id", "batch_no", F.transform("i", lambda x: F.struct(x["bias"].alias("bias"), x["key_points"].alias("key_points"), x["source"].alias("source"))).alias("inputs"))


def enhance_action(events: DataFrame, as_of: Column, minutes: int = 15, backlog: int = 10) -> DataFrame:
    """``action`` of events with summarized_at, forced, backlog (articles) and merged (newly merged events)."""
    n, forced = F.coalesce("backlog", F.lit(0)), F.coalesce("forced", F.lit(False))
    soon = F.coalesce(F.col("summarized_at") > ago(as_of, minutes=minutes), F.lit(False))
    none = (n == 0) & (F.coalesce("merged", F.lit(0)) == 0)
    return events.withColumn("action", F.when(soon & ~forced & (n <= backlog), "DEBOUNCED").when(none & ~forced, "SKIPPED_EMPTY").otherwise("ENHANCE"))


def merge_relink(articles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Articles of victims move to their survivors (victim_id, survivor_id)."""
    m = mapping.select(F.col("victim_id").alias("event_id"), "survivor_id")
    return articles.join(m, "event_id", "left").withColumn("event_id", F.coalesce("survivor_id", "event_id")).drop("survivor_id")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Audit rows (key, action, column, old, new) between two snapshots; deletions carry every column."""
    cols = [c for c in before.columns if c != key]
    b = before.select(F.col(key).alias("k"), F.struct(*[F.col(c).cast("string").alias(c) for c in cols]).alias("b"))
    a = after.select(F.col(key).alias("k"), F.struct(*[F.col(c).cast("string").alias(c) for c in cols]).alias("a"))
    both = b.join(a, "k", "full")
    each = both.select("k", "b", "a", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b.{c}").alias("old"), F.col(f"a.{c}").alias("new")) for c in cols])).alias("c"))
    action = F.when(F.col("b").isNull(), "INSERT").when(F.col("a").isNull(), "DELETE").otherwise("UPDATE")
    return each.filter(~F.col("c.old").eqNullSafe(F.col("c.new"))).select(F.col("k").alias(key), action.alias("action"), "c.column", "c.old", "c.new")

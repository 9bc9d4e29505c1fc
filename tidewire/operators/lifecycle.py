"""How jobs, proposals and events move on: results to next jobs, requeueing, merges and new events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.config import DEFAULTS, Settings
from tidewire.functions.text import last_unique_words
from tidewire.operators.queues import ago, marked, update_where

OPEN = ("PENDING", "PROCESSING")


def _jobs(queue: DataFrame, rows: DataFrame, key: str, name: Column, as_of: Column, msg: Column, new_id: Column | None) -> DataFrame:
    """New pending rows of a queue, one per row of ``rows``; columns that they don't have are null."""
    values = {"id": F.xxhash64(F.col(key), name, msg) if new_id is None else new_id, key: F.col(key), "status": F.lit("PENDING"), "queue_name": name, "created_at": as_of, "updated_at": as_of, "attempts": F.lit(0), "msg": msg}
    return rows.select(*[values.get(c, F.lit(None)).cast(queue.schema[c].dataType).alias(c) for c in queue.columns])


def create_jobs(queue: DataFrame, rows: DataFrame, key: str, name: str, as_of: Column, new_id: Column | None = None) -> DataFrame:
    """Q12: ``queue`` with a pending job for each row (``key``, msg)."""
    return queue.unionByName(_jobs(queue, rows, key, F.lit(name), as_of, F.col("msg"), new_id))


def requeue(queue: DataFrame, wanted: DataFrame, key: str, name: str, as_of: Column, states: tuple[str, ...] = OPEN, first_only: bool = True, new_id: Column | None = None) -> DataFrame:
    """Q11, K4: open jobs of the wanted (``key``, msg) start again in queue ``name``; those without one get a new job.

    first_only: of several open jobs only the one with the smallest id starts again, the others stay as they are.
    """
    w = wanted.groupBy(key).agg(F.min("msg").alias("_msg"))
    is_open = F.col("status").isin(*states)
    hit = is_open & F.col("_msg").isNotNull()
    q = queue.join(w, key, "left")
    if first_only:
        first = queue.filter(is_open).groupBy(key).agg(F.min("id").alias("_first"))
        q = q.join(first, key, "left")
        hit = hit & (F.col("id") == F.col("_first"))
    again = update_where(q, hit, as_of, status="PENDING", queue_name=name, attempts=0, msg=F.col("_msg")).select(*queue.columns)
    missing = w.join(queue.filter(is_open).select(key), key, "left_anti")
    return again.unionByName(_jobs(queue, missing, key, F.lit(name), as_of, F.col("_msg"), new_id))


def requeue_incomplete(queue: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Q7: events that were enhanced and still lack a subtitle or a summary wait for the enhancer again.

    Of an event's enhancer jobs, of which one is done, that with the smallest id starts again.
    """
    bare = events.filter(F.col("subtitle").isNull() | (F.col("subtitle") == "") | (F.size("summary") == 0)).select(F.col("id").alias("event_id")).distinct()
    jobs = queue.filter("queue_name = 'enhancer'").groupBy("event_id").agg(F.min("id").alias("id"), F.max(F.col("status") == "COMPLETED").alias("done"))
    first = jobs.filter("done").join(bare, "event_id", "left_semi").select("id")
    return update_where(marked(queue, first, "id"), F.col("_hit"), as_of, status="PENDING", attempts=0, msg="Re-queued: missing data").select(*queue.columns)


def complete_old(queue: DataFrame, articles: DataFrame, name: str, as_of: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Q9: pending jobs of a queue whose article is older than the cutoff are done."""
    old = articles.filter(F.col("published_date") < ago(as_of, days=s.article_cutoff_days)).select("id")
    hit = F.col("_hit") & (F.col("status") == "PENDING") & (F.col("queue_name") == name)
    return update_where(marked(queue, old, "article_id"), hit, as_of, status="COMPLETED", msg="Article Too Old (Auto-Cleared)").select(*queue.columns)


def _pair(symmetric: bool) -> Column:
    return F.struct(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")) if symmetric else F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b"))


def create_proposals(proposals: DataFrame, new: DataFrame, as_of: Column, symmetric: bool = True) -> DataFrame:
    """Q12: ``proposals`` with the pairs of ``new`` (source_id, target_id, distance, reasoning, ambiguous) that it lacks.

    A pair that stands already, in either order where symmetric, stays as it is, whatever its status. Of several new
    rows of one pair the nearest is taken.
    """
    rows = new.withColumn("_pair", _pair(symmetric)).join(proposals.select(_pair(symmetric).alias("_pair")), "_pair", "left_anti")
    rank = F.struct("distance", "source_id", "target_id", "reasoning")
    once = rows.groupBy("_pair").agg(F.min_by(F.struct("source_id", "target_id", "distance", "reasoning", "ambiguous"), rank).alias("r")).select("r.*")
    reason = F.concat(F.coalesce("reasoning", F.lit("")), F.when(F.coalesce("ambiguous", F.lit(False)), " (AMBIGUOUS)").otherwise(""))
    values = {"source_id": F.col("source_id"), "target_id": F.col("target_id"), "distance": F.col("distance"), "status": F.lit("PENDING"), "reasoning": reason, "updated_at": as_of, "created_at": as_of}
    return proposals.unionByName(once.select(*[values.get(c, F.lit(None)).cast(proposals.schema[c].dataType).alias(c) for c in proposals.columns]))


def set_proposals(proposals: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """Q13: proposals take status and reasoning of the verdict (source_id, target_id, status, reasoning) on their pair."""
    v = verdicts.select("source_id", "target_id", F.col("status").alias("_status"), F.col("reasoning").alias("_reason"))
    p = proposals.join(v, ["source_id", "target_id"], "left")
    return update_where(p, F.col("_status").isNotNull(), as_of, status=F.col("_status"), reasoning=F.col("_reason")).select(*proposals.columns)


def reject_for_sources(proposals: DataFrame, sources: DataFrame, as_of: Column, keep: DataFrame | None = None) -> DataFrame:
    """Q13: open proposals of the sources (source_id, reason) are rejected, but for the pairs in ``keep``."""
    s = sources.groupBy("source_id").agg(F.min("reason").alias("_reason"))
    p = proposals.join(s, "source_id", "left")
    hit = F.col("_reason").isNotNull() & F.col("status").isin(*OPEN)
    if keep is not None:
        p = p.join(keep.select("source_id", "target_id").distinct().withColumn("_keep", F.lit(True)), ["source_id", "target_id"], "left")
        hit = hit & F.col("_keep").isNull()
    return update_where(p, hit, as_of, status="REJECTED", reasoning=F.col("_reason")).select(*proposals.columns)


@dataclass(frozen=True)
class Processed:
    """proposals: all, as they are afterwards; merges (victim_id, survivor_id) and new_events (article_id) to carry out."""

    proposals: DataFrame
    merges: DataFrame
    new_events: DataFrame


def process_proposals(proposals: DataFrame, actions: DataFrame, as_of: Column, of_articles: bool = False) -> Processed:
    """Q16: the editor's action (source_id, target_id, action) on pending proposals: merge, reject or new_event.

    new_event is for proposals of articles only; other actions, and proposals that aren't pending, change nothing.
    """
    p = proposals.join(actions.select("source_id", "target_id", F.col("action").alias("_action")), ["source_id", "target_id"], "left")
    p = p.withColumn("_action", F.when(F.col("status") == "PENDING", F.col("_action")))
    rejects = (F.col("_action") == "reject") | (F.col("_action") == "new_event") & F.lit(of_articles)
    after = update_where(p, rejects, as_of, status="REJECTED").select(*proposals.columns)
    merges = p.filter("_action = 'merge'").select(F.col("source_id").alias("victim_id"), F.col("target_id").alias("survivor_id"))
    return Processed(after, merges, p.filter((F.col("_action") == "new_event") & F.lit(of_articles)).select(F.col("source_id").alias("article_id")))


def reset_limits(usage: DataFrame, resets: DataFrame) -> DataFrame:
    """Q17: usage rows of the (model, metric) in ``resets`` go; the metric matches in any case."""
    r = resets.select(F.col("model"), F.upper("metric").alias("_m")).distinct()
    return usage.withColumn("_m", F.upper("metric")).join(r, ["model", "_m"], "left_anti").select(*usage.columns)


@dataclass(frozen=True)
class Route:
    """What becomes of a job whose work ended in an action.

    msg: the job's message, with {action}, {reason} and {title}; next_queue and next_msg: the job that follows; prunes:
    jobs in these states, of the same subject and queue and no newer, are done with.
    """

    status: str
    msg: str = "{reason}"
    next_queue: str | None = None
    next_msg: str = "{reason}"
    prunes: tuple[str, ...] = ()


#: Queue and action to what follows.
ROUTES: dict[tuple[str, str], Route] = {
    ("filter", "APPROVED"): Route("COMPLETED", "Approved", "enricher", "Approved by Filter"),
    ("filter", "APPROVED_WAITING"): Route("COMPLETED", "Approved", "analyzer", "Approved by Filter"),
    ("filter", "REJECTED"): Route("COMPLETED", "Rejected by Filter"),
    ("enricher", "SUCCESS"): Route("COMPLETED", "{reason}", "analyzer", "Enrichment Complete"),
    ("enricher", "SUCCESS_UNTITLED"): Route("COMPLETED", "{reason}", "filter", "Enrichment Complete"),
    ("enricher", "ARCHIVED"): Route("COMPLETED", "Archived: {reason}"),
    ("enricher", "FAILED"): Route("FAILED"),
    ("analyzer", "SUCCESS"): Route("COMPLETED", "{reason}", "cluster", "Analyzed Successfully"),
    ("analyzer", "IRRELEVANT"): Route("COMPLETED"),
    ("analyzer", "ERROR"): Route("FAILED"),
    ("cluster", "MERGE"): Route("COMPLETED", "{reason}", "enhancer", "From Cluster: {reason}"),
    ("cluster", "NEW"): Route("COMPLETED", "{reason}", "enhancer", "From Cluster: {reason}"),
    ("cluster", "IGNORED"): Route("COMPLETED"),
    ("cluster", "PROPOSE"): Route("COMPLETED", "Parked: {reason}"),
    ("cluster", "PROPOSE_MULTI"): Route("COMPLETED", "Parked: {reason}"),
    ("cluster", "ERROR"): Route("FAILED"),
    ("enhancer", "ENHANCED"): Route("COMPLETED", "{action}: {reason}", "publisher", "Enhanced", ("PENDING",)),
    ("enhancer", "DEBOUNCED"): Route("COMPLETED", "{action}: {reason}", "publisher", "Debounced: Volume Update Only", ("PENDING",)),
    ("enhancer", "SKIPPED_EMPTY"): Route("COMPLETED", "{action}: {reason}", prunes=("PENDING",)),
    ("enhancer", "SKIPPED_INACTIVE"): Route("COMPLETED", "{action}: {reason}", prunes=("PENDING",)),
    ("enhancer", "ERROR"): Route("FAILED", "{action}: {reason}"),
    ("publisher", "WAIT"): Route("WAITING"),
    ("publisher", "IGNORE"): Route("COMPLETED", prunes=("PENDING", "WAITING")),
    ("publisher", "PUBLISH"): Route("COMPLETED", prunes=("PENDING", "WAITING")),
    ("publisher", "MERGE"): Route("COMPLETED", "{reason}", "enhancer", "Merged with {title}", ("PENDING", "WAITING")),
    ("publisher", "PROPOSE"): Route("COMPLETED", prunes=("PENDING", "WAITING")),
    ("publisher", "ERROR"): Route("FAILED"),
}


@dataclass(frozen=True)
class Routed:
    """queue: all jobs afterwards; next_jobs: (subject, queue_name, msg, from_id) of the jobs that follow."""

    queue: DataFrame
    next_jobs: DataFrame


def route_results(queue: DataFrame, results: DataFrame, key: str, as_of: Column, routes: dict[tuple[str, str], Route] = ROUTES) -> Routed:
    """Q18: jobs (id, ``key``, queue_name, status, created_at, ...) after their results (id, action, reason, subject, title).

    ``subject`` is what a following job is for - the event of a clustered article, the survivor of a merge; null means
    the job's own ``key``; ``title`` (may be left out) is its event's, of which 20 characters are told. Jobs without a result, and actions that no route names, stay as they are. A result takes one
    attempt. The routes are a table of fixed size.
    """
    spark = queue.sparkSession
    rows = [(q, a, r.status, r.msg, r.next_queue, r.next_msg, list(r.prunes)) for (q, a), r in routes.items()]
    table = spark.createDataFrame(rows, "queue_name string, _action string, _status string, _msg string, _next string, _next_msg string, _prunes array<string>")
    r = results.select("id", F.col("action").alias("_action"), F.coalesce("reason", F.lit("")).alias("_reason"), F.col("subject").alias("_subject"), (F.coalesce(F.substring("title", 1, 20), F.lit("")) if "title" in results.columns else F.lit("")).alias("_title"))
    q = queue.join(r, "id", "left").join(F.broadcast(table), ["queue_name", "_action"], "left")
    filled = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("{action}"), F.col("_action")), F.lit("{reason}"), F.col("_reason")), F.lit("{title}"), F.col("_title"))
    hit = F.col("_status").isNotNull()
    over = q.select(F.col(key).alias("_k"), F.col("queue_name").alias("_q"), F.explode("_prunes").alias("_s"), F.struct("created_at", "id").alias("_by"))
    newest = over.groupBy("_k", "_q", "_s").agg(F.max("_by").alias("_by"))
    next_jobs = q.filter(hit & F.col("_next").isNotNull()).select(F.coalesce("_subject", key).alias("subject"), F.col("_next").alias("queue_name"), filled("_next_msg").alias("msg"), F.col("id").alias("from_id"))
    done = update_where(q, hit, as_of, status=F.col("_status"), msg=filled("_msg"), attempts=F.col("attempts") + 1)
    done = done.join(newest, (F.col(key) == F.col("_k")) & (F.col("queue_name") == F.col("_q")) & (done["status"] == F.col("_s")), "left")
    stale = ~hit & (F.col("created_at") <= F.col("_by.created_at"))
    done = update_where(done, stale, as_of, status="COMPLETED", msg=F.concat(F.lit("Superseded by Job "), F.col("_by.id").cast("string")))
    return Routed(done.select(*queue.columns), next_jobs)


def merge_work_set(events: DataFrame, proposals: DataFrame, queue: DataFrame, as_of: Column, seen: DataFrame | None = None, hours: int = 48) -> DataFrame:
    """Active events updated in the last hours, in no open proposal and not being enhanced, newest first.

    ``seen`` (id, last_updated_at) are the versions of the last scan: those that haven't changed are left out.
    """
    live = events.filter(F.col("is_active") & (F.col("last_updated_at") >= ago(as_of, hours=hours)))
    busy = proposals.filter(F.col("status").isin(*OPEN)).select(F.explode(F.array("source_id", "target_id")).alias("id"))
    enhanced = queue.filter("queue_name = 'enhancer' and status = 'PROCESSING'").select(F.col("event_id").alias("id"))
    out = live.join(busy.unionByName(enhanced), "id", "left_anti")
    if seen is not None:
        out = out.join(seen.select("id", "last_updated_at"), ["id", "last_updated_at"], "left_anti")
    return out.select("id", "last_updated_at").orderBy(F.desc("last_updated_at"), "id")


@dataclass(frozen=True)
class Merged:
    events: DataFrame
    articles: DataFrame
    proposals: DataFrame
    queue: DataFrame


def execute_merges(events: DataFrame, articles: DataFrame, proposals: DataFrame, queue: DataFrame, mapping: DataFrame, as_of: Column, reason: str = "") -> Merged:
    """Victims merge into survivors (victim_id, survivor_id; no survivor is a victim itself, each victim once).

    Articles move; the victim becomes an inactive tombstone that points to its survivor; both are updated now; every
    proposal on a victim and every job of it is rejected. Statistics are merged apart, by rollup.merge_statistics.
    """
    m = mapping.select("victim_id", "survivor_id").distinct()
    note = f"Event merged: {reason}"
    a = articles.join(m.select(F.col("victim_id").alias("event_id"), "survivor_id"), "event_id", "left")
    a = update_where(a, F.col("survivor_id").isNotNull(), as_of, event_id=F.col("survivor_id")).select(*articles.columns)
    e = events.join(m.select(F.col("victim_id").alias("id"), F.col("survivor_id").alias("_into")), "id", "left")
    e = marked(e, m.select(F.col("survivor_id").alias("id")), "id")
    gone = F.col("_into").isNotNull()
    values = {"is_active": F.when(gone, F.lit(False)), "status": F.when(gone, F.lit("MERGED")), "merged_into_id": F.when(gone, F.col("_into")), "last_updated_at": F.when(gone | F.col("_hit"), as_of)}
    e = e.withColumns({c: F.coalesce(v.cast(events.schema[c].dataType), F.col(c)) for c, v in values.items()}).select(*events.columns)
    victims = m.select(F.col("victim_id").alias("id"))
    p = marked(marked(proposals, victims, "source_id").withColumnRenamed("_hit", "_source"), victims, "target_id")
    p = update_where(p, F.col("_source") | F.col("_hit"), as_of, status="REJECTED", reasoning=note).select(*proposals.columns)
    q = update_where(marked(queue, victims, "event_id"), F.col("_hit"), as_of, status="REJECTED", msg=note).select(*queue.columns)
    return Merged(e, a, p, q)


def new_events(articles: DataFrame, as_of: Column, new_id: Column | None = None) -> DataFrame:
    """An event for each article with a vector: id, title, centroid, dates, rank, score and whole search text from it.

    ``articles``: id, title, published_date, source_rank, embedding, search_text (see functions.text.search_query).
    """
    rank = F.nullif(F.col("source_rank"), F.lit(0))
    return articles.filter(F.size("embedding") > 0).select(
        (F.xxhash64("id") if new_id is None else new_id).alias("id"), F.col("id").alias("article_id"), "title", F.col("embedding").alias("centroid"), F.lit(1).cast("long").alias("article_count"), F.lit(True).alias("is_active"),
        F.coalesce("published_date", as_of).alias("created_at"), as_of.alias("last_updated_at"), F.col("published_date").alias("first_article_date"), F.col("published_date").alias("last_article_date"),
        rank.alias("best_source_rank"), F.coalesce(F.lit(10.0) / rank, F.lit(0.0)).alias("editorial_score"), "search_text",
    )


def link_articles(events: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Events after the articles (event_id, id, published_date, source_rank, search_text) joined them, oldest first.

    Counts, dates, rank, score and search text move on; centroids and maps are rolled up apart. The newest 100 words
    of the search text stay, each at its newest place among all articles; a null date is older than any other.
    """
    rank = F.nullif(F.col("source_rank"), F.lit(0))
    # A word's newest place is found per event and word, so that no group holds more than the words that stay.
    each = articles.select("event_id", "published_date", "id", F.posexplode(F.split("search_text", " +", -1)).alias("p", "word")).filter("word <> ''")
    last = each.groupBy("event_id", "word").agg(F.max(F.struct("published_date", "id", "p")).alias("at"))
    kept = last.withColumn("_rn", F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("at")))).filter("_rn <= 100")
    texts = kept.groupBy(F.col("event_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("_texts"))
    new = articles.groupBy(F.col("event_id").alias("id")).agg(
        F.count("*").alias("_n"), F.min("published_date").alias("_first"), F.max("published_date").alias("_last"), F.min(rank).alias("_rank"), F.coalesce(F.sum(F.lit(10.0) / rank), F.lit(0.0)).alias("_score"),
    )
    e = events.join(new, "id", "left").join(texts, "id", "left").withColumn("_texts", F.coalesce("_texts", F.array().cast("array<string>")))
    words = F.filter(F.split(F.concat_ws(" ", F.coalesce("search_text", F.lit("")), F.array_join("_texts", " ")), " +", -1), lambda w: w != "")
    values = {
        "article_count": F.coalesce("article_count", F.lit(0)) + F.col("_n"), "first_article_date": F.least("first_article_date", "_first"), "last_article_date": F.greatest("last_article_date", "_last"),
        "best_source_rank": F.least("best_source_rank", "_rank"), "editorial_score": F.coalesce("editorial_score", F.lit(0.0)) + F.col("_score"), "search_text": F.array_join(last_unique_words(words), " "), "last_updated_at": as_of,
    }
    return e.withColumns({c: F.when(F.col("_n").isNotNull(), v).otherwise(F.col(c)) for c, v in values.items() if c in events.columns}).select(*events.columns)

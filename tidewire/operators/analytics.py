"""Reports: volumes, grids, histograms, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top_by(df: DataFrame, keys: list[str], n: int, name: str = "n") -> DataFrame:
    """The n most frequent keys; keys break ties."""
    return count_by(df, *keys, name=name).orderBy(F.desc(name), *keys).limit(n)


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of a timestamp without zone."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds).cast("decimal(18,6)"))


def time_grid(df: DataFrame, ts: str, seconds: int, *keys: str) -> DataFrame:
    """Rows per bucket of time and keys, with a day-and-hour label."""
    g = df.withColumn("slot", bucket(F.col(ts), seconds)).groupBy("slot", *keys).agg(F.count("*").alias("n"))
    return g.withColumn("label", F.date_format("slot", "dd HH:mm"))


def union_counts(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(kind, day, n) of several tables by the day of a column."""
    out = None
    for kind, df, ts in parts:
        one = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "day", "n")
        out = one if out is None else out.unionByName(one)
    return out


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bucket_no, centre, n); below the range is bucket 0, its upper end and above is bins + 1."""
    w = (hi - lo) / bins
    no = F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins))
    g = df.filter(F.col(col).isNotNull()).groupBy(no.cast("long").alias("bucket_no")).agg(F.count("*").alias("n"))
    return g.withColumn("centre", F.round(lo + (F.col("bucket_no") - 0.5) * w, 4))


def queue_history(queue: DataFrame) -> DataFrame:
    """Per hour and state: terminal rows by their update, created rows by their creation."""
    done = queue.filter(F.col("status").isin("COMPLETED", "FAILED")).select(F.date_trunc("hour", "updated_at").alias("hour"), "status")
    new = queue.select(F.date_trunc("hour", "created_at").alias("hour"), F.lit("CREATED").alias("status"))
    return done.unionByName(new).groupBy("hour", "status").agg(F.count("*").alias("n")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """One column per value, 0 where nothing was counted."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(v.lower()) for v in values])


def totals(df: DataFrame, part: Column) -> DataFrame:
    """A3: total, part and the part's percentage with two decimals, 0 for an empty table."""
    return df.agg(F.count("*").alias("total"), F.count_if(part).alias("part")).withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("part") * 100.0 / F.col("total"), 2)).otherwise(0.0))


def heartbeat(minutes: Column) -> Column:
    """P1."""
    return F.when(minutes.isNull(), "offline").when(minutes > 60, "critical").when(minutes > 15, "warning").otherwise("healthy")


def source_status(hours: Column) -> Column:
    """P2."""
    return F.when(hours.isNull(), "DEAD").when(hours > 24, "SILENT").when(hours > 3, "WARNING").otherwise("OK")


def volume_status(n: Column) -> Column:
    """P3."""
    return F.when(n == 0, "SILENT").when(n < 5, "LOW").otherwise("OK")


def waiting_reason(n: Column) -> Column:
    """P4."""
    return F.when(n > 5, "Topic/Niche").otherwise("Low Volume")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))) / 3600.0


def source_health(outlets: DataFrame, articles: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Last article and recent volume of every outlet; those without articles come first."""
    a = articles.select(F.col("newspaper").alias("name"), "published_date")
    recent = F.count_if(F.col("published_date") >= as_of - F.expr(f"make_dt_interval(0, {hours})"))
    g = outlets.select("name").join(a, "name", "left").groupBy("name").agg(F.max("published_date").alias("last_seen"), recent.alias("recent"))
    age = hours_between(as_of, F.col("last_seen"))
    return g.withColumn("minutes", F.coalesce(F.floor(age * 60), F.lit(999999)).cast("long")).withColumn("status", source_status(age))


def blocked_by_source(queue: DataFrame, articles: DataFrame, blocked: Column) -> DataFrame:
    """Blocked messages per source with the source's total, from one aggregate."""
    g = queue.filter(blocked).join(articles.select(F.col("id").alias("aid"), "newspaper"), F.col("article_id") == F.col("aid")).groupBy("newspaper", "msg").agg(F.count("*").alias("n"))
    return g.withColumn("source_total", F.sum("n").over(W.partitionBy("newspaper")))


def integrity(events: DataFrame, by_bias: DataFrame) -> DataFrame:
    """Events that count more articles than their biases do, and those with articles and no score."""
    sums = by_bias.groupBy("event_id").agg(F.sum("n").alias("counted"))
    x = events.join(sums, events["id"] == sums["event_id"], "left")
    return x.agg(F.count_if(F.col("article_count") > F.coalesce("counted", F.lit(0))).alias("miscounted"), F.count_if((F.col("hot_score") == 0) & (F.col("article_count") > 0)).alias("unscored"))


def largest_with_latest(events: DataFrame, articles: DataFrame, n: int = 100) -> DataFrame:
    """The newest n articles of the event with most articles."""
    top = events.orderBy(F.desc("article_count"), "id").limit(1).select(F.col("id").alias("event_id"))
    return articles.join(F.broadcast(top), "event_id", "left_semi").orderBy(F.desc("published_date"), "id").limit(n)  # one row


def rate_utilisation(config: DataFrame, usage: DataFrame) -> DataFrame:
    """Percentage used and end of the window per model and metric; models match in any case."""
    u = usage.select(F.lower("model").alias("m"), "metric", "used", "started_at")
    c = config.withColumn("m", F.lower("model"))
    end = F.col("started_at") + F.expr("make_dt_interval(0, 0, 0, window_seconds)")
    return c.join(u, ["m", "metric"], "left").select("model", "metric", F.round(F.coalesce("used", F.lit(0.0)) * 100.0 / F.nullif("limit", F.lit(0)), 2).alias("percent"), end.alias("resets_at"))


def blind_spots(events: DataFrame) -> DataFrame:
    """A5: (side, n, total): active blind spots per side, null sides included, and all of them."""
    g = events.filter(F.coalesce(F.col("is_active") & F.col("is_blind_spot"), F.lit(False))).groupBy(F.col("blind_spot_side").alias("side")).agg(F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(W.partitionBy()))  # one row per side


def errors_by_source(queue: DataFrame, articles: DataFrame, as_of: Column | None = None, hours: int = 24, queue_name: str | None = None, top: int | None = None) -> DataFrame:
    """(newspaper, msg, n) of failed jobs, of the last hours where as_of is given, of one queue, the most frequent."""
    q = queue.filter("status = 'FAILED'")
    if as_of is not None:
        q = q.filter(F.col("updated_at") >= as_of - F.expr(f"make_dt_interval(0, {hours})"))
    if queue_name is not None:
        q = q.filter(F.col("queue_name") == queue_name)
    found = q.select("article_id", "msg").join(articles.select(F.col("id").alias("article_id"), "newspaper"), "article_id").filter("newspaper is not null")
    return top_by(found, ["newspaper", "msg"], top) if top else count_by(found, "newspaper", "msg")


def processed_per_day(articles: DataFrame) -> DataFrame:
    """(day, n) of articles whose analysis is done, by the day of their summary."""
    return articles.filter("summary_status = 'COMPLETED'").groupBy(F.to_date("summary_date").alias("day")).agg(F.count("*").alias("n"))


def pending_proposals(of_articles: DataFrame, of_events: DataFrame) -> DataFrame:
    """(article_merges, event_merges) that wait for a verdict, in one row."""
    n = lambda p: p.agg(F.count_if(F.col("status") == "PENDING").alias("n"))
    return n(of_articles).select(F.col("n").alias("article_merges")).join(n(of_events).select(F.col("n").alias("event_merges")))  # one row each (J11)


def top_events(events: DataFrame, min_score: float | None = None, topic: str | None = None, only_blind_spots: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """Published events by score, with at least min_score, with the topic among main_topic_counts, blind spots only."""
    e = events.filter("status = 'PUBLISHED'")
    if only_blind_spots:
        e = e.filter("is_blind_spot")
    if min_score is not None:
        e = e.filter(F.col("hot_score") >= min_score)
    if topic is not None:
        e = e.filter(F.map_contains_key("main_topic_counts", F.lit(topic)))
    return e.orderBy(F.desc_nulls_first("hot_score"), "id").offset(offset).limit(limit)


def bias_edge(left: Column, right: Column, lead: int = 15) -> Column:
    """The side that leads by more than ``lead``; null counts as 0."""
    l, r = F.coalesce(left, F.lit(0)), F.coalesce(right, F.lit(0))
    return F.when(l > r + lead, "left").when(r > l + lead, "right").otherwise("none")


def impact_level(score: Column) -> Column:
    """P7."""
    return F.when(score > 75, "high").when(score >= 50, "middle").otherwise("low")


def time_since(seconds: Column) -> Column:
    """Elapsed time in its largest whole unit, in Portuguese."""
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))
    text = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n != 1, "s").otherwise(""))
    return F.when(days > 0, text(days, "dia")).when(hours > 0, text(hours, "hora")).when(minutes > 0, text(minutes, "minuto")).otherwise(text(seconds.cast("long"), "segundo"))


#: Viewpoint and who ignores it, by blind-spot side.
BLIND_SPOTS = {"left": ("ESQUERDA", "DIREITA"), "right": ("DIREITA", "ESQUERDA"), "center": ("CENTRO", "ESQUERDA E DIREITA")}


def blind_spot_caption(side: Column) -> Column:
    """(viewpoint, ignored_by) of a side; empty texts for others."""
    table = F.create_map(*[x for k, (v, i) in BLIND_SPOTS.items() for x in (F.lit(k), F.struct(F.lit(v).alias("viewpoint"), F.lit(i).alias("ignored_by")))])
    return F.coalesce(F.try_element_at(table, side), F.struct(F.lit("").alias("viewpoint"), F.lit("").alias("ignored_by")))


#: What a list of events shows where a column is null.
LIST_DEFAULTS = {"category_tag": "GENERAL", "ai_impact_score": 0, "article_count": 0, "stance": 0.0, "is_blind_spot": False}


def event_list(events: DataFrame) -> DataFrame:
    """Events with LIST_DEFAULTS for null columns; empty arrays and maps for null ones; no vectors and texts."""
    kinds = dict(events.dtypes)
    shown = [c for c in events.columns if c not in ("centroid", "embedding", "content", "search_text")]
    empty = lambda c: F.array() if kinds[c].startswith("array") else F.create_map()
    value = lambda c: F.coalesce(F.col(c), F.lit(LIST_DEFAULTS[c])) if c in LIST_DEFAULTS else F.coalesce(F.col(c), empty(c).cast(kinds[c])) if kinds[c].startswith(("array", "map")) else F.col(c)
    return events.select(*[value(c).alias(c) for c in shown])


def newest_first(key: str, ts: str = "published_date", tie: str = "id"):
    return W.partitionBy(key).orderBy(F.desc(ts), tie)


def retired(rows: DataFrame, key: str, ts: str = "published_date") -> DataFrame:
    """``rows`` with ``retired``: all of a key but the newest one (of equal times that with the smallest id)."""
    return rows.withColumn("retired", F.row_number().over(newest_first(key, ts)) > 1)


def newest_per_key(rows: DataFrame, key: str, n: int = 3, ts: str = "published_date") -> DataFrame:
    """T4: (key, ids): the ids of the n newest rows of each key, newest first."""
    top = rows.select(key, "id", F.row_number().over(newest_first(key, ts)).alias("rn")).filter(F.col("rn") <= n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("ids"))


def ranked(rows: DataFrame, name: str, n: int, *order: Column) -> DataFrame:
    """(id, name): the first n rows numbered in an order; a top-k cuts them before they are numbered."""
    return rows.orderBy(*order).limit(n).select("id", F.row_number().over(W.orderBy(*order)).cast("long").alias(name))


def in_either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two rankings by id, null where a ranking lacks it."""
    return a.join(b, "id", "full")


def entries(rows: DataFrame, column: str, kind: str = "map<string,bigint>") -> DataFrame:
    """``rows`` with key and value of each entry of a JSON object in ``column``."""
    return rows.select(*rows.columns, F.explode(F.from_json(column, kind)).alias("key", "value"))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the others'."""
    return rows.join(others.select(key), key, "left_anti")


def first_non_zero(*counts: Column) -> Column:
    """The first count that is not 0, else the last one."""
    zero = F.lit(0).cast("long")
    return F.coalesce(*[F.nullif(c, zero) for c in counts[:-1]], counts[-1])

"""Event roll-up: statistics of an event's articles as associative group aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.config import DEFAULTS, Settings


def basics(articles: DataFrame) -> DataFrame:
    """G1: count, first and last date, best rank, editorial score (sum of 10 / rank; ranks 0 and null are skipped)."""
    rank = F.nullif(F.col("source_rank"), F.lit(0))
    return articles.groupBy("event_id").agg(
        F.count("*").alias("article_count"), F.min("published_date").alias("first_article_date"), F.max("published_date").alias("last_article_date"),
        F.min(rank).alias("best_source_rank"), F.coalesce(F.sum(F.lit(10.0) / rank), F.lit(0.0)).alias("editorial_score"),
    )


def centroid(vectors: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(event_id, embedding): mean of the first ``centroid_limit`` non-empty vectors by date, position by position.

    Which vectors count is settled on narrow rows. Each batch of them is summed to one vector per event before
    positions are shuffled.
    """
    some = vectors.filter(F.size("embedding") > 0)
    first = W.partitionBy("event_id").orderBy("published_date", "id")
    chosen = some.select("event_id", "id", "published_date").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= s.centroid_limit).select("event_id", "id")
    v = some.select("event_id", "id", F.col("embedding").cast("array<double>").alias("embedding")).join(chosen, ["event_id", "id"], "left_semi").select("event_id", "embedding")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict = {}
            for event, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = x.values.to_numpy(zero_copy_only=False)
                old = by.get((event, len(x)))
                by[event, len(x)] = (x.copy(), 1) if old is None else (np.add(old[0], x, out=old[0]), old[1] + 1)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in by], batch.schema.field(0).type), pa.array([t.tolist() for t, _ in by.values()], pa.list_(pa.float64())), pa.array([n for _, n in by.values()], pa.int64())], names=["event_id", "total", "n"])

    kind = vectors.schema["event_id"].dataType.simpleString()
    parts = v.mapInArrow(sums, f"event_id {kind}, total array<double>, n long")
    cells = parts.select("event_id", "n", F.posexplode("total").alias("pos", "x")).groupBy("event_id", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    return cells.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("embedding"))


def interest_counts(articles: DataFrame) -> DataFrame:
    """(event_id, category, entity, n) from ``interests``, a map of category to entities."""
    pairs = articles.select("event_id", F.explode("interests").alias("category", "names"))
    return pairs.select("event_id", "category", F.explode("names").alias("entity")).groupBy("event_id", "category", "entity").agg(F.count("*").alias("n"))


def topic_counts(articles: DataFrame) -> DataFrame:
    """(event_id, topic, n)."""
    return articles.select("event_id", F.explode("main_topics").alias("topic")).groupBy("event_id", "topic").agg(F.count("*").alias("n"))


def bias_sets(articles: DataFrame) -> DataFrame:
    """(event_id, bias, newspaper_ids sorted)."""
    return articles.filter("bias is not null").groupBy("event_id", "bias").agg(F.sort_array(F.collect_set("newspaper_id")).alias("newspaper_ids"))


def ownership_counts(articles: DataFrame) -> DataFrame:
    return articles.filter("ownership_type is not null").groupBy("event_id", "ownership_type").agg(F.count("*").alias("n"))


def stance_bucket(stance: Column, s: Settings = DEFAULTS) -> Column:
    """P5: critical, supportive or neutral; both edges belong to the outer buckets."""
    return F.when(stance <= -s.stance_edge, "critical").when(stance >= s.stance_edge, "supportive").when(stance.isNotNull(), "neutral")


def stance_by_bias(articles: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(event_id, bias, critical, supportive, neutral, total): counts and the mean stance."""
    b = stance_bucket(F.col("stance"), s)
    counts = [F.count_if(b == k).alias(k) for k in ("critical", "supportive", "neutral")]
    return articles.filter("stance is not null and bias is not null").groupBy("event_id", "bias").agg(*counts, F.avg("stance").alias("total"))


def global_stance(by_bias: DataFrame) -> DataFrame:
    """The unweighted mean of the means per bias."""
    return by_bias.groupBy("event_id").agg(F.avg("total").alias("stance"))


def clickbait_by_bias(articles: DataFrame) -> DataFrame:
    """Mean click-bait score per bias."""
    return articles.filter("clickbait_score is not null and bias is not null").groupBy("event_id", "bias").agg(F.avg("clickbait_score").alias("clickbait"))


def articles_by_bias(articles: DataFrame) -> DataFrame:
    """G8."""
    return articles.filter("bias is not null").groupBy("event_id", "bias").agg(F.count("*").alias("n"))


def sources_snapshot(articles: DataFrame) -> DataFrame:
    """(event_id, newspaper, newspaper_id, bias) of the newest article of each source."""
    newest = F.max_by(F.struct("newspaper_id", "bias"), F.struct("published_date", "id")).alias("v")
    return articles.groupBy("event_id", "newspaper").agg(newest).select("event_id", "newspaper", "v.newspaper_id", "v.bias")


def merge_counts(a: Column, b: Column) -> Column:
    """Sums of two maps of counts."""
    zero = F.lit(0).cast("long")
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,bigint>")), F.coalesce(b, F.create_map().cast("map<string,bigint>")), lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def merge_means(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """The mean of two means by their counts; null counts as absent."""
    wa, wb = F.when(a.isNotNull(), na).otherwise(0), F.when(b.isNotNull(), nb).otherwise(0)
    return (F.coalesce(a, F.lit(0.0)) * wa + F.coalesce(b, F.lit(0.0)) * wb) / F.nullif(wa + wb, F.lit(0))


def merge_events(pairs: DataFrame) -> DataFrame:
    """G10 over rows of (survivor, victim) structs with the additive statistics; the centroid stays the survivor's."""
    s, v = (lambda f: F.col(f"survivor.{f}")), (lambda f: F.col(f"victim.{f}"))
    return pairs.select(
        s("event_id").alias("event_id"), (s("article_count") + v("article_count")).alias("article_count"),
        F.least(s("first_article_date"), v("first_article_date")).alias("first_article_date"), F.greatest(s("last_article_date"), v("last_article_date")).alias("last_article_date"),
        F.least(s("best_source_rank"), v("best_source_rank")).alias("best_source_rank"), (s("editorial_score") + v("editorial_score")).alias("editorial_score"),
    )


def _zipped(a: Column, b: Column, kind: str, both) -> Column:
    """Two maps of one type united; ``both`` gives the value of a key from its two values, either of which may be null."""
    none = F.create_map().cast(kind)
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), both)


def _stance_n(x: Column) -> Column:
    return F.coalesce(x["critical"] + x["supportive"] + x["neutral"], F.lit(0).cast("long"))


STANCE = "struct<critical:bigint,supportive:bigint,neutral:bigint,total:double>"
#: Columns of an event's statistics whose counts per key add up.
SUMMED = ("main_topic_counts", "ownership_stats", "article_counts_by_bias")


def merge_statistics(pairs: DataFrame) -> DataFrame:
    """G10 whole: one row per (survivor, victim) of structs with all of an event's statistics, as columns of the result.

    Beyond merge_events: SUMMED maps add up, interest_counts per category; stances per bias are means weighted by
    their counts, which add up, and the global one by all of them; click-bait means are weighted by the stance counts
    from before the merge; bias_distribution and publisher_insights are united; of sources_snapshot the victim's wins.
    """
    s, v = F.col("survivor"), F.col("victim")
    counts = "map<string,bigint>"
    stance = "stance_distribution"

    def weighted(x: Column, n: Column, y: Column, m: Column) -> Column:
        return F.coalesce((F.coalesce(x, F.lit(0.0)) * n + F.coalesce(y, F.lit(0.0)) * m) / F.nullif(n + m, F.lit(0).cast("long")), x, y)

    def stances(_, x: Column, y: Column) -> Column:
        n, m = _stance_n(x), _stance_n(y)
        part = lambda f: (F.coalesce(x[f], F.lit(0).cast("long")) + F.coalesce(y[f], F.lit(0).cast("long"))).alias(f)
        return F.struct(part("critical"), part("supportive"), part("neutral"), weighted(x["total"], n, y["total"], m).alias("total"))

    all_n = lambda e: F.aggregate(F.map_values(F.coalesce(e[stance], F.create_map().cast(f"map<string,{STANCE}>"))), F.lit(0).cast("long"), lambda acc, x: acc + _stance_n(x))
    bias_n = lambda e, k: F.coalesce(_stance_n(F.try_element_at(e[stance], k)), F.lit(0).cast("long"))
    extra = [merge_counts(s[c], v[c]).alias(c) for c in SUMMED]
    extra += [
        _zipped(s["interest_counts"], v["interest_counts"], f"map<string,{counts}>", lambda k, x, y: merge_counts(x, y)).alias("interest_counts"),
        _zipped(s[stance], v[stance], f"map<string,{STANCE}>", stances).alias(stance),
        weighted(s["stance"], all_n(s), v["stance"], all_n(v)).alias("stance"),
        _zipped(s["clickbait_distribution"], v["clickbait_distribution"], "map<string,double>", lambda k, x, y: F.when(x.isNull() | y.isNull(), F.coalesce(x, y)).otherwise(weighted(x, bias_n(s, k), y, bias_n(v, k)))).alias("clickbait_distribution"),
        _zipped(s["bias_distribution"], v["bias_distribution"], "map<string,array<string>>", lambda k, x, y: F.array_sort(F.array_union(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))))).alias("bias_distribution"),
        _zipped(s["sources_snapshot"], v["sources_snapshot"], "map<string,string>", lambda k, x, y: F.coalesce(y, x)).alias("sources_snapshot"),
        F.array_sort(F.array_union(F.coalesce(s["publisher_insights"], F.array().cast("array<string>")), F.coalesce(v["publisher_insights"], F.array().cast("array<string>")))).alias("publisher_insights"),
    ]
    added = merge_events(pairs).columns
    least = {"first_article_date": F.least, "best_source_rank": F.least, "last_article_date": F.greatest}
    base = [s["event_id"].alias("event_id")] + [(least[c](s[c], v[c]) if c in least else F.coalesce(s[c], F.lit(0)) + F.coalesce(v[c], F.lit(0))).alias(c) for c in added if c != "event_id"]
    return pairs.select(*base, *extra)


def as_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(event_id, name): a map of key to value from (event_id, key, value) rows whose keys differ."""
    return rows.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))).alias(name))


def statistics(articles: DataFrame) -> DataFrame:
    """All statistics of each event's articles (G1, G3-G9) in one row, as merge_statistics wants them.

    ``articles``: event_id, id, published_date, source_rank, interests, main_topics, newspaper, newspaper_id, bias,
    ownership_type, stance, clickbait_score. What an event has none of is null.
    """
    out = basics(articles)
    stances = stance_by_bias(articles)
    whole = stances.select("event_id", "bias", F.struct("critical", "supportive", "neutral", "total").alias("v"))
    places = as_map(interest_counts(articles).withColumn("event_id", F.struct("event_id", "category")), "entity", "n", "v").select("event_id.event_id", "event_id.category", "v")
    ids = bias_sets(articles).select("event_id", "bias", F.array_sort(F.transform("newspaper_ids", lambda x: x.cast("string"))).alias("v"))
    snapshot = sources_snapshot(articles).filter("newspaper is not null").select("event_id", "newspaper", F.coalesce("bias", F.lit("")).alias("v"))
    parts = [
        as_map(topic_counts(articles), "topic", "n", "main_topic_counts"), as_map(ownership_counts(articles), "ownership_type", "n", "ownership_stats"), as_map(articles_by_bias(articles), "bias", "n", "article_counts_by_bias"),
        as_map(places, "category", "v", "interest_counts"), as_map(whole, "bias", "v", "stance_distribution"), global_stance(stances), as_map(clickbait_by_bias(articles), "bias", "clickbait", "clickbait_distribution"),
        as_map(ids, "bias", "v", "bias_distribution"), as_map(snapshot, "newspaper", "v", "sources_snapshot"),
    ]
    for p in parts:
        out = out.join(p, "event_id", "left")
    return out


def backfill(events: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """``events`` whose map column ``name`` is null or empty take that of ``values`` (event_id, name)."""
    v = values.select(F.col("event_id").alias("id"), F.col(name).alias("_new"))
    missing = F.col(name).isNull() | (F.size(name) == 0)
    return events.join(v, "id", "left").withColumn(name, F.when(missing & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(name))).select(*events.columns)


def flat_entities(groups: Column) -> Column:
    """The distinct names of a map of category to names, sorted; null and empty maps have none."""
    return F.array_sort(F.array_distinct(F.flatten(F.map_values(F.coalesce(groups, F.create_map().cast("map<string,array<string>>"))))))


def full_recalculation(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Every event with the roll-up of its articles, title of the earliest one; without articles it is inactive."""
    by = basics(articles)
    title = articles.groupBy("event_id").agg(F.min_by("title", F.struct("published_date", "id")).alias("title"), F.avg("stance").alias("plain_stance"))
    out = events.select(F.col("id").alias("event_id"), "is_active").join(by, "event_id", "left").join(title, "event_id", "left")
    return out.withColumn("is_active", F.coalesce(F.col("article_count") > 0, F.lit(False)) & F.col("is_active")).withColumn("article_count", F.coalesce("article_count", F.lit(0).cast("long")))

"""Queries of the news-event operators over the test tables, each beside its DuckDB SQL; ``QUERIES`` has those of all modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.config import DEFAULTS
from tidewire.functions import text as tx
from tidewire.functions.vectors import cosine_distance
from tidewire.operators import analytics as an
from tidewire.operators import decisions as de
from tidewire.operators import desk as dk
from tidewire.operators import filters as fi
from tidewire.operators import queues as qu
from tidewire.operators import rollup as ru
from tidewire.operators import score as sc
from tidewire.operators import search as se
from tidewire.operators import split as sp
from tidewire.plans.base import AB, ORACLE_SQL, QUERIES, T, outlet_articles, query
from tidewire.sources import entities as en
from tidewire.sources import harvest as ha
from tidewire.streaming import streams as st

@query("s1_scan_s2_pruned", "select doc_id, lang, n_chars from documents")
def _(s, d):
    return en.table(s, d, "documents").select("doc_id", "lang", "n_chars")


@query("s3_serialised_events", "select id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, lower(status) as status, is_active from evs", "events")
def _(s, d):
    return en.events(s, d).drop("centroid").select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lower("status").alias("status"), "is_active")


@query("s7_newest_sitemap", "select 'id' as kind, l_suppkey as feed_id, 'https://x.test/sitemap-' || max(l_orderkey) || '.xml' as loc from lineitem group by 2 union all select 'date', l_suppkey, 'https://x.test/map-' || max(strftime(l_shipdate, '%Y-%m-%d')) || '.xml' from lineitem group by 2 union all select 'pair', l_suppkey, arg_max('https://x.test/' || l_orderkey || '-' || l_linenumber || '.xml', (l_linenumber, l_orderkey)) from lineitem group by 2")
def _(s, d):
    x = en.table(s, d, "lineitem")
    loc = lambda *parts: x.select(F.col("l_suppkey").alias("feed_id"), F.concat(F.lit("https://x.test/"), *parts, F.lit(".xml")).alias("loc"))
    number = lambda c: F.col(c).cast("string")
    kinds = {
        "id": ha.newest_sitemap(loc(F.lit("sitemap-"), number("l_orderkey")), r"sitemap-(\d+)\.xml"),
        "date": ha.newest_sitemap(loc(F.lit("map-"), F.date_format("l_shipdate", "yyyy-MM-dd")), r"map-([\d-]+)\.xml", "date"),
        "pair": ha.newest_sitemap(loc(number("l_orderkey"), F.lit("-"), number("l_linenumber")), r"/(\d+)-(\d+)\.xml", "pair"),
    }
    one, two, three = (df.select(F.lit(k).alias("kind"), "feed_id", "loc") for k, df in kinds.items())
    return one.unionByName(two).unionByName(three)


@query("s6_page_links_w6")
def _(s, d):
    pages = en.table(s, d, "pages")
    known = pages.select(tx.url_hash(F.col("url")).alias("url_hash"))
    return ha.new_links(ha.page_links(pages), known, "login|signup|/tag/")


@query("s12_source_catalogue_a27", "select name, count(*) as articles, max(published_date) as newest from articles join newspapers on newspaper = name group by 1", "newspapers articles")
def _(s, d):
    return outlet_articles(s, d).groupBy(F.col("newspaper").alias("name")).agg(F.count("*").alias("articles"), F.max("published_date").alias("newest"))


@query("s14_seed_upsert_k3", "select o_custkey as key, max(o_orderkey) as version, arg_max(o_orderpriority, o_orderkey) as value from orders group by 1")
def _(s, d):
    o = en.table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("value"))
    return qu.upsert(o.filter("version % 2 = 0"), o.filter("version % 2 = 1"), ["key"], "version")


@query("k1_insert_new_k2", "select article_id, min(id) as id from aq where id % 3 = 0 group by 1 union all select article_id, min(id) as id from aq where id % 3 = 1 and article_id not in (select article_id from aq where id % 3 = 0) group by 1", "queue")
def _(s, d):
    q = en.articles_queue(s, d).select("article_id", "id")
    state = q.filter("id % 3 = 0").groupBy("article_id").agg(F.min("id").alias("id"))
    return qu.insert_new(state, q.filter("id % 3 = 1"), ["article_id"])


@query("k10_audit_changes", f"select id, 'UPDATE' as action, 'status' as \"column\", 'PUBLISHED' as old, 'ARCHIVED' as new from evs where status = 'PUBLISHED' and is_active and ((created_at < {T} - interval 7 day and hot_score < 50) or created_at < {T} - interval 14 day)", "events")
def _(s, d):
    e = en.events(s, d).drop("centroid")
    return qu.changes(e, qu.archive(e, en.as_of()), "id")


@query("f1_dynamic_filter", "select id, status, hot_score from evs where status in ('PUBLISHED', 'DRAFT') and hot_score >= 20 and hot_score < 90 and status ilike '%publ%'", "events")
def _(s, d):
    return fi.apply_filters(en.events(s, d), {"status__in": ["PUBLISHED", "DRAFT"], "hot_score__gte": 20, "hot_score__lt": 90, "status__ilike": "publ", "nothing__eq": 1, "label": None}).select("id", "status", "hot_score")


@query("f2_relation_filter", "select a.id, a.newspaper, n.bias from articles a join newspapers n on n.name = a.newspaper where n.bias like '%left%' and a.clickbait_score > 0.5", "articles newspapers")
def _(s, d):
    rel = {"outlet": fi.Relation(en.newspapers(s, d), "newspaper", "name")}
    return fi.apply_filters(en.articles(s, d), {"outlet__bias__like": "left", "clickbait_score__gt": 0.5}, rel).select("id", "newspaper", F.col("outlet__bias").alias("bias"))


@query("f3_order_page_t2_t3", "select id, hot_score, count(*) over () as total from evs where is_active order by hot_score desc, id limit 10 offset 20", "events")
def _(s, d):
    return fi.paged(en.events(s, d).filter("is_active").select("id", "hot_score"), ["-hot_score", "unknown"], number=3, size=10).select("id", "hot_score", "total")


@query("f5_text_filter", "select id, newspaper from articles where (title ilike '%the%' or content ilike '%the%') and published_date >= timestamp '2024-01-10'", "articles")
def _(s, d):
    return fi.search_text(en.articles(s, d).filter("published_date >= timestamp_ntz'2024-01-10 00:00:00'"), "the", ["title", "content"]).select("id", "newspaper")


@query("f7_blocklist_f8", "select page_id, url from pages where not regexp_matches(url, '(?i)ref=|#top') and regexp_matches(url, '/(en|fr)/')")
def _(s, d):
    return en.table(s, d, "pages").filter(~F.col("url").rlike("(?i)ref=|#top") & F.col("url").rlike("/(en|fr)/")).select("page_id", "url")


@query("f9_recent_links", f"select id from aq where created_at >= {T} - interval 100 hour or id % 7 = 0", "queue")
def _(s, d):
    q = en.articles_queue(s, d).withColumn("date", F.when(F.col("id") % 7 == 0, "no date").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")))
    return q.filter(ha.recent_or_undated(F.col("date"), en.as_of())).select("id")


@query("f10_known_hashes", "select id, url_hash from articles where url_hash not in (select md5(cast(vec_id as varchar)) from embeddings where vec_id % 2 = 0)", "articles")
def _(s, d):
    known = en.events(s, d).filter("id % 2 = 0").select(F.md5(F.col("id").cast("string")).alias("url_hash"))
    return en.articles(s, d).select("id", "url_hash").join(known, "url_hash", "left_anti").select("id", "url_hash")


#: Messages with each sign, and some that only resemble one.
_MESSAGES = ("got http 403", "HTTP 429!", "x HTTP 503", "access DENIED", "Cloudflare", "solve captcha", "Forbidden", "too many requests", "it was blocked", "403 rows", "error 429", "HTTP 500", "robot", "forbid", "captch", "ok")


@query("f11_block_signatures_a17", f", b as (select article_id, {list(_MESSAGES)}[(id % {len(_MESSAGES)} + 1)::int] as msg from aq) select newspaper, msg, count(*) as n, sum(count(*)) over (partition by newspaper)::bigint as source_total from b join articles on b.article_id = articles.id where msg ilike '%http 403%' or msg ilike '%http 429%' or msg ilike '%http 503%' or msg ilike '%access denied%' or msg ilike '%cloudflare%' or msg ilike '%captcha%' or msg ilike '%forbidden%' or msg ilike '%too many requests%' or msg ilike '%blocked%' group by 1, 2", "queue articles")
def _(s, d):
    q = en.articles_queue(s, d).withColumn("msg", en.pick(_MESSAGES, F.col("id")))
    return an.blocked_by_source(q, en.articles(s, d), tx.looks_blocked(F.col("msg")))


@query("f12_json_keys", "select event_id, cast(props->>'k' as bigint) as k from events where json_exists(props, '$.k') and cast(props->>'k' as bigint) > 50")
def _(s, d):
    e = en.table(s, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.filter(F.map_contains_key("m", "k")).select("event_id", F.col("m")["k"].alias("k")).filter("k > 50")


@query("f15_untitled", "select id from articles where lower(title) in ('no title', 'unknown', '') or id % 10 = 0", "articles")
def _(s, d):
    a = en.articles(s, d).withColumn("title", F.when(F.col("id") % 10 == 0, "No Title").otherwise(F.col("title")))
    return a.filter(qu.untitled(F.col("title"))).select("id")


@query("f16_title_filter_f17_x4", f"select id, case when published_date < {T} - interval 7 day then 'IGNORED' when title = '' then 'FAILED' else 'KEEP' end as decision, case when length(content) < 50 or content is null then 'FAILED' when id % 5 = 0 then 'COMPLETED' when published_date < {T} - interval 7 day then 'IGNORED' when id % 7 = 0 then 'FAILED' else 'ANALYSE' end as analysis from articles", "articles")
def _(s, d):
    a = en.articles(s, d).withColumn("summary_status", F.when(F.col("id") % 5 == 0, "COMPLETED"))
    known = F.when((F.col("id") % 7 != 0) | (F.col("published_date") < qu.ago(en.as_of(), days=7)), F.col("published_date"))
    return a.select("id", qu.title_decision(F.col("title"), F.col("published_date"), en.as_of()).alias("decision"), qu.analysis_decision(F.col("content"), F.col("summary_status"), known, en.as_of()).alias("analysis"))


@query("f18_binary_urls", "select page_id, regexp_matches(lower(split_part(url || kind, '?', 1)), '\\.(pdf|jpg|png|gif|mp4|zip|exe)$') as is_binary, md5(split_part(url || kind, '?', 1)) as url_hash, coalesce(regexp_matches(lower(left(html, 1000)), 'cloudflare|access denied|403 forbidden|captcha'), false) as is_firewall from (select *, case when page_id % 3 = 0 then ['.PDF', '.exe?x', '.doc', '.jpeg', '.mp4'][(page_id // 3) % 5 + 1] else '' end as kind from (select page_id, url, case when page_id % 4 = 0 then ['Access Denied', 'CAPTCHA', '403', repeat('x', 999) || 'captcha'][(page_id // 4) % 4 + 1] else html end as html from pages))")
def _(s, d):
    third, fourth = F.floor(F.col("page_id") / 3), F.floor(F.col("page_id") / 4)
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, en.pick((".PDF", ".exe?x", ".doc", ".jpeg", ".mp4"), third)).otherwise(""))
    html = F.when(F.col("page_id") % 4 == 0, en.pick(("Access Denied", "CAPTCHA", "403", "x" * 999 + "captcha"), fourth)).otherwise(F.col("html"))
    return en.table(s, d, "pages").select("page_id", tx.is_binary_url(url).alias("is_binary"), tx.url_hash(url).alias("url_hash"), tx.is_firewall_page(html).alias("is_firewall"))


@query("p1_labels_p4", "select id, case when m is null then 'offline' when m > 60 then 'critical' when m > 15 then 'warning' else 'healthy' end as heartbeat, case when n = 0 then 'SILENT' when n < 5 then 'LOW' else 'OK' end as volume, case when n > 5 then 'Topic/Niche' else 'Low Volume' end as waiting from (select id, article_count as n, nullif(id % 90, 0) as m from evs)", "events")
def _(s, d):
    n, m = F.col("article_count"), F.nullif(F.col("id") % 90, F.lit(0))
    return en.events(s, d).select("id", an.heartbeat(m).alias("heartbeat"), an.volume_status(n).alias("volume"), an.waiting_reason(n).alias("waiting"))


@query("p5_stance_buckets", "select id, case when stance <= -0.35 then 'critical' when stance >= 0.35 then 'supportive' when stance is not null then 'neutral' end as bucket from articles", "articles")
def _(s, d):
    return en.articles(s, d).select("id", ru.stance_bucket(F.col("stance")).alias("bucket"))


@query("p6_tri_bias", f", {AB}, c as (select event_id, count(*) filter (bias = 'left') as l, count(*) filter (bias = 'leans_left') as ll, count(*) filter (bias = 'far_left') as fl from ab group by 1) select event_id, coalesce(nullif(l, 0), nullif(ll, 0), fl) as first_left, l + ll + fl as all_left from c", "articles newspapers")
def _(s, d):
    p = an.pivot_counts(outlet_articles(s, d), "event_id", "bias", ["left", "leans_left", "far_left"])
    return p.select("event_id", an.first_non_zero(F.col("left"), F.col("leans_left"), F.col("far_left")).alias("first_left"), (F.col("left") + F.col("leans_left") + F.col("far_left")).alias("all_left"))


@query("j1_articles_per_bias_a1", "select bias, count(*) as n from articles join newspapers on newspaper = name group by 1", "articles newspapers")
def _(s, d):
    return an.count_by(outlet_articles(s, d), "bias")


@query("j2_source_health_j3_a16_p2", f", h as (select name, max(published_date) as last_seen, count(*) filter (published_date >= {T} - interval 24 hour) as recent from newspapers left join articles on newspaper = name group by 1) select name, last_seen, recent, coalesce(floor((epoch({T}) - epoch(last_seen)) / 3600.0 * 60), 999999)::bigint as minutes, case when last_seen is null then 'DEAD' when (epoch({T}) - epoch(last_seen)) / 3600.0 > 24 then 'SILENT' when (epoch({T}) - epoch(last_seen)) / 3600.0 > 3 then 'WARNING' else 'OK' end as status from h", "articles newspapers")
def _(s, d):
    return an.source_health(en.newspapers(s, d), en.articles(s, d), en.as_of())


@query("j4_full_join_ranks", "select coalesce(a.id, b.id) as id, a.ra, b.rb from (select id, row_number() over (order by hot_score desc, id) as ra from evs qualify ra <= 50) a full join (select id, row_number() over (order by created_at desc, id) as rb from evs qualify rb <= 50) b on a.id = b.id", "events")
def _(s, d):
    e = en.events(s, d)
    return an.in_either(an.ranked(e, "ra", 50, F.desc("hot_score"), F.col("id")), an.ranked(e, "rb", 50, F.desc("created_at"), F.col("id")))


@query("j6_not_exists_or", "select id from evs where not exists (select 1 from pr where pr.status = 'PENDING' and (pr.source_id = evs.id or pr.target_id = evs.id))", "events proposals")
def _(s, d):
    busy = en.proposals(s, d).filter("status = 'PENDING'").select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return en.events(s, d).select("id").join(busy, "id", "left_anti")


@query("j8_semi_join", "select id, title from articles where event_id in (select label from evs where status = 'PUBLISHED' and hot_score > 95)", "articles events")
def _(s, d):
    hot = en.events(s, d).filter("status = 'PUBLISHED' and hot_score > 95").select(F.col("label").alias("event_id"))
    return en.articles(s, d).join(hot, "event_id", "left_semi").select("id", "title")


@query("j9_review_pick_r13_w3", ", busy as (select source_id as k from pr where status = 'PROCESSING' union select target_id from pr where status = 'PROCESSING'), f as (select *, dense_rank() over (order by source_id) as group_no from pr where status = 'PENDING' and source_id not in (select k from busy) and target_id not in (select k from busy)) select source_id, target_id, group_no from f where group_no <= 10", "proposals")
def _(s, d):
    return de.review_pick(en.proposals(s, d)).select("source_id", "target_id", F.col("group_no").cast("long").alias("group_no"))


@query("j10_latest_ticket_w4_q10", "select id, article_id, row_number() over (partition by article_id order by created_at desc, id desc) > 1 as superseded from aq where status = 'PENDING'", "queue")
def _(s, d):
    return qu.latest_ticket(en.articles_queue(s, d), "article_id").select("id", "article_id", "superseded")


@query("j12_lateral_json", "select cast(props->>'k' as bigint) as k, count(*) as n from events group by 1")
def _(s, d):
    return an.count_by(an.entries(en.table(s, d, "events").select("props"), "props").select(F.col("value").alias("k")), "k")


@query("j13_nearest_neighbour_r2", "select a.id, arg_min(b.id, (round(list_cosine_distance(a.centroid, b.centroid), 9), b.id)) as nearest, round(min(list_cosine_distance(a.centroid, b.centroid)), 5) as distance from evs a join evs b on a.id <> b.id where a.id % 20 = 0 group by 1", "events")
def _(s, d):
    e = en.events(s, d).select("id", "centroid")
    return se.nearest(e.filter("id % 20 = 0"), e).withColumn("distance", F.round("distance", 5))


@query("j14_time_window_join", "select a.id as article_id, e.id as event_id from articles a join evs e on e.created_at between a.published_date - interval 5 day and a.published_date", "articles events")
def _(s, d):
    q = en.articles(s, d).select(F.col("id").alias("qid"), F.col("published_date").alias("target"))
    return se.candidates_by_day(q, en.events(s, d).select("id", "created_at"), 5).select(F.col("qid").alias("article_id"), F.col("id").alias("event_id"))


@query("j15_survivors", "select vec_id as id, vec_id - vec_id % 4 as survivor from embeddings")
def _(s, d):
    e = en.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 != 0, F.col("vec_id") - 1).alias("merged_into_id"))
    return de.resolve_survivors(e)


@query("j17_entity_overlap", "select source_id, target_id, (source_id % 3 = target_id % 3 or source_id % 5 = target_id % 5) as overlap from pr", "proposals")
def _(s, d):
    names = lambda c: F.array(F.concat(F.lit("a"), (F.col(c) % 3).cast("string")), F.concat(F.lit("b"), (F.col(c) % 5).cast("string")))
    return en.proposals(s, d).select("source_id", "target_id", F.arrays_overlap(names("source_id"), names("target_id")).alias("overlap"))


@query("a2_top_sources", "select newspaper, count(*) as n from articles group by 1 order by n desc, newspaper limit 5", "articles")
def _(s, d):
    return an.top_by(en.articles(s, d), ["newspaper"], 5)


@query("a3_totals", "select count(*) as total, count(*) filter (is_active) as part, round(count(*) filter (is_active) * 100.0 / count(*), 2) as percent from evs", "events")
def _(s, d):
    return an.totals(en.events(s, d), F.col("is_active"))


@query("a4_latest_ingestion", f"select max(created_at) as latest, ((epoch({T}) - epoch(max(created_at))) / 60)::bigint as minutes_ago from evs", "events")
def _(s, d):
    g = en.events(s, d).agg(F.max("created_at").alias("latest"))
    return g.select("latest", ((F.unix_seconds(en.as_of().cast("timestamp")) - F.unix_seconds(F.col("latest").cast("timestamp"))) / 60).cast("long").alias("minutes_ago"))


@query("a6_top_topics_g4", "select topic, count(*) as n from (select lang as topic from articles union all select newspaper from articles) group by 1 order by n desc, topic limit 10", "articles")
def _(s, d):
    return ru.topic_counts(en.articles(s, d)).groupBy("topic").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query("a7_daily_by_source", "select published_date::date as day, newspaper, count(*) as n from articles group by 1, 2", "articles")
def _(s, d):
    return en.articles(s, d).groupBy(F.to_date("published_date").alias("day"), "newspaper").agg(F.count("*").alias("n"))


@query("a8_six_hour_grid_x6", "select time_bucket(interval '6 hours', published_date, timestamp '1970-01-01') as slot, newspaper, count(*) as n, strftime(time_bucket(interval '6 hours', published_date, timestamp '1970-01-01'), '%d %H:%M') as label from articles group by 1, 2", "articles")
def _(s, d):
    return an.time_grid(en.articles(s, d), "published_date", 21600, "newspaper")


@query("a9_daily_volumes_u1", "select 'articles' as kind, published_date::date as day, count(*) as n from articles group by 2 union all select 'events', created_at::date, count(*) from evs group by 2", "articles events")
def _(s, d):
    return an.union_counts([("articles", en.articles(s, d), "published_date"), ("events", en.events(s, d), "created_at")])


@query("a10_stance_histogram", "select b as bucket_no, count(*) as n, round(-1 + (b - 0.5) * 0.2, 4)::double as centre from (select case when stance < -1 then 0 when stance >= 1 then 11 else floor((stance + 1) / 2.0::double * 10)::bigint + 1 end as b from articles where stance is not null) group by 1", "articles")
def _(s, d):
    return an.histogram(en.articles(s, d), "stance", -1.0, 1.0, 10)


@query("a11_clickbait_histogram", "select b as bucket_no, count(*) as n, round((b - 0.5) * 12.5, 4)::double as centre from (select case when c >= 100 then 9 else floor(c / 100.0::double * 8)::bigint + 1 end as b from (select id % 101 as c from articles)) group by 1", "articles")
def _(s, d):
    return an.histogram(en.articles(s, d).withColumn("c", (F.col("id") % 101).cast("double")), "c", 0.0, 100.0, 8)


@query("a12_queue_history", "select hour, status, count(*) as n from (select date_trunc('hour', updated_at) as hour, status from aq where status in ('COMPLETED', 'FAILED') union all select date_trunc('hour', created_at), 'CREATED' from aq) group by 1, 2", "queue")
def _(s, d):
    return an.queue_history(en.articles_queue(s, d))


@query("a13_queue_overview", "select queue_name, status, count(*) as n from aq group by 1, 2", "queue")
def _(s, d):
    return an.count_by(en.articles_queue(s, d), "queue_name", "status")


@query("a14_queue_pivot", "select queue_name, count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'PROCESSING') as processing, count(*) filter (status = 'FAILED') as failed from aq group by 1", "queue")
def _(s, d):
    return an.pivot_counts(en.articles_queue(s, d), "queue_name", "status", ["PENDING", "PROCESSING", "FAILED"])


@query("a15_row_counts", "select 'articles' as name, count(*) as n from documents union all select 'events', count(*) from embeddings union all select 'queue', count(*) from events union all select 'pages', count(*) from pages")
def _(s, d):
    parts = [en.table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in (("articles", "documents"), ("events", "embeddings"), ("queue", "events"), ("pages", "pages"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("a18_eight_hour_slots", "select time_bucket(interval '8 hours', updated_at, timestamp '1970-01-01') as slot, count(*) as n from aq where status = 'COMPLETED' group by 1 order by 1 desc limit 20", "queue")
def _(s, d):
    return an.time_grid(en.articles_queue(s, d).filter("status = 'COMPLETED'"), "updated_at", 28800).drop("label").orderBy(F.desc("slot")).limit(20)


@query("a19_errors", "select newspaper, msg, count(*) as n from aq join articles on aq.article_id = articles.id where status = 'FAILED' group by 1, 2 order by n desc, newspaper, msg limit 50", "queue articles")
def _(s, d):
    q = en.articles_queue(s, d).filter("status = 'FAILED'").select("article_id", "msg").join(en.articles(s, d).select(F.col("id").alias("article_id"), "newspaper"), "article_id")
    return an.top_by(q, ["newspaper", "msg"], 50)


@query("a21_integrity", ", c as (select event_id, count(*) as n from articles group by 1) select count(*) filter (article_count > coalesce(n, 0)) as miscounted, count(*) filter (hot_score = 0 and article_count > 0) as unscored from evs left join c on evs.id = c.event_id", "articles events")
def _(s, d):
    return an.integrity(en.events(s, d), ru.articles_by_bias(outlet_articles(s, d)))


@query("a22_overview", "select count(*) filter (is_active) as active, count(*) filter (status = 'PUBLISHED') as published, count(*) filter (status = 'DRAFT') as draft, count(*) filter (status = 'ARCHIVED') as archived from evs", "events")
def _(s, d):
    c = lambda k: F.count_if(F.col("status") == k)
    return en.events(s, d).agg(F.count_if("is_active").alias("active"), c("PUBLISHED").alias("published"), c("DRAFT").alias("draft"), c("ARCHIVED").alias("archived"))


@query("a24_largest_event", ", e as (select event_id as id, count(*) as article_count from articles group by 1) select id, published_date from articles where event_id = (select id from e order by article_count desc, id limit 1) order by published_date desc, id limit 100", "articles")
def _(s, d):
    a = en.articles(s, d)
    return an.largest_with_latest(ru.basics(a).withColumnRenamed("event_id", "id"), a).select("id", "published_date")


@query("a25_links_per_outlet", "select name, count(id) as n from newspapers left join articles on newspaper = name and id % 2 = 0 group by 1", "newspapers articles")
def _(s, d):
    a = en.articles(s, d).filter("id % 2 = 0").select(F.col("newspaper").alias("name"), "id")
    return en.newspapers(s, d).join(a, "name", "left").groupBy("name").agg(F.count("id").alias("n"))


@query("a26_rate_utilisation_j5", "select o_orderpriority as model, round(sum(o_totalprice) * 100.0 / 1e9, 2) as percent from orders group by 1")
def _(s, d):
    o = en.table(s, d, "orders")
    usage = o.groupBy(F.upper("o_orderpriority").alias("model")).agg(F.sum("o_totalprice").alias("used")).withColumns({"metric": F.lit("TOKENS"), "started_at": en.as_of()})
    config = o.select(F.col("o_orderpriority").alias("model")).distinct().withColumns({"metric": F.lit("TOKENS"), "limit": F.lit(1e9), "window_seconds": F.lit(60)})
    return an.rate_utilisation(config, usage).select("model", "percent")


@query("g1_basics", "select event_id, count(*) as article_count, min(published_date) as first_article_date, max(published_date) as last_article_date, min(source_rank) as best_source_rank, round(sum(10.0::double / source_rank), 6) as editorial_score from articles group by 1", "articles")
def _(s, d):
    return ru.basics(en.articles(s, d)).withColumn("editorial_score", F.round("editorial_score", 6))


@query("g2_centroid", "select label::bigint as event_id, pos - 1 as pos, round(avg(x), 5) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as pos from (select * from embeddings qualify row_number() over (partition by label order by vec_id * 83 % 43200, vec_id) <= 500)) group by 1, 2")
def _(s, d):
    v = en.events(s, d).select(F.col("label").alias("event_id"), "id", F.col("created_at").alias("published_date"), F.col("centroid").alias("embedding"))
    return ru.centroid(v).select("event_id", F.posexplode("embedding").alias("pos", "x")).select("event_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("g3_interest_counts", "select event_id, 'place' as category, lang as entity, count(*) as n from articles group by 1, 3 union all select event_id, 'org', newspaper, count(*) from articles group by 1, 3", "articles")
def _(s, d):
    a = en.articles(s, d).withColumn("interests", F.create_map(F.lit("place"), F.array("lang"), F.lit("org"), F.array("newspaper")))
    return ru.interest_counts(a)


@query("g5_bias_sets_g8", f", {AB} select event_id, bias, string_agg(distinct newspaper_id::varchar, ',' order by newspaper_id::varchar) as ids, count(*) as n from ab group by 1, 2", "articles newspapers")
def _(s, d):
    a = outlet_articles(s, d)
    ids = ru.bias_sets(a).select("event_id", "bias", F.array_join(F.array_sort(F.transform("newspaper_ids", lambda x: x.cast("string"))), ",").alias("ids"))
    return ids.join(ru.articles_by_bias(a), ["event_id", "bias"])


@query("g5_ownership", f", {AB} select event_id, ownership_type, count(*) as n from ab group by 1, 2", "articles newspapers")
def _(s, d):
    return ru.ownership_counts(outlet_articles(s, d))


@query("g6_stance_by_bias", f", {AB} select event_id, bias, count(*) filter (stance <= -0.35) as critical, count(*) filter (stance >= 0.35) as supportive, count(*) filter (stance > -0.35 and stance < 0.35) as neutral, round(avg(stance), 6) as total from ab where stance is not null group by 1, 2", "articles newspapers")
def _(s, d):
    return ru.stance_by_bias(outlet_articles(s, d)).withColumn("total", F.round("total", 6))


@query("g6_global_stance", f", {AB} select event_id, round(avg(m), 6) as stance from (select event_id, bias, avg(stance) as m from ab where stance is not null group by 1, 2) group by 1", "articles newspapers")
def _(s, d):
    return ru.global_stance(ru.stance_by_bias(outlet_articles(s, d))).withColumn("stance", F.round("stance", 6))


@query("g7_clickbait", f", {AB} select event_id, bias, round(avg(clickbait_score), 6) as clickbait from ab group by 1, 2", "articles newspapers")
def _(s, d):
    return ru.clickbait_by_bias(outlet_articles(s, d)).withColumn("clickbait", F.round("clickbait", 6))


@query("g9_sources_snapshot", f", {AB} select event_id, newspaper, max(newspaper_id) as newspaper_id, max(bias) as bias from ab group by 1, 2", "articles newspapers")
def _(s, d):
    return ru.sources_snapshot(outlet_articles(s, d))


@query("g10_merge", "select least(event_id, event_id - event_id % 2) as event_id, count(*) as article_count, min(published_date) as first_article_date, max(published_date) as last_article_date, min(source_rank) as best_source_rank, round(sum(10.0::double / source_rank), 6) as editorial_score from articles group by 1", "articles")
def _(s, d):
    b = ru.basics(en.articles(s, d))
    a = b.filter("event_id % 2 = 0").select(F.col("event_id").alias("k"), F.struct(*b.columns).alias("survivor"))
    v = b.filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("k"), F.struct(*b.columns).alias("victim"))
    return ru.merge_events(a.join(v, "k")).withColumn("editorial_score", F.round("editorial_score", 6))


@query("g12_recalculation_g11", "select e.label as event_id, count(a.id) as article_count, count(a.id) > 0 as is_active, round(avg(a.stance), 6) as plain_stance from (select distinct label from evs) e left join articles a on a.event_id = e.label group by 1", "articles events")
def _(s, d):
    e = en.events(s, d).select(F.col("label").alias("id")).distinct().withColumn("is_active", F.lit(True))
    return ru.full_recalculation(e, en.articles(s, d)).select("event_id", "article_count", "is_active", F.round("plain_stance", 6).alias("plain_stance"))


@query("g13_search_text", "select id, array_to_string(list_reverse(list_transform(list_filter(list_zip(list_reverse(w), range(1, len(w) + 1)), lambda p: not list_contains(list_reverse(w)[1:p[2] - 1], p[1])), lambda p: p[1])[1:100]), ' ') as search_text from (select id, string_split(title, ' ') as w from articles)", "articles")
def _(s, d):
    return en.articles(s, d).select("id", F.array_join(tx.last_unique_words(F.split("title", " ", -1)), " ").alias("search_text"))


@query("g14_search_query", "select id, title || ' ' || lang || ' ' || newspaper || ' ' || lang as q from articles", "articles")
def _(s, d):
    return en.articles(s, d).select("id", tx.search_query(F.col("title"), F.col("main_topics"), F.array("lang")).alias("q"))


@query("w5_first_per_event", "select id, event_id, rn > 1 as retired from (select id, event_id, row_number() over (partition by event_id order by published_date desc, id) as rn from articles)", "articles")
def _(s, d):
    return an.retired(en.articles(s, d), "event_id").select("id", "event_id", "retired")


@query("t1_nulls_first", "select id, source_rank from articles order by source_rank asc nulls first, id limit 40", "articles")
def _(s, d):
    return en.articles(s, d).select("id", "source_rank").orderBy(F.asc_nulls_first("source_rank"), "id").limit(40)


@query("t4_context_articles", "select event_id, string_agg(id::varchar, ',' order by rn) as ids from (select event_id, id, row_number() over (partition by event_id order by published_date desc, id) as rn from articles) where rn <= 3 group by 1", "articles")
def _(s, d):
    top = an.newest_per_key(en.articles(s, d), "event_id", 3)
    return top.select("event_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("u3_set_difference", "select id from evs where id not in (select event_id from articles)", "events articles")
def _(s, d):
    return an.without(en.events(s, d).select("id"), en.articles(s, d).select(F.col("event_id").alias("id")), "id")


_TOKS = "regexp_extract_all(lower(coalesce(d.text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_Q1 = f""", live as (select evs.*, {_TOKS} as toks from evs left join documents d on d.doc_id = evs.id where is_active),
q as (select evs.id as qid, centroid as v, created_at as t, list_distinct(list_filter([toks[3], toks[8]], lambda w: w is not null)) as words from (select evs.*, {_TOKS} as toks from evs left join documents d on d.doc_id = evs.id) evs where evs.id % 20 = 0),
n as (select qid, id, list_cosine_distance(centroid, v) as dist, row_number() over (partition by qid order by round(list_cosine_distance(centroid, v), 9), id) as r from q join live on created_at <= t and created_at >= t - interval 5 day qualify r <= 50),
w as (select qid, t, len(words) as n, unnest(words) as word from q), h as (select id, created_at, unnest(toks) as tok, generate_subscripts(toks, 1) as p from live),
m as (select qid, id, n, word, p from w join h on tok = word where created_at <= t and created_at >= t - interval 5 day),
k as (select qid, id, n from m group by 1, 2, 3 having count(distinct word) = n),
c as (select m.qid, m.id, m.n, m.p, (select list(word order by word) from w where w.qid = m.qid) as ws, m.word from m join k using (qid, id)),
l as (select qid, id, n, p, case when n = 1 then p else least(max(case when word = ws[1] then p end) over o, max(case when word = ws[2] then p end) over o) end as first, max(case when word = ws[1] then p end) over o as a, max(case when word = ws[2] then p end) over o as b from c window o as (partition by qid, id order by p)),
f as (select qid, id, n, first, min(p) as e from l where n = 1 or (a is not null and b is not null) group by 1, 2, 3, 4),
u as (select f.qid, f.id, f.first, f.e, 0.1::double / (1 + (f.e - f.first + 1) - count(*)) as part from f join l on l.qid = f.qid and l.id = f.id and l.p between f.first and f.e group by 1, 2, 3, 4),
x as (select qid, id, sum(part) as rank from u group by 1, 2),
y as (select qid, id, row_number() over (partition by qid order by round(rank, 9) desc, id) as r from x qualify r <= 50),
z as (select coalesce(n.qid, y.qid) as qid, coalesce(n.id, y.id) as id, n.r as nr, y.r as wr, dist from n full join y on n.qid = y.qid and n.id = y.id),
g as (select z.qid, z.id, (coalesce(1.0::double / (60 + nr), 0) + coalesce(1.0::double / (60 + wr), 0)) / (1 + 0.05::double * abs(epoch(t) - epoch(last_updated_at)) / 3600) as score, coalesce(dist, 1) as dist from z join live on live.id = z.id join q on q.qid = z.qid)
select qid, id, round(score, 6) as rrf_score, round(dist, 4) as distance from g qualify row_number() over (partition by qid order by round(score, 9) desc, id) <= 10"""


def _searched(s, d):
    """Events with the words of their document."""
    docs = en.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return en.events(s, d).join(docs, "id", "left").withColumn("toks", se.tokens(F.col("text"))).drop("text")


@query("r1_hybrid_search_w1_w2", _Q1, "events")
def hybrid(s, d):
    e = _searched(s, d)
    words = F.array_compact(F.array(F.get("toks", F.lit(2)), F.get("toks", F.lit(7))))
    q = e.filter("id % 20 = 0").select(F.col("id").alias("qid"), words.alias("words"), F.col("centroid").alias("vector"), F.col("created_at").alias("target"))
    return se.hybrid_search_many(q, e).select("qid", "id", F.round("rrf_score", 6).alias("rrf_score"), F.round("distance", 4).alias("distance"))


@query("r3_text_query", "select doc_id as id from (select doc_id, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as t from documents) where (list_contains(t, 'idiot') and not list_contains(t, 'les')) or list_contains(t, 'clown')")
def _(s, d):
    query = se.TextQuery.parse("idiot -les or clown")
    x = en.table(s, d, "documents").filter(query.may_match(F.col("text"))).select(F.col("doc_id").alias("id"), se.tokens(F.col("text")).alias("toks"))
    return se.text_search(x, query).select("id")


_R4 = ", x as (select evs.id, last_updated_at, " + _TOKS + " as t from evs join documents d on d.doc_id = evs.id), m as (select * from x where list_contains(t, 'idiot') or (list_contains(t, 'the') and len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' and t[i + 1] = 'the')) > 0)), r as (select id, 0.1::double * (len(list_filter(t, lambda w: w = 'idiot')) + len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' and t[i + 1] = 'the'))) as rank from m) select m.id, round(coalesce(rank, 0), 6) as text_rank from m left join r using (id)"


def _found(s, d, text: str):
    """Events whose document satisfies a query; texts that lack its words are told before they are joined and split."""
    query = se.TextQuery.parse(text)
    docs = en.table(s, d, "documents").filter(query.may_match(F.col("text"))).select(F.col("doc_id").alias("id"), "text")
    return se.text_search(en.events(s, d).join(docs, "id").withColumn("toks", se.tokens(F.col("text"))).drop("text"), query)


@query("r4_cover_density", _R4, "events")
def _(s, d):
    return _found(s, d, 'idiot or "of the"').select("id", F.round("text_rank", 6).alias("text_rank"))


@query("r5_ranked_page", _R4.replace("select m.id, round(coalesce(rank, 0), 6) as text_rank from m left join r using (id)", "select m.id, round(coalesce(rank, 0), 6) as text_rank from m left join r using (id) order by round(coalesce(rank, 0), 9) desc, last_updated_at desc, id limit 20 offset 20"), "events")
def _(s, d):
    return se.ranked_page(_found(s, d, 'idiot or "of the"'), 2, 20).select("id", F.round("text_rank", 6).alias("text_rank"))


@query("r28_duplicates")
def _(s, d):
    e = _searched(s, d)
    return se.find_duplicates(e, e.filter("id % 20 = 0")).select("qid", "id", F.round("rrf_score", 6).alias("rrf_score"))


_R6 = """, c as (select a.id as article_id, evs.id as event_id, ((evs.id * 13 + a.id) % 40) / 100.0::double as d, 1.0::double / (60 + evs.id) as rrf, last_updated_at as u, article_count as n, row_number() over (partition by a.id order by 1.0::double / (60 + evs.id) desc, evs.id) as rn from articles a join evs on evs.label = a.event_id),
t as (select article_id, list(struct_pack(e := event_id, d := d, rrf := rrf, u := u, n := n) order by rn) as c from c where rn <= 10 group by 1),
x as (select a.id as article_id, published_date as p, c, c[1] as b, c[2] as s from articles a left join t on t.article_id = a.id),
y as (select *, case when p < timestamp '2024-01-20' - interval 7 day then 'IGNORED' when article_id % 9 = 0 then 'ERROR' when b is null then 'NEW' when b.d > 0.18 then case when b.rrf > 0.05 then 'PROPOSE' else 'NEW' end
  when b.d > 0.05 and b.d < 0.18 then case when b.u > timestamp '2024-01-20' - interval 4 hour and b.n > 10 and b.d < 0.12 then 'MERGE' else 'PROPOSE' end when s is not null and s.d - b.d < 0.05 then 'PROPOSE_MULTI' else 'MERGE' end as decision from x)
select article_id, decision, case decision when 'PROPOSE_MULTI' then array_to_string(list_transform(list_filter(c[1:3], lambda z: z.d < 0.18), lambda z: z.e), ',') when 'MERGE' then b.e::varchar when 'PROPOSE' then b.e::varchar end as targets from y"""


def _r6_candidates(s, d):
    """The best events of each article's label; their rank depends on the event alone, so it is cut before articles meet them."""
    rrf = F.lit(1.0) / (60 + F.col("id"))
    best = W.partitionBy("label").orderBy(F.desc("rrf"), "id")
    e = en.events(s, d).select("id", "label", rrf.alias("rrf"), "last_updated_at", "article_count").withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= DEFAULTS.search_limit)
    a = en.articles(s, d).select(F.col("id").alias("article_id"), F.col("event_id").alias("label"))
    return a.join(e, "label").select("article_id", F.col("id").alias("event_id"), (((F.col("id") * 13 + F.col("article_id")) % 40) / F.lit(100.0)).alias("distance"), "rrf", "last_updated_at", "article_count")


@query("r6_cluster_decision", _R6, "articles events")
def _(s, d):
    a = en.articles(s, d).select(F.col("id").alias("article_id"), "published_date", (F.col("id") % 9 != 0).alias("has_vector"))
    return de.cluster_decision(a, _r6_candidates(s, d), F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("article_id", "decision", F.array_join(F.transform("targets", lambda t: t.cast("string")), ",").alias("targets"))


@query("r7_merge_decision", ", p as (select source_id as event_id, target_id as other_id, distance, 1.0::double / (60 + target_id - source_id) as rrf, ['PUBLISHED','DRAFT','ENHANCED','ARCHIVED'][source_id % 4 + 1] as status, ['PUBLISHED','DRAFT','ENHANCED','ARCHIVED'][target_id % 4 + 1] as other_status, case when source_id % 3 = 0 then [] else ['n' || source_id % 2, 'n' || source_id % 5] end as names, case when target_id % 5 = 0 then null else ['n' || target_id % 7] end as other_names from pr), x as (select *, case when distance < 0.05 then case when status = 'PUBLISHED' and other_status = 'PUBLISHED' then 'PROPOSE' else 'MERGE' end when distance < 0.13 or (distance < 0.21 and rrf > 0.02) then 'PROPOSE' end as action from p where distance >= 0.13 or case when len(names) = 0 or other_names is null then distance <= 0.08 else list_has_any(names, other_names) or rrf >= 0.02 end), r as (select *, row_number() over (partition by event_id order by rrf desc, other_id) as rn from x where action is not null) select event_id, other_id, action, case when action = 'MERGE' then case when status = 'PUBLISHED' and other_status <> 'PUBLISHED' then event_id else other_id end end as survivor from r where rn = 1", "proposals")
def _(s, d):
    st_ = lambda c: en.pick(("PUBLISHED", "DRAFT", "ENHANCED", "ARCHIVED"), F.col(c))
    name = lambda c, n: F.concat(F.lit("n"), (F.col(c) % n).cast("string"))
    names = F.when(F.col("source_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name("source_id", 2), name("source_id", 5)))
    other_names = F.when(F.col("target_id") % 5 != 0, F.array(name("target_id", 7)))
    p = en.proposals(s, d).select(F.col("source_id").alias("event_id"), F.col("target_id").alias("other_id"), "distance", (F.lit(1.0) / (60 + F.col("target_id") - F.col("source_id"))).alias("rrf"), st_("source_id").alias("status"), st_("target_id").alias("other_status"), names.alias("names"), other_names.alias("other_names"), F.lit(False).alias("blocked"))
    return de.merge_decision(p)


@query("r9_collision", ", p as (select source_id as event_id, target_id as other_id, distance, (target_id - source_id) * 9 as hours from pr where distance <= 0.15), n as (select event_id, arg_min(struct_pack(o := other_id, d := distance, h := hours), (distance, other_id)) as n from p group by 1) select event_id, n.o as other_id, case when n.d <= 0.05 and n.h <= 72 then 'AUTO' when n.h <= 24 then 'PROPOSE' end as action from n", "proposals")
def _(s, d):
    p = en.proposals(s, d).select(F.col("source_id").alias("event_id"), F.col("target_id").alias("other_id"), "distance", ((F.col("target_id") - F.col("source_id")) * 9).alias("hours"), F.lit(False).alias("known"))
    return de.collision_decision(p)


@query("r12_review", ", v as (select *, (source_id + target_id) % 3 = 0 as ok from pr), f as (select source_id, arg_min(target_id, (distance, target_id)) as accepted from v where ok group by 1) select v.source_id, target_id, accepted, case when accepted is null then 'NEW_EVENT' when target_id = accepted then 'APPROVED' else 'REJECTED' end as outcome from v left join f on v.source_id = f.source_id", "proposals")
def _(s, d):
    v = en.proposals(s, d).withColumn("same_event", (F.col("source_id") + F.col("target_id")) % 3 == 0).withColumn("confidence", F.lit(0.9))
    return de.review_decision(v).select("source_id", "target_id", "accepted", "outcome")


_R10 = f""", {AB}, g as (select event_id, sum(10.0::double / source_rank) as ed, count(*) as ac, min(published_date) as f, count(distinct newspaper) as n, avg(clickbait_score) as cb, count(*) filter (stance >= 0.35) as sup, count(*) filter (stance <= -0.35) as cri,
  count(distinct case when ownership_type = 'independent' then newspaper end) as ind, bool_or(bias in ('left', 'far_left', 'leans_left')) as prog, bool_or(bias in ('right', 'far_right', 'leans_right')) as cons, bool_or(bias in ('center', 'neutral', 'mainstream')) as cent from ab group by 1),
a as (select *, greatest(0, (epoch({T}) - epoch(f)) / 3600.0::double) as age, case when event_id = 0 then 10.0::double else event_id * 10.0::double end as raw from g),
b as (select *, case when event_id % 2 = 0 and raw < 70 then raw * 0.85::double else raw end as imp, case when ac >= 2 and prog and not cons and not cent then 'BS_RIGHT' when ac >= 2 and cons and not prog and not cent then 'BS_LEFT' when ac >= 2 and prog and cons and not cent then 'BS_CENTER' end as side from a),
c as (select *, (case when ed > 0 then 40 * ln(1 + ed) else 0 end + 100 * ln(1 + n::double) + case when age < 72 then 150 * pow(0.5::double, age / 3) else -0.1::double * age end) * 1.5::double
  * case when imp < 30 then 0.01::double + 0.09::double * imp / 30 when imp < 50 then 0.1::double + 0.7::double * (imp - 30) / 20 else 0.8::double + 2.2::double * (imp - 50) / 50 end / case when age > 6 then 1 + 0.05::double * pow(age - 6, 1.5::double) else 1 end
  * case when cb > 0.7 then 0.7::double else 1 end * case when sup > 1 and cri > 1 then 1.15::double else 1 end * case when ind >= 2 then 1.1::double else 1 end * case when prog and cons then 1.25::double else 1 end * case when cent then 1.1::double else 1 end
  * case when prog and cons and cent then 1.3::double else 1 end * case when side is not null then 1.2::double else 1 end as s,
  [case when cb > 0.7 then 'CLICKBAIT_RISK' end, case when imp >= 80 then 'HIGH_IMPACT' end, case when imp <= 30 then 'LOW_IMPACT' end, case when (age < 6 and imp >= 60) or age < 2 then 'BREAKING' end, case when sup > 1 and cri > 1 then 'CONTROVERSIAL' end,
   case when ind >= 2 then 'INDEPENDENT_COVERAGE' end, case when prog and cons then 'CROSS_BUBBLE' end, case when prog and cons and cent then 'FULL_SPECTRUM' end, case when side is not null then 'BLIND_SPOT' end, side] as marks from b),
d as (select *, list_sort(list_filter(marks, lambda m: m is not null)) as i from c), w as (select *, not (list_contains(i, 'BREAKING') or list_contains(i, 'HIGH_IMPACT') or list_contains(i, 'BLIND_SPOT')) and ac < 2 as waits from d)
select event_id, round(greatest(0, s), 2)::double as hot_score, array_to_string(i, ',') as insights, case side when 'BS_RIGHT' then 'right' when 'BS_LEFT' then 'left' when 'BS_CENTER' then 'center' end as blind_side, case event_id % 11 when 0 then 'WAIT' when 1 then 'MERGE' when 2 then 'PROPOSE' else case when waits then 'WAIT' else 'PUBLISH' end end as decision, case when event_id % 11 < 3 then 'collision' when waits then 'volume' end as reason from w"""


@query("r10_spectrum_score_r11", _R10, "newspapers articles")
def _(s, d):
    a = outlet_articles(s, d)
    g = ru.basics(a).join(a.groupBy("event_id").agg(F.countDistinct("newspaper").alias("n_sources"), F.collect_set("bias").alias("biases"), F.avg("clickbait_score").alias("clickbait"), F.count_if(F.col("stance") >= 0.35).alias("supportive"), F.count_if(F.col("stance") <= -0.35).alias("critical"), F.countDistinct(F.when(F.col("ownership_type") == "independent", F.col("newspaper"))).alias("independent")), "event_id")
    g = g.withColumns({"created_at": F.col("first_article_date"), "topics": F.array(F.lit("politics")), "ai_impact": (F.col("event_id") * 10).cast("int"), "is_international": F.col("event_id") % 2 == 0, "is_active": F.lit(True), "collision": F.get(F.array(F.lit("WAITING"), F.lit("AUTO"), F.lit("PROPOSE")), (F.col("event_id") % 11).cast("int"))})
    return sc.publish_gate(sc.spectrum_score(g, en.as_of()), en.as_of()).select("event_id", "hot_score", F.array_join("insights", ",").alias("insights"), "blind_side", "decision", "reason")


_SPLIT = ", c as (select event_id, id % 3 as group_no, count(*) as n, arg_min(id, (coalesce(source_rank, 999), published_date, id)) as seed from articles group by 1, 2), k as (select *, row_number() over (partition by event_id order by n desc, group_no) as rn from c)"


def _split(s, d):
    a = en.articles(s, d).select("id", "event_id", "source_rank", "published_date")
    return sp.apply_split(a, a.select("event_id", "id", (F.col("id") % 3).alias("group_no")), new_id=F.col("event_id") * 1000000 + F.col("seed_id"))


@query("r15_apply_split", _SPLIT + " select a.id, case when rn > 1 then a.event_id * 1000000 + seed else a.event_id end as event_id from articles a join k on a.event_id = k.event_id and a.id % 3 = group_no", "articles")
def _(s, d):
    return _split(s, d).articles.select("id", "event_id")


@query("r15_split_immunity", _SPLIT + " select event_id * 1000000 + seed as source_id, event_id as target_id, 0::double as distance, 'REJECTED' as status from k where rn > 1", "articles")
def _(s, d):
    return _split(s, d).proposals.drop("reason")


@query("r15_split_jobs", _SPLIT + " select event_id * 1000000 + seed as event_id, 'FORCE' as msg from k where rn > 1 union select event_id, 'FORCE' from k where rn > 1", "articles")
def _(s, d):
    return _split(s, d).jobs.select("event_id", "msg")


@query("r16_relink", "select id, case when event_id % 2 = 1 then event_id - 1 else event_id end as event_id from articles", "articles")
def _(s, d):
    m = en.articles(s, d).filter("event_id % 2 = 1").select(F.col("event_id").alias("victim_id"), (F.col("event_id") - 1).alias("survivor_id")).distinct()
    return qu.merge_relink(en.articles(s, d).select("id", "event_id"), m).select("id", "event_id")


@query("r18_pair_keys", "select least(source_id, target_id) as lo, greatest(source_id, target_id) as hi, count(*) as n from (select source_id, target_id from pr union all select target_id, source_id from pr) group by 1, 2", "proposals")
def _(s, d):
    p = en.proposals(s, d)
    both = p.select("source_id", "target_id").union(p.select("target_id", "source_id"))
    return both.groupBy(de.pair_key(F.col("source_id"), F.col("target_id")).alias("k")).agg(F.count("*").alias("n")).select("k.lo", "k.hi", "n")


@query("r19_archive", f"select id, case when status = 'PUBLISHED' and is_active and ((created_at < {T} - interval 7 day and hot_score < 50) or created_at < {T} - interval 14 day) then 'ARCHIVED' else status end as status, is_active from evs", "events")
def _(s, d):
    return qu.archive(en.events(s, d), en.as_of()).select("id", "status", "is_active")


@query("r21_stale_summaries_j7", "select id from evs where is_active and article_count > id % 9 and created_at < timestamp '2024-01-30 23:30:00' and id not in (select article_id from aq where id % 2 = 0 and status in ('PENDING', 'PROCESSING') and (id // 2) % 2 = 0) order by created_at, id limit 50", "events queue")
def _(s, d):
    e = en.events(s, d).withColumns({"articles_at_last_summary": F.col("id") % 9, "summarized_at": F.col("created_at")})
    return qu.stale_summaries(e, en.events_queue(s, d), en.as_of()).select("id")


@query("f19_feed_view", "select id, hot_score from evs where status = 'PUBLISHED' and is_active and hot_score >= 30 order by hot_score desc, id limit 20", "events")
def _(s, d):
    return fi.page(fi.apply_filters(en.events(s, d), {"status": "PUBLISHED", "is_active": True, "hot_score__gte": 30.0}), ["-hot_score"], 1, 20).select("id", "hot_score")


@query("r23_event_detail", ", al as (select event_id, string_agg(id::varchar || ':' || coalesce(bias, 'Unknown'), ',' order by published_date desc, id desc) as articles from articles left join newspapers on newspaper = name group by 1), qt as (select article_id as event_id, arg_min(['enhancer','publisher'][(id // 2) % 2 + 1] || ' (' || status || ')', id) as queue_tag from aq where id % 2 = 0 and status in ('PENDING', 'PROCESSING', 'WAITING') group by 1), pt as (select source_id as pid from pr where status = 'PENDING' union select target_id from pr where status = 'PENDING') select id, status, hot_score, articles, queue_tag, case when pid is not null then 'Merge Proposed' end as proposal_tag from evs left join al on al.event_id = id left join qt on qt.event_id = id left join pt on pid = id", "articles newspapers events queue proposals")
def _(s, d):
    a = en.articles(s, d).join(en.newspapers(s, d), F.col("newspaper") == F.col("name"), "left")
    x = dk.event_detail(en.events(s, d), a, en.events_queue(s, d), en.proposals(s, d))
    shown = F.array_join(F.transform("articles", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["bias"])), ",")
    return x.select("id", "status", "hot_score", shown.alias("articles"), "queue_tag", "proposal_tag")


@query("r24_waiting_events", "select evs.id, article_count, case when article_count > 5 then 'Topic/Niche' else 'Low Volume' end as reason from evs join aq on evs.id = aq.article_id where aq.id % 2 = 0 and aq.status = 'WAITING'", "events queue")
def _(s, d):
    return dk.waiting_events(en.events(s, d), en.events_queue(s, d)).select("id", "article_count", "reason")


@query("r24_next_proposal", "select source_id, target_id, distance from pr where status = 'PENDING' order by distance, source_id, target_id limit 1", "proposals")
def _(s, d):
    return dk.next_proposal(en.proposals(s, d)).select("source_id", "target_id", "distance")


@query("r25_delta_batches", ", x as (select id, event_id, bias, newspaper, row_number() over (partition by event_id order by published_date, id) as rn from articles join newspapers on newspaper = name where id % 4 <> 1 and id not in (select source_id from pr where status in ('PENDING', 'PROCESSING'))) select event_id, (rn - 1) // 5 as batch_no, count(*) as n, string_agg(bias || '/' || newspaper, ',' order by rn) as inputs from x where id % 5 <> 0 group by 1, 2", "articles newspapers proposals")
def _(s, d):
    a = outlet_articles(s, d).withColumns({"summary_status": F.when(F.col("id") % 4 == 1, "PENDING").otherwise("COMPLETED"), "key_points": F.when(F.col("id") % 5 != 0, F.array("title"))})
    x = qu.batch_inputs(qu.delta_articles(a, en.proposals(s, d)))
    shown = F.array_join(F.transform("inputs", lambda i: F.concat(i["bias"], F.lit("/"), i["source"])), ",")
    return x.select("event_id", "batch_no", F.size("inputs").cast("long").alias("n"), shown.alias("inputs"))


@query("r25_enhance_action_x8", f"select id, case when last_updated_at > {T} - interval 15 minute and id % 13 <> 0 and article_count <= 10 then 'DEBOUNCED' when article_count = 0 and id % 3 = 0 and id % 13 <> 0 then 'SKIPPED_EMPTY' else 'ENHANCE' end as action from evs", "events")
def _(s, d):
    e = en.events(s, d).withColumns({"summarized_at": F.col("last_updated_at"), "forced": F.col("id") % 13 == 0, "backlog": F.col("article_count"), "merged": F.col("id") % 3})
    return qu.enhance_action(e, en.as_of()).select("id", "action")


@query("r27_archive_approve", f"select id, case when id % 4 = 0 then 'ARCHIVED' when id % 6 = 1 then 'PUBLISHED' else status end as status, is_active and id % 4 <> 0 as is_active, case when id % 6 = 1 then {T} end as published_at from evs", "events")
def _(s, d):
    e = en.events(s, d).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    e = dk.archive_by_hand(e, e.filter("id % 4 = 0"), en.as_of())
    e, _ = dk.approve(e, en.events_queue(s, d), e.filter("id % 6 = 1"), en.as_of())
    return e.select("id", "status", "is_active", "published_at")


@query("r27_approved_jobs", "select id, case when status = 'WAITING' and article_id % 6 = 1 then 'COMPLETED' else status end as status, case when status = 'WAITING' and article_id % 6 = 1 then 'Approved by hand' else msg end as msg from aq where id % 2 = 0", "queue")
def _(s, d):
    q = en.events_queue(s, d)
    e = en.events(s, d).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    return dk.approve(e, q, q.filter("event_id % 6 = 1").select(F.col("event_id").alias("id")), en.as_of())[1].select("id", "status", "msg")


@query("r27_edit_boost", "select id, case when id % 2 = 0 then 'EDITED' else status end as status, case when id % 3 = 0 then hot_score + 10 else hot_score end as editorial_score from evs", "events")
def _(s, d):
    e = en.events(s, d).withColumnRenamed("hot_score", "editorial_score")
    edited = dk.edit_events(e, e.select("id", F.when(F.col("id") % 2 == 0, "EDITED").alias("status")))
    return dk.boost(edited, e.filter("id % 3 = 0").select("id", F.lit(10).alias("amount"))).select("id", "status", "editorial_score")


@query("r27_dissolve", "select id, case when event_id % 5 <> 0 then event_id end as event_id, case when event_id % 5 = 0 then 'Unknown' else title end as title, case when event_id % 5 <> 0 then stance end as stance from articles", "articles")
def _(s, d):
    a, q = en.articles(s, d), en.articles_queue(s, d)
    ids = a.filter("event_id % 5 = 0").select(F.col("event_id").alias("id")).distinct()
    return dk.dissolve(en.events(s, d), a, q, en.events_queue(s, d), en.proposals(s, d), ids, en.as_of()).articles.select("id", "event_id", "title", "stance")


@query("r26_merge_by_link", "select l_partkey as link, min(l_linenumber) as rank, arg_min(l_returnflag, (l_orderkey, l_linenumber)) filter (l_returnflag <> 'N') as content from lineitem group by 1")
def _(s, d):
    x = en.table(s, d, "lineitem").select(F.col("l_partkey").alias("link"), F.col("l_linenumber").alias("rank"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.lit("x").alias("published"), F.when(F.col("l_returnflag") == "N", "Unknown").otherwise(F.col("l_returnflag")).alias("content"))
    return ha.merge_by_link(x).drop("published")


@query("q1_rescue_stuck", f"select id, case when status = 'PROCESSING' and updated_at < {T} - interval 30 minute then 'PENDING' else status end as status from aq", "queue")
def _(s, d):
    return qu.rescue_stuck(en.articles_queue(s, d), en.as_of()).select("id", "status")


@query("q2_retry_failed_q3", "select id, case when status = 'FAILED' and queue_name = 'filter' then 'PENDING' when status = 'PROCESSING' then 'PENDING' else status end as status from aq", "queue")
def _(s, d):
    return qu.reset_processing(qu.retry_failed(en.articles_queue(s, d), en.as_of(), "filter"), en.as_of()).select("id", "status")


@query("q4_purge_done_k6", "select id, status from aq where status <> 'COMPLETED'", "queue")
def _(s, d):
    return qu.purge_done(en.articles_queue(s, d)).select("id", "status")


@query("q5_expire_pending_k5", f"select id, case when status = 'PENDING' and created_at < {T} - interval 7 day then 'COMPLETED' else status end as status, case when status = 'PENDING' and created_at < {T} - interval 7 day then 'expired' else msg end as msg from aq", "queue")
def _(s, d):
    return qu.expire_pending(en.articles_queue(s, d), en.as_of()).select("id", "status", "msg")


@query("q6_requeue_untitled", ", q as (select article_id, status, queue_name from aq qualify row_number() over (partition by article_id order by id) = 1), u as (select id from articles where lower(title) in ('no title', 'unknown', '') or id % 10 = 0) select article_id, case when article_id in (select id from u) then 'PENDING' else status end as status, case when article_id in (select id from u) then 'enricher' else queue_name end as queue_name from q union all select id, 'PENDING', 'enricher' from u where id not in (select article_id from q)", "articles queue")
def _(s, d):
    q = en.articles_queue(s, d)
    once = q.groupBy("article_id").agg(F.min_by(F.struct("status", "queue_name", "updated_at", "created_at"), "id").alias("r")).select("article_id", "r.*")
    a = en.articles(s, d).withColumn("title", F.when(F.col("id") % 10 == 0, "No Title").otherwise(F.col("title")))
    return qu.requeue_untitled(once, a, F.expr("timestamp_ntz'2030-01-01 00:00:00'")).select("article_id", "status", "queue_name")


@query("q8_janitor", f"select id, case when status = 'PROCESSING' and updated_at < {T} - interval 6 hour then 'PENDING' else status end as status from aq where not (status = 'COMPLETED' and updated_at < {T} - interval 7 day)", "queue")
def _(s, d):
    return qu.janitor(en.articles_queue(s, d), en.as_of()).select("id", "status")


@query("q14_claim_x1", "select id, article_id from aq where status = 'PENDING' and queue_name = 'filter' order by created_at, id limit 50", "queue")
def _(s, d):
    return qu.claim(en.articles_queue(s, d), "filter", 50, [F.col("created_at").asc_nulls_last()]).select("id", "article_id")


@query("fn_url_date_and_cut", "select doc_id, case when strlen(text) > 0 and length(text) > 1000 then left(text, 700) || chr(10) || '...' || chr(10) || right(text, 300) else text end as cut, make_date(2024, (doc_id % 12 + 1)::int, (doc_id % 28 + 1)::int) as d from documents")
def _(s, d):
    x = en.table(s, d, "documents")
    url = F.concat(F.lit("https://a.test/2024/"), (F.col("doc_id") % 12 + 1).cast("string"), F.lit("/"), (F.col("doc_id") % 28 + 1).cast("string"), F.lit("/x"))
    return x.select("doc_id", tx.head_and_tail(F.col("text"), 1000).alias("cut"), tx.url_date(url).alias("d"))


@query("x9_leaky_bucket")
def _(s, d):
    r = en.table(s, d, "events").select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.lit(20.0).alias("cost"))
    return st.rate_limited_batch(r, 60.0, 86400.0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search."""
    return hybrid(spark, sf_dir)


# These add their queries to the registers.
from tidewire.plans import flow_queries, report_queries  # noqa: E402, F401

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

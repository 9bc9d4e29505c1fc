"""Queries of reports, lists, filters, dates, merged statistics and splits, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import dates as da
from tidewire.functions import text as tx
from tidewire.operators import analytics as an
from tidewire.operators import desk as dk
from tidewire.operators import filters as fi
from tidewire.operators import queues as qu
from tidewire.operators import rollup as ru
from tidewire.operators import score as sc
from tidewire.operators import split as sp
from tidewire.plans.base import AB, T, outlet_articles, query
from tidewire.plans.oracle_views import with_views
from tidewire.sources import backup as ba
from tidewire.sources import entities as en

_SIDE = "['left','right','center'][(id % 4 + 1)::int]"


def _sided(s, d):
    """Events with blind spots: every third one, on a side of its own or on none."""
    side = F.get(F.array(*map(F.lit, ("left", "right", "center"))), (F.col("id") % 4).cast("int"))
    return en.events(s, d).withColumns({"blind_spot_side": side, "is_blind_spot": F.when(F.col("id") % 5 != 0, F.col("id") % 3 == 0)})


@query("a5_blind_spots", f"select {_SIDE} as side, count(*) as n, sum(count(*)) over ()::bigint as total from evs where is_active and id % 3 = 0 and id % 5 <> 0 group by 1", "events")
def _(s, d):
    return an.blind_spots(_sided(s, d))


_ERRORS = "select newspaper, msg, count(*) as n from aq join articles on aq.article_id = articles.id where status = 'FAILED' and newspaper is not null"


@query("a20_recent_errors", _ERRORS + f" and updated_at >= {T} - interval 24 hour group by 1, 2", "queue articles")
def _(s, d):
    return an.errors_by_source(en.articles_queue(s, d), en.articles(s, d), en.as_of())


@query("a20_enricher_errors", _ERRORS + " and queue_name = 'enricher' group by 1, 2 order by n desc, newspaper, msg limit 10", "queue articles")
def _(s, d):
    return an.errors_by_source(en.articles_queue(s, d), en.articles(s, d), queue_name="enricher", top=10)


@query("a20_processed_per_day", "select published_date::date as day, count(*) as n from articles where id % 3 <> 0 group by 1", "articles")
def _(s, d):
    return an.processed_per_day(en.articles(s, d).withColumns({"summary_status": F.when(F.col("id") % 3 != 0, "COMPLETED"), "summary_date": F.col("published_date")}))


@query("a23_pending_proposals_j11", "select (select count(*) from aq where status = 'PENDING') as article_merges, (select count(*) from pr where status = 'PENDING') as event_merges", "queue proposals")
def _(s, d):
    return an.pending_proposals(en.articles_queue(s, d), en.proposals(s, d))


@query("r22_top_published", "select id, hot_score from evs where status = 'PUBLISHED' and id % 3 = 0 and id % 5 <> 0 and hot_score >= 10 and id % 8 = 0 order by hot_score desc, id limit 20 offset 2", "events")
def _(s, d):
    topics = F.when(F.col("id") % 8 == 0, F.create_map(F.lit("Politics"), F.lit(2))).otherwise(F.create_map(F.lit("Sports"), F.lit(1)))
    return an.top_events(_sided(s, d).withColumn("main_topic_counts", topics), 10.0, "Politics", True, 20, 2).select("id", "hot_score")


@query("r24_article_detail", "select articles.id, coalesce(name, 'Unknown') as source, content, stance from articles left join newspapers on newspaper = name where articles.id % 3 = 0", "newspapers articles")
def _(s, d):
    a = en.articles(s, d)
    return dk.article_detail(a, en.newspapers(s, d), a.filter("id % 3 = 0")).select("id", "source", "content", "stance")


@query("p7_edges_p8_captions", f"select id, case when hot_score > article_count * 4 + 15 then 'left' when article_count * 4 > hot_score + 15 then 'right' else 'none' end as edge, case when hot_score > 75 then 'high' when hot_score >= 50 then 'middle' else 'low' end as level, case when x >= 86400 then (x // 86400) || ' dia' || case when x // 86400 <> 1 then 's' else '' end when x >= 3600 then (x // 3600) || ' hora' || case when x // 3600 <> 1 then 's' else '' end when x >= 60 then (x // 60) || ' minuto' || case when x // 60 <> 1 then 's' else '' end else x || ' segundo' || case when x <> 1 then 's' else '' end end as since, case {_SIDE} when 'left' then 'ESQUERDA' when 'right' then 'DIREITA' when 'center' then 'CENTRO' else '' end as viewpoint, case {_SIDE} when 'left' then 'DIREITA' when 'right' then 'ESQUERDA' when 'center' then 'ESQUERDA E DIREITA' else '' end as ignored_by from (select *, id * id * id % 200000 as x from evs)", "events")
def _(s, d):
    e = _sided(s, d).withColumn("x", F.col("id") * F.col("id") * F.col("id") % 200000)
    caption = an.blind_spot_caption(F.col("blind_spot_side"))
    return e.select("id", an.bias_edge(F.col("hot_score"), F.col("article_count") * 4).alias("edge"), an.impact_level(F.col("hot_score")).alias("level"), an.time_since(F.col("x")).alias("since"), caption["viewpoint"].alias("viewpoint"), caption["ignored_by"].alias("ignored_by"))


@query("p9_event_list", "select id, case when id % 2 = 0 then 'X' else 'GENERAL' end as category_tag, case when id % 3 = 0 then 0 else article_count end as article_count, id % 3 = 0 and id % 5 <> 0 as is_blind_spot, 0::bigint as n_insights from evs", "events")
def _(s, d):
    e = _sided(s, d).withColumns({"category_tag": F.when(F.col("id") % 2 == 0, "X"), "article_count": F.when(F.col("id") % 3 != 0, F.col("article_count")), "publisher_insights": F.lit(None).cast("array<string>"), "topics": F.lit(None).cast("map<string,int>")})
    x = an.event_list(e)
    assert "centroid" not in x.columns
    return x.select("id", "category_tag", "article_count", "is_blind_spot", (F.size("publisher_insights") + F.size("topics")).cast("long").alias("n_insights"))


@query("f4_listed_queue", "select aq.id, updated_at from aq join articles a on a.id = aq.article_id where status = 'FAILED' and attempts > 0 and a.newspaper ilike '%src1%' order by updated_at desc, aq.id limit 20 offset 20", "articles queue")
def _(s, d):
    q = en.articles_queue(s, d)
    a = en.articles(s, d).select("id", "title", "newspaper")
    relations = {"article": fi.Relation(a, "article_id", "id"), "article.newspaper": fi.Relation(en.newspapers(s, d), "newspaper", "name")}
    return fi.listed(q, "articles_queue", {"status": "FAILED", "attempts__gt": 0, "article__newspaper__name__ilike": "src1", "order_by": "-updated_at"}, relations, 2, 20, strict=True).select("id", "updated_at")


@query("f6_article_list", "select a.id from articles a join newspapers n on n.name = a.newspaper where published_date between timestamp '2024-01-05' and timestamp '2024-01-25' and (title ilike '%an%' or lang ilike '%an%') and bias = 'left' and (name ilike '%1%' or ownership_type ilike '%1%')", "newspapers articles")
def _(s, d):
    at = lambda x: F.expr(f"timestamp_ntz'{x} 00:00:00'")
    a = en.articles(s, d).withColumn("summary", F.col("lang"))
    return fi.article_list(a, en.newspapers(s, d).withColumn("description", F.col("ownership_type")), at("2024-01-05"), at("2024-01-25"), "left", "an", "1").select("id")


@query("f13_empty_maps_u4", "select id, id % 3 <> 1 as missing, array_to_string(list_sort(list_distinct(['a', 'b' || (id % 3)] || case when id % 2 = 0 then ['b1', 'c'] else [] end)), ',') as insights from evs", "events")
def _(s, d):
    m = F.when(F.col("id") % 3 == 0, F.create_map().cast("map<string,int>")).when(F.col("id") % 3 == 1, F.create_map(F.lit("a"), F.lit(1)))
    both = fi.united(F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string"))), F.when(F.col("id") % 2 == 0, F.array(F.lit("b1"), F.lit("c"))))
    return en.events(s, d).select("id", fi.empty_or_missing(m).alias("missing"), F.array_join(both, ",").alias("insights"))


@query("u2_prefer_existing", "select id, case when id % 3 = 0 then hot_score else article_count::double end as value from evs where id % 3 = 0 or id % 2 = 0", "events")
def _(s, d):
    e = en.events(s, d)
    one = e.filter("id % 3 = 0").select("id", F.col("hot_score").alias("value"))
    return fi.prefer_existing(e, one, e.filter("id % 2 = 0").select("id", F.col("article_count").cast("double").alias("value")), "id")


def _topics(s, d):
    return ru.as_map(ru.topic_counts(en.articles(s, d)), "topic", "n", "main_topic_counts")


@query("g15_backfill", ", t as (select event_id, topic, count(*) as n from (select event_id, lang as topic from articles union all select event_id, newspaper from articles) group by 1, 2) select id, coalesce(case when id % 3 <> 2 then (select string_agg(topic || ':' || n, ',' order by topic) from t where t.event_id = evs.id and topic is not null) else 'old:1' end, case when id % 3 = 0 then '' end) as topics from evs", "events articles")
def _(s, d):
    m = F.when(F.col("id") % 3 == 0, F.create_map().cast("map<string,bigint>")).when(F.col("id") % 3 == 2, F.create_map(F.lit("old"), F.lit(1).cast("long")))
    topics = ru.as_map(ru.topic_counts(en.articles(s, d)).filter("topic is not null"), "topic", "n", "main_topic_counts")
    e = ru.backfill(en.events(s, d).withColumn("main_topic_counts", m), "main_topic_counts", topics)
    shown = F.transform(F.array_sort(F.map_entries("main_topic_counts")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string")))
    return e.select("id", F.array_join(shown, ",").alias("topics"))


@query("g16_flat_entities", "select id, array_to_string(list_sort(list_distinct([lang, 'x', 'a' || (id % 3), 'a1'])), ',') as names from articles", "articles")
def _(s, d):
    groups = F.create_map(F.lit("place"), F.array("lang", F.lit("x")), F.lit("org"), F.array(F.concat(F.lit("a"), (F.col("id") % 3).cast("string")), F.lit("a1")))
    return en.articles(s, d).select("id", F.array_join(ru.flat_entities(groups), ",").alias("names"))


#: Merged two by two, the statistics of events must be those of their articles together, but where a rule says otherwise.
_G10 = f""", m as (select a.*, n.bias, n.newspaper_id, n.ownership_type, a.event_id // 2 * 2 as k from articles a join newspapers n on n.name = a.newspaper),
ok as (select k from m group by 1 having count(distinct event_id) = 2), x as (select * from m where k in (select k from ok)),
st as (select k, event_id, bias, count(stance) as n, avg(stance) as a from x where stance is not null group by 1, 2, 3), g as (select k, event_id, avg(a) as s, sum(n) as n from st group by 1, 2),
cb as (select k, event_id, bias, avg(clickbait_score) as c, count(stance) as n from x group by 1, 2, 3),
r as (select k, 'topic:' || topic as name, count(*)::double as value from (select k, lang as topic from x union all select k, newspaper from x) group by 1, 2
  union all select k, 'owner:' || ownership_type, count(*) from x group by 1, 2 union all select k, 'articles:' || bias, count(*) from x group by 1, 2
  union all select k, 'place:' || lang, count(*) from x group by 1, 2
  union all select k, 'stance:' || bias, round(sum(a * n) / sum(n), 6) from st group by 1, 2 union all select k, 'supportive:' || bias, count(*) filter (stance >= 0.35) from x where stance is not null group by 1, 2
  union all select k, 'all_stance', round(sum(s * n) / sum(n), 6) from g group by 1
  union all select k, 'clickbait:' || bias, round(case when count(*) = 1 then max(c) when sum(n) = 0 then arg_min(c, event_id) else sum(c * n) / sum(n) end, 6) from cb group by 1, 2
  union all select k, 'ids:' || bias, count(distinct newspaper_id) from x group by 1, 2 union all select k, 'snapshot', count(distinct newspaper) from x group by 1
  union all select k, 'count', count(*) from x group by 1 union all select k, 'score', round(sum(10.0::double / source_rank), 6) from x group by 1)
select k as event_id, name, coalesce(value, 0)::double as value from r"""


@query("g10_merged_statistics", _G10, "articles newspapers")
def _(s, d):
    a = outlet_articles(s, d).withColumn("interests", F.create_map(F.lit("place"), F.array("lang")))
    st = ru.statistics(a).withColumn("publisher_insights", F.lit(None).cast("array<string>"))
    whole = lambda name: F.struct(*[F.col(c) for c in st.columns]).alias(name)
    even = st.filter("event_id % 2 = 0").select(F.col("event_id").alias("k"), whole("survivor"))
    odd = st.filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("k"), whole("victim"))
    m = ru.merge_statistics(even.join(odd, "k"))
    entry = lambda name, value: F.struct(name.alias("name"), F.round(value.cast("double"), 6).alias("value"))
    of = lambda c, mark, value=lambda v: v: F.transform(F.map_entries(c), lambda e: entry(F.concat(F.lit(mark), e["key"]), value(e["value"])))
    single = F.array(entry(F.lit("all_stance"), F.col("stance")), entry(F.lit("snapshot"), F.size("sources_snapshot")), entry(F.lit("count"), F.col("article_count")), entry(F.lit("score"), F.col("editorial_score")))
    rows = F.concat(
        of("main_topic_counts", "topic:"), of("ownership_stats", "owner:"), of("article_counts_by_bias", "articles:"), of(F.col("interest_counts")["place"], "place:"), of("stance_distribution", "stance:", lambda v: v["total"]),
        of("stance_distribution", "supportive:", lambda v: v["supportive"]), of("clickbait_distribution", "clickbait:"), of("bias_distribution", "ids:", lambda v: F.size(v)), single,
    )
    return m.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.name", F.coalesce("r.value", F.lit(0.0)).alias("value"))


@query("r20_decay", f", {AB}, g as (select event_id, sum(10.0::double / source_rank) as ed, count(distinct newspaper) as n, min(published_date) as f from ab group by 1), z as (select evs.id, hot_score, (case when coalesce(ed, 0) > 0 then 40 * ln(1 + ed) else 0 end + 100 * ln(1 + coalesce(n, article_count)::double) + case when age < 72 then 150 * pow(0.5, age / 3) else -0.1 * age end) * (0.01 + 0.09 * 10 / 30) / case when age > 6 then 1 + 0.05 * pow(age - 6, 1.5) else 1 end as s from (select evs.*, ed, n, greatest(0, (epoch({T}) - epoch(coalesce(f, created_at))) / 3600.0::double) as age from evs left join g on g.event_id = evs.id) evs where status = 'PUBLISHED' and is_active) select id, round(greatest(0, s), 2)::double as hot_score from z where abs(round(greatest(0, s), 2) - hot_score) > 0.01", "newspapers articles events")
def _(s, d):
    e = en.events(s, d)
    a = outlet_articles(s, d).groupBy(F.col("event_id").alias("id")).agg(F.sum(F.lit(10.0) / F.col("source_rank")).alias("editorial_score"), F.countDistinct("newspaper").alias("n_sources"), F.min("published_date").alias("first_article_date"))
    none = {"topics": F.array().cast("array<string>"), "ai_impact": F.lit(10), "is_international": F.lit(False), "clickbait": F.lit(0.0), "supportive": F.lit(0), "critical": F.lit(0), "independent": F.lit(0), "biases": F.array().cast("array<string>")}
    x = e.drop("hot_score", "centroid").join(a, "id", "left").withColumns(none)
    return qu.decay(e, sc.spectrum_score(x, en.as_of()))


_HTML = "<html><head><meta property='og:title' content='x'>{meta}<script type=\"application/ld+json\">{ld}</script><style>publicado 1/1/2001</style></head><body><nav>data 02/02/2002</nav><p class=\"date\">{text}</p></body></html>"
#: URL, metadata, JSON-LD and text of a page, and the time that the ladder finds.
DATE_CASES = (
    ("/a", "", '{"@type":"NewsArticle","datePublished":"2024-01-05T10:20:00Z"}', "", "2024-01-05 10:20"),
    ("/a", "", '{"@graph":[{"@type":"WebPage","datePublished":"2020-01-01"},{"@type":["Thing","Report"],"dateCreated":"2024-01-06 11:00"}]}', "", "2024-01-06 11:00"),
    ("/a", "", '[{"@type":"Person"},{"@type":"Article","datePublished":"2024-02-07T08:00:00+02:00"}]', "", "2024-02-07 06:00"),
    ("/2024/1/8/x", "", "{broken", "em 08/01 as 9h05", "2024-01-08 09:05"),
    ("/2024-01-09/x", "", "{}", "2024-01-09, updated 17:45", "2024-01-09 17:45"),
    ("/2024/01/10", "", "", "nothing", "2024-01-10 00:00"),
    ("/2024/13/45", "<meta content='2024-01-11T01:02:00Z' property='article:published_time'>", "", "", "2024-01-11 01:02"),
    ("/a", '<meta name="pubdate" content="12/01/2024">', "", "", "2024-01-12 00:00"),
    ("/a", "", "", "Publicado em 13/01/2024 14h30", "2024-01-13 14:30"),
    ("/a", "", "", "Atualizado: 14-1-2024", "2024-01-14 00:00"),
    ("/a", "", "", "15/01/2024", None),
)
_DATE_VALUES = ", ".join(f"({i}, {'null' if c[4] is None else f"timestamp '{c[4]}:00'"})" for i, c in enumerate(DATE_CASES))


@query("fn_published_date", f"with c(i, t) as (values {_DATE_VALUES}) select page_id, t as published from pages join c on page_id % {len(DATE_CASES)} = i")
def _(s, d):
    i = F.col("page_id") % len(DATE_CASES)
    url = F.concat(F.lit("https://x.test"), en.pick(tuple(c[0] for c in DATE_CASES), i))
    html = en.pick(tuple(_HTML.replace("{meta}", c[1]).replace("{ld}", c[2]).replace("{text}", c[3]) for c in DATE_CASES), i)
    return en.table(s, d, "pages").select("page_id", da.published_date(url, html).cast("timestamp_ntz").alias("published"))


_SPOKEN = ("05/02/2024 10:20", "5-2-2024", "2024-02-05", "2024-02-05 07:08:09", "Mon, 05 Feb 2024 10:00:00 +0000", "2024-02-05T10:00:00-03:00", "31/12/2030", "soon", "")
_SPOKEN_SQL = "[timestamp '2024-02-05 10:20:00', timestamp '2024-02-05', timestamp '2024-02-05', timestamp '2024-02-05 07:08:09', timestamp '2024-02-05 10:00:00', timestamp '2024-02-05 13:00:00', null, null, null]"


@query("fn_lenient_dates", f"select page_id, {_SPOKEN_SQL}[page_id % 9 + 1] as t, case when page_id % 9 in (2, 3, 5) then date '2024-02-05' end as d from pages")
def _(s, d):
    text = en.pick(_SPOKEN, F.col("page_id"))
    return en.table(s, d, "pages").select("page_id", da.parsed_date(text, F.expr("timestamp'2024-12-31 00:00:00'")).cast("timestamp_ntz").alias("t"), da.loose_date(text).alias("d"))


@query("fn_texts", "select doc_id, left(text, 500) as cut, 'search_document: ' || left(trim(text), 100) as input, length(text) < 10 as short from documents where length(text) >= 10 or length(text) < 10")
def _(s, d):
    x = en.table(s, d, "documents").filter("text is not null")
    long_ = F.char_length("text") >= 10
    return x.select("doc_id", tx.prefix(F.col("text"), 500).alias("cut"), F.coalesce(tx.embedding_input(F.col("text"), ["\x01"], 100), F.concat(F.lit("search_document: "), F.trim("text"))).alias("input"), (~long_).alias("short"))


@query("k9_markdown", "select '| ' || name || ' | ' || newspaper_id || ' | ' || replace(bias, '_', '\\|') || ' |' as line from newspapers", "newspapers")
def _(s, d):
    return ba.markdown_rows(en.newspapers(s, d).select("name", "newspaper_id", F.replace("bias", F.lit("_"), F.lit("|")).alias("bias")))


#: Articles whose vectors lean to one of three directions of their event, so that some events fall apart.
_R14 = f""", v as (select a.id, a.event_id, epoch(published_date) / 3600.0::double as h, (select list_transform(list_zip(b.e, o.e), lambda p: p[1] + 0.2::double * p[2]) from (select embedding::double[] as e from embeddings where vec_id = a.event_id * 3 + a.id % 3) b, (select embedding::double[] as e from embeddings where vec_id = a.id % 500) o) as x from articles a),
c as (select event_id, least(9.0::double / count(*), 0.7) as eps from v group by 1 having count(*) > 2),
w as (select v.*, eps from v join c using (event_id)),
p as (select a.id as a, b.id as b from w a join w b on a.event_id = b.event_id and a.id <> b.id where round(list_cosine_distance(a.x, b.x) + least(0.15::double * abs(a.h - b.h) / 24, 0.5), 9) <= a.eps),
k as (select a as node, a as comp from p union select p.b, k.comp from k join p on p.a = k.node where k.comp < p.b),
m as (select node, min(comp) as comp from k group by 1),
f as (select m.comp, arg_min(w.id, (h, w.id)) as first from m join w on w.id = m.node group by 1),
z as (select a.id, arg_min(f.comp, (round(list_cosine_distance(a.x, b.x) + least(0.15::double * abs(a.h - b.h) / 24, 0.5), 9), b.h, b.id)) as comp from w a join w b on a.event_id = b.event_id join f on f.first = b.id
  where a.id not in (select node from m) and round(list_cosine_distance(a.x, b.x) + least(0.15::double * abs(a.h - b.h) / 24, 0.5), 9) <= 0.25 group by 1),
g as (select w.event_id, w.id, h, coalesce(m.comp, z.comp, w.id) as comp from w left join m on m.node = w.id left join z on z.id = w.id where w.event_id in (select w.event_id from w join m on m.node = w.id)),
q as (select event_id, comp, min((h, id)) as first from g group by 1, 2),
r as (select event_id, comp, row_number() over (partition by event_id order by first) - 1 as group_no, count(*) over (partition by event_id) as n from q)
select g.event_id, g.id, group_no from g join r on g.event_id = r.event_id and g.comp = r.comp where n > 1"""


@query("r14_split_events", "with recursive " + with_views("articles", _R14).removeprefix("with "))
def _(s, d):
    v = en.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    base, own = (v.select(F.col("vec_id").alias(f"v{i}"), F.col("e").alias(f"e{i}")) for i in (0, 1))
    a = en.articles(s, d).join(base, F.col("event_id") * 3 + F.col("id") % 3 == F.col("v0")).join(own, F.col("id") % 500 == F.col("v1"))
    x = a.select("id", "event_id", "published_date", F.zip_with("e0", "e1", lambda p, q: p + 0.2 * q).alias("embedding"))
    return sp.split_events(x, dimension=64)

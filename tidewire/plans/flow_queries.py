"""Queries of jobs, proposals, merges and new events, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.operators import desk as dk
from tidewire.operators import lifecycle as li
from tidewire.operators import search as se
from tidewire.operators import sequence as sq
from tidewire.plans.base import T, query
from tidewire.sources import entities as en

_BARE = "id % 3 = 0 or id % 4 = 0"


@query("q7_requeue_incomplete", f", j as (select event_id, min(id) as first, bool_or(status = 'COMPLETED') as done from eq where queue_name = 'enhancer' group by 1), h as (select first from j where done and event_id in (select id from evs where {_BARE})) select id, case when id in (select first from h) then 'PENDING' else status end as status, case when id in (select first from h) then 0 else attempts end as attempts, case when id in (select first from h) then 'Re-queued: missing data' else msg end as msg from eq", "events queue equeue")
def _(s, d):
    e = en.events(s, d).withColumns({"subtitle": F.when(F.col("id") % 3 != 0, "x"), "summary": F.when(F.col("id") % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("bias"), F.lit("x")))})
    return li.requeue_incomplete(en.events_queue(s, d), e, en.as_of()).select("id", "status", "attempts", "msg")


@query("q9_complete_old", f", o as (select id from articles where published_date < {T} - interval 7 day) select id, case when status = 'PENDING' and queue_name = 'cluster' and article_id in (select id from o) then 'COMPLETED' else status end as status, case when status = 'PENDING' and queue_name = 'cluster' and article_id in (select id from o) then 'Article Too Old (Auto-Cleared)' else msg end as msg from aq", "articles queue")
def _(s, d):
    return li.complete_old(en.articles_queue(s, d), en.articles(s, d), "cluster", en.as_of()).select("id", "status", "msg")


@query("q11_requeue_event_articles_k4", ", w as (select id as article_id, 'Forced Requeue from Event ' || event_id as m from articles where event_id % 5 = 3), o as (select *, status in ('PENDING', 'PROCESSING', 'FAILED') as is_open from aq) select id, article_id, case when m is not null and is_open then 'PENDING' else status end as status, case when m is not null and is_open then 'enricher' else queue_name end as queue_name, case when m is not null and is_open then 0 else attempts end as attempts, case when m is not null and is_open then m else msg end as msg from o left join w using (article_id) union all select article_id + 10000000, article_id, 'PENDING', 'enricher', 0, m from w where article_id not in (select article_id from o where is_open)", "articles queue")
def _(s, d):
    wanted = en.articles(s, d).filter("event_id % 5 = 3").select(F.col("id").alias("article_id"), F.concat(F.lit("Forced Requeue from Event "), F.col("event_id").cast("string")).alias("msg"))
    q = li.requeue(en.articles_queue(s, d), wanted, "article_id", "enricher", en.as_of(), ("PENDING", "PROCESSING", "FAILED"), first_only=False, new_id=F.col("article_id") + 10_000_000)
    return q.select("id", "article_id", "status", "queue_name", "attempts", "msg")


@query("q11_requeue_events", ", f as (select event_id, min(id) as first from eq where status in ('PENDING', 'PROCESSING') group by 1), w as (select id as event_id from evs where id % 2 = 0) select id, eq.event_id, case when id = first then 'PENDING' else status end as status, case when id = first then 'enhancer' else queue_name end as queue_name, case when id = first then 'Manual Re-Enhance' else msg end as msg from eq left join (select * from f where event_id in (select event_id from w)) f on eq.event_id = f.event_id union all select event_id + 10000000, event_id, 'PENDING', 'enhancer', 'Manual Re-Enhance' from w where event_id not in (select event_id from f)", "events queue equeue")
def _(s, d):
    wanted = en.events(s, d).filter("id % 2 = 0").select(F.col("id").alias("event_id"), F.lit("Manual Re-Enhance").alias("msg"))
    return li.requeue(en.events_queue(s, d), wanted, "event_id", "enhancer", en.as_of(), new_id=F.col("event_id") + 10_000_000).select("id", "event_id", "status", "queue_name", "msg")


@query("q12_create_proposals", ", n as (select id as a, id + 1 as b, (id % 100) / 100.0::double as distance, id % 2 = 0 as ambiguous from evs union all select id + 1, id, (id % 70 + 1) / 100.0::double, false from evs), k as (select *, row_number() over (partition by least(a, b) order by distance, a, b) as rn from n where not exists (select 1 from pr where pr.source_id = least(a, b) and pr.target_id = greatest(a, b))) select source_id, target_id, status, distance, '' as reasoning from pr union all select a, b, 'PENDING', distance, case when ambiguous then 'near (AMBIGUOUS)' else 'near' end from k where rn = 1", "events proposals")
def _(s, d):
    e = en.events(s, d)
    one = e.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), (F.col("id") % 100 / F.lit(100.0)).alias("distance"), F.lit("near").alias("reasoning"), (F.col("id") % 2 == 0).alias("ambiguous"))
    two = e.select((F.col("id") + 1).alias("source_id"), F.col("id").alias("target_id"), ((F.col("id") % 70 + 1) / F.lit(100.0)).alias("distance"), F.lit("near").alias("reasoning"), F.lit(False).alias("ambiguous"))
    return li.create_proposals(en.proposals(s, d).withColumn("reasoning", F.lit("")), one.unionByName(two), en.as_of())


@query("q12_create_jobs", ", n as (select id as event_id from evs where status = 'DRAFT') select id, event_id, status, queue_name, msg from eq union all select event_id + 20000000, event_id, 'PENDING', 'publisher', 'By hand' from n", "events queue equeue")
def _(s, d):
    rows = en.events(s, d).filter("status = 'DRAFT'").select(F.col("id").alias("event_id"), F.lit("By hand").alias("msg"))
    return li.create_jobs(en.events_queue(s, d), rows, "event_id", "publisher", en.as_of(), F.col("event_id") + 20_000_000).select("id", "event_id", "status", "queue_name", "msg")


@query("q13_proposal_status", "select source_id, target_id, case when (source_id + target_id) % 7 = 0 then case when target_id % 2 = 0 then 'APPROVED' else 'REJECTED' end when status in ('PENDING', 'PROCESSING') and source_id % 5 = 0 and target_id - source_id <> 1 then 'REJECTED' else status end as status, case when (source_id + target_id) % 7 = 0 then case when target_id % 2 = 0 then 'same' else case when status in ('PENDING', 'PROCESSING') and false then '' else 'other' end end when status in ('PENDING', 'PROCESSING') and source_id % 5 = 0 and target_id - source_id <> 1 then 'Cleanup' else '' end as reasoning from pr", "proposals")
def _(s, d):
    p = en.proposals(s, d).withColumn("reasoning", F.lit(""))
    ok = F.col("target_id") % 2 == 0
    v = p.filter("(source_id + target_id) % 7 = 0").select("source_id", "target_id", F.when(ok, "APPROVED").otherwise("REJECTED").alias("status"), F.when(ok, "same").otherwise("other").alias("reasoning"))
    sources = p.filter("source_id % 5 = 0").select("source_id", F.lit("Cleanup").alias("reason"))
    return li.reject_for_sources(li.set_proposals(p, v, en.as_of()), sources, en.as_of(), keep=p.filter("target_id - source_id = 1")).select("source_id", "target_id", "status", "reasoning")


def _processed(s, d):
    p = en.proposals(s, d)
    actions = p.select("source_id", "target_id", en.pick(("merge", "reject", "new_event", "none"), F.col("source_id") + F.col("target_id")).alias("action"))
    return li.process_proposals(p, actions, en.as_of(), of_articles=True)


@query("q16_process_proposals", "select source_id, target_id, case when status = 'PENDING' and (source_id + target_id) % 4 in (1, 2) then 'REJECTED' else status end as status from pr", "proposals")
def _(s, d):
    return _processed(s, d).proposals.select("source_id", "target_id", "status")


@query("q16_what_follows", "select 'merge' as kind, source_id as a, target_id as b from pr where status = 'PENDING' and (source_id + target_id) % 4 = 0 union all select 'new_event', source_id, null from pr where status = 'PENDING' and (source_id + target_id) % 4 = 2", "proposals")
def _(s, d):
    x = _processed(s, d)
    return x.merges.select(F.lit("merge").alias("kind"), F.col("victim_id").alias("a"), F.col("survivor_id").alias("b")).unionByName(x.new_events.select(F.lit("new_event").alias("kind"), F.col("article_id").alias("a"), F.lit(None).cast("long").alias("b")))


@query("q17_reset_limits", "select o_orderpriority as model, o_orderstatus as metric, count(*) as used from orders where not (o_orderstatus = 'F' and o_orderpriority in (select o_orderpriority from orders where o_orderkey % 97 = 0)) group by 1, 2")
def _(s, d):
    o = en.table(s, d, "orders")
    usage = o.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("metric")).agg(F.count("*").alias("used"))
    return li.reset_limits(usage, o.filter("o_orderkey % 97 = 0").select(F.col("o_orderpriority").alias("model"), F.lit("f").alias("metric")))


@query("q17_edit_feeds", "select name, case when newspaper_id % 2 = 0 then '/en/' else '/old/' end as url_pattern, case when newspaper_id % 3 = 0 then true else false end as is_ranked from newspapers", "newspapers")
def _(s, d):
    feeds = en.newspapers(s, d).select(F.col("newspaper_id").alias("id"), "name", F.lit("/old/").alias("url_pattern"), F.lit(False).alias("is_ranked"))
    edits = feeds.filter("id % 2 = 0 or id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "/en/").alias("url_pattern"), F.when(F.col("id") % 3 == 0, True).alias("is_ranked"))
    return dk.edit_events(feeds, edits).select("name", "url_pattern", "is_ranked")


#: Actions by queue, taken in turn by job id.
_ACTIONS = {
    "filter": ("APPROVED", "APPROVED_WAITING", "REJECTED"), "enricher": ("SUCCESS", "SUCCESS_UNTITLED", "ARCHIVED", "FAILED"), "analyzer": ("SUCCESS", "IRRELEVANT", "ERROR"),
    "cluster": ("MERGE", "NEW", "IGNORED", "PROPOSE", "PROPOSE_MULTI", "ERROR", "UNHEARD"), "enhancer": ("ENHANCED", "DEBOUNCED", "SKIPPED_EMPTY", "SKIPPED_INACTIVE", "ERROR"), "publisher": ("WAIT", "IGNORE", "PUBLISH", "MERGE", "PROPOSE", "ERROR"),
}


def _with_waiting(queue):
    """Of the pending tickets every third waits, so that both states are met."""
    return queue.withColumn("status", F.when((F.col("status") == "PENDING") & (F.col("id") % 3 == 0), "WAITING").otherwise(F.col("status")))


def _routed(queue, key: str):
    action = None
    for q, names in _ACTIONS.items():
        one = en.pick(names, F.floor(F.col("id") / 8).cast("long"))
        action = F.when(F.col("queue_name") == q, one) if action is None else action.when(F.col("queue_name") == q, one)
    results = queue.filter("status = 'PROCESSING'").select("id", action.alias("action"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("reason"), F.when(F.col("queue_name").isin("cluster", "publisher"), F.col(key) + 1000).alias("subject"), F.concat(F.lit("An event with a long title "), F.col(key).cast("string")).alias("title") if key == "event_id" else F.lit(None).cast("string").alias("title"))
    return li.route_results(queue, results, key, en.as_of())


_ACTION_SQL = "case queue_name " + " ".join(f"when '{q}' then {list(names)}[((id // 8) % {len(names)} + 1)::int]" for q, names in _ACTIONS.items()) + " end"
_ROUTE_SQL = f"""
, rt(q, a, st, m, nq, nm, sup) as (values ('filter','APPROVED','COMPLETED','Approved','enricher','Approved by Filter',false), ('filter','APPROVED_WAITING','COMPLETED','Approved','analyzer','Approved by Filter',false), ('filter','REJECTED','COMPLETED','Rejected by Filter',null,null,false),
  ('enricher','SUCCESS','COMPLETED','@','analyzer','Enrichment Complete',false), ('enricher','SUCCESS_UNTITLED','COMPLETED','@','filter','Enrichment Complete',false), ('enricher','ARCHIVED','COMPLETED','Archived: @',null,null,false), ('enricher','FAILED','FAILED','@',null,null,false),
  ('analyzer','SUCCESS','COMPLETED','@','cluster','Analyzed Successfully',false), ('analyzer','IRRELEVANT','COMPLETED','@',null,null,false), ('analyzer','ERROR','FAILED','@',null,null,false),
  ('cluster','MERGE','COMPLETED','@','enhancer','From Cluster: @',false), ('cluster','NEW','COMPLETED','@','enhancer','From Cluster: @',false), ('cluster','IGNORED','COMPLETED','@',null,null,false), ('cluster','PROPOSE','COMPLETED','Parked: @',null,null,false), ('cluster','PROPOSE_MULTI','COMPLETED','Parked: @',null,null,false), ('cluster','ERROR','FAILED','@',null,null,false),
  ('enhancer','ENHANCED','COMPLETED','ENHANCED: @','publisher','Enhanced',true), ('enhancer','DEBOUNCED','COMPLETED','DEBOUNCED: @','publisher','Debounced: Volume Update Only',true), ('enhancer','SKIPPED_EMPTY','COMPLETED','SKIPPED_EMPTY: @',null,null,true), ('enhancer','SKIPPED_INACTIVE','COMPLETED','SKIPPED_INACTIVE: @',null,null,true), ('enhancer','ERROR','FAILED','ERROR: @',null,null,false),
  ('publisher','WAIT','WAITING','@',null,null,false), ('publisher','IGNORE','COMPLETED','@',null,null,true), ('publisher','PUBLISH','COMPLETED','@',null,null,true), ('publisher','MERGE','COMPLETED','@','enhancer','Merged with #',true), ('publisher','PROPOSE','COMPLETED','@',null,null,true), ('publisher','ERROR','FAILED','@',null,null,false)),
w as (select *, case when status = 'PROCESSING' then {_ACTION_SQL} end as act, 'r' || (id % 3) as reason from jobs),
x as (select w.*, rt.* from w left join rt on rt.q = w.queue_name and rt.a = w.act),
o as (select subject_key as k, q, max(struct_pack(c := created_at, i := id)) as b from x where sup group by 1, 2)
"""
_DONE_SQL = "select id, case when st is not null then st when (status = 'PENDING' or (status = 'WAITING' and queue_name = 'publisher')) and created_at <= b.c then 'COMPLETED' else status end as status, case when st is not null then replace(m, '@', reason) when (status = 'PENDING' or (status = 'WAITING' and queue_name = 'publisher')) and created_at <= b.c then 'Superseded by Job ' || b.i else msg end as msg, case when st is not null then attempts + 1 else attempts end as attempts from x left join o on o.k = x.subject_key and o.q = x.queue_name"
_NEXT_SQL = "select case when queue_name in ('cluster', 'publisher') then subject_key + 1000 else subject_key end as subject, nq as queue_name, replace(replace(nm, '@', reason), '#', 'An event with a long') as msg, id as from_id from x where nq is not null"
_ARTICLE_JOBS = ", jobs as (select *, article_id as subject_key from aq)"
_EVENT_JOBS = ", jobs as (select * replace (case when status = 'PENDING' and id % 3 = 0 then 'WAITING' else status end as status), event_id as subject_key from eq)"


@query("q18_article_results_x3", _ARTICLE_JOBS + _ROUTE_SQL + _DONE_SQL, "queue")
def _(s, d):
    return _routed(en.articles_queue(s, d), "article_id").queue.select("id", "status", "msg", "attempts")


@query("q18_article_next_jobs", _ARTICLE_JOBS + _ROUTE_SQL + _NEXT_SQL, "queue")
def _(s, d):
    return _routed(en.articles_queue(s, d), "article_id").next_jobs


@query("q18_event_results_q10", _EVENT_JOBS + _ROUTE_SQL + _DONE_SQL, "queue equeue")
def _(s, d):
    return _routed(_with_waiting(en.events_queue(s, d)), "event_id").queue.select("id", "status", "msg", "attempts")


@query("q18_event_next_jobs", _EVENT_JOBS + _ROUTE_SQL + _NEXT_SQL, "queue equeue")
def _(s, d):
    return _routed(_with_waiting(en.events_queue(s, d)), "event_id").next_jobs


@query("r8_merge_work_set", f"select id, last_updated_at from evs where is_active and last_updated_at >= {T} - interval 48 hour and not exists (select 1 from pr where pr.status in ('PENDING', 'PROCESSING') and (pr.source_id = evs.id or pr.target_id = evs.id)) and id not in (select event_id from eq where queue_name = 'enhancer' and status = 'PROCESSING' and id % 4 = 0) and id % 6 <> 0", "events queue equeue proposals")
def _(s, d):
    e, q = en.events(s, d), en.events_queue(s, d).filter("id % 4 = 0")
    seen = e.filter("id % 6 = 0").select("id", "last_updated_at").unionByName(e.filter("id % 6 = 1").select("id", F.col("created_at").alias("last_updated_at")).filter("id % 48 <> 0"))
    return li.merge_work_set(e, en.proposals(s, d), q, en.as_of(), seen)


def _merged(s, d):
    e = en.events(s, d)
    mapping = e.filter("id % 4 = 1").select(F.col("id").alias("victim_id"), (F.col("id") - 1).alias("survivor_id"))
    return li.execute_merges(e.withColumn("merged_into_id", F.lit(None).cast("long")), en.articles(s, d), en.proposals(s, d).withColumn("reasoning", F.lit("")), en.events_queue(s, d), mapping, en.as_of(), "test")


@query("r16_merged_events", f"select id, case when id % 4 = 1 then 'MERGED' else status end as status, is_active and id % 4 <> 1 as is_active, case when id % 4 = 1 then id - 1 end as merged_into_id, case when id % 4 = 1 or (id % 4 = 0 and id + 1 in (select id from evs)) then {T} else last_updated_at end as last_updated_at from evs", "events")
def _(s, d):
    return _merged(s, d).events.select("id", "status", "is_active", "merged_into_id", "last_updated_at")


@query("r16_merged_articles", "select id, case when event_id % 4 = 1 then event_id - 1 else event_id end as event_id from articles", "articles")
def _(s, d):
    return _merged(s, d).articles.select("id", "event_id")


@query("r16_merged_proposals", "select source_id, target_id, case when source_id % 4 = 1 or target_id % 4 = 1 then 'REJECTED' else status end as status, case when source_id % 4 = 1 or target_id % 4 = 1 then 'Event merged: test' else '' end as reasoning from pr", "proposals")
def _(s, d):
    return _merged(s, d).proposals.select("source_id", "target_id", "status", "reasoning")


@query("r16_merged_queue", "select eq.id, case when evs.id is not null then 'REJECTED' else eq.status end as status, case when evs.id is not null then 'Event merged: test' else msg end as msg from eq left join evs on evs.id = event_id and evs.id % 4 = 1", "events queue equeue")
def _(s, d):
    return _merged(s, d).queue.select("id", "status", "msg")


def _linked(s, d):
    a = en.articles(s, d)
    return a.select("id", "event_id", "title", "published_date", "source_rank", F.array(F.lit(1.0)).alias("embedding"), tx.search_query(F.col("lang"), F.col("main_topics"), F.array("newspaper")).alias("search_text"))


@query("r17_new_events", f"select id + 1000000 as id, id as article_id, title, 1::bigint as article_count, coalesce(published_date, {T}) as created_at, source_rank as best_source_rank, coalesce(10.0::double / source_rank, 0) as editorial_score, concat_ws(' ', lang, concat_ws(' ', lang, newspaper), coalesce(newspaper, '')) as search_text from articles", "articles")
def _(s, d):
    return li.new_events(_linked(s, d), en.as_of(), F.col("id") + 1_000_000).select("id", "article_id", "title", "article_count", "created_at", "best_source_rank", "editorial_score", "search_text")


@query("r17_linked_articles", f", r as (select event_id, count(*) as n, min(published_date) as f, max(published_date) as l, min(source_rank) as rank, coalesce(sum(10.0::double / source_rank), 0) as score from articles group by 1) select id, article_count + coalesce(n, 0) as article_count, least(created_at, f) as first_article_date, case when n is null then created_at else greatest(created_at, l) end as last_article_date, rank as best_source_rank, round(hot_score + coalesce(score, 0), 6) as editorial_score, case when n is null then last_updated_at else {T} end as last_updated_at from evs left join r on event_id = id", "articles events")
def _(s, d):
    e = en.events(s, d).withColumns({"first_article_date": F.col("created_at"), "last_article_date": F.col("created_at"), "best_source_rank": F.lit(None).cast("long"), "editorial_score": F.col("hot_score"), "search_text": F.lit("old")})
    return li.link_articles(e, _linked(s, d), en.as_of()).select("id", "article_count", "first_article_date", "last_article_date", "best_source_rank", F.round("editorial_score", 6).alias("editorial_score"), "last_updated_at")


@query("r6_r17_sequence")
def _(s, d):
    """All articles, four at a time about one vector that is mixed with the next by one of five weights, in sequence."""
    v = en.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = v.count()
    topic = F.floor(F.col("id") / 4) % n
    a = en.articles(s, d).withColumns({"_a": topic, "_b": (topic + 1) % n, "_w": F.element_at(F.array(*map(F.lit, (0.0, 0.2, 0.4, 0.6, 1.5))), (F.col("id") % 5 + 1).cast("int"))})
    a = a.join(v.select(F.col("vec_id").alias("_a"), F.col("v").alias("va")), "_a").join(v.select(F.col("vec_id").alias("_b"), F.col("v").alias("vb")), "_b")
    a = a.select("id", (F.col("published_date") + F.expr("make_dt_interval(0, cast(id % 3 as int))")).alias("at"), "published_date", F.zip_with("va", "vb", lambda x, y: 0.95 * x + F.col("_w") * y).alias("embedding"), se.tokens(F.col("title")).alias("words"), (F.col("id") + 1_000_000_000).alias("new_id"))
    texts = en.table(s, d, "documents").select(F.col("doc_id").alias("id"), se.tokens(F.substring("text", 1, 60)).alias("words"))
    e = en.events(s, d).join(texts, "id", "left")
    done = sq.cluster_in_sequence(a, e, block_days=31)
    return done.decisions.select("id", "decision", F.array_join(F.transform("targets", lambda t: t.cast("string")), ",").alias("targets"), "event_id")

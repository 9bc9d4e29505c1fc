"""Golden and boundary cases of single operators."""

import datetime as dt
import math
import random
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.config import DEFAULTS
from tidewire.functions import text as tx
from tidewire.operators import decisions as de
from tidewire.operators import desk as dk
from tidewire.operators import lifecycle as li
from tidewire.operators import queues as qu
from tidewire.operators import rollup as ru
from tidewire.operators import score as sc
from tidewire.operators import search as se
from tidewire.operators.analytics import histogram
from tidewire.operators.components import components
from tidewire.operators.split import apply_split, split_events
from tidewire.plans import registry
from tidewire.sources import backup as ba
from tidewire.sources import harvest as ha
from tidewire.streaming import streams as st

NOW = dt.datetime(2024, 1, 31)


def now():
    return F.expr("timestamp_ntz'2024-01-31 00:00:00'")



def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def scored(spark, age_hours):
    row = (1, 30.0, 1, 3, NOW - dt.timedelta(hours=age_hours), [], None, False, None, 0, 3, 3, ["left"])
    schema = "event_id long, editorial_score double, n_sources long, article_count long, first_article_date timestamp_ntz, topics array<string>, ai_impact int, is_international boolean, clickbait double, supportive long, critical long, independent long, biases array<string>"
    e = spark.createDataFrame([row], schema).withColumn("created_at", F.col("first_article_date"))
    return sc.spectrum_score(e, now()).first()


def test_score_fresh_and_old(spark):
    fresh, old = scored(spark, 0.5), scored(spark, 48)
    assert fresh.hot_score == pytest.approx(17.97, abs=0.01)
    assert set(fresh.insights) == {"LOW_IMPACT", "BREAKING", "INDEPENDENT_COVERAGE", "BS_RIGHT", "BLIND_SPOT"}
    assert fresh.blind_side == "right"
    assert old.hot_score == pytest.approx(0.75, abs=0.01)
    assert "BREAKING" not in old.insights


def test_stance_edges_and_global_mean(spark):
    row = one(spark, *[ru.stance_bucket(F.lit(x)) for x in (-0.35, -0.3499, 0.35, 0.0)])
    assert list(row) == ["critical", "neutral", "supportive", "neutral"]
    a = spark.createDataFrame([(1, "left", -1.0)] * 3 + [(1, "right", 1.0)], "event_id long, bias string, stance double")
    assert ru.global_stance(ru.stance_by_bias(a)).first().stance == 0.0


def test_histogram_ends(spark):
    x = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (1.0,)], "x double")
    assert sorted(r.bucket_no for r in histogram(x, "x", -1.0, 1.0, 10).collect()) == [0, 1, 6, 11]


def test_centroid_is_frozen_and_skips_empty_vectors(spark):
    rows = [(1, 1, NOW, [1.0, 0.0]), (1, 2, NOW, [0.0, 1.0]), (1, 3, NOW, [1.0, 1.0]), (1, 4, NOW, [])]
    v = spark.createDataFrame(rows, "event_id long, id long, published_date timestamp_ntz, embedding array<double>")
    assert ru.centroid(v).first().embedding == pytest.approx([2 / 3, 2 / 3])
    many = v.sparkSession.range(501).select(F.lit(1).alias("event_id"), "id", (now() + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("published_date"), F.array(F.when(F.col("id") == 500, 1000.0).otherwise(1.0)).alias("embedding"))
    assert ru.centroid(many).first().embedding == [1.0]


def test_archive_edges(spark):
    rows = [(1, 8, 10.0), (2, 8, 50.0), (3, 14, 90.0), (4, 15, 90.0)]
    e = spark.createDataFrame([(i, NOW - dt.timedelta(days=d), s, "PUBLISHED", True) for i, d, s in rows], "id long, created_at timestamp_ntz, hot_score double, status string, is_active boolean")
    assert {r.id: r.status for r in qu.archive(e, now()).collect()} == {1: "ARCHIVED", 2: "PUBLISHED", 3: "PUBLISHED", 4: "ARCHIVED"}


def test_janitor_keeps_failed_and_recent(spark):
    rows = [(1, "COMPLETED", 8), (2, "COMPLETED", 5), (3, "FAILED", 30), (4, "PROCESSING", 1), (5, None, 30)]
    q = spark.createDataFrame([(i, s, NOW - dt.timedelta(days=d)) for i, s, d in rows], "id long, status string, updated_at timestamp_ntz")
    assert {r.id: r.status for r in qu.janitor(q, now()).collect()} == {2: "COMPLETED", 3: "FAILED", 4: "PENDING", 5: None}


def test_cluster_decision_edges(spark):
    a = spark.createDataFrame([(i, NOW - dt.timedelta(days=d), v) for i, d, v in ((1, 1, True), (2, 1, True), (3, 1, True), (4, 9, True), (5, 1, False), (6, 1, True), (7, 1, True))], "article_id long, published_date timestamp_ntz, has_vector boolean")
    c = spark.createDataFrame([(1, 10, 0.05, 0.03), (2, 11, 0.18, 0.03), (3, 12, 0.1, 0.03), (7, 13, 0.01, 0.03), (7, 14, 0.02, 0.02)], "article_id long, event_id long, distance double, rrf double").withColumns({"last_updated_at": now(), "article_count": F.lit(1).cast("long")})
    got = {r.article_id: r.decision for r in de.cluster_decision(a, c, now()).collect()}
    assert got == {1: "MERGE", 2: "MERGE", 3: "PROPOSE", 4: "IGNORED", 5: "ERROR", 6: "NEW", 7: "PROPOSE_MULTI"}


def labels(v, hours):
    """Groups of one event's articles, row by row over the whole matrix of distances."""
    n = len(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = np.round(1 - unit @ unit.T + np.minimum(0.15 * np.abs(hours[:, None] - hours[None, :]) / 24, 0.5), 9)
    near = dist <= min(9 / n, 0.7)
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            label[i] = min(label[j] for j in range(n) if near[i, j])
    alone = [near[i].sum() < 2 for i in range(n)]
    firsts = sorted({label[i] for i in range(n) if not alone[i]})
    if not firsts or n < 3:
        return None
    # Rows are in order of time, so the smallest label is a group's oldest article.
    for i in range(n):
        if alone[i]:
            best = min(firsts, key=lambda f: (dist[i, f], f))
            label[i] = best if dist[i, best] <= 0.25 else i
    groups = sorted(set(label), key=lambda g: min(i for i in range(n) if label[i] == g))
    return [groups.index(g) for g in label] if len(groups) > 1 else None


def test_split_against_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for event, (n, spread, noise) in enumerate([(12, 0, 0.01), (40, 200, 0.05), (25, 30, 0.2), (2, 0, 0.0), (60, 500, 0.1), (15, 5, 0.5), (8, 400, 0.01), (5, 0, 9.0)]):
        v = np.eye(8)[rng.integers(0, 3, n)] + noise * rng.normal(size=(n, 8))
        hours = np.sort(rng.integers(0, spread + 1, n)).astype(float)
        rows += [(event, event * 1000 + i, NOW + dt.timedelta(hours=h), x.tolist()) for i, (x, h) in enumerate(zip(v, hours, strict=True))]
        got = labels(v, hours)
        want |= {event * 1000 + i: g for i, g in enumerate(got)} if got else {}
    a = spark.createDataFrame([*rows, (0, -1, NOW, [1.0]), (0, -2, NOW, None)], "event_id long, id long, published_date timestamp_ntz, embedding array<double>")
    assert {r.id: r.group_no for r in split_events(a, dimension=8).collect()} == want and len(set(want.values())) > 2
    assert split_events(a.limit(0), dimension=8).count() == 0


def test_components_of_chains(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in components(nodes, links).collect()}
    assert got == {i: 0 if i <= 40 else i for i in range(60)}


def test_leaky_bucket(spark):
    assert st.leak(60, 10, 60, 60, 20) == (False, 50.0, 11)
    assert st.leak(60, 10, 60, 60, 10) == (True, 60.0, 0)
    r = spark.createDataFrame([("a", 0.0, 60.0), ("a", 10.0, 20.0), ("a", 21.0, 20.0)], "key string, ts double, cost double")
    got = st.rate_limited_batch(r, 60.0, 60.0).first()
    assert (got.allowed, got.rejected) == (2, 1)


def test_leaky_bucket_against_a_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{k}" if k < 5 else None, float(t), float(c)) for k, t, c in zip(np.minimum(rng.integers(0, 12, 3000), 5), rng.integers(0, 40_000, 3000), rng.integers(1, 30, 3000), strict=True)]
    want = {}
    for key, ts, cost in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        used, last, yes, no = want.get(key, (0.0, None, 0, 0))
        used = max(0.0, used - (0.0 if last is None else ts - last) * 1.0)
        ok = used + cost <= 60
        want[key] = (used + cost if ok else used, ts, yes + ok, no + (not ok))
    got = {r.key: (r.used, r.allowed, r.rejected) for r in st.rate_limited_batch(spark.createDataFrame(rows, "key string, ts double, cost double").repartition(7), 60.0, 60.0).collect()}
    assert got == {k: (pytest.approx(u, abs=1e-6), y, n) for k, (u, _, y, n) in want.items()}
    assert st.rate_limited_batch(spark.createDataFrame([], "key string, ts double, cost double"), 60.0, 60.0).count() == 0


def test_stages_route_fail_and_pass_by(spark):
    jobs = spark.createDataFrame([(1, "filter", "PENDING", ""), (2, "filter", "PENDING", ""), (3, "enricher", "FAILED", "old"), (4, "other", "PENDING", "x")], "id long, queue_name string, status string, msg string")
    one_ = lambda df: df.select("id", F.lit("ok").alias("outcome"), F.when(F.col("id") == 1, "enricher").alias("next_queue"), F.when(F.col("id") == 2, F.lit("e" * 900)).alias("error"))
    two = lambda df: df.select("id", F.lit("rich").alias("outcome"), F.lit(None).cast("string").alias("next_queue"), F.lit(None).cast("string").alias("error"))
    got = {r.id: (r.queue_name, r.status, r.msg) for r in st.run_stages(jobs, [("filter", one_), ("enricher", two)]).collect()}
    assert got == {1: ("enricher", "COMPLETED", "rich"), 2: ("filter", "FAILED", "e" * 500), 3: ("enricher", "FAILED", "old"), 4: ("other", "PENDING", "x")}


def test_dump_and_restore(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1, "x|y", None), (2, None, [1, 2])], "id long, name string, v array<int>")}
    ba.dump_tables(t, str(tmp_path))
    back = ba.restore_tables(spark, str(tmp_path), {k: df.schema for k, df in t.items()})
    assert sorted(back["a"].collect()) == sorted(t["a"].collect())
    assert ba.markdown_rows(t["a"].select("id", "name")).first().line == "| 1 | x\\|y |" and ba.markdown_head(t["a"], id="No") == "| No | name | v |\n| --- | --- | --- |"


def test_page_links(spark):
    html = "<a href='/a'>First  link</a><a href='b/c'>x</a><a href='/a'>Again here</a><a href='https://o.test/z'>Other &amp; more</a><a>no target</a><a href='/d'>Fourth<b> one</b></a>"
    pages = spark.createDataFrame([(1, "https://s.test/x/", html), (2, None, None)], "page_id long, url string, html string")
    got = ha.page_links(pages)
    assert [tuple(r) for r in got.orderBy("position").collect()] == [(1, "https://s.test/a", "First link", 1), (1, "https://o.test/z", "Other & more", 2), (1, "https://s.test/d", "Fourth one", 3)]
    known = spark.createDataFrame([("https://s.test/a?x=1",)], "url string").select(tx.url_hash(F.col("url")).alias("url_hash"))
    assert sorted((r.link, r.ordinal) for r in ha.new_links(got, known, "o[.]test").collect()) == [("https://s.test/d", 2)]


def test_publish_gate_branches(spark):
    cases = [
        (False, 0, None, [], [], 9, "IGNORE", "inactive"), (True, 2, None, [], [], 9, "WAIT", "future"), (True, 1, "WAITING", [], [], 9, "WAIT", "collision"), (True, 1, "AUTO", [], [], 9, "MERGE", "collision"), (True, 1, "PROPOSE", ["Sports"], [], 1, "PROPOSE", "collision"), (True, 0, None, ["sports"], [], 2, "PUBLISH", None), (True, 0, None, ["Sports"], [], 4, "WAIT", "topic"),
        (True, 0, None, ["Sports"], ["BREAKING"], 1, "PUBLISH", None), (True, 0, None, ["Sports"], [], 5, "PUBLISH", None), (True, 0, None, ["Politics"], [], 1, "WAIT", "volume"),
        (True, 0, None, ["Politics"], ["BLIND_SPOT"], 1, "PUBLISH", None), (True, 1, None, None, ["HIGH_IMPACT"], 1, "PUBLISH", None), (None, 0, None, [], [], 9, "IGNORE", "inactive"),
    ]
    e = spark.createDataFrame([(i, a, NOW + dt.timedelta(hours=h), c, t, m, n) for i, (a, h, c, t, m, n, _, _) in enumerate(cases)], "id int, is_active boolean, first_article_date timestamp_ntz, collision string, topics array<string>, insights array<string>, article_count long")
    assert {r.id: (r.decision, r.reason) for r in sc.publish_gate(e, now()).collect()} == {i: c[6:] for i, c in enumerate(cases)}


def test_search_for_its_own_words(spark):
    rows = [(1, [1.0, 0.0], ["a", "b", "c"], True), (2, [1.0, 0.1], ["b", "x", "a"], True), (3, [0.0, 1.0], ["a"], True), (4, [1.0, 0.0], ["a", "b"], False), (5, [0.0, 0.0], ["q"], True)]
    e = spark.createDataFrame(rows, "id long, centroid array<double>, toks array<string>, is_active boolean").withColumns({"created_at": now(), "last_updated_at": now()})
    found = se.find_duplicates(e, e.filter("id = 1").withColumn("toks", F.array(F.lit("a"), F.lit("b")))).collect()
    assert sorted(r.id for r in found) == [2, 3] and max(found, key=lambda r: r.rrf_score).id == 2
    alone = se.hybrid_search(e, se.TextQuery.parse("a b"), [1.0, 0.0], now()).collect()
    assert [r.id for r in alone][:2] == [1, 2] and {r.id for r in alone} == {1, 2, 3}
    words = se.find_duplicates(e, e.filter("id = 5")).collect()
    assert words == []


def test_firewall_and_lock_key(spark):
    row = one(spark, tx.is_firewall_page(F.lit("x" * 995 + "captcha")), tx.is_firewall_page(F.lit(None).cast("string")), tx.lock_key(F.lit("abc")), tx.wrapped_json(F.lit('[{"a":1}]'), "items"), tx.wrapped_json(F.lit('{"a":1}'), "items"), tx.wrapped_json(F.lit('{"items":[]}'), "items"))
    assert list(row) == [False, False, 891568578, '{"items":[{"a":1}]}', '{"items":[{"a":1}]}', '{"items":[]}']


def test_guards_and_first_per_key(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", NOW, 1), ("a", NOW + dt.timedelta(minutes=1), 2), ("b", NOW + dt.timedelta(hours=9), 3)], "key string, ts timestamp, n int").coalesce(1).write.parquet(src)
    stream = st.event_stream(spark, src, spark.read.parquet(src).schema)
    guarded = st.guard_future(spark.read.parquet(src), "ts", now().cast("timestamp"))
    assert sorted(r.n for r in guarded.filter("ts is null").collect()) == [3]
    q = st.first_per_key(stream, "ts", "1 hour", "key").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.table("firsts").collect()) == ["a", "b"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", NOW + dt.timedelta(minutes=m), 60.0 if m == 0 else 1.0) for m in (0, 1, 50, 70)]
    spark.createDataFrame(rows, "key string, ts timestamp, cost double").write.parquet(src)
    stream = st.event_stream(spark, src, spark.read.parquet(src).schema)
    q = st.tumbling_counts(stream, "ts", "1 hour", "10 minutes", "key").writeStream.format("memory").queryName("slots").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("slots").collect()) == [1, 3]
    seconds = stream.select("key", F.unix_timestamp("ts").cast("double").alias("ts"), "cost")
    q = st.rate_limited(seconds, 60.0, 60.0).writeStream.format("memory").queryName("limits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.allowed for r in spark.table("limits").orderBy("ts").collect()] == [True, True, True, True]


def test_urls_and_texts(spark):
    url = [tx.url_date(F.lit(u)) for u in ("https://a/2024/01/02/x", "https://a/2024-1-2", "https://a/2024/13/40")]
    row = one(spark, tx.url_hash(F.lit("https://a/b?x=1")) == tx.url_hash(F.lit("https://a/b")), *url)
    assert list(row) == [True, dt.date(2024, 1, 2), dt.date(2024, 1, 2), None]
    long = "k" * 160 + " leia também"
    cut = one(spark, tx.cut_at_stop_line(F.lit("body text\nLeia também: x\nrest"), ["leia também"]), tx.cut_at_stop_line(F.lit(f"body\n{long}\nend"), ["leia também"]))
    assert list(cut) == ["body text", f"body\n{long}\nend"]
    j = one(spark, tx.repaired_json(F.lit('<think>x</think>```json\n{"a": 1}\n```')), tx.repaired_json(F.lit("none")))
    assert list(j) == ['{"a": 1}', None]
    assert sc.topic_product(F.array(F.lit("politics"), F.lit("Mercado da Bola"))) is not None
    assert one(spark, sc.topic_product(F.array(F.lit("politics"), F.lit("Mercado da Bola"))))[0] == 1.5


def test_text_queries(spark):
    df = spark.createDataFrame([(1, "The red fox jumps"), (2, "red blue"), (3, "a fox that is red"), (4, None)], "id long, text string").withColumn("toks", se.tokens(F.col("text")))
    hits = lambda q: sorted(r.id for r in se.text_search(df, se.TextQuery.parse(q)).collect())
    assert hits("red fox") == [1, 3]
    assert hits('"red fox"') == [1]
    assert hits("red -fox") == [2]
    assert hits('"red fox" or blue') == [1, 2]


def test_feeds(spark):
    xml = '<rss><item><title><![CDATA[One]]></title><link>https://a/1</link><pubDate>x</pubDate></item></rss><feed><entry><title>Two</title><link href="https://a/2"/><published>y</published></entry></feed>'
    got = ha.feed_items(spark.createDataFrame([(1, xml)], "feed_id long, xml string")).collect()
    assert [(r.title, r.link, r.published, r.content) for r in got] == [("One", "https://a/1", "x", "Unknown"), ("Two", "https://a/2", "y", "Unknown")]
    maps = spark.createDataFrame([(1, "<urlset><url><loc> https://a/9 </loc></url></urlset>")], "feed_id long, xml string")
    assert [r.link for r in ha.sitemap_urls(maps).collect()] == ["https://a/9"]
    api = spark.createDataFrame([('{"items":[{"config":{"order":{"data":{"title":"T","linkExterno":"","url":"/u","createdAt":"2024"}}}}]}',)], "json string")
    assert ha.api_items(api, "https://s").first().link == "https://s/u"


def test_dissolve_requeues_articles_and_clears_the_rest(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    articles = spark.createDataFrame([(10, 1, "x", 0.5), (11, 2, "y", 0.1), (12, 1, "z", None)], "id long, event_id long, title string, stance double")
    queue = spark.createDataFrame([(10, "FAILED", "filter", NOW - dt.timedelta(days=9), NOW, 3, "old"), (11, "COMPLETED", "cluster", NOW, NOW, 1, "ok")], "article_id long, status string, queue_name string, created_at timestamp_ntz, updated_at timestamp_ntz, attempts int, msg string")
    jobs = spark.createDataFrame([(1, "PENDING"), (2, "PENDING")], "event_id long, status string")
    proposals = spark.createDataFrame([(1, 2), (3, 1), (2, 4), (None, 2)], "source_id long, target_id long")
    out = dk.dissolve(events, articles, queue, jobs, proposals, spark.createDataFrame([(1,), (1,)], "id long"), now())
    assert [r.id for r in out.events.collect()] == [2]
    assert sorted((r.id, r.event_id, r.title, r.stance) for r in out.articles.collect() if r.id != 11) == [(10, None, "Unknown", None), (12, None, "Unknown", None)]
    rows = {r.article_id: (r.status, r.queue_name, r.created_at, r.attempts, r.msg) for r in out.articles_queue.collect()}
    again = "Dissolved from Event 1"
    assert rows == {10: ("PENDING", "enricher", NOW - dt.timedelta(days=9), 3, again), 11: ("COMPLETED", "cluster", NOW, 1, "ok"), 12: ("PENDING", "enricher", NOW, 0, again)}
    assert [r.event_id for r in out.events_queue.collect()] == [2]
    assert sorted((r.source_id or 0, r.target_id) for r in out.proposals.collect()) == [(0, 2), (2, 4)]


def test_split_leaves_busy_and_whole_events(spark):
    rows = [(1, i, None if i == 2 else 5, NOW) for i in (1, 2, 3)] + [(2, 4, 1, NOW), (2, 5, 1, NOW), (3, 6, 1, NOW)]
    a = spark.createDataFrame(rows, "event_id long, id long, source_rank long, published_date timestamp_ntz")
    groups = a.select("event_id", "id", F.when(F.col("id").isin(2, 5), 1).otherwise(0).alias("group_no"))
    busy = spark.createDataFrame([(2, "enhancer", "PROCESSING")], "event_id long, queue_name string, status string")
    out = apply_split(a, groups, busy, F.col("event_id") * 100 + F.col("seed_id"))
    assert {r.id: r.event_id for r in out.articles.collect()} == {1: 1, 2: 102, 3: 1, 4: 2, 5: 2, 6: 3}
    assert [(r.id, r.parent_id, r.article_count) for r in out.events.collect()] == [(102, 1, 1)]
    assert sorted(r.event_id for r in out.jobs.collect()) == [1, 102]



def test_merge_decision_branches(spark):
    """Survivor, entity gate below 0.13 only, keyword rescue."""
    cases = [
        ("DRAFT", "DRAFT", 0.01, 0.0, [], [], "MERGE", 2), ("PUBLISHED", "DRAFT", 0.01, 0.0, [], None, "MERGE", 1), ("DRAFT", "PUBLISHED", 0.01, 0.0, ["a"], ["a"], "MERGE", 2), (None, None, 0.01, 0.0, ["a"], ["a"], "MERGE", 2),
        ("PUBLISHED", "PUBLISHED", 0.01, 0.0, [], [], "PROPOSE", None), ("DRAFT", "DRAFT", 0.01, 0.01, ["a"], ["b"], None, None), ("DRAFT", "DRAFT", 0.01, 0.02, ["a"], ["b"], "MERGE", 2), ("DRAFT", "DRAFT", 0.09, 0.9, [], ["b"], None, None),
        ("DRAFT", "DRAFT", 0.09, 0.0, ["a", "b"], ["b"], "PROPOSE", None), ("DRAFT", "DRAFT", 0.15, 0.03, None, None, "PROPOSE", None), ("DRAFT", "DRAFT", 0.15, 0.02, ["a"], ["a"], None, None), ("DRAFT", "DRAFT", 0.22, 0.9, ["a"], ["a"], None, None),
    ]
    rows = [(10 * i + 1, 10 * i + 2, *c[:6], False) for i, c in enumerate(cases)]
    p = spark.createDataFrame(rows, "event_id long, other_id long, status string, other_status string, distance double, rrf double, names array<string>, other_names array<string>, blocked boolean")
    got = {r.event_id // 10: (r.action, r.survivor and r.survivor % 10) for r in de.merge_decision(p).collect()}
    assert got == {i: c[6:] for i, c in enumerate(cases) if c[6]}


def test_several_targets_are_of_the_first_three(spark):
    a = spark.createDataFrame([(1, NOW, True)], "article_id long, published_date timestamp_ntz, has_vector boolean")
    c = spark.createDataFrame([(1, i, d, 1.0 - i / 10, NOW, 1) for i, d in enumerate([0.01, 0.02, 0.5, 0.03])], "article_id long, event_id long, distance double, rrf double, last_updated_at timestamp_ntz, article_count long")
    assert [tuple(r) for r in de.cluster_decision(a, c, now()).collect()] == [(1, "PROPOSE_MULTI", [0, 1])]


def test_older_tickets_are_pruned(spark):
    """The publisher's waiting tickets go with its pending ones, the enhancer's stay; newer and other tickets stay."""
    hour = lambda h: NOW + dt.timedelta(hours=h)
    q = [(1, 7, "publisher", "PROCESSING", 5), (2, 7, "publisher", "WAITING", 1), (3, 7, "publisher", "PENDING", 5), (4, 7, "publisher", "WAITING", 6), (5, 8, "publisher", "WAITING", 1), (6, 7, "enhancer", "PROCESSING", 5), (7, 7, "enhancer", "WAITING", 1), (8, 7, "enhancer", "PENDING", 1), (9, 7, "publisher", "FAILED", 1)]
    queue = spark.createDataFrame([(i, e, n, s, "", 0, hour(h), hour(h)) for i, e, n, s, h in q], "id long, event_id long, queue_name string, status string, msg string, attempts int, created_at timestamp_ntz, updated_at timestamp_ntz")
    results = spark.createDataFrame([(1, "MERGE", "why", 9, "A title of more than twenty"), (6, "ENHANCED", "ok", None, None)], "id long, action string, reason string, subject long, title string")
    done = li.route_results(queue, results, "event_id", now())
    assert {r.id: r.status for r in done.queue.collect()} == {1: "COMPLETED", 2: "COMPLETED", 3: "COMPLETED", 4: "WAITING", 5: "WAITING", 6: "COMPLETED", 7: "WAITING", 8: "COMPLETED", 9: "FAILED"}
    assert sorted((r.subject, r.queue_name, r.msg) for r in done.next_jobs.collect()) == [(7, "publisher", "Enhanced"), (9, "enhancer", "Merged with A title of more than")]


def test_chains_of_merged_events_that_do_not_end(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 4)], "id long, merged_into_id long")
    assert {r.id: r.survivor for r in de.resolve_survivors(e).collect()} == {1: 3, 2: 3, 3: 3, 4: 4}
    with pytest.raises(RuntimeError):
        de.resolve_survivors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, merged_into_id long"), depth=3)


def test_cover_density_by_trying_all_stretches(spark):
    """Known ranks, then random texts and queries against every stretch of every text."""
    known = [('idiot or "of the"', "an idiot spoke", 0.1), ('idiot or "of the"', "end of the day", 0.1), ("of the", "of x x the idiot", 0.1 / 3), ("of the", "of the", 0.1), ("a", "a b a", 0.2), ('"a a"', "a a a", 0.2), ("a b", "a b a", 0.2), ("z", "a", 0.0)]
    rng = random.Random(2)
    for q in ["a b", "a b c", '"a b" or c', '"a b a" d or "b b" -c', "a or b or c d", '"a b" b', 'a "c a" or "a a"']:
        for _ in range(25):
            words = rng.choices("abcdx", k=rng.randrange(0, 25))
            query = se.TextQuery.parse(q)
            at = [{p: [i for i in range(len(words)) if words[i : i + len(p)] == list(p)] for p in {tuple(p) for p in need}} for need, _ in query.alternatives]
            good = lambda i, j: any(all(any(i <= x and x + len(p) - 1 <= j for x in where) for p, where in a.items()) for a in at)  # noqa: B023, E731
            covers = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if good(i, j) and not (i < j and (good(i + 1, j) or good(i, j - 1)))]
            known.append((q, " ".join(words), sum(0.1 / (1 + sum(w not in query.words for w in words[i : j + 1])) for i, j in covers)))
    rows = spark.createDataFrame([(i, q, t.split()) for i, (q, t, _) in enumerate(known)], "id long, q string, toks array<string>").cache()
    for q in {k[0] for k in known}:
        for x in rows.filter(F.col("q") == q).select("id", se.cover_density(F.col("toks"), se.TextQuery.parse(q)).alias("r")).collect():
            assert x.r == pytest.approx(known[x.id][2]), known[x.id]


def test_blocks_find_what_pairs_find(spark):
    rng = random.Random(3)
    day, words = NOW.replace(tzinfo=None), "abcdefgh"
    events = [(i, [rng.choice((0.0, 1.0, 2.0)) for _ in range(3)], [rng.choice(words) for _ in range(rng.randrange(9))], day + dt.timedelta(hours=rng.randrange(200)), rng.random() < 0.9) for i in range(150)]
    queries = [(q, rng.sample(words, rng.randrange(4)) if q % 7 else [events[q][2][0] if events[q][2] else "a"] * 2, events[q][1] if q % 5 else None, day + dt.timedelta(hours=rng.randrange(200))) for q in range(40)]
    e = spark.createDataFrame(events, "id long, centroid array<double>, toks array<string>, created_at timestamp_ntz, is_active boolean").withColumn("last_updated_at", F.col("created_at"))
    q = spark.createDataFrame(queries, "qid long, words array<string>, vector array<double>, target timestamp_ntz")
    s = replace(DEFAULTS, rrf_depth=4)
    near, worded, want = {}, {}, {}
    for qid, asked, v, t in queries:
        there = [x for x in events if x[4] and t - dt.timedelta(days=5) <= x[3] <= t]
        dist = {x[0]: 1 - sum(a * b for a, b in zip(v, x[1])) / (math.hypot(*v) * math.hypot(*x[1])) for x in there if v and any(v) and any(x[1])}
        near[qid] = sorted(dist, key=lambda i: (round(dist[i], 9), i))[:4]
        rank = {x[0]: covers(x[2], set(asked)) for x in there if asked and set(asked) <= set(x[2])}
        worded[qid] = sorted(rank, key=lambda i: (-round(rank[i], 9), i))[:4]
        score = {i: sum(1 / (61 + side.index(i)) for side in (near[qid], worded[qid]) if i in side) / (1 + 0.05 * abs((t - events[i][3]).total_seconds()) / 3600) for i in {*near[qid], *worded[qid]}}
        want[qid] = sorted(score, key=lambda i: (-round(score[i], 9), i))[:10]
    got = {}
    for r in sorted(se.hybrid_search_many(q, e, s).collect(), key=lambda r: (r.qid, -round(r.rrf_score, 9), r.id)):
        got.setdefault(r.qid, []).append(r.id)
    assert got == {k: v for k, v in want.items() if v}
    # No query takes more than its best events out of a block, however many there are.
    assert max(r["count"] for r in se.worded_events(q, e, 4, 0).groupBy("qid").count().collect()) <= 4


def covers(toks, asked, weight=0.1):
    places = [i for i, w in enumerate(toks) if w in asked]
    spans = [(a, b) for a in places for b in places if a <= b and asked <= set(toks[a : b + 1])]
    shortest = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    return sum(weight / (1 + (b - a + 1) - sum(a <= p <= b for p in places)) for a, b in shortest)


def test_words_told_before_texts_are_split(spark):
    texts = ["The idiot!", "idiots les", "Clown", "les clown, \u00e9t\u00e9 \U0001f600x-A1", "", None, "of--THE", "oft he", "\x00a\x7fb  ", "of a the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    old = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(se.WORD), F.lit(0))
    assert df.filter(~old.eqNullSafe(se.tokens(F.col("text")))).count() == 0
    for text, may in (("idiot -les or clown", {0, 1, 2, 3}), ('idiot or "of the"', {0, 1, 6, 9}), ("", set())):
        q = se.TextQuery.parse(text)
        assert {r.id for r in df.filter(q.may_match(F.col("text"))).collect()} == may
        hits = {r.id for r in se.text_search(df.withColumn("toks", se.tokens(F.col("text"))), q).collect()}
        assert hits <= may


def test_candidates_are_ranked_before_they_meet_articles(spark, sf):
    c = registry._r6_candidates(spark, sf)
    assert max(r["count"] for r in c.groupBy("article_id").count().collect()) <= DEFAULTS.search_limit


def test_articles_without_newspaper_found_events(spark, tmp_path, sf):
    for t in ("documents", "embeddings"):
        x = spark.read.parquet(f"{sf}/{t}.parquet")
        (x.withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source"))) if t == "documents" else x).write.parquet(f"{tmp_path}/{t}.parquet")
    got = {r.article_id: r.search_text for r in registry.QUERIES["r17_new_events"](spark, str(tmp_path)).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(registry.ORACLE_SQL["r17_new_events"])
    at = [c[0] for c in cur.description]
    assert got == {r[at.index("article_id")]: r[at.index("search_text")] for r in cur.fetchall()}


def test_window_pairs_are_whole_and_written_small(spark, tmp_path):
    moment = lambda c, p: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({c} * {p} % 864000 as int))")
    q = spark.range(3000).select(F.col("id").alias("qid"), moment("id", 43 * 60).alias("target"))
    e = spark.range(2000).select("id", moment("id", 83 * 60).alias("created_at"))
    se.candidates_by_day(q, e, 5).select("qid", "id").write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    plain = q.join(e, (F.col("created_at") <= F.col("target")) & (F.col("created_at") >= F.col("target") - F.expr("make_dt_interval(5)"))).select("qid", "id")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("qid", "id").cast("decimal(38,0)"))).first()
    assert digest(found) == digest(plain) and digest(found)[0] > 1_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * digest(found)[0]


def test_window_pairs_at_the_edges_of_blocks_and_windows(spark):
    t, us = dt.datetime(2024, 1, 10), dt.timedelta(microseconds=1)
    at = [t + dt.timedelta(days=d) + k * us for d in (-6, -5, -2, 0) for k in (-1, 0, 1)]
    events = [*enumerate(at), (3, at[3]), (50, None), (None, at[5]), *((100 + i, t - dt.timedelta(days=2)) for i in range(40))]
    queries = [(0, t), (1, t - us), (2, t + us), (2, t + us), (3, None), (4, t + dt.timedelta(days=4)), (5, t - dt.timedelta(days=9)), *((10 + i, t) for i in range(20))]
    want = Counter((q, e) for q, a in queries for e, c in events if a and c and a - dt.timedelta(days=5) <= c <= a)
    q, e = spark.createDataFrame(queries, "qid long, target timestamp_ntz"), spark.createDataFrame(events, "id long, created_at timestamp_ntz")
    for how in ({}, {"rows": (7, 30), "step": 11, "per_task": 100}, {"rows": (1, 1), "step": 1}):
        assert Counter((r["qid"], r["id"]) for r in se.candidates_by_day(q, e, 5, **how).collect()) == want
    assert se.candidates_by_day(q.filter("false"), e, 5).count() == se.candidates_by_day(q, e.filter("false"), 5).count() == 0

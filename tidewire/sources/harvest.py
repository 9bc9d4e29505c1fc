"""Harvested pages, feeds and sitemaps as tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import url_hash


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = True
            self.found.append([dict(attrs).get("href") or "", ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.found[-1][1] += data


def page_links(pages: DataFrame, min_text: int = 5) -> DataFrame:
    """(page_id, link, title, position) of anchors with at least min_text characters of text, each link once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for page_id, base, html in pdf.itertuples(index=False):
                p = _Anchors()
                p.feed(html or "")
                seen: set[str] = set()
                for href, text in p.found:
                    text = " ".join(text.split())
                    link = urljoin(base or "", href)
                    if href and len(text) >= min_text and link not in seen:
                        seen.add(link)
                        rows.append((page_id, link, text, len(seen)))
            yield pd.DataFrame(rows, columns=["page_id", "link", "title", "position"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, link string, title string, position long")


def feed_items(feeds: DataFrame) -> DataFrame:
    """Title, link, published, content of the items or entries of RSS and Atom documents in ``xml``."""
    tags = lambda name: F.regexp_extract("item", rf"(?s)<{name}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    items = feeds.select("feed_id", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), F.lit(0))).alias("item"))
    some = lambda *names: F.coalesce(*[F.nullif(F.trim(tags(n)), F.lit("")) for n in names])
    link = F.coalesce(F.nullif(F.trim(tags("link")), F.lit("")), F.nullif(F.regexp_extract("item", r'<link[^>]*href="([^"]+)"', 1), F.lit("")))
    return items.select("feed_id", some("title").alias("title"), link.alias("link"), some("pubDate", "published", "dc:date").alias("published"), F.coalesce(some("content:encoded", "description"), F.lit("Unknown")).alias("content"))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """Every location of sitemaps in ``xml``."""
    return maps.select("feed_id", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<url>.*?<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("link"), F.lit("Unknown").alias("title"))


def newest_sitemap(locations: DataFrame, pattern: str, key: str = "id") -> DataFrame:
    """Per feed the location with the largest id, date text, or (b, a) of an ``a-b`` number pair."""
    one, two = F.regexp_extract("loc", pattern, 1), F.regexp_extract("loc", pattern, 2) if key == "pair" else F.lit("")
    rank = {"id": F.struct(one.cast("long").alias("k")), "date": F.struct(one.alias("k"))}.get(key) if key != "pair" else F.struct(two.cast("long").alias("k"), one.cast("long").alias("j"))
    return locations.filter(F.col("loc").rlike(pattern)).groupBy("feed_id").agg(F.max_by("loc", F.struct(rank, "loc")).alias("loc"))


def api_items(replies: DataFrame, site: str) -> DataFrame:
    """Title and link of the items of a JSON reply in ``json``; relative links get the site in front."""
    schema = "struct<items:array<struct<config:struct<order:struct<data:struct<title:string,linkExterno:string,url:string,createdAt:string>>>>>>"
    d = replies.select(F.explode(F.from_json("json", schema)["items"]).alias("i")).select("i.config.order.data.*")
    return d.select("title", F.coalesce(F.nullif("linkExterno", F.lit("")), F.concat(F.lit(site), "url")).alias("link"), F.col("createdAt").alias("created_at"))


def recent_or_undated(date: Column, as_of: Column, hours: int = 100) -> Column:
    """unparseable and missing dates pass."""
    parsed = F.coalesce(F.try_to_timestamp(date), F.try_to_timestamp(F.regexp_replace(date, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    return parsed.isNull() | (parsed >= as_of.cast("timestamp") - F.expr(f"make_dt_interval(0, {hours})"))


def new_links(links: DataFrame, known: DataFrame, blocked: str, allowed: str | None = None) -> DataFrame:
    """Links that no pattern blocks and no known hash holds; ordinals are given before hashes go."""
    x = links.filter(~F.col("link").rlike(f"(?i){blocked}"))
    if allowed:
        x = x.filter(F.col("link").rlike(allowed))
    x = x.withColumn("ordinal", F.row_number().over(W.partitionBy("page_id").orderBy("position"))).withColumn("url_hash", url_hash(F.col("link")))
    return x.join(known.select("url_hash"), "url_hash", "left_anti")


def merge_by_link(items: DataFrame) -> DataFrame:
    """One row per link: best rank, first non-empty date and first real content in order of seq."""
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("seq")))
    real = F.coalesce((F.col("content") != "Unknown") & (F.col("content") != ""), F.lit(False))
    return items.groupBy("link").agg(F.min("rank").alias("rank"), first("published", F.coalesce(F.col("published") != "", F.lit(False))).alias("published"), first("content", real).alias("content"))

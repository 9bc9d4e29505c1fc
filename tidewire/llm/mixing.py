"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Native: DataFrame functions only. Points of the golden-ratio sequence, mapped through the sources' cumulative slot
shares, say which source each slot of the mix serves; a source's slots are ranked and joined with its blocks. The
blocks of a source cut its documents, in a shuffled order that depends on a seed only, into equal numbers of words;
once all its blocks are used they are used again in the same order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, text_or_empty

#: 1/phi and phi itself are the same sequence modulo 1.
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class MixSettings:
    """weights repeat over the sources in their order; share is the mix's size as a multiple of all sizes;
    max_repeat bounds how often a source is used; the mix has about ``slots`` slots whatever the input's size;
    ``buckets`` cut each source's shuffled order so that no task sorts a whole source."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    max_repeat: int = 2
    slots: int = 1 << 18
    buckets: int = 256
    seed: str = "mix-1"


def source_targets(sizes: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, stopped at max_repeat times the size.

    Sources by code point, null last. What stops is shared again by weight among the rest until none is above: sorted
    by size over weight, the sources that stop are a prefix, so one running sum finds them. One row per source is all
    that meets here, never rows of documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in s.weights]), ((F.row_number().over(order) - 1) % len(s.weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(s.max_repeat)))
    everything = W.partitionBy()
    w = w.withColumn("budget", F.sum("source_size").over(everything) * F.lit(s.share)).withColumn("all_weight", F.sum("weight").over(everything))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left / rest).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    # The level of the first source that doesn't stop holds for all that don't.
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return w.withColumn("final", final).select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _plan(targets: DataFrame, s: MixSettings) -> DataFrame:
    """Adds quota (whole words to take), block (words in a block), n_blocks and n_slots of each source."""
    everything = W.partitionBy()
    block = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("target").over(everything) / F.lit(float(s.slots))))
    p = targets.withColumn("quota", F.floor("target").cast("long")).withColumn("block", block)
    p = p.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    whole, part = F.expr("quota div source_size"), F.col("quota") % F.col("source_size")
    n_slots = F.when(F.col("source_size") > 0, whole * F.col("n_blocks") + F.ceil(part / F.col("block"))).otherwise(0)
    return p.withColumn("n_slots", n_slots.cast("long"))


def slot_schedule(plan: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """(slot, source, rank, block_no, words): the mix in its order.

    Slot i serves the source whose share of [0, 1) holds frac(i * golden ratio). A source's ranks stop at its n_slots;
    where its points fall short of them - by the sequence's discrepancy, a few slots - the missing ranks follow at the
    end. The last slot of a source takes only the words left of its quota.
    """
    spark = plan.sparkSession
    cells = 1024
    p = plan.filter("n_slots > 0")
    run = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n_slots").over(W.partitionBy()).cast("double")
    p = p.withColumn("hi", F.sum("n_slots").over(run) / total).withColumn("lo", F.col("hi") - F.col("n_slots") / total)
    n = int(p.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0])
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    spans = p.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    points = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}D) % 1D").alias("u"))
    points = points.withColumn("cell", cell(F.col("u")))
    last = F.col("hi") > 1 - 1e-12
    hit = points.join(spans, "cell").filter((F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | last))
    # Ranks by runs of slots, so that a source with most of the slots is not numbered in one task.
    chunk = max(1, n // s.buckets)
    hit = hit.withColumn("run", F.floor(F.col("slot") / chunk))
    counts = hit.groupBy("source", "run").agg(F.count("*").alias("c"))
    ahead = F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s2"), F.col("run").alias("r2"), ahead.alias("ahead"))
    ranked = hit.join(counts, hit["source"].eqNullSafe(counts["s2"]) & (hit["run"] == counts["r2"]))
    rank = F.col("ahead") + F.row_number().over(W.partitionBy("source", "run").orderBy("slot")) - 1
    cols = ["source", "source_size", "quota", "block", "n_blocks", "n_slots"]
    ranked = ranked.withColumn("rank", rank).filter("rank < n_slots").select("slot", "rank", *cols)
    served = ranked.groupBy("source").agg(F.count("*").alias("served"))
    served = served.select(F.col("source").alias("s3"), "served")
    short = p.join(served, p["source"].eqNullSafe(served["s3"]), "left").withColumn("served", F.coalesce("served", F.lit(0).cast("long"))).filter("served < n_slots")
    tail = short.withColumn("rank", F.explode(F.sequence(F.col("served"), F.col("n_slots") - 1))).select((F.lit(n) + F.col("rank")).alias("slot"), "rank", *cols)
    out = ranked.unionByName(tail).withColumn("block_no", F.col("rank") % F.col("n_blocks"))
    before = F.expr("rank div n_blocks") * F.col("source_size") + F.col("block_no") * F.col("block")
    words = F.least(F.col("block"), F.col("source_size") - F.col("block_no") * F.col("block"), F.col("quota") - before)
    return out.withColumn("words", words).filter("words > 0").select("slot", "source", "rank", "block_no", "words")


def _placed(docs: DataFrame, s: MixSettings, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, bucket, rn, offset): where each document lies in its source's shuffled order."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = F.md5(F.concat(F.lit(s.seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), order.alias("ord"))
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * s.buckets / F.lit(float(1 << 32))))
    d = materialize(d, "sizes")
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("b"))
    ahead = F.coalesce(F.sum("b").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), ahead.alias("ahead"))
    d = d.join(sums, d["source"].eqNullSafe(sums["s2"]) & (d["bucket"] == sums["b2"]))
    inside = W.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size")
    offset = F.col("ahead") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return d.select("doc_id", "source", "size", "bucket", F.row_number().over(inside).alias("rn"), offset.alias("offset"))


def mix_sources(docs: DataFrame, s: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target (its source's), taken (words the mix takes), source, first_slot.

    first_slot is the first slot of the schedule in which words of the document stand, null where none are taken: in
    this order the mix is near its weights from its first slots on.

    Size counts runs of characters other than ASCII white space; null and empty texts have size 0 and take 0. A null
    source is a source of its own, the last. Repeated rows each count. A source's taken words are its target rounded
    down, and no document is taken more than max_repeat times its size. The same rows give the same result in any
    partitioning; an empty table gives no rows.
    """
    placed = materialize(_placed(docs, s, id_col, text_col, source_col), "placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(_plan(source_targets(sizes, s), s), "targets")
    used = slot_schedule(plan, s).groupBy("source", "block_no", "words").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    p = plan.select(F.col("source").alias("ps"), "source_size", "target", "block")
    d = placed.join(p, placed["source"].eqNullSafe(p["ps"])).drop("ps")
    first, last = F.expr("offset div block"), F.expr("(offset + size - 1) div block")
    pieces = d.filter("size > 0").withColumn("no", F.explode(F.sequence(first, last)))
    u = used.select(F.col("source").alias("us"), F.col("block_no").alias("un"), "words", "times", "slot")
    pieces = pieces.join(u, pieces["source"].eqNullSafe(u["us"]) & (pieces["no"] == u["un"]))
    start = F.col("no") * F.col("block")
    overlap: Column = F.greatest(F.lit(0).cast("long"), F.least(F.col("offset") + F.col("size"), start + F.col("words")) - F.greatest(F.col("offset"), start))
    taken = pieces.groupBy("source", "bucket", "rn").agg(F.sum(overlap * F.col("times")).alias("taken"), F.min(F.when(overlap > 0, F.col("slot"))).alias("first_slot"))
    t = taken.select(F.col("source").alias("ts"), F.col("bucket").alias("tb"), F.col("rn").alias("tr"), "taken", "first_slot")
    out = d.join(t, d["source"].eqNullSafe(t["ts"]) & (d["bucket"] == t["tb"]) & (d["rn"] == t["tr"]), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_slot")

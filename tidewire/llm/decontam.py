"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words (a whole item where it has fewer). The fingerprint of a window is the minimum
of the hashes of its k-grams, so equal windows have equal fingerprints wherever they stand: every shared span of
WINDOW words is found. Fingerprints of documents are joined with those of the benchmark; a hit is extended to its
whole window, which must agree in 128 bits of hash, and the windows of a document are united to the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import arrowtext as at
from tidewire.llm.common import hash_bitmap, materialize

WINDOW, K = 10, 5


def _windows(words: at.Words, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, fingerprint) of all windows of ``size`` words that lie in one document."""
    m = len(words.hash) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(words.doc[:m] == words.doc[size - 1 :])
    grams = at.roll(words.hash, min(k, size))
    least = grams[:m].copy()
    for j in range(1, size - min(k, size) + 1):
        np.minimum(least, grams[j : j + m], out=least)
    return starts, least[starts]


def benchmark_windows(items: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, fp, h1, h2): the distinct windows of every item with at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in at.slices(batch.column(1)):
                words = at.Words(data, offsets, at.ALNUM, second=True)
                for size in range(1, window + 1):
                    starts, fps = _windows(words, size, k)
                    n = words.count[words.doc[starts]]
                    take = (n >= window) if size == window else (n == size)
                    starts, fps = starts[take], fps[take]
                    if len(starts):
                        items_ = batch.column(0).take(pa.array(row + words.doc[starts]))
                        yield pa.RecordBatch.from_arrays(
                            [items_, pa.array(np.full(len(starts), size, np.int32)), pa.array(at.signed(fps)), pa.array(at.signed(at.roll(words.hash, size)[starts])), pa.array(at.signed(at.roll(words.hash2, size)[starts]))],
                            names=["item", "size", "fp", "h1", "h2"],
                        )

    picked = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return materialize(picked.mapInArrow(run, "item string, size int, fp long, h1 long, h2 long").distinct(), "windows")


def document_hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 23) -> DataFrame:
    """(doc_id, rid, n_words, hits): windows of each document whose fingerprint may be one of the benchmark's.

    A bitmap of fixed size lets few others through. rid is a hash of doc_id and text; it is null without hits.
    """
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` values
    bitmap = docs.sparkSession.sparkContext.broadcast(hash_bitmap(windows, "fp", filter_bits))
    shift = np.uint64(64 - filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for row, data, offsets in at.slices(batch.column(1)):
                words = at.Words(data, offsets, at.ALNUM)
                second, parts = None, []
                for size in sizes:
                    starts, fps = _windows(words, size, k)
                    slot = (fps >> shift).astype(np.int64)
                    hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    starts, fps = starts[hit], fps[hit]
                    if len(starts):
                        second = second or at.Words(data, offsets, at.ALNUM, second=True)
                        parts.append((words.doc[starts], starts - words.first[words.doc[starts]], np.full(len(starts), size), fps, at.roll(words.hash, size)[starts], at.roll(second.hash2, size)[starts]))
                n = words.n_docs
                if parts:
                    doc, pos, size_, fp, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
                    o = np.argsort(doc, kind="stable")
                    doc, pos, size_, fp, h1, h2 = doc[o], pos[o], size_[o], fp[o], h1[o], h2[o]
                else:
                    doc = pos = size_ = np.zeros(0, np.int64)
                    fp = h1 = h2 = np.zeros(0, np.uint64)
                counts = np.bincount(doc, minlength=n)
                ids = batch.column(0).slice(row, n)
                texts = data.tobytes() if len(doc) else b""
                rid = [hashlib.blake2b(f"{i}:".encode() + texts[a:b], digest_size=16).digest() if c else None for i, a, b, c in zip(ids.to_pylist(), offsets[:-1], offsets[1:], counts, strict=True)]
                struct = pa.StructArray.from_arrays([pa.array(pos, pa.int64()), pa.array(size_, pa.int32()), pa.array(at.signed(fp)), pa.array(at.signed(h1)), pa.array(at.signed(h2))], names=["pos", "size", "fp", "h1", "h2"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([ids, pa.array(rid, pa.binary()), pa.array(words.count, pa.int64()), lists], names=["doc_id", "rid", "n_words", "hits"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(picked.mapInArrow(run, "doc_id long, rid binary, n_words long, hits array<struct<pos:long,size:int,fp:long,h1:long,h2:long>>"), "hits")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated.

    Words are runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased; null texts have none. n_hit counts the words
    inside any occurrence of a benchmark window; n_items the distinct items with such a window; items their ids,
    sorted as strings. Items with a null id, null text or no words find nothing. Repeated rows each get a row. Without
    documents or items there are no rows or no hits.
    """
    wins = benchmark_windows(items.filter(F.col(item_col).isNotNull()), window, k, item_col, item_text_col)
    rows = document_hits(docs, wins, window, k, id_col, text_col)
    hits = rows.filter("rid is not null").select("rid", F.explode("hits").alias("w")).select("rid", "w.*").distinct()
    found = materialize(hits.join(wins, ["fp", "size", "h1", "h2"]).select("rid", "pos", "size", "item"), "found")
    spans = found.select("rid", "pos", (F.col("pos") + F.col("size")).alias("end")).distinct()
    reach = F.max("end").over(W.partitionBy("rid").orderBy("pos", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest(F.col("pos"), F.coalesce(reach, F.lit(0))))
    words = spans.withColumn("fresh", fresh).groupBy("rid").agg(F.sum("fresh").alias("n_hit"))
    per_doc = found.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit_docs = rows.filter("rid is not null").select("doc_id", "n_words", "rid").join(words, "rid", "left").join(per_doc, "rid", "left")
    clean = rows.filter("rid is null").select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    both = hit_docs.select("doc_id", "n_words", "n_hit", "items").unionByName(clean)
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), items_.alias("items"), (n_hit > 0).alias("contaminated"))

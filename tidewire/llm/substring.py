"""Substring deduplication by hashing units: lines or paragraphs, and passages of words that may begin anywhere.

Words end at ASCII white space and A-Z count as a-z; a unit is normalised to its words and hashed to 128 bits. Digests
are grouped over the whole corpus; the occurrence that ranks first - by doc_id, null last, then by the text's hash,
then by place - stays, and the others are removed by their original offsets, in characters.

A passage is a window of ``PASSAGE`` words wherever it begins. Windows are not grouped one by one:

1. Of rows with equal texts only the first takes part; all passages of the others stand in it.
2. The anchor of a window is the least hash of its k-grams. Windows of one anchor that follow each other are a run, with
   one hash per window. Only runs whose anchor stands at several places go on; few others pass a filter of fixed size.
3. Equal runs are grouped whole: all but the first are removed. What is left are the first runs of each kind; where
   different ones share an anchor, as at the ends of a shared passage, their windows are grouped one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import arrowtext as at
from tidewire.llm.common import Scratch, drop_keyed, hash_bitmap, materialize, split_keyed, unused

#: Newlines between two words that end a unit.
BREAKS = {"line": 1, "paragraph": 2}
#: Words of a passage, and of the k-grams that it is anchored by.
PASSAGE, K = 50, 32

_LAST = (1 << 63) - 1
_NEWLINE = np.arange(256) == 10


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): rows that repeat a doc_id, or have none, are told apart by their text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _rank(place: str) -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.col("text_hash").alias("t"), F.col(place).alias("p"))


def _list_of(structs: dict[str, pa.Array], counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(structs.values()), names=list(structs)))


def text_units(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, digest, n_words, first, last, units) of every row of ``docs``; no shuffle.

    units: (h1, h2, start, end) of the lines or paragraphs of min_words words or more, from their first word to their
    last. first and last bound all words. digest is that of the text as it is. Null texts count as empty.
    """
    breaks = BREAKS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in at.slices(batch.column(3)):
                words = at.Words(data, offsets, at.SPACED, second=True)
                lines = np.concatenate([[0], np.cumsum(_NEWLINE[data])])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                n = len(words.hash)
                opens = np.ones(n, bool)
                if n:
                    opens[1:] = (words.doc[1:] != words.doc[:-1]) | (lines[words.start[1:]] - lines[words.end[:-1]] >= breaks)
                first = np.flatnonzero(opens)
                last = np.append(first[1:], n) if n else first
                take = last - first >= min_words
                first, last = first[take], last[take]
                doc = words.doc[first]
                begins = chars[offsets[doc]]
                units = _list_of(
                    {
                        "h1": pa.array(at.signed(at.runs(words.hash, first, last))), "h2": pa.array(at.signed(at.runs(words.hash2, first, last))),
                        "start": pa.array(chars[words.start[first]] - begins), "end": pa.array(chars[words.end[last - 1]] - begins),
                    },
                    np.bincount(doc, minlength=words.n_docs),
                )
                some = words.count > 0
                head, tail = np.zeros(words.n_docs, np.int64), np.zeros(words.n_docs, np.int64)
                own = chars[offsets[:-1]][some]
                head[some] = chars[words.start[words.first[:-1][some]]] - own
                tail[some] = chars[words.end[words.first[1:][some] - 1]] - own
                part = batch.slice(row, words.n_docs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(words.count, pa.int64()), pa.array(head), pa.array(tail), units], names=["doc_id", "text_hash", "digest", "n_words", "first", "last", "units"])

    picked = _keyed(docs, id_col, text_col).select("doc_id", "text_hash", F.unhex(F.md5("text")).alias("digest"), "text")
    return picked.mapInArrow(run, "doc_id long, text_hash long, digest binary, n_words long, first long, last long, units array<struct<h1:long,h2:long,start:long,end:long>>")


def _repeated_units(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, start, end, keep_doc_id, copies) of the units that stand at an earlier place."""
    units = scratch.write(rows.select("doc_id", "text_hash", F.explode("units").alias("u")).select("doc_id", "text_hash", "u.*"), "units")
    rank = _rank("start")
    kept = units.groupBy("h1", "h2").agg(F.min(rank).alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
    # Written first, so that the join deals its own sides and a very common unit can be split.
    kept = scratch.write(kept, "kept")
    found = units.join(kept, ["h1", "h2"]).filter(rank != F.col("kept"))
    return found.select("doc_id", "text_hash", "start", "end", F.nullif("kept.d", F.lit(_LAST)).alias("keep_doc_id"), "copies")


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is removed: doc_id, text_hash, start, end, keep_doc_id, copies; one row per line or paragraph.

    Its text is characters start to end (exclusive) of the original. Rows that repeat a doc_id and its text are one
    document; null doc_ids rank last. Units of fewer than min_words words stay; null and empty texts have none, and an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "units")
    return _repeated_units(scratch.write(text_units(docs, unit, min_words, id_col, text_col), "rows"), scratch).distinct()


def _anchors(words: at.Words, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, k-gram hash, number of windows) of each run of windows of one document with one anchor."""
    m = len(words.hash) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = at.roll(words.hash, k)
    anchor = at.leftmost_least(grams, size - k + 1)
    p = np.flatnonzero(words.doc[:m] == words.doc[size - 1 :])
    if not len(p):
        return p, np.zeros(0, np.uint64), p
    opens = np.ones(len(p), bool)
    opens[1:] = (anchor[p[1:]] != anchor[p[:-1]]) | (words.doc[p[1:]] != words.doc[p[:-1]])
    first = np.flatnonzero(opens)
    return p[first], grams[anchor[p[first]]], np.diff(np.append(first, len(p)))


def _repeated_anchors(texts: DataFrame, size: int, k: int, scratch: Scratch) -> DataFrame:
    """(fp): anchors that stand at more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in at.slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(at.signed(_anchors(at.Words(data, offsets, at.SPACED), size, k)[1]))], names=["fp"])

    found = texts.select("text").mapInArrow(run, "fp long")
    return scratch.write(found.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "anchors")


def _runs(texts: DataFrame, size: int, k: int, filter_bits: int, scratch: Scratch) -> DataFrame:
    """(fp, rh, doc_id, text_hash, place, hashes, starts, ends) of runs whose anchor may repeat.

    place counts words; hashes, starts and ends have a value for each window. rh is the hash of hashes.
    """
    bitmap = texts.sparkSession.sparkContext.broadcast(hash_bitmap(_repeated_anchors(texts, size, k, scratch), "fp", filter_bits))
    shift = np.uint64(64 - filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for row, data, offsets in at.slices(batch.column(2)):
                words = at.Words(data, offsets, at.SPACED)
                first, fp, n = _anchors(words, size, k)
                slot = (fp >> shift).astype(np.int64)
                hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                first, fp, n = first[hit], fp[hit], n[hit]
                if not len(first):
                    continue
                doc = words.doc[first]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                each = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                begins = chars[offsets[words.doc[each]]]
                ids = pa.array(row + doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at.signed(fp)), batch.column(0).take(ids), batch.column(1).take(ids), pa.array(first - words.first[doc]), at.list_column(at.signed(at.runs(words.hash, each, each + size)), n, pa.int64()),
                        at.list_column(chars[words.start[each]] - begins, n, pa.int64()), at.list_column(chars[words.end[each + size - 1]] - begins, n, pa.int64()),
                    ],
                    names=["fp", "doc_id", "text_hash", "place", "hashes", "starts", "ends"],
                )

    found = texts.mapInArrow(run, "fp long, doc_id long, text_hash long, place long, hashes array<long>, starts array<long>, ends array<long>")
    return scratch.write(found.withColumn("rh", F.xxhash64("hashes")), "runs")


def _merged(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end): overlapping spans of a document united."""
    order = W.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = spans.withColumn("opens", (before.isNull() | (F.col("start") > before)).cast("long"))
    numbered = opens.withColumn("no", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "text_hash", "no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("no")


def _repeated_passages(docs: DataFrame, rows: DataFrame, size: int, k: int, id_col: str, text_col: str, filter_bits: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, start, end); ``rows`` are those of text_units."""
    rank = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.col("text_hash").alias("t"))
    long_ = scratch.write(rows.filter(F.col("n_words") >= size).select("doc_id", "text_hash", "digest", "first", "last").distinct(), "long")
    equal = scratch.write(long_.groupBy("digest").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"), "equal")
    copies = scratch.write(long_.join(equal, "digest").filter(rank != F.col("kept")).select("doc_id", "text_hash", F.col("first").alias("start"), F.col("last").alias("end")), "copies")
    # Rows that repeat a doc_id and its text rank alike: none of them is removed for another.
    texts = drop_keyed(_keyed(docs, id_col, text_col), copies, ["doc_id", "text_hash"])
    found = _runs(texts, size, k, filter_bits, scratch)
    rank = _rank("place")
    kinds = scratch.write(found.groupBy("fp", "rh").agg(F.min(rank).alias("kept"), F.count("*").alias("n")), "kinds")
    several = scratch.write(kinds.groupBy("fp").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("fp", F.lit(True).alias("shared")), "several")
    # Written first, so that the join deals its own sides and a very common run can be split.
    wanted = scratch.write(kinds.join(several, "fp", "left").filter("n > 1 or shared").select("fp", "rh", "kept", F.coalesce("shared", F.lit(False)).alias("shared")), "wanted")
    met = scratch.write(found.join(wanted, ["fp", "rh"]).withColumn("is_first", rank == F.col("kept")).drop("kept", "rh"), "met")
    whole = met.filter("not is_first").select("doc_id", "text_hash", F.get("starts", F.lit(0)).alias("start"), F.element_at("ends", -1).alias("end"))
    windows = met.filter("is_first and shared").select("fp", "doc_id", "text_hash", "place", F.posexplode(F.arrays_zip("hashes", "starts", "ends")).alias("i", "w"))
    windows = scratch.write(windows.select("fp", "doc_id", "text_hash", (F.col("place") + F.col("i")).alias("place"), F.col("w.hashes").alias("h"), F.col("w.starts").alias("start"), F.col("w.ends").alias("end")), "windows")
    firsts = scratch.write(windows.groupBy("fp", "h").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    single = windows.join(firsts, ["fp", "h"]).filter(rank != F.col("kept")).select("doc_id", "text_hash", "start", "end")
    cut = scratch.write(whole.unionByName(single), "cut")
    return _merged(cut).unionByName(copies)


def repeated_passages(docs: DataFrame, size: int = PASSAGE, k: int = K, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 26) -> DataFrame:
    """What is removed: doc_id, text_hash, start, end of every passage of ``size`` words or more that stands earlier.

    Of equal windows the first stays; the others are united to passages, characters start to end (exclusive) of the
    original. Rows that repeat a doc_id and its text are one document. Null and empty texts, and texts of fewer words,
    have none; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    return _repeated_passages(docs, scratch.write(text_units(docs, id_col=id_col, text_col=text_col), "rows"), size, k, id_col, text_col, filter_bits, scratch)


def _spans(removed: DataFrame, name: str) -> DataFrame:
    return removed.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(name))


def deduplicate_text(docs: DataFrame, unit: str = "line", min_words: int = 1, size: int = PASSAGE, k: int = K, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 26) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, lines, passages (removed spans), removed_chars.

    Spans are (start, end) in characters of the original, end exclusive, in order; lines and passages may overlap, and
    removed_chars counts what either covers. A document from which nothing is removed has empty lists. Rows that repeat
    a doc_id and its text are one document and get the same spans. Null and empty texts have none; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows = scratch.write(text_units(docs, unit, min_words, id_col, text_col), "rows")
    lines = scratch.write(_spans(_repeated_units(rows, scratch), "lines"), "lines")
    passages = scratch.write(_spans(_repeated_passages(docs, rows, size, k, id_col, text_col, filter_bits, scratch), "passages"), "passages")
    out = rows.select("doc_id", "text_hash", "n_words")
    for part in (lines, passages):
        p = part.withColumnsRenamed({"doc_id": "i", "text_hash": "t"})
        out = out.join(p, out["doc_id"].eqNullSafe(p["i"]) & (out["text_hash"] == p["t"]), "left").drop("i", "t")
    none = F.array().cast("array<struct<start:long,end:long>>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("lines", "passages")})
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("reach"), zero.alias("total"))
    step = lambda acc, s: F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), (acc["total"] + F.greatest(zero, s["end"] - F.greatest(acc["reach"], s["start"]))).alias("total"))
    return out.withColumn("removed_chars", F.aggregate(F.array_sort(F.concat("lines", "passages")), start, step)["total"])


def remove_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with removed spans (doc_id, text_hash, start, end) cut from their texts; other columns as they are.

    Spans may overlap; what surrounds them stays as it is, line breaks included. Rows are told apart by doc_id, null
    equal to null, and the hash of their text; null texts stay null. Only rows that lose something are shuffled.
    """
    row, cuts, at_id = (unused(docs.columns, x) for x in ("row", "cuts", "id"))
    keyed = docs.withColumn(row, F.struct(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t")))
    lists = materialize(removed.groupBy(F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).alias(at_id)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cuts)), "cuts")
    clear, maybe = split_keyed(keyed, lists, row, at_id)
    joined = maybe.join(lists, F.col(row).eqNullSafe(F.col(at_id)), "left")
    text, zero = F.col(text_col), F.lit(0).cast("long")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(zero, b - a).cast("int"))
    start = F.struct(zero.alias("reach"), F.lit("").alias("kept"))
    step = lambda acc, s: F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), F.concat(acc["kept"], piece(acc["reach"], s["start"])).alias("kept"))
    left = F.aggregate(cuts, start, step)
    whole = F.concat(left["kept"], piece(left["reach"], F.char_length(text).cast("long")))
    done = joined.withColumn(text_col, F.when(F.col(cuts).isNull(), text).otherwise(whole))
    return clear.select(*docs.columns).unionByName(done.select(*docs.columns))

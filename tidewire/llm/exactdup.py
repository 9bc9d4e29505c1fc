"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash of the survivors.

Native: DataFrame functions only. Two scans of the texts, and no text is ever shuffled:

1. the first scan keeps (length, prefix hash) of each row; counting by length, then by length and prefix hash, leaves
   the keys that more than one row has. They fill a bitmap of ``2**filter_bits`` bits - a broadcast of fixed size;
2. the second scan computes the full SHA-256 only of rows whose key is in the bitmap (a row let through by accident
   merely gets hashed); rows with the same length, prefix hash and full hash are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, slot_bitmap, slot_of, text_or_empty, with_slot


def normalised(text_col: str) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")


def duplicate_keys(docs: DataFrame, text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """(len, prefix) that more than one row has, found in two steps: by length, then with the prefix hash."""
    norm = docs.select(normalised(text_col).alias("t"))
    seen = norm.select(F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix"))
    seen = materialize(seen.groupBy("len", "prefix").agg(F.count("*").alias("n")), "lengths")
    lengths = seen.groupBy("len").agg(F.sum("n").alias("m")).filter("m > 1").select("len")
    return seen.join(lengths, "len", "left_semi").filter("n > 1").select("len", "prefix")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, filter_bits: int = 24, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes (of the normalised text).

    Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty.
    keep_id is the smallest doc_id of the equal rows, and that row is kept; of rows that also repeat the doc_id one is
    kept. Rows with a null doc_id come after all others. text_sha256 is null for rows that refinement told apart
    before their full text was hashed, unless digest_all asks for it. Other columns are ignored; an empty table gives
    no rows.
    """
    slot = slot_of(filter_bits, F.col("len"), F.col("prefix"))
    bitmap = slot_bitmap(duplicate_keys(docs, text_col, prefix_chars), slot)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("t"))
    rows = rows.withColumn("len", F.octet_length("t")).withColumn("prefix", F.xxhash64(F.substring("t", 1, prefix_chars)))
    rows = with_slot(rows, bitmap, slot)
    survives = F.col("__hit")
    full = F.sha2("t", 256) if digest_all else F.when(survives, F.sha2("t", 256))
    narrow = rows.select("doc_id", "len", "prefix", survives.alias("survives"), F.unhex(full).alias("full"))
    # Rows that are equal in everything are one row with a count until the end.
    narrow = materialize(narrow.groupBy("doc_id", "len", "prefix", "survives", "full").agg(F.count("*").alias("n")), "digests")
    groups = narrow.filter("survives").groupBy("len", "prefix", "full").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Written first, so that the join deals its own sides and large groups of copies can be split.
    multiple = materialize(groups.filter("group_size > 1"), "groups")
    g = multiple.select(F.col("len").alias("l"), F.col("prefix").alias("p"), F.col("full").alias("f"), "keep_id", "group_size")
    found = narrow.join(g, (F.col("len") == F.col("l")) & (F.col("prefix") == F.col("p")) & (F.col("full") == F.col("f")), "left")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    alone = F.col("group_size").isNull()
    first = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return each.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, True).otherwise(first).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
        F.col("len").cast("long").alias("n_bytes"),
    )

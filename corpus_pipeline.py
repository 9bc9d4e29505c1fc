"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality classifier -> exact dedup -> n-gram Jaccard join -> benchmark decontamination -> mixing to target weights.
All but the last return the columns of ``documents``; the last adds how often the mix takes each document.

In every stage null texts count as empty, rows are told apart by doc_id (null equal to null) and text, so ids may be
null or repeat, other columns stay as they are whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontam, exactdup, jaccard, mixing, quality
from tidewire.llm.common import drop_keyed, materialize, shared_path, split_keyed, unused, workspace

#: Near duplicates: five words and a similarity of 0.8.
NEAR_K, NEAR_PERCENT = 5, 80
#: Texts that Python gets at once, and Spark's setting for it.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Python gets at most BATCH_ROWS texts at once from here on; a smaller setting of the session stays.

    Spark's own 10,000 hold a task's whole input of texts in memory twice, in the executor and in its Python worker. A
    stage's result is read by its caller, so the setting outlasts the stage; ``run`` puts the old one back.
    """
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it is fitted on labelled rows of the stage's own input.

    Repeated rows stay; without usable labels all texts get one score and stay or go together.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.fit_quality(docs, labels))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of doc_id and text in 64 bits, in a column that has a name of its own, and that name."""
    key = unused(docs.columns, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def _all_but_first(keyed: DataFrame, key: str, found: DataFrame, group: str) -> DataFrame:
    """(key) of the members of each group but the one with the smallest (doc_id, key), null doc_ids last.

    ``found`` has key and ``group``, which is the key of a member, for each row.
    """
    others = materialize(found.filter(F.col(key) != F.col(group)).select(key, F.col(group).alias("g")).distinct(), "others")
    members = others.unionByName(others.select(F.col("g").alias(key), "g").distinct())
    # Written first, so that the join deals its own sides and large groups can be split.
    named = materialize(members.join(keyed.select(key, "doc_id"), key).distinct(), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("d"), F.col(key).alias("k"))
    first = materialize(named.groupBy("g").agg(F.min(rank).alias("first")), "first")
    return named.join(first, "g").filter(F.col(key) != F.col("first.k")).select(key)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts, null ids last; rows that repeat a doc_id and its text are one."""
    keyed, key = _keyed(docs)
    found = materialize(exactdup.exact_duplicates(keyed, id_col=key).withColumnRenamed("doc_id", key).select(key, "keep_id", "kept"), "copies")
    kept = drop_keyed(keyed, _all_but_first(keyed, key, found, "keep_id"), [key])
    again = materialize(found.filter(~F.col("kept") & (F.col(key) == F.col("keep_id"))).select(F.col(key).alias("mark")).distinct(), "again")
    clear, maybe = split_keyed(kept, again, key, "mark")
    return clear.unionByName(maybe.dropDuplicates([key])).drop(key)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id, null ids last."""
    small_batches(spark)
    keyed, key = _keyed(docs)
    found = jaccard.near_duplicate_components(keyed, NEAR_K, NEAR_PERCENT, id_col=key).withColumnRenamed("doc_id", key)
    return drop_keyed(keyed, _all_but_first(keyed, key, found, "component_id"), [key]).drop(key)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    small_batches(spark)
    keyed, key = _keyed(docs)
    found = decontam.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return drop_keyed(keyed, found.filter("contaminated").select(F.col("doc_id").alias(key)), [key]).drop(key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document that is left."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]

#: The classifier cannot be expressed in SQL; tests hold run() against a row-by-row pipeline that asks it for its scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again.

    What a stage writes besides goes when it ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch_rows = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            path = shared_path(spark, name.replace(" ", "-"))
            with workspace(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, batch_rows)
    return docs

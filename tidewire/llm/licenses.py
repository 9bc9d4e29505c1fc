"""License scans by diagonal voting.

Rolling hashes of word k-grams of the documents are joined with the positions at which license templates hold them;
each match votes for a diagonal (position in the document minus position in the template). A phrase stands wherever a
diagonal holds all its k-grams. For longer templates neighbouring diagonals - the same template with a few words
added or left out - are merged, and a span counts once it covers enough of the template over a plausible length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import arrowtext as at
from tidewire.llm.common import materialize

#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening notices of public licenses and the labels that the method adds for them.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

PHRASE_K, NOTICE_K = 2, 4
#: Diagonals this close are one occurrence of a notice.
SLACK = 6
#: Share of a notice's k-grams that a span must hold.
COVER = 0.5


def _template_words(text: str) -> at.Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return at.Words(data, np.array([0, len(data)]), at.ALNUM)


def template_positions(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, phrase, k, h, tpos, grams, words): where each template holds each k-gram. A few hundred rows."""
    rows = []
    for is_phrase, k, group in ((True, PHRASE_K, phrases), (False, NOTICE_K, notices)):
        for text, label in group:
            _, grams = _template_words(text).grams(k)
            rows += [(f"{'p' if is_phrase else 'n'}:{text[:60]}", label, is_phrase, k, int(h), i, len(grams), len(grams) + k - 1) for i, h in enumerate(at.signed(grams))]
    return spark.createDataFrame(rows, "template string, label string, phrase boolean, k int, h long, tpos long, grams long, words long")


def gram_hits(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, n_words, hits): positions of k-grams that some template holds; rid (doc_id and text) is null without any."""
    known = {k: np.sort(np.array([r.h for r in templates.filter(F.col("k") == k).select("h").distinct().collect()], np.int64)) for k in (PHRASE_K, NOTICE_K)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in at.slices(batch.column(1)):
                words = at.Words(data, offsets, at.ALNUM)
                parts = []
                for k, hashes in known.items():
                    starts, grams = words.grams(k)
                    grams = at.signed(grams)
                    near = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
                    hit = hashes[near] == grams
                    starts, grams = starts[hit], grams[hit]
                    parts.append((words.doc[starts], starts - words.first[words.doc[starts]], np.full(len(starts), k), grams))
                doc, pos, size, h = (np.concatenate(x) for x in zip(*parts, strict=True))
                o = np.argsort(doc, kind="stable")
                n, counts = words.n_docs, np.bincount(doc, minlength=words.n_docs)
                ids = batch.column(0).slice(row, n)
                texts = data.tobytes() if len(doc) else b""
                rid = [hashlib.blake2b(f"{i}:".encode() + texts[a:b], digest_size=16).digest() if c else None for i, a, b, c in zip(ids.to_pylist(), offsets[:-1], offsets[1:], counts, strict=True)]
                struct = pa.StructArray.from_arrays([pa.array(pos[o], pa.int64()), pa.array(size[o], pa.int32()), pa.array(h[o], pa.int64())], names=["pos", "k", "h"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([ids, pa.array(rid, pa.binary()), pa.array(words.count, pa.int64()), lists], names=["doc_id", "rid", "n_words", "hits"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(picked.mapInArrow(run, "doc_id long, rid binary, n_words long, hits array<struct<pos:long,k:int,h:long>>"), "grams")


def license_spans(hits: DataFrame, templates: DataFrame, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """(rid, template, label, phrase, first, end, coverage): verified occurrences, in words (end exclusive)."""
    each = hits.filter("rid is not null").select("rid", F.explode("hits").alias("w")).select("rid", "w.pos", "w.k", "w.h").distinct()
    votes = each.join(F.broadcast(templates), ["k", "h"]).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    about = ["template", "label", "phrase", "k", "grams", "words"]
    lines = votes.groupBy("rid", "diagonal", *about).agg(F.collect_set("tpos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    phrases = lines.filter(F.col("phrase") & (F.size("held") == F.col("grams"))).withColumn("coverage", F.lit(1.0))
    w = W.partitionBy("rid", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > slack).cast("int"), F.lit(1))
    merged = lines.filter(~F.col("phrase")).withColumn("run", fresh)
    merged = merged.withColumn("run", F.sum("run").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy("rid", "run", *about).agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    merged = merged.withColumn("coverage", F.col("n") / F.col("grams"))
    merged = merged.filter((F.col("coverage") >= cover) & (F.col("last") - F.col("first") + F.col("k") <= 2 * F.col("words")))
    cols = ["rid", "template", "label", "phrase", "first", (F.col("last") + F.col("k")).alias("end"), "coverage"]
    return phrases.select(*cols).unionByName(merged.select(*cols))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased; null and empty texts have none. Base places
    are those of PHRASES; labels adds those of NOTICES; score is the best coverage of a template, 0 without any.
    Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    templates = template_positions(docs.sparkSession)
    rows = gram_hits(docs, templates, id_col, text_col)
    spans = license_spans(rows, templates)
    start = F.when(F.col("phrase"), F.col("first"))
    label = F.when(F.col("phrase"), F.col("label"))
    found = spans.groupBy("rid").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.concat_ws(",", F.sort_array(F.collect_set(label))).alias("base_labels"), F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("labels"), F.max("coverage").alias("score"),
    )
    hit = rows.filter("rid is not null").select("rid", "doc_id", "n_words").join(found, "rid", "left").drop("rid")
    none = rows.filter("rid is null").select("doc_id", "n_words")
    both = hit.unionByName(none, allowMissingColumns=True)
    return both.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

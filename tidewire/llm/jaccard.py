"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every document becomes its set of word k-gram hashes. Equal sets form one class (its smallest doc_id stands for
   it), so exact copies never meet each other in the join.
2. Sets are ordered rare-first by a histogram of all k-grams of all documents: ``2**rarity_bits`` counters, whatever
   the input's size (any fixed order gives the same result; rarity only decides how few pairs meet).
3. Sets that are similar enough share a k-gram among their first ``n - ceil(t*n) + 1``; those are the postings.
4. Pairs in one posting list pass the length, positional and suffix filters, and are verified once on whole sets.
5. Links make components. A posting list of many near copies is not paired out: at every size, one hub per list first
   meets all others and the components are drawn; this is repeated as long as the pairs between *different* components
   outnumber the postings and it halves them; what still lies in different components after that is paired
   completely. No cap: every pair that could join two components is verified.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import arrowtext as at
from tidewire.llm.common import Scratch, materialize, split_keyed
from tidewire.llm.graph import labels, star_edges

#: Hash ranges whose counts the suffix filter compares.
BINS = 256
#: The largest count that a bin of 16 bits holds.
FULL = 32767
#: Posting lists of more members carry the suffix filter's counts into their join.
LONG_LIST = 64
#: Postings whose pairs are worth a task of their own, and tasks per core at least.
POSTINGS_PER_TASK, TASKS_PER_CORE = 20_000, 8


def _doc_sets(column, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct k-gram hashes (the whole sequence where it is shorter than k)."""
    for _, data, offsets in at.slices(column):
        words = at.Words(data, offsets, at.SPACED)
        where, grams = words.grams(k)
        lo = np.searchsorted(where, words.first[:-1])
        hi = np.searchsorted(where, words.first[1:])
        for d in range(words.n_docs):
            n = words.count[d]
            if n >= k:
                yield np.unique(grams[lo[d] : hi[d]])
            elif n:
                yield at.roll(words.hash[words.first[d] : words.first[d + 1]], int(n))
            else:
                yield grams[:0]


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection with which sets of n and m members reach the threshold, as a whole number."""
    return F.ceil((n + m) * F.lit(percent).cast("long") / F.lit(100 + percent))


#: Counters of one row at most.
PIECE = 1 << 16
SETS = "doc_id long, n long, digest binary, slots array<int>, counts array<int>"


def shingle_sets(docs: DataFrame, k: int, rarity_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, digest, slots, counts): one row per document, and rows with the k-gram counters of each task.

    Rows of counters have null in the other columns and hold only counters above 0, at most PIECE each.
    """
    size = 1 << rarity_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.int32)
        names = [x.split()[0] for x in SETS.split(", ")]
        for batch in batches:
            n, digests = np.zeros(batch.num_rows, np.int64), []
            for i, s in enumerate(_doc_sets(batch.column(1), k)):
                n[i] = len(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                np.add.at(counters, (s & np.uint64(size - 1)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digests, pa.binary()), none, none], names=names)
        some = np.flatnonzero(counters).astype(np.int32)
        for i in range(0, len(some), PIECE):
            piece = some[i : i + PIECE]
            lists = [pa.array([x], pa.list_(pa.int32())) for x in (piece, counters[piece])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *lists], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, SETS)


def rarity_table(sets: DataFrame, rarity_bits: int) -> np.ndarray:
    """How often k-grams of each of ``2**rarity_bits`` hash classes occur in the whole corpus: a table of fixed size.

    Counts are kept as 8 times their binary logarithm, one byte each: they only order k-grams, the same way for all.
    """
    each = sets.filter(F.col("slots").isNotNull()).select(F.explode(F.arrays_zip("slots", "counts")).alias("x"))
    sums = each.groupBy(F.col("x.slots").alias("slot")).agg(F.sum("x.counts").alias("c"))
    level = F.least(F.lit(255), F.floor(8 * F.log2(F.col("c").cast("double"))) + 1).cast("int")
    # One row per 2**12 slots travels to the driver.
    rows = sums.groupBy(F.shiftright("slot", 12).alias("base")).agg(F.collect_list(F.struct((F.col("slot") % 4096).alias("at"), level.alias("level"))).alias("x"))
    packed = rows.select("base", F.transform("x", lambda e: e["at"].cast("short")).alias("at"), F.transform("x", lambda e: e["level"].cast("short")).alias("level"))
    table = np.zeros(1 << rarity_bits, np.uint8)
    for row in packed.toArrow().to_batches():
        for base, at_, level_ in zip(row.column(0).to_pylist(), row.column(1), row.column(2), strict=True):
            table[(base << 12) + at_.values.to_numpy().astype(np.int64)] = level_.values.to_numpy()
    return table


def _prefixes(docs: DataFrame, reps: DataFrame, rarity, k: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc, n, prefix, bins) of each class's document: its rarest k-grams in the common order, and suffix-filter counts."""
    least = _least_n(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        mask = np.uint64(len(table) - 1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep, sizes, flat, bins = [], [], [], []
            for i, s in enumerate(_doc_sets(batch.column(1), k)):
                n = len(s)
                if n < least or ids[i] is None:
                    continue
                p = n - (n * percent + 99) // 100 + 1
                order = np.argsort(table[(s & mask).astype(np.int64)], kind="stable")[:p]
                keep.append(i)
                sizes.append(n)
                flat.append(at.signed(s[order]))
                bins.append(_bins(s))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in keep], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    at.list_column(np.concatenate(flat) if flat else np.zeros(0, np.int64), [len(x) for x in flat], pa.int64()),
                    at.list_column(np.concatenate(bins) if bins else np.zeros(0, np.int16), [BINS] * len(bins), pa.int16()),
                ],
                names=["doc", "n", "prefix", "bins"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(run, "doc long, n long, prefix array<long>, bins array<smallint>")
    return scratch.write(out.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi"), "prefixes")


def _bins(s: np.ndarray) -> np.ndarray:
    """How many k-grams each hash range holds; FULL stands for any number from there on."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS), FULL).astype(np.int16)


def _least_n(percent: int) -> int:
    """Sets smaller than this only reach the threshold with equal sets: n/(n+1) stays below it."""
    return -(-percent // (100 - percent))


def _token_sets(docs: DataFrame, wanted: DataFrame, k: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc, toks) of the documents in ``wanted``, read again from their texts, and of few others; most leave the scan at once."""
    least = _least_n(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keep, flat = batch.column(0).to_pylist(), [], []
            for i, s in enumerate(_doc_sets(batch.column(1), k)):
                if len(s) >= least:
                    keep.append(ids[i])
                    flat.append(at.signed(s))
                if len(keep) >= 500:
                    yield _token_batch(keep, flat)
                    keep, flat = [], []
            yield _token_batch(keep, flat)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    return scratch.write(split_keyed(picked, wanted, "doc_id", "doc")[1].mapInArrow(run, "doc long, toks array<long>"), "tokens")


def _token_batch(ids: list, flat: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), at.list_column(np.concatenate(flat) if flat else np.zeros(0, np.int64), [len(x) for x in flat], pa.int64())], names=["doc", "toks"])


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold on their whole sets."""
    pairs = scratch.write(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    tokens = _token_sets(docs, wanted, k, percent, id_col, text_col, scratch)
    ta, tb = (tokens.select(F.col("doc").alias(s), F.col("toks").alias(f"toks_{s}")) for s in "ab")
    both = F.size(F.array_intersect("toks_a", "toks_b")).cast("long")
    union = F.size("toks_a") + F.size("toks_b") - both
    return pairs.join(ta, "a").join(tb, "b").filter(both * 100 >= union * percent).select("a", "b").distinct()


def _shared_at_most(x: Column, y: Column) -> Column:
    """The suffix filter's bound: sets share at most the smaller count of each hash range; no bound where both are full."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q).cast("long")), F.lit(0).cast("long"), lambda acc, z: acc + F.when(z == FULL, F.lit(1 << 40)).otherwise(z))


def _list_pairs(left: DataFrame, right: DataFrame, percent: int, ordered: bool, bins: bool) -> DataFrame:
    """Pairs (a < b) of two posting tables on one k-gram in different components that pass the filters.

    Length: the smaller set must hold ``percent`` of the larger. Positional: a shared k-gram at places i and j of the
    common order leaves at most min(i, j) + 1 + min(rest, rest) shared. bins: apply the suffix filter as well.
    ordered: both tables are the same one, so each pair need be met in one order only.
    """
    r = right.select("tok", *[F.col(c).alias(f"{c}_r") for c in ("doc", "n", "pos", "comp", *["bins"] * bins)])
    need = _least_overlap(F.col("n"), F.col("n_r"), percent)
    met = (left["tok"] == r["tok"]) & (F.col("doc") < F.col("doc_r") if ordered else F.col("doc") != F.col("doc_r")) & (F.col("comp") != F.col("comp_r"))
    met &= F.least("n", "n_r") * 100 >= F.greatest("n", "n_r") * percent
    met &= F.least("pos", "pos_r") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n_r") - F.col("pos_r") - 1) >= need
    if bins:
        met &= _shared_at_most(F.col("bins"), F.col("bins_r")) >= need
    return left.join(r, met).select(F.least("doc", "doc_r").alias("a"), F.greatest("doc", "doc_r").alias("b"))


def _filtered_pairs(work: DataFrame, other: DataFrame, meta: DataFrame, percent: int, complete: bool, tasks: int) -> DataFrame:
    """The pairs of all posting lists that pass the three filters, each once.

    Lists are paired on narrow rows and the suffix filter follows. Only where long lists are paired completely do they
    carry its counts into the join, so that their many pairs never leave it. A join that Spark splits into very many
    small pieces goes on in ``tasks`` tasks.
    """
    if complete:
        bins = meta.select(F.col("doc").alias("bd"), "bins")
        long_ = work.filter(F.col("size") > LONG_LIST).join(bins, F.col("doc") == F.col("bd")).drop("bd")
        at_once = _list_pairs(long_, long_, percent, True, bins=True).coalesce(tasks)
        work = other = work.filter(F.col("size") <= LONG_LIST)
    pairs = _list_pairs(work, other, percent, complete, bins=False).coalesce(tasks).distinct()
    a, b = (meta.select(*[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "bins")]) for s in "ab")
    pairs = pairs.join(a, F.col("a") == F.col("doc_a")).join(b, F.col("b") == F.col("doc_b"))
    pairs = pairs.filter(_shared_at_most(F.col("bins_a"), F.col("bins_b")) >= _least_overlap(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    return pairs.unionByName(at_once).distinct() if complete else pairs


def _hubs(work: DataFrame, step: int) -> DataFrame:
    """The posting of one document per list, that the others are held against.

    First the one in which the k-gram ranks as rarest: an original has no rarer k-grams of its own, its edited copies
    have. Later any, by a hash.
    """
    by_place = F.struct(F.col("pos"), F.xxhash64("doc").alias("h"))
    rest = [c for c in work.columns if c != "tok"]
    return work.groupBy("tok").agg(F.min_by(F.struct(*rest), by_place if step == 0 else F.struct(F.xxhash64("doc", F.lit(step)))).alias("r")).select("tok", "r.*")


def _open_lists(work: DataFrame, comps: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """(postings of the lists that still hold several components, how many pairs of different components they hold).

    Components only grow, so a list that has settled never opens again: each round reads what the last one left.
    """
    placed = work.drop("comp").join(comps, work["doc"] == comps["node"], "left").withColumn("comp", F.coalesce("component", "doc")).select("tok", "doc", "n", "pos", "size", "comp")
    groups = placed.groupBy("tok", "comp").agg(F.count("*").cast("double").alias("c"))
    mixed = groups.groupBy("tok").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
    mixed = scratch.write(mixed.filter("pairs > 0"), "mixed")
    return scratch.write(placed.join(mixed.select("tok"), "tok", "left_semi"), "work"), mixed.agg(F.sum("pairs")).first()[0] or 0


def near_links(docs: DataFrame, sets: DataFrame, k: int, percent: int, rarity_bits: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(node, component) over classes with partners, or None where no k-gram is shared. Its tables are in ``scratch``."""
    spark = docs.sparkSession
    reps = sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")).filter(f"rep is not null and n >= {_least_n(percent)}")
    rarity = spark.sparkContext.broadcast(rarity_table(sets, rarity_bits))
    meta = _prefixes(docs, reps, rarity, k, percent, id_col, text_col, scratch)
    postings = meta.select("doc", "n", F.posexplode("prefix").alias("pos", "tok")).select("tok", "doc", "n", F.col("pos").cast("long").alias("pos"))
    shared = postings.groupBy("tok").agg(F.count("*").alias("size")).filter("size > 1")
    last = Scratch(spark, "round", scratch)
    work = last.write(postings.join(shared, "tok").withColumn("comp", F.col("doc")), "postings")
    n_live = work.count()
    if not n_live:
        return None
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-n_live // POSTINGS_PER_TASK))

    edges = None
    open_pairs, before, step = float("inf"), float("inf"), 0
    while True:
        # Few pairs, or hubs no longer draw components together: what is left is paired completely.
        complete = step > 0 and (open_pairs <= 4 * n_live or open_pairs > before / 2)
        other = work if complete else _hubs(work, step)
        pairs = _filtered_pairs(work, other, meta, percent, complete, tasks)
        now = Scratch(spark, "round", scratch)
        checked = Scratch(spark, "checked", now)
        found = now.write(_verified(docs, pairs, k, percent, id_col, text_col, checked), "links")
        checked.clear()
        # What is known so far goes on as edges. Between rounds their components need not have settled: nodes that
        # are not yet known to be in one are held against each other once more.
        known = [] if edges is None else [edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"))]
        links = functools.reduce(DataFrame.unionByName, [found, *known])
        if complete:
            return labels(star_edges(links, now))
        edges = star_edges(links, now, rounds=2)
        before, step = open_pairs, step + 1
        work, open_pairs = _open_lists(work, now.write(labels(edges), "labels"), now)
        if not open_pairs:
            return labels(star_edges(links, now))
        last.clear()
        last = now


def near_duplicate_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rarity_bits: int = 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Words are runs of characters other than ASCII white space, A-Z lower-cased; two documents link when their sets of
    k-grams have a Jaccard similarity of ``percent`` / 100 or more. Null and empty texts, and texts of white space
    only, have no k-gram and link with nothing. A text of fewer than k words has one member, its whole sequence.
    Rows that repeat a doc_id are one node of the graph. A row with a null doc_id joins the component of its equal set,
    and is alone (component null) if only such rows hold it. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sets = materialize(shingle_sets(docs, k, rarity_bits, id_col, text_col), "sets")
    rows = sets.filter(F.col("slots").isNull()).select("doc_id", "n", "digest")
    comps = near_links(docs, sets, k, percent, rarity_bits, scratch, id_col, text_col)
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    if comps is not None:
        classes = classes.join(comps, classes["rep"] == comps["node"], "left").select("digest", F.coalesce("component", "rep").alias("rep"))
    # Written first, so that the join deals its own sides and a large class can be split.
    classes = materialize(classes, "classes")
    scratch.clear()
    # Texts without k-grams are told apart by doc_id so that they don't meet in one task.
    key = F.coalesce("digest", F.col("doc_id").cast("string").cast("binary"))
    out = rows.withColumn("key", key).join(classes.withColumnRenamed("digest", "key"), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("component_id"))


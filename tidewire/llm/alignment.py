"""Alignment of the tokens that two tokenizers give to the same text.

The token bytes of a whole slice of an Arrow batch are laid end to end, with document offsets beside them. Two
bincounts over the bytes mark where tokens of A and of B end; a cut is a byte where both do, a link (two tokens that
share bytes) is a stretch between neighbouring marks. Prefix sums over the marks, read at the documents' ends, give
each document its counts.

How often an id pair is linked in the whole corpus is summed from the tasks' own sums. The most frequent pairs, at
most ``2**frequent_bits``, are broadcast; all others meet their documents in a join.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import arrowtext as at
from tidewire.llm.common import Scratch

#: Distinct pairs that a task gathers before it hands their sums on.
HELD_PAIRS = 1 << 20


@dataclass(frozen=True)
class Tokenizers:
    """The vocabulary files, which every executor has in the same place. A is byte-level BPE, B pieces with byte fallback."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"


def byte_of_letter() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of every id, flat: ``bytes_of(ids)`` lays those of a run of ids end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[places(self.at[ids], self.size[ids])]


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] of them) for each i, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Pair:
    """Both tokenizers with their vocabularies' bytes; one per Python worker and pair of files."""

    def __init__(self, files: Tokenizers):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(files.a)
        self.a.encode_special_tokens = True
        letters, entries = byte_of_letter(), [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            entries[i] = bytes(letters[c] for c in token)
        self.a_bytes = Vocabulary(entries)
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = Vocabulary([piece(i) for i in range(self.b.get_piece_size())])
        self.b_ids = self.b.get_piece_size()
        self.decimals = Vocabulary([str(i).encode() for i in range(max(len(entries), self.b_ids))])

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        full = [i for i, t in enumerate(texts) if t]
        a: list[list[int]] = [[] for _ in texts]
        b: list[list[int]] = [[] for _ in texts]
        for i, e in zip(full, self.a.encode_batch_fast([" " + texts[i] for i in full], add_special_tokens=False), strict=True):
            a[i] = e.ids
        for i, ids in zip(full, self.b.encode([texts[i] for i in full], num_threads=1), strict=True):
            b[i] = ids
        return a, b


@functools.lru_cache(maxsize=2)
def load_pair(files: Tokenizers) -> Pair:
    return Pair(files)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(bounds[-1]))
    return flat, bounds


def _same_bytes(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each document's tokens, joined, are its bytes ``text[ends[d]:ends[d + 1]]``."""
    ok = _sums(vocabulary.size[ids], bounds) == np.diff(ends)
    keep = np.repeat(ok, np.diff(bounds))
    size = np.where(ok, np.diff(ends), 0)
    differs = vocabulary.bytes_of(ids[keep]) != text[places(ends[:-1][ok], size[ok])]
    ok[ok] = _sums(differs, np.concatenate([[0], np.cumsum(size[ok])])) == 0
    return ok


@dataclass
class Aligned:
    """What one slice of documents gives: counts by document, its groups' digest, and its links as pair * 1 with document."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    pair: np.ndarray
    doc: np.ndarray


def align(tokens: tuple[list[list[int]], list[list[int]]], data: np.ndarray, offsets: np.ndarray, p: Pair) -> Aligned:
    """Aligns the documents ``data[offsets[d]:offsets[d + 1]]`` of a slice, whose tokens are given, all at once."""
    n = len(offsets) - 1
    (a, a_bounds), (b, b_bounds) = map(_flat, tokens)
    size = np.diff(offsets)
    # Each document that has text gets the space in front that both tokenizers see.
    ends = np.concatenate([[0], np.cumsum(size + (size > 0))])
    text = np.full(int(ends[-1]), 32, np.uint8)
    text[places(ends[:-1] + (size > 0), size)] = data
    ok = (size > 0) & _same_bytes(p.a_bytes, a, a_bounds, text, ends) & _same_bytes(p.b_bytes, b, b_bounds, text, ends)
    a, b = a[np.repeat(ok, np.diff(a_bounds))], b[np.repeat(ok, np.diff(b_bounds))]
    n_a, n_b = np.where(ok, np.diff(a_bounds), 0), np.where(ok, np.diff(b_bounds), 0)
    ends = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(ends), 0))])
    total = int(ends[-1])
    # Byte x is marked where a token ends after x bytes.
    end_a = np.bincount(np.cumsum(p.a_bytes.size[a]), minlength=total + 1) > 0
    end_b = np.bincount(np.cumsum(p.b_bytes.size[b]), minlength=total + 1) > 0
    marks = np.flatnonzero(end_a | end_b)
    at_a, at_b = end_a[marks], end_b[marks]
    cut = at_a & at_b
    doc = np.searchsorted(ends, marks, "left") - 1
    # The tokens that hold the bytes before each mark: as many have ended before it.
    of_a, of_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
    pair = a[of_a] * p.b_ids + b[of_b]
    at_doc = np.searchsorted(marks, ends, "right")
    n_groups, n_links = _sums(cut, at_doc), np.diff(at_doc)
    return Aligned(n_a, n_b, n_groups, n_links, _digests(a, b, n_a, n_b, at_a, at_b, cut, ok, p), pair, doc)


def _digests(a, b, n_a, n_b, at_a, at_b, cut, ok, p: Pair) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document with tokens, '' for the others."""
    if not len(a):
        return [""] * len(ok)
    group = np.cumsum(cut) - cut
    n_groups = int(cut.sum())
    in_a, in_b = np.bincount(group[at_a], minlength=n_groups), np.bincount(group[at_b], minlength=n_groups)
    # Where a group's A tokens and then its B tokens stand among all tokens of the slice.
    first = np.cumsum(in_a + in_b) - in_a - in_b
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[places(first, in_a)] = a
    ids[places(first + in_a, in_b)] = b
    sign[first + in_a - 1] = ord("|")
    sign[first + in_a + in_b - 1] = ord(";")
    size = p.decimals.size[ids] + 1
    line = np.empty(int(size.sum()), np.uint8)
    ends = np.cumsum(size)
    line[places(ends - size, size - 1)] = p.decimals.bytes_of(ids)
    line[ends - 1] = sign
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    raw = memoryview(line)
    return [hashlib.sha256(raw[x : y - 1]).hexdigest() if good else "" for good, x, y in zip(ok.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class _PairSums:
    """How often each pair was linked, for as many distinct pairs as HELD_PAIRS; beyond that they are handed on."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(pair)
        pair, times = pair[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pair[first], np.add.reduceat(times, first)

    def add(self, pair: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((pair, times))
        self.held += len(pair)
        if self.held > HELD_PAIRS:
            pair, times = self.merge()
            self.parts, self.held = [(pair, times)], len(pair)
            if self.held > HELD_PAIRS // 2:
                self.parts, self.held = [], 0
                yield pair, times


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _by_document(found: Aligned, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs by document, how often each, how many of them each document has)."""
    if not len(found.pair):
        return found.pair, found.pair, np.zeros(n, np.int64)
    order = np.lexsort((found.pair, found.doc))
    pair, doc = found.pair[order], found.doc[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])]))
    times = np.diff(np.append(first, len(pair)))
    return pair[first], times, np.bincount(doc[first], minlength=n)


def aligned_documents(docs: DataFrame, files: Tokenizers = Tokenizers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` (is_doc) with its counts, digest and (pairs, times): its distinct links; and rows of sums.

    A pair is A's id times the number of B's ids, plus B's id. Rows of sums (not is_doc) hold pairs with the number of
    their links in a part of the corpus; added up they give those of the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums = load_pair(files), _PairSums()
        kind = pa.int64()

        def sum_rows(pair: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            step = 1 << 15
            sizes = np.diff(np.append(np.arange(0, len(pair), step), len(pair)))
            none = pa.nulls(len(sizes), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), bool)), none, none, none, none, none, pa.nulls(len(sizes), pa.string()), at.list_column(pair, sizes, kind), at.list_column(times, sizes, kind)], names=["is_doc", *_NAMES, "pairs", "times"])

        for batch in batches:
            for row, data, offsets in at.slices(batch.column(1)):
                n = len(offsets) - 1
                found = align(p.encode(batch.column(1).slice(row, n).to_pylist()), data, offsets, p)
                pair, times, counts = _by_document(found, n)
                cols = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), batch.column(0).slice(row, n), *cols, pa.array(found.digests), at.list_column(pair, counts, kind), at.list_column(times, counts, kind)], names=["is_doc", *_NAMES, "pairs", "times"])
                for s in sums.add(pair, times):
                    yield sum_rows(*s)
        if sums.held:
            yield sum_rows(*sums.merge())

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"is_doc boolean, {_DOC}, pairs array<long>, times array<long>")


def _score_frequent(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Adds n_best and count_sum over the links whose pair is among ``frequent`` (pair, count, best); rest has the others."""
    table = frequent.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    known = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            n = batch.num_rows
            column = {name: batch.column(batch.schema.get_field_index(name)) for name in ("pairs", "times")}
            bounds = np.concatenate([[0], np.cumsum(column["pairs"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            pair, times = (column[c].flatten().to_numpy() for c in ("pairs", "times"))
            slot = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[slot] == pair if len(pairs) else np.zeros(len(pair), bool)
            count, top = (np.where(hit, x[slot], 0) if len(pairs) else np.zeros(len(pair), np.int64) for x in (counts, best))
            rest = ~hit
            left = _sums(rest, bounds)
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("row", *_NAMES)]
            sums = [pa.array(_sums(times * x, bounds), pa.int64()) for x in (top, count)]
            yield pa.RecordBatch.from_arrays([*own, *sums, at.list_column(pair[rest], left, pa.int64()), at.list_column(times[rest], left, pa.int64())], names=["row", *_NAMES, "n_best", "count_sum", "pairs", "times"])

    return rows.mapInArrow(run, f"row long, {_DOC}, n_best long, count_sum long, pairs array<long>, times array<long>")


def align_tokenizers(docs: DataFrame, files: Tokenizers = Tokenizers(), frequent_bits: int = 20, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is encoded with one space in front of it, without special tokens; their strings are plain text. Null and
    empty texts, and those whose joined tokens are not the space and the text (B reads U+2581 as a space), have no
    tokens: all counts 0 and groups_sha256 ''. Groups are cut where tokens of A and B both end; links are all pairs of
    an A and a B token that share bytes. n_best counts links whose pair is linked as often in the corpus as any of its
    B id, ties included; count_sum adds up, over links, how often their pair is linked. Repeated rows each count and get
    a row of their own, whatever the ids; other columns are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    first = scratch.write(aligned_documents(docs, files, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    sums = first.filter("not is_doc").select(F.explode(F.arrays_zip("pairs", "times")).alias("s")).groupBy(F.col("s.pairs").alias("pair")).agg(F.sum("s.times").alias("count"))
    sums = scratch.write(sums, "pairs")
    b_id = F.col("pair") % F.lit(load_pair(files).b_ids)
    # One row per id of B, so that its size is that of the vocabulary.
    highest = sums.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    counted = sums.withColumn("b", b_id).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    # The least power of two that no more than 2**frequent_bits pairs reach.
    log = F.length(F.bin("count")) - 1
    reach, least = 0, 64
    for r in sorted(counted.groupBy(log.alias("log")).count().collect(), reverse=True):
        reach += r["count"]
        if reach > 1 << frequent_bits:
            break
        least = r["log"]
    counted = scratch.write(counted.withColumn("frequent", log >= least), "counted")
    docs_ = first.filter("is_doc").select("row", *_NAMES, "pairs", "times")
    scored = scratch.write(_score_frequent(docs_, counted.filter("frequent").select("pair", "count", "best")), "scored")
    rest = scratch.write(scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("s")).select("row", F.col("s.pairs").alias("pair"), F.col("s.times").alias("times")), "rest")
    more = rest.join(counted.filter("not frequent"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("best_"), F.sum(F.col("times") * F.col("count")).alias("sum_"))
    zero = F.lit(0).cast("long")
    out = scored.select("row", *_NAMES, "n_best", "count_sum").join(more, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("best_", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_", zero)).alias("count_sum"), "groups_sha256")

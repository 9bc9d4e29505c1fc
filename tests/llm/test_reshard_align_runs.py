"""Resharding, tokenizer alignment and periodic runs against brute force, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import alignment, registry, sharding, tandem
from tidewire.llm.common import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, n long, shard int, slot long, row long, pairs string"
BLANK = b" \t\n\x0b\x0c\r"


def documents(spark, texts):
    """Rows with extra columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "ab"[k % 2], 0, "x", 1, 3, 4, 5, "p") for k, (i, t) in enumerate(texts)], DOCS)


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, empty, blank, long, odd and repeated texts."""
    long = "alpha beta gamma " * 4_000 + "end " + " ".join(f"w{i}" for i in range(3_000))
    texts = [None, "", " \n\t ", "one two", "one two", " lead", "<|endoftext|> <s> </s> <unk>", "▁ low line", "é ñ 漢字 \U0001f600‍ x y", "a\x00b\tc\r\n d", long]
    ids = [1, 2, 3, 4, 4, None, 7, 8, 9, 10, 11]
    return documents(spark, list(zip(ids, texts, strict=True)))


def whole(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def same_rows(got, want, cols):
    assert sorted(repr([r[c] for c in cols]) for r in got) == sorted(repr(list(w)) for w in want)


# Periodic runs


def brute_runs(words, min_words=24, min_periods=3):
    name = {}
    x = np.array([name.setdefault(w, len(name)) for w in words], np.int64)
    n, out = len(x), []
    for q in range(1, n // min_periods + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= max(min_words, min_periods * q) and not any((x[a + p : a + length] == x[a : a + length - p]).all() for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_row(doc_id, text, rewrite=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


RUN_COLS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_brute_force(spark, sf):
    got = registry.op13_periodic_runs(spark, sf).collect()
    want = [runs_row(*d) for d in whole(spark, sf)]
    assert sum(w[1] > 0 for w in want) > 3
    same_rows(got, want, RUN_COLS)


def test_runs_edge(spark, edge):
    got = tandem.periodic_runs(edge).collect()
    same_rows(got, [runs_row(r.doc_id, r.text, False) for r in edge.collect()], RUN_COLS)
    assert tandem.periodic_runs(edge.filter("false")).collect() == []


def test_runs_random(spark):
    """Small alphabets, powers, nested and touching runs, Fibonacci words, noise."""
    rng, texts = random.Random(5), []
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts += [" ".join(fib[-1]), "x " * 24, "x " * 23, "x y " * 12 + "x y x", "  a " * 30]
    for _ in range(300):
        words = []
        while len(words) < rng.randrange(1, 250):
            base = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
            words += base * rng.choice([1, 2, 3, 5, 9]) + base[: rng.randrange(len(base) + 1)]
            if rng.random() < 0.3:
                words += words[-rng.randrange(1, 60) :] * 3
        texts.append(rng.choice([" ", "  ", "\n", "\t \x0b"]).join(words))
    rows = list(enumerate(texts))
    for rewrite in (False, True):
        got = tandem.periodic_runs(documents(spark, rows), rewrite=rewrite).collect()
        same_rows(got, [runs_row(i, t, rewrite) for i, t in rows], RUN_COLS)


def test_all_runs_linear_method():
    """Every maximal repetition of two periods or more, on all kinds of short strings."""
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(2, 40)
        x = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
        got = tandem.all_runs(np.array([*x, 9]))
        assert list(zip(*(a.tolist() for a in got), strict=True)) == brute_runs(x, 2, 2)


# Alignment


def brute_alignment(texts):
    import sentencepiece

    files = alignment.Tokenizers()
    a, b = Tokenizer.from_file(files.a), sentencepiece.SentencePieceProcessor(model_file=files.b)
    a.encode_special_tokens = True
    letter = alignment.byte_of_letter()
    rows, links = [], []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for e in both:
            i2, j2 = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            i, j = i2, j2
        own, j = [], 0
        for i, end in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(ends_b) and (ends_b[k - 1] if k else 0) < end:
                own.append((ids_a[i], ids_b[k]))
                k += 1
        rows.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = collections.Counter(p for own in links for p in own)
    top = collections.defaultdict(int)
    for (_, y), c in count.items():
        top[y] = max(top[y], c)
    return [(n_a, n_b, n_g, len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), sha) for (n_a, n_b, n_g, sha), own in zip(rows, links, strict=True)]


ALIGN_COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_brute_force(spark, sf):
    docs = whole(spark, sf)
    got = registry.op12_token_alignment(spark, sf).collect()
    same_rows(got, [(i, *r) for (i, _), r in zip(docs, brute_alignment([t for _, t in docs]), strict=True)], ALIGN_COLS)


@pytest.mark.parametrize("frequent_bits", [0, 4, 20])
def test_alignment_edge(spark, edge, frequent_bits):
    rows = edge.collect()
    got = alignment.align_tokenizers(edge, frequent_bits=frequent_bits).collect()
    want = brute_alignment([r.text for r in rows])
    assert sum(w[0] > 0 for w in want) > 3
    same_rows(got, [(r.doc_id, *w) for r, w in zip(rows, want, strict=True)], ALIGN_COLS)
    assert alignment.align_tokenizers(edge.filter("false"), frequent_bits=frequent_bits).collect() == []


# Resharding


def check_shards(rows, shards, limit):
    sizes, slots = collections.Counter({j: 0 for j in range(shards)}), collections.defaultdict(list)
    for shard, slot, size in rows:
        sizes[shard] += size
        slots[shard].append(slot)
    assert set(sizes) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(x - mean) <= limit for x in sizes.values())


def test_resharding_query(spark, sf):
    got = registry.op11_resharding(spark, sf).collect()
    docs = whole(spark, sf)
    size = lambda t: len((t or "").encode()) + 16
    same_rows(got, [(i, size(t), zlib.crc32((t or "").encode())) for i, t in docs], ["doc_id", "size", "text_crc32"])
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    check_shards([(r.shard, r.slot, r.size) for r in got], 40, max(size(t) for _, t in docs) + 1)
    again = registry.op11_resharding(spark, sf).collect()
    same_rows(again, [tuple(r) for r in got], got[0].__fields__)


def test_transfers_move_fewest_bytes():
    """With one zone exactly what stands above the capacities moves; with zones, as little as trying all small flows finds."""
    rng = random.Random(3)
    for _ in range(100):
        sizes = {i: rng.randrange(0, 50) for i in range(-1, rng.randrange(1, 7))}
        caps = sharding.equal_capacities(sum(sizes.values()), rng.randrange(1, 8))
        moves = sharding.solve_transfers(sizes, caps)
        for i, x in sizes.items():
            assert sum(n for o, _, n in moves if o == i) == x
        for j, x in enumerate(caps):
            assert sum(n for _, o, n in moves if o == j) == x
        stay = sum(min(x, caps[i]) for i, x in sizes.items() if 0 <= i < len(caps))
        assert sum(n for i, j, n in moves if i != j) == sum(sizes.values()) - stay
    s = sharding.ReshardSettings(zones=(0, 1, 0, 1), far=4)
    for _ in range(40):
        sizes = {i: rng.randrange(0, 4) for i in range(3)}
        caps = sharding.equal_capacities(sum(sizes.values()), 4)
        cost = lambda i, j: 0 if i == j else 1 if s.zone(i) == s.zone(j) else 4
        units = [i for i, x in sizes.items() for _ in range(x)]
        best = {tuple(caps): 0}
        for i in units:
            step = {}
            for room, c in best.items():
                for j in range(4):
                    if room[j]:
                        left = (*room[:j], room[j] - 1, *room[j + 1 :])
                        step[left] = min(step.get(left, 10**9), c + cost(i, j))
            best = step
        assert sum(n * cost(i, j) for i, j, n in sharding.solve_transfers(sizes, caps, s)) == min(best.values())


def test_reshard_round_trip(spark, edge):
    """All columns come back as they were; shards that keep their bytes are left alone."""
    for old, shards in ((F.lit(0), 3), (F.lit(None).cast("int"), 2), (F.col("doc_id") % 3, 5)):
        done = sharding.reshard(edge, old, shards, shared_path(spark, "shards"))
        back = done.read(spark)
        assert done.untouched == []
        same_rows(back.select(*edge.columns).collect(), [tuple(r) for r in edge.collect()], edge.columns)
        slots = collections.defaultdict(list)
        for r in back.select(done.shard_col, done.slot_col).collect():
            slots[r[0]].append(r[1])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    rows = documents(spark, [(i, "x" * 84) for i in range(400)])
    done = sharding.reshard(rows, F.col("doc_id") % 4, 4, shared_path(spark, "shards"))
    assert done.untouched == [0, 1, 2, 3] and done.read(spark).count() == 0
    done = sharding.reshard(rows, F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 150, 1).when(F.col("doc_id") < 300, 2).otherwise(3), 4, shared_path(spark, "shards"))
    assert done.untouched == [0, 3] and done.transfers == [(0, 0, 10_000), (1, 1, 5_000), (2, 1, 5_000), (2, 2, 10_000), (3, 3, 10_000)]
    moved = done.read(spark).select("doc_id", done.shard_col).collect()
    assert len(moved) == 200 and sum(r[1] == 1 for r in moved) == 100 and all(r[1] == 1 for r in moved if r[0] < 150)
    none = sharding.reshard(rows.filter("false"), F.lit(0), 4, shared_path(spark, "shards"))
    assert none.read(spark).count() == 0


def test_reshard_hot_row_and_copies(spark):
    """One row larger than a shard, and copies that are a third of all: no row is lost, no shard passes what a row adds."""
    texts = [(i, "copy of one text " * 6) for i in range(300)] + [(1_000 + i, f"text {i} " * (i % 30)) for i in range(600)] + [(5_000, "y" * 40_000)]
    docs = documents(spark, texts)
    done = sharding.reshard(docs, F.col("doc_id") % 7, 5, shared_path(spark, "shards"), sharding.ReshardSettings(file_bytes=4_000))
    back = done.read(spark).select("doc_id", "text", done.shard_col, done.slot_col).collect()
    assert sorted(r[0] for r in back) == sorted(i for i, _ in texts)
    check_shards([(r[2], r[3], len(r[1]) + 16) for r in back], 5, 40_017)

"""Quality classifier: a sparse rule ensemble.

Statistics of each text (one pass, byte classes and word hashes) feed small boosted trees on a bounded sample of
labelled rows; every path from a root is a conjunctive rule; a lasso logistic regression keeps few of them; the kept
rules are compiled into Spark column expressions over the statistics, which score the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import arrowtext as at
from tidewire.llm.common import unused

FEATURES = ("words", "word_bytes", "upper", "digit", "punct", "symbol", "bang", "bar", "high", "per_line", "distinct", "top_word", "repeat", "gram_repeat", "line_repeat", "caps_words", "symbol_words")
SYMBOLS = b"#$%&*<>=@\\^_`{}~/+[]"


@dataclass(frozen=True)
class QualitySettings:
    """The sample is bounded by train_rows, the rows smallest by hash of doc_id; threshold turns scores into 0 or 1."""

    train_rows: int = 20_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    lasso: float = 2e-3
    steps: int = 600
    threshold: float = 0.7


def _byte_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASS = {"upper": _byte_table(bytes(range(65, 91))), "digit": _byte_table(bytes(range(48, 58))), "punct": _byte_table(b".,;:?'\"()-"), "symbol": _byte_table(SYMBOLS), "bang": _byte_table(b"!"), "bar": _byte_table(b"|"), "high": np.arange(256) >= 128}
_LOWER_LETTER = _byte_table(bytes(range(97, 123)))
_NEWLINE = _byte_table(b"\n")


def _doc_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document of a slice; all are 0 for an empty text."""
    words = at.Words(data, offsets, at.SPACED)
    n, bytes_ = words.count, np.maximum(1, np.diff(offsets))
    one = np.maximum(1, n)
    f = {name: _doc_sums(table[data], offsets) / bytes_ for name, table in _CLASS.items()}
    f["words"] = np.log1p(n)
    f["word_bytes"] = np.bincount(words.doc, weights=words.end - words.start, minlength=len(n)) / one
    f["per_line"] = np.log1p(n / (1 + _doc_sums(_NEWLINE[data], offsets)))
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    f["repeat"] = np.bincount(words.doc, weights=same, minlength=len(n)) / one
    up, low, sym = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_CLASS["upper"], _LOWER_LETTER, _CLASS["symbol"]))
    caps = (up[words.end] - up[words.start] > 1) & (low[words.end] == low[words.start])
    f["caps_words"] = np.bincount(words.doc, weights=caps, minlength=len(n)) / one
    f["symbol_words"] = np.bincount(words.doc, weights=sym[words.end] > sym[words.start], minlength=len(n)) / one
    lines = at.Words(data, offsets, ~_NEWLINE)
    distinct, top, grams, line_repeat = (np.zeros(len(n)) for _ in range(4))
    where, gram = words.grams(4)
    lo, hi = np.searchsorted(where, words.first[:-1]), np.searchsorted(where, words.first[1:])
    for d in np.flatnonzero(n):
        h = np.sort(words.hash[words.first[d] : words.first[d + 1]])
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        # Long texts repeat words by nature; the share is set against the square root of the length.
        distinct[d] = (len(cuts) - 1) / np.sqrt(len(h))
        top[d] = np.diff(cuts).max() / len(h)
        if hi[d] > lo[d]:
            grams[d] = 1 - len(np.unique(gram[lo[d] : hi[d]])) / (hi[d] - lo[d])
        k = lines.first[d + 1] - lines.first[d]
        if k > 1:
            line_repeat[d] = 1 - len(np.unique(lines.hash[lines.first[d] : lines.first[d + 1]])) / k
    f |= {"distinct": distinct, "top_word": top, "gram_repeat": grams, "line_repeat": line_repeat}
    return np.column_stack([f[name] for name in FEATURES]).astype(np.float64)


def with_statistics(docs: DataFrame, text_col: str = "text", stats: str = "stats") -> DataFrame:
    """``docs`` with a column ``stats``, an array of FEATURES. Null texts count as empty; no shuffle."""
    columns = docs.columns
    schema = docs.withColumn(stats, F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in at.slices(batch.column(columns.index(text_col))):
                x = _stats(data, offsets)
                part = batch.slice(row, len(x))
                lists = at.list_column(x.ravel(), [len(FEATURES)] * len(x), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*columns, stats])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature number, whether at most, value), with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, at_most, v in self.terms:
            out &= (x[:, f] <= v) if at_most else (x[:, f] > v)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for r in self.rules:
            cond = F.lit(True)
            for f, at_most, v in r.terms:
                value = F.get(stats, F.lit(f))
                cond = cond & ((value <= v) if at_most else (value > v))
            total = total + F.when(cond, r.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, path: tuple, out: list, pred: np.ndarray, rows: np.ndarray) -> None:
    """A regression tree on the residuals; adds the rule of every node but the root, and each leaf's value to pred."""
    best, total, mass = (1e-9, None, None), residual[rows].sum(), weight[rows].sum()
    if depth and len(rows) >= 20:
        for f in range(x.shape[1]):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
                left = v <= cut
                wl, rl = weight[rows][left].sum(), residual[rows][left].sum()
                if min(left.sum(), len(rows) - left.sum()) < 10 or wl <= 0 or mass - wl <= 0:
                    continue
                gain = rl * rl / wl + (total - rl) ** 2 / (mass - wl) - total * total / mass
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] is None:
        pred[rows] += total / max(mass, 1e-9)
        return
    _, f, cut = best
    left = x[rows, f] <= cut
    for at_most, part in ((True, rows[left]), (False, rows[~left])):
        terms = (*path, (f, at_most, cut))
        out.append(terms)
        _tree(x, residual, weight, depth - 1, terms, out, pred, part)


def fit_rules(x: np.ndarray, y: np.ndarray, s: QualitySettings = QualitySettings()) -> RuleEnsemble:
    """Boosted trees give candidate rules; proximal gradient steps fit their lasso logistic weights."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(rate / (1 - rate))), ())
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, None] = {}
    rng = np.random.default_rng(7)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), min(len(y), 3000), replace=False))
        terms: list = []
        pred = np.zeros(len(y))
        # Leaves are fitted on the drawn rows; the rules then say what the others get.
        _tree(x, y - p, np.maximum(p * (1 - p), 1e-6), s.depth, (), terms, pred, rows)
        found |= dict.fromkeys(terms)
        for t in terms:
            held = Rule(t, 0.0).holds(x)
            inside = held[rows]
            if any(len(o) > len(t) and o[: len(t)] == t for o in terms) or not inside.any():
                continue
            margin[held] += s.rate * np.clip(pred[rows][inside].mean(), -4, 4)
        margin = np.clip(margin, -8, 8)
    # Of rules that hold for the same rows the first stays. One bit a row tells them apart; the fit takes 4 bytes.
    first: dict[bytes, tuple] = {}
    for t in found:
        held = Rule(t, 0.0).holds(x)
        if 0 < held.mean() < 1:
            first.setdefault(np.packbits(held).tobytes(), t)
    rules = list(first.values())
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    hold = np.empty((len(y), len(rules)), np.float32)
    for i, t in enumerate(rules):
        hold[:, i] = Rule(t, 0.0).holds(x)
    # Both labels weigh the same in total, up to a prior that leans to label 1.
    sample = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(hold.shape[1]), 0.0
    z, bz, t = w.copy(), b, 1.0
    gram = sum(hold[i : i + 1000].T @ (hold[i : i + 1000] * sample[i : i + 1000, None]) for i in range(0, len(y), 1000))
    step = 4.0 / max(1e-9, np.linalg.norm(gram / len(y), 2) + 1)
    for _ in range(s.steps):
        g = (1 / (1 + np.exp(-(hold @ z.astype(np.float32) + bz))) - y) * sample / len(y)
        new = z - step * (hold.T @ g.astype(np.float32))
        new = np.sign(new) * np.maximum(np.abs(new) - step * s.lasso, 0)
        nb = bz - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    # Labels of one kind are rarer: the intercept goes back from equal weights to the sample's own odds.
    return RuleEnsemble(float(b + np.log(y.mean() / (1 - y.mean())) * 0.5), tuple(Rule(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


_TERM = pa.struct([("f", pa.int32()), ("at_most", pa.bool_()), ("v", pa.float64())])
MODEL = pa.schema([("intercept", pa.float64()), ("weights", pa.list_(pa.float64())), ("terms", pa.list_(pa.list_(_TERM)))])


def held_out(doc_id: Column) -> Column:
    """Rows kept for judging the fit: crc32 of the doc_id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, s: QualitySettings = QualitySettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, y, h, stats) of at most s.train_rows labelled rows that are not held out, the smallest by hash.

    Rows without a doc_id, and labels other than 0 and 1, are left out. A doc_id that repeats gives a row for each of
    its texts and labels; the limit holds for rows, not for ids.
    """
    l = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    l = l.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(s.train_rows)
    # The sample's size is bounded by train_rows, so it is broadcast to the texts.
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(l), "doc_id")
    rows = with_statistics(x).select("doc_id", "y", F.xxhash64("text").alias("h"), "stats")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "h").limit(s.train_rows)


def fit_quality(docs: DataFrame, labels: DataFrame, s: QualitySettings = QualitySettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """The rules fitted on training_rows, in one task that reads at most s.train_rows rows of statistics.

    Only the rules travel to the driver. Without usable rows, or with one label only, there are no rules.
    """

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("h", "ascending")])
        x = table["stats"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        model = fit_rules(x, table["y"].to_numpy().astype(np.float64), s)
        terms = [[{"f": f, "at_most": bool(m), "v": v} for f, m, v in r.terms] for r in model.rules]
        return pa.Table.from_pydict({"intercept": [model.intercept], "weights": [[r.weight for r in model.rules]], "terms": [terms]}, schema=MODEL)

    rows = training_rows(docs, labels, s, id_col, text_col, label_col)
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "intercept double, weights array<double>, terms array<array<struct<f:int,at_most:boolean,v:double>>>").first()
    if found is None:
        return fit_rules(np.zeros((0, len(FEATURES))), np.zeros(0), s)
    return RuleEnsemble(found.intercept, tuple(Rule(tuple((t.f, t.at_most, t.v) for t in ts), w) for ts, w in zip(found.terms, found.weights, strict=True)))


def score_quality(docs: DataFrame, model: RuleEnsemble, s: QualitySettings = QualitySettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts score as empty ones; a null doc_id is not held out. Other columns are ignored; an empty table
    gives no rows, and without usable labels every text gets the same score.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_statistics(x).select("doc_id", model.score(F.col("stats")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: RuleEnsemble, s: QualitySettings = QualitySettings(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns and repeated rows as they are; no shuffle.

    Null texts are judged as empty ones. An empty table gives no rows.
    """
    stats = unused(docs.columns, "stats")
    return with_statistics(docs, text_col, stats).filter(model.score(F.col(stats)) >= s.threshold).drop(stats)


def crc_mod4(doc_id: int) -> int:
    """The held-out rule in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4

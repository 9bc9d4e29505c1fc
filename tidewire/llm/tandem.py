"""Periodic runs of words, by tandem repeats (the linear method of Gusfield and Stoye).

Lempel-Ziv blocks of a string give squares that cover, from the left, the first occurrence of every kind of square in
it; from the places where these end in the suffix tree, walks along suffix links find all their rotations, and so the
whole vocabulary of squares; the leaves below are all their occurrences. Occurrences of one period that start at
neighbouring words are one run.

The string is put together, for a slice of an Arrow batch at a time, from those stretches of the documents in which
every word lies in a repeated 16-gram - no run of 24 words and three periods has other words - with separators that
occur once. Ranks of all substrings of 2**l words (prefix doubling) order the suffixes and answer, for whole arrays of
position pairs, how far the words before or after them agree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import arrowtext as at


@dataclass(frozen=True)
class RunSettings:
    """A run has at least ``min_words`` words and ``min_periods`` periods, of which each is at least 1 word.

    ``gram`` words of a run's first period stand again one period later wherever min_words >= gram + gram / 2 and
    min_periods >= 3, so stretches without repeated grams hold no run.
    """

    min_words: int = 24
    min_periods: int = 3
    gram: int = 16


class Factors:
    """Ranks of the substrings of 1, 2, 4, ... symbols at each position; the last ranks tell all suffixes apart."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names, size = [np.append(names, -1)], 1
        while names.max() < n - 1:
            behind = np.zeros(n, np.int64)
            behind[: n - size] = names[size:] + 1
            names = np.unique(names * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
            self.names.append(np.append(names, -1))
            size *= 2
        self.rank = names
        self.order = np.empty(n, np.int64)
        self.order[names] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j (i != j) on are the same."""
        x, y = i.copy(), j.copy()
        for level in range(len(self.names) - 1, -1, -1):
            step = (self.names[level][x] == self.names[level][y]).astype(np.int64) << level
            x += step
            y += step
        return x - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j (i != j) are the same."""
        x, y = i.copy(), j.copy()
        for level in range(len(self.names) - 1, -1, -1):
            size = 1 << level
            fits = (x >= size) & (y >= size)
            step = (fits & (self.names[level][np.where(fits, x - size, 0)] == self.names[level][np.where(fits, y - size, 0)])).astype(np.int64) << level
            x -= step
            y -= step
        return i - x

    def keys(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that, with the size (at least 1), are the same for equal substrings only."""
        level = np.frexp(size.astype(np.float64))[1] - 1
        first, last = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for k in np.unique(level):
            m = level == k
            first[m], last[m] = self.names[k][i[m]], self.names[k][i[m] + size[m] - (1 << k)]
        return first, last


def blocks(f: Factors) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest that also begins earlier, or one new symbol."""
    order, n = f.order.tolist(), f.n
    before, after, stack = [-1] * n, [-1] * n, []
    for k, x in enumerate(order):
        while stack and order[stack[-1]] > x:
            after[order[stack.pop()]] = x
        before[x] = order[stack[-1]] if stack else -1
        stack.append(k)
    size, here = np.zeros(n, np.int64), np.arange(n)
    for other in (np.array(before), np.array(after)):
        have = other >= 0
        size[have] = np.maximum(size[have], f.ahead(here[have], other[have]))
    steps, starts, i = np.maximum(size, 1).tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    return np.array(starts, np.int64)


def _one_to(sizes: np.ndarray) -> np.ndarray:
    """1, ..., sizes[0], 1, ..., sizes[1], ... """
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def covering_squares(f: Factors, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the first occurrence of every kind of square from the left.

    The first occurrence of a square lies in no block alone and its right half ends in the block after that of its
    centre at the latest, so that it holds the block's start in its left half or the next block's start in its right.
    """
    ends = np.append(starts[1:], f.n)
    sizes = ends - starts
    found = []
    inner = ends < f.n
    for bound, reach, side in ((ends[inner], sizes[inner], -1), (starts[1:], (sizes + np.append(sizes[1:], 0))[1:], 1)):
        k = _one_to(reach)
        h = np.repeat(bound, reach)
        q = h + side * k
        inside = (q >= 0) & (q < f.n)
        k, h, q = k[inside], h[inside], q[inside]
        fore = f.ahead(h, q)
        some = fore > 0
        k, h, q, fore = k[some], h[some], q[some], fore[some]
        back = f.behind(h, q)
        square = (fore + back >= k) & ((back > 0) | (side < 0))
        left = (np.minimum(h, q) - np.minimum(back, k - 1))[square]
        found.append(np.stack([left, k[square]]))
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    primitive = _primitive(f, start, period)
    return start[primitive], period[primitive]


def _primitive(f: Factors, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power of a shorter word."""
    good = np.ones(len(start), bool)
    if not len(start):
        return good
    top = int(period.max()) + 1
    least = np.arange(top)
    for r in range(2, int(top**0.5) + 1):
        if least[r] == r:
            part = least[r * r :: r]
            part[part == np.arange(r * r, top, r)] = r
    rest = period.copy()
    todo = np.flatnonzero(rest > 1)
    while len(todo):
        r = least[rest[todo]]
        d = period[todo] // r
        good[todo[f.ahead(start[todo], start[todo] + d) >= period[todo] - d]] = False
        rest[todo] //= r
        todo = todo[(rest[todo] > 1) & good[todo]]
    return good


class Tree:
    """The suffix tree: leaves 0 to n - 1 in the suffixes' order, the root n, other inner nodes after it."""

    def __init__(self, f: Factors, symbols: np.ndarray):
        n = self.n = f.n
        common = [0, *f.ahead(f.order[:-1], f.order[1:]).tolist()] if n > 1 else [0]
        order = f.order.tolist()
        depth, low, high, parent, first = [n - i for i in order] + [0], [*range(n), 0], [*range(n), n - 1], [-1] * (n + 1), [*order, n]
        stack = [n]
        for k in range(1, n + 1):
            d, child = common[k] if k < n else -1, k - 1
            while depth[stack[-1]] > d:
                v = stack[-1]
                parent[child], high[v] = v, k - 1
                if first[child] < first[v]:
                    first[v] = first[child]
                child = v
                if v == n:
                    break
                stack.pop()
            if child == n:
                break
            if depth[stack[-1]] < d:
                depth.append(d)
                low.append(low[child])
                high.append(k)
                parent.append(-1)
                first.append(n)
                stack.append(len(depth) - 1)
            v = stack[-1]
            parent[child] = v
            if first[child] < first[v]:
                first[v] = first[child]
        #: first is the leftmost suffix below each node, low and high its leaves.
        self.depth, self.low, self.high, self.parent, self.first, self.order, self.rank = depth, low, high, parent, first, order, f.rank.tolist()
        self.symbols, self.width = symbols.tolist(), int(symbols.max()) + 1
        a, up, lo = np.array(depth), np.array(parent), np.array(low)
        nodes = np.flatnonzero(up >= 0)
        edge = symbols[f.order[lo[nodes]] + a[up[nodes]]]
        self.child = dict(zip((up[nodes] * self.width + edge).tolist(), nodes.tolist(), strict=True))
        # A suffix link leads to the node of the same substring without its first symbol.
        inner = np.arange(n + 1, len(depth))
        at_, size = f.order[lo[inner]], a[inner]
        self.link = dict.fromkeys(inner[size == 1].tolist(), n)
        long = size > 1
        own = f.keys(at_, size)
        to = f.keys(at_[long] + 1, size[long] - 1)
        both = [np.concatenate([x, y]) for x, y in zip(own, to, strict=True)]
        name = np.unique(both[0] * (n + 1) + both[1], return_inverse=True)[1]
        name = name * (n + 1) + np.concatenate([size, size[long] - 1])
        by = np.argsort(name[: len(inner)])
        self.link |= zip(inner[long].tolist(), inner[by[np.searchsorted(name[: len(inner)], name[len(inner) :], sorter=by)]].tolist(), strict=True) if long.any() else ()


def vocabulary(t: Tree, start: np.ndarray, period: np.ndarray) -> set[tuple[int, int]]:
    """(node, length) of every kind of square: it ends on the edge above the node.

    ``start`` and ``period`` are covering squares.
    """
    depth, low, parent, first, order, symbols, child, link, width, root = t.depth, t.low, t.parent, t.first, t.order, t.symbols, t.child, t.link, t.width, t.n
    # Bottom up: a node takes the list of its leftmost leaf; every other list has squares that occur earlier.
    lists: dict[int, list[int]] = {}
    for i, k in zip(start.tolist(), period.tolist(), strict=True):
        lists.setdefault(i, []).append(2 * k)
    ends = []
    for i, sizes in lists.items():
        sizes.sort()
        v = t.rank[i]
        while sizes and v != root and first[v] == i:
            above = depth[parent[v]]
            while sizes and sizes[-1] > above:
                ends.append((v, sizes.pop()))
            v = parent[v]
    seen = set(ends)
    for v, size in ends:
        while True:
            i, p = order[low[v]], parent[v]
            x = root if p == root else link[p]
            # Down to the place of the square without its first symbol, edge by edge.
            while depth[x] < size - 1:
                x = child[x * width + symbols[i + 1 + depth[x]]]
            if depth[x] == size - 1:
                x = child.get(x * width + symbols[i], -1)
                if x < 0:
                    break
            elif symbols[order[low[x]] + size - 1] != symbols[i]:
                break
            if (x, size) in seen:
                break
            seen.add((x, size))
            v = x
    return seen


def all_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs of two periods or more, by start and period; the period is the smallest.

    The last symbol occurs once. An empty string has none.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < 3:
        return none, none, none
    f = Factors(symbols)
    start, period = covering_squares(f, blocks(f))
    if not len(start):
        return none, none, none
    t = Tree(f, symbols)
    ends = vocabulary(t, start, period)
    node, size = np.array(list(ends)).T
    low, high = np.array(t.low)[node], np.array(t.high)[node]
    counts = high - low + 1
    at_ = f.order[np.repeat(low, counts) + _one_to(counts) - 1]
    half = np.repeat(size // 2, counts)
    by = np.lexsort((at_, half))
    at_, half = at_[by], half[by]
    opens = np.concatenate([[True], (half[1:] != half[:-1]) | (at_[1:] != at_[:-1] + 1)])
    begin = np.flatnonzero(opens)
    last = np.append(begin[1:], len(at_)) - 1
    start, period = at_[begin], half[begin]
    length = at_[last] - start + 2 * period
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _stretches(doc: np.ndarray, gram: np.ndarray, at_: np.ndarray, n_words: int, word_doc: np.ndarray, s: RunSettings) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of stretches of words in repeated grams that stand near enough to each other to be periods of a run.

    ``gram`` has the hash of the ``s.gram`` words from word ``at_`` on, mixed with its document ``doc``.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(gram):
        return none
    by = np.argsort(gram, kind="stable")
    same = gram[by[1:]] == gram[by[:-1]]
    one, two = at_[by[:-1][same]], at_[by[1:][same]]
    size = np.bincount(word_doc, minlength=int(word_doc[-1]) + 1)[word_doc[one]] if len(one) else one
    for _ in range(3):
        near = (two - one) * s.min_periods <= size
        one, two, size = one[near], two[near], size[near]
        if not len(one):
            return none
        marks = np.concatenate([one, two])
        edge = np.bincount(marks, minlength=n_words + 1) - np.bincount(marks + s.gram, minlength=n_words + s.gram + 1)[: n_words + 1]
        inside = np.cumsum(edge)[:n_words] > 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | (word_doc[1:] != word_doc[:-1])
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | (word_doc[1:] != word_doc[:-1])
        first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        size = (end - first)[np.searchsorted(first, one, "right") - 1]
    long = end - first >= s.min_words
    return first[long], end[long]


def _rewritten(ids: list[int | None], words: at.Words) -> np.ndarray:
    """Which word of the slice stands at each place: in one document of ten a period is laid over the words from some on."""
    j = np.arange(len(words.doc)) - words.first[words.doc]
    a, p = words.count.copy(), np.ones(words.n_docs, np.int64)
    for d, (i, n) in enumerate(zip(ids, words.count.tolist(), strict=True)):
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            if h % 10 == 0:
                g = h // 10
                a[d] = g % n
                p[d] = 1 + (n - a[d]) // (3 + g % 8)
    a, p = a[words.doc], p[words.doc]
    return words.first[words.doc] + np.where(j >= a, a + (j - a) % p, j)


def slice_runs(words: at.Words, data: bytes, place: np.ndarray, s: RunSettings = RunSettings()) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document of a slice that has any; word x is the slice's ``place[x]``-th."""
    n = len(place)
    m = n - s.gram + 1
    if m <= 0:
        return {}
    inside = np.flatnonzero(words.doc[:m] == words.doc[s.gram - 1 :])
    grams = at.mix(at.roll(words.hash[place], s.gram)[inside] + words.doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first, end = _stretches(words.doc[inside], grams, inside, n, words.doc, s)
    if not len(first):
        return {}
    size = end - first
    # Each stretch is followed by a symbol of its own; the words' own numbers come after those.
    number: dict[bytes, int] = {}
    symbols = np.empty(int(size.sum()) + len(first), np.int64)
    bounds = np.cumsum(size + 1) - size - 1
    symbols[bounds + size] = np.arange(len(first))
    where = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    of = place[where]
    known = [number.setdefault(data[x:y], len(number)) for x, y in zip(words.start[of].tolist(), words.end[of].tolist(), strict=True)]
    symbols[np.repeat(bounds - np.cumsum(size) + size, size) + np.arange(len(where))] = np.array(known) + len(first)
    start, length, period = all_runs(symbols)
    keep = (length >= s.min_words) & (length >= s.min_periods * period)
    start, length, period = start[keep], length[keep], period[keep]
    stretch = np.searchsorted(bounds, start, "right") - 1
    start = start - bounds[stretch] + first[stretch]
    doc = words.doc[start]
    out: dict[int, list[tuple[int, int, int]]] = {}
    for d, x, y, z in zip(doc.tolist(), (start - words.first[doc]).tolist(), length.tolist(), period.tolist(), strict=True):
        out.setdefault(d, []).append((x, y, z))
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, s: RunSettings = RunSettings(), rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs.

    Words are runs of bytes other than ASCII white space, as they stand, numbered from 0. A run is a stretch of words
    with smallest period q, at least s.min_words and s.min_periods * q words, that can't be extended. start, length,
    period and exponent_milli (thousandths, rounded down) are those of the run with most periods, the leftmost of equal
    ones, then that of the least period; null without runs. collapsed_sha256 is that of the words outside all runs or in
    their first periods, joined by one space. Null and empty texts have no words. ``rewrite`` lays periods over one
    document of ten, by its doc_id (none where that is null), before runs are looked for. Repeated rows each get a row;
    other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in at.slices(batch.column(1)):
                words = at.Words(data, offsets, at.SPACED)
                ids = batch.column(0).slice(row, words.n_docs)
                place = _rewritten(ids.to_pylist(), words) if rewrite else np.arange(len(words.doc))
                raw = data.tobytes()
                found = slice_runs(words, raw, place, s)
                changed = np.bincount(words.doc[place != np.arange(len(place))], minlength=words.n_docs) > 0
                cols: list[list] = [[] for _ in range(8)]
                for d, (x, y, odd) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), changed.tolist(), strict=True)):
                    own, runs = raw[x:y].split(), found.get(d, [])
                    if odd:
                        a, b = words.first[d : d + 2].tolist()
                        own = [own[i - a] for i in place[a:b].tolist()]
                    if runs:
                        own = _kept(own, runs)
                    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                    values = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                long, text = pa.int64(), pa.string()
                kinds = [long, long, long, long, long, text, text, pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, _RESULT)

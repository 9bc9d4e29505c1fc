"""Personal data, with offset-preserving deobfuscation.

Each text is searched as it is, and once more after transducers have undone disguises: look-alike letters and digits,
zero-width characters, spelled digits, and "(at)" / "dot" in addresses. A transducer keeps for each character of its
output the source characters it stands for, so spans of the normalised text map back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: The base patterns (email is anchored at its @, see _emails).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "авеорсухіјѕһԁԛԝкмнтвАВЕКМНОРСТХІЈЅοαρυνκΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
    "abeopcyxijshdqwkmhtbABEKMHOPCTXIJSoapuvkABEZHIKMNOPTYXig",
)
INVISIBLE = frozenset("​‌‍⁠﻿­")
#: Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "|".join(DIGIT_WORDS)
SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ ,-]+)?(?:{_WORD})(?:[ ,-]{{1,3}}(?:{_WORD})){{6,}}(?![A-Za-z])", re.I | re.A)
SPELLED_PART = re.compile(rf"plus|{_WORD}", re.I | re.A)
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
#: Top-level domains after which a bare "at ... dot ..." counts as an address.
_TOP = "com|org|net|edu|gov|info|biz|io|co|ai|app|dev|me|eu|uk|us|ca|de|fr|es|it|nl|ch|at|be|pt|br|in|jp|test|example"
#: Bracketed "at" and "dot", or the bare words in the shape "name at host dot tld".
BRACKETED = re.compile(rf"\s{{0,3}}{_OPEN}\s{{0,2}}(at|dot|@|\.)\s{{0,2}}{_SHUT}\s{{0,3}}", re.I | re.A)
BRACKETS = re.compile(rf"{_OPEN}\s{{0,2}}(?:at|dot|@|\.)\s{{0,2}}{_SHUT}", re.I | re.A)
#: Four or more octets in digits or digit words, between dots in any form.
_OCTET = rf"(?:[0-9]{{1,3}}|(?:{_WORD})(?:[ ,-]{{1,3}}(?:{_WORD})){{0,2}})"
_DOT = rf"(?:\s{{1,3}}dot\s{{1,3}}|\s{{0,3}}{_OPEN}\s{{0,2}}(?:dot|\.)\s{{0,2}}{_SHUT}\s{{0,3}}|\.)"
OCTETS = re.compile(rf"(?<![A-Za-z0-9]){_OCTET}(?:{_DOT}{_OCTET}){{3,}}(?![A-Za-z0-9])", re.I | re.A)
OCTET_PART = re.compile(rf"{_DOT}|{_WORD}|[0-9]+", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(\s+at\s+)[A-Za-z0-9-]{1,63}((?:(?:\s+dot\s+|\.)[A-Za-z0-9-]{1,63}){0,4}\s+dot\s+(?:" + _TOP + r"))(?![A-Za-z0-9-])", re.I | re.A)
BARE_DOT = re.compile(r"\s+dot\s+", re.I | re.A)


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outwards in linear time."""
    done, at = 0, t.find("@")
    while at >= 0:
        i = at
        while i > done and (t[i - 1].isascii() and t[i - 1].isalnum() or t[i - 1] in "._%+-"):
            i -= 1
        m = DOMAIN.match(t, at + 1) if i < at else None
        if m:
            yield i, m.end()
            done = m.end()
        else:
            done = at + 1
        at = t.find("@", max(at + 1, done))


def _ips(t: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers, from the left of each dotted run; numbers above 255 drop their match."""
    for run in DOTTED.finditer(t):
        if run.group().count(".") < 3:
            continue
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(t: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(t):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(t: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def detect(t: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base spans, by kind as listed, then start."""
    out = []
    if "@" in t:
        out += [(0, a, b) for a, b in _emails(t)]
    if DIGIT.search(t):
        if "." in t:
            out += [(1, a, b) for a, b in _ips(t)]
        out += [(2, a, b) for a, b in _cards(t)]
        if "+" in t:
            out += [(3, a, b) for a, b in _phones(t)]
    return out


class Tape:
    """A text with, for each of its characters, the span of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a text, for sorted disjoint edits; its characters stand for the whole replaced span."""
        if not edits:
            return
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


class _Letters(dict):
    """Code point to ASCII look-alike, to nothing for invisible ones, to itself for all others; filled as they occur."""

    def __missing__(self, code: int) -> int | str | None:
        c = chr(code)
        new: int | str | None = code
        if c in INVISIBLE:
            new = None
        elif c > "ÿ":
            other = c.translate(LOOKALIKES)
            if other == c:
                other = unicodedata.normalize("NFKC", c)
            if other != c and len(other) == 1 and other.isascii():
                new = other
        self[code] = new
        return new


_LETTERS = _Letters()
_GONE = np.array(sorted(map(ord, INVISIBLE)), np.uint32)


def _letters(tape: Tape) -> None:
    """Look-alikes to ASCII, one character each; invisible characters go."""
    new = tape.text.translate(_LETTERS)
    if len(new) != len(tape.text):
        stays = ~np.isin(np.frombuffer(tape.text.encode("utf-32-le", "surrogatepass"), np.uint32), _GONE)
        tape.start, tape.end = tape.start[stays], tape.end[stays]
    tape.text = new


def _octets(tape: Tape) -> None:
    """Spelled octets and dots to digits and dots. Words between plain dots alone are names, not addresses."""
    edits = []
    for run in OCTETS.finditer(tape.text):
        parts = list(OCTET_PART.finditer(tape.text, *run.span()))
        if not any(c.isdigit() for c in run.group()) and all(m.group() == "." for m in parts if m.group().lower() not in DIGIT_WORDS):
            continue
        at = run.start()
        for m in parts:
            if m.start() > at:
                edits.append((at, m.start(), ""))
            part = m.group().lower()
            new = part if part.isdigit() else DIGIT_WORDS.get(part, ".")
            if new != part:
                edits.append((*m.span(), new))
            at = m.end()
    tape.edit(edits)


def _spelled(tape: Tape) -> None:
    """Runs of at least seven digit words to digits; each digit stands for its word."""
    edits = []
    for run in SPELLED.finditer(tape.text):
        at = run.start()
        for m in SPELLED_PART.finditer(tape.text, run.start(), run.end()):
            if m.start() > at:
                edits.append((at, m.start(), ""))
            edits.append((*m.span(), DIGIT_WORDS.get(m.group().lower(), "+")))
            at = m.end()
    tape.edit(edits)


def _addresses(tape: Tape) -> None:
    """Disguised @ and dots of addresses."""
    sign = {"at": "@", "dot": ".", "@": "@", ".": "."}
    tape.edit([(*m.span(), sign[m.group(1).lower()]) for m in BRACKETED.finditer(tape.text)])
    edits = []
    for m in BARE.finditer(tape.text):
        edits.append((*m.span(1), "@"))
        edits += [(*d.span(), ".") for d in BARE_DOT.finditer(tape.text, *m.span(2))]
    tape.edit(edits)


def _disguised(t: str) -> bool:
    """Whether any transducer could change the text: the patterns themselves, behind tests that each match must pass."""
    if not t.isascii():
        try:
            t.encode("latin-1")
        except UnicodeEncodeError:
            return True
        if "­" in t:
            return True
    if BRACKETS.search(t):
        return True
    low = t.lower()
    dots = low.count("dot")
    if dots and BARE.search(t):
        return True
    words = sum(low.count(w) for w in DIGIT_WORDS)
    return words >= 7 and SPELLED.search(t) is not None or (words or dots) and dots + t.count(".") >= 3 and OCTETS.search(t) is not None


def deobfuscated(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in source characters found only after the disguises are undone; none lies inside a base span of its kind."""
    if not _disguised(t):
        return []
    tape = Tape(t)
    _letters(tape)
    _octets(tape)
    _spelled(tape)
    _addresses(tape)
    if tape.text == t:
        return []
    out = []
    for kind, a, b in detect(tape.text):
        a, b = tape.source(a, b)
        if not any(k == kind and x <= a and b <= y for k, x, y in base):
            out.append((kind, a, b))
    return out


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of base spans, base_sha256 and spans (base and disguised).

    Spans are kind:start:end in characters of the source, end exclusive, by kind as listed, then start. Null and empty
    texts have none. One pass without a shuffle; other columns are ignored; an empty table gives no rows.
    """

    def join(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            digests, spans = [], []
            for i, text in enumerate(batch.column(1)):
                t = text.as_py() or ""
                base = detect(t)
                for k, _, _ in base:
                    counts[i, k] += 1
                digests.append(hashlib.sha256(join(base).encode()).hexdigest())
                spans.append(join(sorted(base + deobfuscated(t, base))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[x.strip().split()[0] for x in OUT.split(",")])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, OUT)

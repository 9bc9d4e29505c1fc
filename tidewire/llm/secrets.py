"""Secret scans with an incremental blob ledger.

Native: DataFrame functions only. Every version of every path is addressed by the SHA-256 of its content; only
(blob, rule, rule version) triples that the ledger lacks are scanned, each once, and findings are joined back to all
paths that hold the blob. Which row of a blob is scanned is settled on narrow rows; texts stay where they are, but for
those of rows that repeat both path and blob and of blobs that some rules have seen and others have not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.common import drop_keyed, materialize, split_keyed, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters; leftmost, non-overlapping."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, base=True),
)
#: Well-known token shapes that the method adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}+", version=2),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", version=2),
)
RULES = BASE_RULES + MORE_RULES


def address(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob, text) with the blob's SHA-256 in 32 bytes; null texts are empty."""
    text = text_or_empty(text_col)
    return versions.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def unseen_blobs(blobs: DataFrame, paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, seen): each distinct blob once, with the 'kind/version' marks the ledger has of it, if any is missing.

    ``paths`` are the (path, blob) of ``blobs``, written: of each blob the row of the smallest path is taken.
    """
    rank = F.struct(F.col("path").isNull().alias("no_path"), F.col("path").alias("path"))
    rows = materialize(paths.groupBy("blob", "path").agg(F.count("*").alias("n")), "rows")
    # Written first, so that the join deals its own sides and a blob of very many paths can be split.
    several = materialize(rows.groupBy("blob").agg(F.min(rank).alias("first"), F.count("*").alias("m")).filter("m > 1").select("blob", "first"), "several")
    others = rows.join(several, "blob").filter(rank != F.col("first")).select("path", "blob")
    once = drop_keyed(blobs, others, ["path", "blob"])
    repeated = materialize(rows.filter("n > 1").select(F.struct("path", "blob").alias("mark")), "repeated")
    clear, maybe = split_keyed(once.withColumn("key", F.struct("path", "blob")), repeated, "key", "mark")
    once = clear.unionByName(maybe.dropDuplicates(["key"])).drop("key", "path")
    none = F.array().cast("array<string>")
    if ledger is None:
        return once.withColumn("seen", none)
    marks = materialize(ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "kind", "version")).alias("seen")), "marks")
    now = F.array(*[F.lit(f"{r.kind}/{r.version}") for r in rules])
    missing = F.size(F.array_except(now, "seen"))
    some = marks.filter((missing > 0) & (missing < len(rules))).withColumnsRenamed({"blob": "mark"})
    clear, maybe = split_keyed(drop_keyed(once, marks.filter(missing == 0).select("blob"), ["blob"]), some, "blob", "mark")
    told = maybe.join(some, F.col("blob") == F.col("mark"), "left").withColumn("seen", F.coalesce("seen", none))
    return clear.withColumn("seen", none).unionByName(told.drop("mark"))


def scan_blobs(unseen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, start, end), end exclusive, in characters, of all matches in (blob, text, seen).

    A pattern's matches and the pieces of text between them, both in order, give the offsets.
    """
    each = []
    for no, r in enumerate(rules):
        hits = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        groups = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else hits
        fresh = ~F.array_contains("seen", f"{r.kind}/{r.version}") & F.col("text").rlike(r.pattern)
        lengths = F.transform(F.arrays_zip(F.split("text", r.pattern, -1).alias("gap"), hits.alias("hit"), groups.alias("part")), lambda x: F.struct(F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["hit"]).cast("long").alias("hit"), F.char_length(x["part"]).cast("long").alias("part")))
        each.append(F.when(fresh, F.struct(F.lit(r.kind).alias("kind"), F.lit(no).alias("no"), F.lit(r.least).alias("least"), lengths.alias("m"))))
    found = unseen.select("blob", F.array_compact(F.array(*each)).alias("found")).filter(F.size("found") > 0)
    found = materialize(found, "matches").select("blob", F.explode("found").alias("f")).select("blob", "f.kind", "f.no", "f.least", F.posexplode("f.m").alias("pos", "x"))
    order = W.partitionBy("blob", "no").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.coalesce("x.hit", F.lit(0))).over(order)
    # The last gap has no match behind it.
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("x.hit")).filter("x.hit is not null and x.part >= least")
    return found.select("blob", "kind", "start", "end")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger): (path, blob) of every row, (blob, kind, start, end), and (blob, kind, version).

    ledger and findings are those of earlier scans, with which the new ones are united; findings of kinds whose rule
    has a new version are replaced. Every row of ``versions`` is a version: repeated rows and paths stay.
    """
    blobs = address(versions, path_col, text_col)
    paths = materialize(blobs.select("path", "blob"), "paths")
    unseen = unseen_blobs(blobs, paths, ledger, rules)
    fresh = materialize(scan_blobs(unseen, rules), "findings")
    marks = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("m")
    now = paths.select("blob").distinct().select("blob", marks).select("blob", "m.*")
    if ledger is None:
        return paths, fresh, now
    new = now.join(ledger, ["blob", "kind", "version"], "left_anti")
    if findings is not None:
        fresh = findings.join(new.select("blob", "kind"), ["blob", "kind"], "left_anti").unionByName(fresh)
    return paths, fresh, ledger.select("blob", "kind", "version").unionByName(new)


def findings_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: counts of the base kinds and the spans, by start, then kind as listed."""
    listed = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    no = listed[F.col("kind")]
    span = F.struct("start", no.alias("no"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    base = F.col("kind").isin([r.kind for r in rules if r.base])
    joined = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]))
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules if r.base]
    return findings.groupBy("blob").agg(*counts, joined(F.when(base, span)).alias("base"), joined(span).alias("spans"))


def scan_increments(increments: list[DataFrame], rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger) of scan_versions over increments in order, each against what those before it left.

    paths has (path, blob, known): whether the blob was in the ledger when its row came.
    """
    paths, findings, ledger = None, None, None
    for versions in increments:
        before = ledger
        own, findings, ledger = scan_versions(versions, ledger, findings, rules, path_col, text_col)
        ledger = materialize(ledger, "ledger")
        if before is None:
            own = own.withColumn("known", F.lit(False))
        else:
            known = materialize(before.select("blob").distinct().withColumn("known", F.lit(True)), "known")
            own = own.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        paths = own if paths is None else paths.unionByName(own)
    return paths, findings, ledger


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, increments: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of the base kinds, base_sha256, spans, known; see scan_versions.

    The rows come in as many increments, dealt by doc_id (null first); a blob that an earlier one brought is not
    scanned again (known). Null and empty texts have no spans. Other columns are ignored; an empty table gives no rows.
    """
    part = F.pmod(F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)), F.lit(increments)) if increments > 1 else F.lit(0)
    parts = [docs.select(id_col, text_col).filter(part == i) for i in range(increments)] if increments > 1 else [docs]
    paths, findings, _ = scan_increments(parts, rules, id_col, text_col)
    # Written first, so that the join deals its own sides and a blob of very many paths can be split.
    found = materialize(findings_by_blob(findings, rules), "found")
    out = paths.join(found, "blob", "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return out.select(F.col("path").alias("doc_id"), *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "known")

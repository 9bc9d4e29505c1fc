"""WARC archives of pages, and their capture index by external merge.

Writing: one record per page as text lines that end in CRLF, by Spark's own writer, so any store that Spark writes
will do; payloads seen before become revisit records. Reading: whole files, parsed by Content-Length; the number of
records of a file is bounded, its bytes are not.
Index: each archive file is a locally sorted run of captures; key ranges, cut by a bounded sample, are merged k-way
with a loser tree by URL key and timestamp, so that ranges in order, and captures in them, are globally ordered.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, shared_path, split_keyed

CRLF = "\r\n"
#: Equal payloads below this many bytes are stored again rather than referred to.
REVISIT_FROM = 100
_PAGE = "urn:page:"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "page_id long, url string, url_key string, captured_at string, record_type string, refers_to long, payload_bytes long, payload_digest string, run string, seq long, offset long"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured_at: Column | None = None) -> DataFrame:
    """(page_id, url, captured_at, payload, payload_bytes, payload_digest, refers_to) of every row.

    Null payloads are empty. Of equal payloads of at least REVISIT_FROM bytes the smallest page_id is stored and the
    others refer to it; a row that repeats that page_id is stored again. Rows without a page_id are always stored.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    when = captured_at if captured_at is not None else F.lit("2024-01-31T00:00:00Z")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), when.alias("captured_at"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    groups = rows.filter(f"payload_bytes >= {REVISIT_FROM}").groupBy("payload_digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    # Written first, so that the join deals its own sides and a payload of very many pages can be split.
    groups = materialize(groups.select(F.col("payload_digest").alias("mark"), "keeper"), "payloads")
    # Pages whose payload is surely no other's are not shuffled.
    clear, maybe = split_keyed(rows, groups, "payload_digest", "mark")
    joined = maybe.join(groups, F.col("payload_digest") == F.col("mark"), "left").drop("mark")
    none = F.lit(None).cast("long")
    return clear.withColumn("refers_to", none).unionByName(joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("keeper"), F.col("keeper"))).drop("keeper"))


def _record() -> Column:
    """The WARC record of a planned row, without the CRLF that ends its last line."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <{_PAGE}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), url, F.lit(f"{CRLF}WARC-Date: "), F.col("captured_at"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {_SAME_PAYLOAD}{CRLF}WARC-Refers-To: <{_PAGE}"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), block_bytes.cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")), F.lit(CRLF))


def write_archives(planned: DataFrame, path: str, records_per_file: int = 2000) -> None:
    """Write gzip-compressed archives of at most records_per_file records each to the folder ``path``."""
    planned.select(_record().alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def surt(url: str) -> str:
    """Sort-friendly key: host labels reversed, then port, path and query in lower case; the fragment is dropped."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    return (",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record; only Content-Length says where a block ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield at, headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record not ended at byte {at}")
        at += 4


def _page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(_PAGE)
    return int(number) if number else None


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """CAPTURES of all archives under ``path``; those of one file are a run, sorted by (url_key, captured_at, page_id).

    Lengths and digests of responses are taken from the payload itself, those of revisits from their headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, h, block in parse_records(gzip.decompress(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = h["warc-type"] == "revisit"
                    if revisit:
                        size = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        digest, refers = h["warc-payload-digest"].removeprefix("sha256:"), _page(h["warc-refers-to"])
                    else:
                        size, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                    url = h.get("warc-target-uri", "")
                    rows.append((_page(h["warc-record-id"]), url, surt(url), h["warc-date"], h["warc-type"], refers, size, digest, offset))
                rows.sort(key=lambda r: (r[2], r[3], r[0] is None, r[0] or 0))
                run_name = name.rpartition("/")[2]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
                kinds = (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(columns[:8], kinds, strict=True)]
                arrays += [pa.array([run_name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(columns[8], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.strip().split()[0] for x in CAPTURES.split(",")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURES)


class LoserTree:
    """Merges sorted lists: each inner node remembers the loser of its match, so the next winner costs one path."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, k = runs, key, max(1, len(runs))
        self.at = [0] * k
        self.tree = [-1] * k
        self.k = k
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's next entry goes before run b's; a run that has ended loses to all others."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        ka, kb = self.key(self.runs[a][self.at[a]]), self.key(self.runs[b][self.at[b]])
        return ka < kb or ka == kb and a < b

    def _play(self, run: int) -> None:
        node, winner = (run + self.k) // 2, run
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        for _ in range(sum(map(len, self.runs))):
            winner = self.tree[0]
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self._play(winner)


def merge_index(captures: DataFrame, range_rows: int = 50_000, sample_rows: int = 4096) -> DataFrame:
    """CAPTURES with range_no and position: (range_no, position) is the global order by (url_key, captured_at, page_id).

    Range borders come from at most sample_rows keys (the smallest by hash), which decide balance only. A border is a
    full key, so one URL with very many captures spreads over several ranges.
    """
    captures = materialize(captures, "captures")
    total = captures.count()
    n_ranges = min(sample_rows, -(-total // range_rows)) or 1
    key = lambda r: (r["url_key"], r["captured_at"], r["page_id"] is None, r["page_id"] or 0)
    h = F.xxhash64("url_key", "captured_at", "page_id")
    # About twice the sample is let through by hash, so that tasks send few rows; then its size is fixed.
    few = F.pmod(h, F.lit(1 << 30)) <= min(1 << 30, 2 * sample_rows * (1 << 30) // max(1, total))
    sample = captures.select("url_key", "captured_at", "page_id").filter(few).orderBy(h).limit(sample_rows).collect() if n_ranges > 1 else []
    keys = sorted(map(key, sample))
    borders = [keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)] if keys else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no = [bisect.bisect_right(borders, key(r)) for r in batch.select(["url_key", "captured_at", "page_id"]).to_pylist()]
            yield batch.append_column("range_no", pa.array(no, pa.int64()))

    def merge(table: pa.Table) -> pa.Table:
        runs: dict[str, list] = {}
        for r in table.sort_by([("run", "ascending"), ("seq", "ascending")]).to_pylist():
            runs.setdefault(r["run"], []).append(r)
        merged = list(LoserTree(list(runs.values()), key))
        out = pa.Table.from_pylist(merged, schema=table.schema)
        return out.append_column("position", pa.array(range(len(merged)), pa.int64()))

    placed = captures.mapInArrow(place, CAPTURES + ", range_no long")
    return placed.groupBy("range_no").applyInArrow(merge, CAPTURES + ", range_no long, position long")


def global_positions(index: DataFrame) -> DataFrame:
    """The index with ``place``, the place of a capture in the whole order, from 0; its ranges are few rows."""
    index = materialize(index, "index")
    sizes = index.groupBy("range_no").agg(F.count("*").alias("n"))
    before = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    ahead = materialize(sizes.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ranges")
    # At most as many ranges as merge_index has borders.
    return index.join(F.broadcast(ahead), "range_no").withColumn("place", F.col("ahead") + F.col("position")).drop("ahead")


def archive_and_index(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the archives of ``pages``, read them back and merge their index; see merge_index for the columns.

    Other columns of ``pages`` are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(plan_records(pages, **columns), path)
    return merge_index(read_captures(spark, path))

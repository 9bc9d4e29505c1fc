"""The queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import alignment, decontam, exactdup, jaccard, licenses, mixing, pii, quality, secrets, sharding, substring, tandem, warc
from tidewire.llm.common import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.global_positions(warc.archive_and_index(_table(spark, sf_dir, "pages")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "place")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate_text(_table(spark, sf_dir, "documents"))
    shown = lambda c, kind: F.transform(c, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    spans = F.array_join(F.concat(shown("lines", "line"), shown("passages", "passage")), ",")
    return found.select("doc_id", F.col("n_words"), F.size("lines").cast("long").alias("n_lines"), F.size("passages").cast("long").alias("n_passages"), "removed_chars", spans.alias("spans"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal_data(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdup.exact_duplicates(_table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by source, so of very different sizes, to 40 of equal bytes; read back from the files."""
    docs = _table(spark, sf_dir, "documents")
    old = F.pmod(F.coalesce(F.crc32(F.encode("source", "utf-8")), F.lit(0)), F.lit(32))
    done = sharding.reshard(docs, old, 40, shared_path(spark, "shards"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0).cast("long"))
    rows = done.read(spark)
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col(done.shard_col).alias("shard"), F.col(done.slot_col).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=True).drop("runs")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_license_scan, op4_secret_scan, op5_decontamination, op6_personal_data, op7_quality, op8_mixing, op9_exact_dedup, op10_jaccard_join, op11_resharding, op12_token_alignment, op13_periodic_runs)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS, _BLANK_WORDS = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)", r"'[^\x20\x09-\x0D]+'"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
with p as (select page_id, coalesce(html, '') as h, regexp_replace(coalesce(url, ''), '[\x00-\x20]', '%20', 'g') as u from pages),
s as (select *, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') as host, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]*:(\d+)', 1) as port,
  regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(u, '^[^#?]*\?([^#]*)', 1) as query from p),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest,
  lower(array_to_string(list_reverse(string_split(host, '.')), ',') || case when port in ('', '80', '443') then '' else ':' || port end || ')' || case path when '' then '/' else path end || case query when '' then '' else '?' || query end) as url_key from s),
g as (select payload_digest as gd, min(page_id) as keeper from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when page_id <> keeper then 'revisit' else 'response' end as record_type,
  case when page_id <> keeper then keeper end as refers_to, url_key, '2024-01-31T00:00:00Z' as captured_at, row_number() over (order by encode(url_key), page_id) - 1 as place
from d left join g on payload_digest = gd""",
    "op2_substring_dedup": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
l as (select r, doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as no from d),
o as (select *, sum(length(line) + 1) over (partition by r order by no) - length(line) - 1 as s from l),
u as (select r, doc_id, (s + length(line) - length(ltrim(line, {_BLANKS})))::bigint as s, (s + length(rtrim(line, {_BLANKS})))::bigint as e,
  array_to_string(regexp_extract_all({_LOWER.format("line")}, {_BLANK_WORDS}), ' ') as t from o where regexp_matches(line, {_BLANK_WORDS})),
x as (select r, 'line' as kind, s, e from u qualify rank() over (partition by t order by doc_id) > 1 or row_number() over (partition by t, doc_id order by s) > 1),
g as (select r, doc_id, t, regexp_extract_all({_LOWER.format("t")}, {_BLANK_WORDS}) as w, regexp_extract_all(t, {_BLANK_WORDS}) as raw, regexp_split_to_array(t, {_BLANK_WORDS}) as gaps from d),
n as (select r, sum(length(gap)) over q + coalesce(sum(length(word)) over (partition by r order by p rows between unbounded preceding and 1 preceding), 0) as s, length(word) as size, p
  from (select r, unnest(gaps[1:len(raw)]) as gap, unnest(raw) as word, generate_subscripts(raw, 1) as p from g) window q as (partition by r order by p)),
v as (select r, doc_id, p, array_to_string(w[p:p + 49], ' ') as t from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as p from g where len(w) >= 50)),
z as (select r, p from v qualify rank() over (partition by t order by doc_id) > 1 or row_number() over (partition by t, doc_id order by p) > 1),
b as (select z.r, z.p, a.s::bigint as s, (c.s + c.size)::bigint as e from z join n a on a.r = z.r and a.p = z.p join n c on c.r = z.r and c.p = z.p + 49),
i as (select *, s > coalesce(max(e) over (partition by r order by s rows between unbounded preceding and 1 preceding), -1) as opens from b),
k as (select *, sum(opens::int) over (partition by r order by s) as no from i),
y as (select r, 'passage' as kind, min(s) as s, max(e) as e from k group by r, no),
a as (select * from x union all select * from y),
m as (select r, kind, s, e, greatest(0, e - greatest(s, coalesce(max(e) over (partition by r order by s, e rows between unbounded preceding and 1 preceding), 0))) as fresh from a),
f as (select r, count(*) filter (kind = 'line') as n_lines, count(*) filter (kind = 'passage') as n_passages, sum(fresh)::bigint as removed_chars,
  string_agg(kind || ':' || s || ':' || e, ',' order by kind, s) as spans from m group by r)
select doc_id, len(g.w)::bigint as n_words, coalesce(n_lines, 0) as n_lines, coalesce(n_passages, 0) as n_passages, coalesce(removed_chars, 0) as removed_chars, coalesce(spans, '') as spans
from g left join f using (r)""",
    "op5_decontamination": f"""
with i as (select item_id::varchar as item, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from benchmark where item_id is not null),
iw as (select distinct item, least(len(w), 10) as size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as t
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
d as (select row_number() over () as r, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
s as (select distinct size from iw),
dw as (select r, size, p, array_to_string(w[p:p + size - 1], ' ') as t from (select r, w, size, unnest(range(1, len(w) - size + 2)) as p from d, s where len(w) >= size)),
h as (select distinct r, size, p, item from dw join iw using (size, t)),
c as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + size)) as q from h) group by r),
k as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join k using (r)""",
    "op8_mixing": r"""
with d as (select doc_id, source, md5('mix-1:' || coalesce(doc_id::varchar, 'null')) as ord, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
z as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2.0::double as cap from z),
b as (select *, sum(source_size) over () * 1.5::double as budget, sum(weight) over () as all_weight from w),
l as (select *, (budget - coalesce(sum(cap) over q, 0)) / (all_weight - coalesce(sum(weight) over q, 0)) as level from b
  window q as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, cap <= level * weight as stops, max(case when cap <= level * weight then null else level end) over () as final from l),
t as (select source, source_size, case when stops then cap else final * weight end as target from f),
o as (select doc_id, d.source, size, source_size, target, floor(target)::bigint as quota,
  (sum(size) over (partition by d.source order by ord, doc_id, size rows between unbounded preceding and current row) - size)::bigint as a
  from d join t on d.source is not distinct from t.source),
p as (select source, source_size, quota, block, ceil(source_size / block)::bigint as n_blocks from (select *, floor(target)::bigint as quota, greatest(1, ceil(sum(target) over () / 262144.0::double))::bigint as block from t) where source_size > 0),
c as (select *, (quota // source_size) * n_blocks + ceil((quota % source_size) / block)::bigint as n_slots from p),
h as (select *, sum(n_slots) over (order by source nulls last) / (sum(n_slots) over ())::double as hi from c where n_slots > 0),
k as (select *, hi - n_slots / (sum(n_slots) over ())::double as lo, sum(n_slots) over () as n from h),
j as (select i as slot, (i * 0.6180339887498949::double) % 1.0::double as u from range((select coalesce(max(n), 0)::bigint from k)) q(i)),
r as (select k.*, slot, row_number() over (partition by source order by slot) - 1 as rank from j join k on u >= lo and (u < hi or hi > 1 - 1e-12)),
v as (select source, rank, slot from r where rank < n_slots union all
  select source, unnest(range(served, n_slots)) as rank, n + unnest(range(served, n_slots)) as slot from (select k.source, k.n_slots::bigint as n_slots, k.n::bigint as n, count(rank)::bigint as served from k left join r on k.source is not distinct from r.source group by 1, 2, 3)),
y as (select v.source, slot, rank % n_blocks as no, least(block, source_size - rank % n_blocks * block, quota - (rank // n_blocks * source_size + rank % n_blocks * block)) as words, block
  from v join c on v.source is not distinct from c.source),
x as (select o.doc_id, o.source, a, min(slot)::bigint as first_slot from (select o.*, block, unnest(range(a // block, (a + size - 1) // block + 1)) as no from o join c on o.source is not distinct from c.source where size > 0) o
  join y on o.source is not distinct from y.source and o.no = y.no and least(a + size, o.no * o.block + words) > greatest(a, o.no * o.block) group by 1, 2, 3)
select o.doc_id, size, source_size, target,
  (case when source_size = 0 then 0 else size * (quota // source_size) + greatest(0, least(o.a + size, quota % source_size) - o.a) end)::bigint as taken, first_slot
from o left join x on o.doc_id is not distinct from x.doc_id and o.source is not distinct from x.source and o.a = x.a and size > 0""",
    "op9_exact_dedup": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by text_sha256 order by doc_id) = 1 as kept, text_sha256
from d window g as (partition by text_sha256)""",
    "op10_jaccard_join": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2])) end as g from d),
c as (select min(doc_id) as rep, list_sort(g) as g from s where len(g) > 0 group by list_sort(g)),
e as (select rep, len(g) as n, unnest(g) as t from c),
p as (select a.rep as x, b.rep as y from e a join e b on a.t = b.t and a.rep < b.rep and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l as (select x, y from p union select y, x from p),
r as (select rep as node, rep as comp from c union select l.y, r.comp from r join l on l.x = r.node where r.comp < l.y),
m as (select node, min(comp) as comp from r group by node)
select s.doc_id, len(s.g)::bigint as n_shingles, coalesce(m.comp, s.doc_id) as component_id
from s left join c on list_sort(s.g) = c.g left join m on m.node = c.rep""",
}

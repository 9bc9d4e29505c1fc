"""The entity views as DuckDB common table expressions, written apart from the Spark ones."""

from __future__ import annotations

VIEWS = {
    "newspapers": """newspapers as (select source as name, cast(substr(source, 4) as bigint) as newspaper_id,
  ['far_left','left','leans_left','center','neutral','mainstream','leans_right','right','far_right'][cast(substr(source, 4) as int) % 9 + 1] as bias,
  ['independent','corporate','state'][cast(substr(source, 4) as int) % 3 + 1] as ownership_type
  from (select distinct source from documents where source is not null))""",
    "articles": """articles as (select doc_id as id, substr(text, 1, 60) as title, text as content, source as newspaper, lang,
  timestamp '2024-01-01' + to_minutes(cast(doc_id * 43 % 43200 as int)) as published_date,
  case when doc_id % 11 <> 0 then ((doc_id * 37) % 201 - 100) / 100.0::double end as stance, ((doc_id * 53) % 101) / 100.0::double as clickbait_score,
  nullif(doc_id % 12, 0) as source_rank, md5(cast(doc_id as varchar)) as url_hash, label::bigint as event_id
  from documents join embeddings on vec_id = doc_id % 500)""",
    "events": """evs as (select vec_id as id, embedding::double[] as centroid, label::bigint as label, timestamp '2024-01-01' + to_minutes(cast(vec_id * 83 % 43200 as int)) as created_at,
  timestamp '2024-01-01' + to_minutes(cast(vec_id * 83 % 43200 as int)) + to_hours(cast(vec_id % 48 as int)) as last_updated_at, vec_id % 10 <> 0 as is_active,
  ['PUBLISHED','DRAFT','ENHANCED','ARCHIVED'][vec_id % 4 + 1] as status, ((vec_id * 7) % 101)::double as hot_score, vec_id % 17 as article_count from embeddings)""",
    "queue": """aq as (select event_id as id, user_id as article_id, case event_type when 'click' then 'PENDING' when 'view' then 'PROCESSING' when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' when 'signup' then 'WAITING' end as status,
  ['filter','enricher','analyzer','cluster'][event_id % 4 + 1] as queue_name, ts as updated_at, ts - to_hours(cast(event_id % 72 as int)) as created_at, event_id % 4 as attempts,
  case when event_type = 'error' and event_id % 2 = 0 then 'HTTP 403 Forbidden' else 'ok' end as msg, props, value from events)""",
    "equeue": """eq as (select id, article_id as event_id, status, case (id // 2) % 2 when 0 then 'enhancer' else 'publisher' end as queue_name, updated_at, created_at, attempts, msg from aq where id % 2 = 0)""",
    "proposals": """pr as (select a.vec_id as source_id, b.vec_id as target_id, ['PENDING','PROCESSING','APPROVED','REJECTED','FAILED'][(a.vec_id + b.vec_id) % 5 + 1] as status, ((a.vec_id + b.vec_id) % 100) / 100.0::double as distance
  from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id and b.vec_id - a.vec_id <= 10)""",
}


def with_views(names: str, sql: str) -> str:
    return "with " + ",\n".join(VIEWS[n] for n in names.split()) + "\n" + sql

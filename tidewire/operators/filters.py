"""Dynamic filters, ordering and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v), "like": lambda c, v: c.like(f"%{v}%"), "ilike": lambda c, v: c.ilike(f"%{v}%"),
}


@dataclass(frozen=True)
class Relation:
    """How a filter path reaches another table: an inner join of ``table`` on left = right; its columns get a prefix."""

    table: DataFrame
    left: str
    right: str


def apply_filters(df: DataFrame, filters: dict, relations: dict[str, Relation] | None = None) -> DataFrame:
    """Rows that pass all ``column[__op]`` filters; None values, unknown columns and ``in`` without a list are skipped.

    ``relation__column__op`` joins that relation first, once for all its filters; relations of relations join in turn.
    """
    joined: set[str] = set()
    conditions: list[Column] = []
    for key, value in filters.items():
        if value is None:
            continue
        *path, last = key.split("__")
        op = last if last in _OPS and path else "eq"
        column = path if op == last and path else [*path, last]
        prefix = ""
        for hop in column[:-1]:
            name = f"{prefix}{hop}"
            rel = (relations or {}).get(name.replace("__", "."))
            if rel is None:
                break
            if name not in joined:
                other = rel.table.select(*[F.col(c).alias(f"{name}__{c}") for c in rel.table.columns])
                df = df.join(other, df[f"{prefix}{rel.left}" if prefix else rel.left] == other[f"{name}__{rel.right}"])
                joined.add(name)
            prefix = f"{name}__"
        full = prefix + column[-1]
        if full in df.columns and not (op == "in" and not isinstance(value, list | tuple)):
            conditions.append(_OPS[op](F.col(full), list(value) if op == "in" else value))
    for c in conditions:
        df = df.filter(c)
    return df


def search_text(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text, in any case, in one of the columns."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.filter(cond)


def order_keys(df: DataFrame, order_by: list[str], key: str = "id") -> list[Column]:
    """Sort columns: ``-name`` descends, unknown names are skipped, the key breaks ties; nulls as the larger value."""
    known = [o for o in order_by if o.lstrip("-") in df.columns]
    if not known:
        known = [f"-{c}" for c in ("updated_at", "created_at") if c in df.columns][:1]
    return [F.col(o[1:]).desc_nulls_first() if o[0] == "-" else F.col(o).asc_nulls_last() for o in known] + [F.col(key)]


def page(df: DataFrame, order_by: list[str], number: int = 1, size: int = 50, key: str = "id") -> DataFrame:
    return df.orderBy(*order_keys(df, order_by, key)).offset((number - 1) * size).limit(size)


def paged(df: DataFrame, order_by: list[str], number: int = 1, size: int = 50, key: str = "id") -> DataFrame:
    """The page's rows with total, page and size of the whole result."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order_by, number, size, key).crossJoin(F.broadcast(total)).withColumns({"page": F.lit(number), "size": F.lit(size)})  # one row


_TIMES = ("created_at__gte", "created_at__lte", "updated_at__gte", "updated_at__lte")
_JOBS = (*_TIMES, "status", "attempts", "attempts__gt", "attempts__lt", "msg__ilike", "order_by")
_ENTITY = (*_TIMES, "id", "order_by")
#: The declared filters of each kind of list; further ones are let through.
FILTERS: dict[str, tuple[str, ...]] = {
    "articles_queue": (*_JOBS, "article__title__ilike", "article__original_url__ilike", "article__newspaper__name__ilike"),
    "events_queue": (*_JOBS, "event__title__ilike", "event__status"),
    "proposals": (*_JOBS, "proposal_type", "reasoning__ilike", "distance_score__lt"),
    "articles": (*_ENTITY, "title__ilike", "content__ilike", "url_hash", "original_url__ilike", "published_date__gte", "newspaper__name__ilike"),
    "events": (*_ENTITY, "status", "is_active", "hot_score__gt", "article_count__gt", "title__ilike"),
    "newspapers": (*_ENTITY, "name__ilike", "bias"),
    "audit": (*_ENTITY, "target_table", "target_id", "action", "actor_id"),
}


def listed(df: DataFrame, kind: str, filters: dict, relations: dict[str, Relation] | None = None, number: int = 1, size: int = 50, strict: bool = False) -> DataFrame:
    """a page of a list under its declared filters, in the order of ``order_by``; strict: others are an error."""
    unknown = sorted(set(filters) - set(FILTERS[kind]))
    if strict and unknown:
        raise ValueError(f"{kind} has no filters {', '.join(unknown)}")
    order = [o.strip() for o in (filters.get("order_by") or "").split(",") if o.strip()]
    return page(apply_filters(df, {k: v for k, v in filters.items() if k != "order_by"}, relations), order, number, size)


def article_list(articles: DataFrame, newspapers: DataFrame, since=None, until=None, bias: str | None = None, search: str | None = None, newspaper_search: str | None = None) -> DataFrame:
    """articles by date range, their outlet's bias, text in title or summary, and text in the outlet's name or description."""
    a = apply_filters(articles, {"published_date__gte": since, "published_date__lte": until})
    if search is not None:
        a = search_text(a, search, ["title", "summary"])
    if bias is not None or newspaper_search is not None:
        n = apply_filters(newspapers, {"bias": bias})
        n = n if newspaper_search is None else search_text(n, newspaper_search, ["name", "description"])
        a = a.join(n.select(F.col("name").alias("newspaper")), "newspaper", "left_semi")
    return a


def empty_or_missing(c: Column) -> Column:
    """a map or array that is null or has no entries."""
    return c.isNull() | (F.size(c) == 0)


def prefer_existing(keys: DataFrame, existing: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """For each key the row of ``existing``, or else that of ``fallback``, if there is either."""
    rest = [c for c in existing.columns if c != key]
    a = existing.select(key, F.struct(*rest).alias("_a"))
    b = fallback.select(key, F.struct(*rest).alias("_b"))
    return keys.select(key).join(a, key, "left").join(b, key, "left").select(key, F.coalesce("_a", "_b").alias("_r")).filter("_r is not null").select(key, "_r.*")


def united(a: Column, b: Column) -> Column:
    """U4: the union of two sets in arrays, sorted; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))

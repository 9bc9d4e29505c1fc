"""What the query modules share: the registers of queries and SQL, and joined views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.oracle_views import with_views
from tidewire.sources import entities as en

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
T = "timestamp '2024-01-31'"


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query by its inventory ids; sql repeats it in DuckDB, after the named views."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return f

    return put


def outlet_articles(s: SparkSession, d: str) -> DataFrame:
    return en.articles(s, d).join(en.newspapers(s, d), F.col("newspaper") == F.col("name")).drop("name")


AB = "ab as (select * from articles join newspapers on newspaper = name)"

"""Tables as JSON lines and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def dump_tables(tables: dict[str, DataFrame], path: str) -> None:
    """K7: each table as a folder of JSON lines, in the given order; what stands there is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def restore_tables(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The dumped tables; columns that a dump lacks are null, and a table without a dump fails when it is read."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def markdown_rows(df: DataFrame) -> DataFrame:
    """K9: (line) of each row as a Markdown table row, columns in order; null is empty and bars are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line: Column = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    return df.select(line.alias("line"))


def markdown_head(df: DataFrame, **titles: str) -> str:
    """K9: the two lines above markdown_rows."""
    names = [titles.get(c, c) for c in df.columns]
    return "| " + " | ".join(names) + " |\n|" + " --- |" * len(names)

"""Named tables: loading, view registration, row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_tables(
    spark: SparkSession, folder: str, names: Sequence[str] = RAW_TABLES, views: bool = True
) -> dict[str, DataFrame]:
    """Open every named table lazily and, if asked, expose each as a view."""
    tables = {name: read_table(spark, folder, name) for name in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, row_count)`` for all tables in a single job."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, most common first, ties by value."""
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )

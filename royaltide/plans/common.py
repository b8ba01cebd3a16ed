"""Shared pieces of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from royaltide.bindings import bind, with_bindings
from royaltide.session import fill_cores

Query = Callable[[SparkSession, str], DataFrame]

AS_OF_TIME = "2024-01-31 00:00:00"
AS_OF_DATE = "2000-01-01"


class Catalogue:
    """Collects queries and, where SQL can express the result, their check SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.checks: dict[str, str] = {}

    def add(self, name: str, check: str | None = None) -> Callable[[Callable], Callable]:
        def register(build: Callable[["Tables"], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plain_types(build(Tables(spark, sf_dir)))

            run.__doc__ = build.__doc__
            self.queries[name] = run
            if check is not None:
                self.checks[name] = with_bindings(check)
            return build

        return register


class Tables:
    """Domain and raw tables of one data folder, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def spread(self, name: str) -> DataFrame:
        """Table for work that costs much per row."""
        return fill_cores(bind(self.spark, self.sf_dir, name))

    def __getattr__(self, name: str) -> DataFrame:
        return bind(self.spark, self.sf_dir, name)


def plain_types(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so that both engines print them alike."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- snippets for the check SQL ------------------------------------------------


def sql_round(expr: str, digits: int) -> str:
    """Half-up rounding of the printed number, the way Spark rounds doubles."""
    return (
        f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"
    )


def sql_int(sql: str, *columns: str) -> str:
    """The query with some columns as 32-bit integers."""
    swaps = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"


def sql_cents(expr: str) -> str:
    return f"CAST(floor(CAST({expr} AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def sql_money(expr: str, where: str = "") -> str:
    return f"CAST(sum({sql_cents(expr)}){where} AS DOUBLE) / 100"


def sql_time(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_bucket(expr: str, buckets: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8) AS BIGINT) % {buckets}"


def sql_draw(row: str, stream: int, seed: int) -> str:
    m = 2147483647
    start = (
        f"((({row}) % {m}) * 48271 + (({row}) // {m}) * 69621 "
        f"+ {(stream * 1299709 + seed * 15485863) % m}) % {m}"
    )
    return f"(((({start}) * ({start}) + 12345) % {m}) * 40692) % {m}"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"

"""Row expectations and ingestion metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Territory codes accepted by the default territory rule.
TERRITORIES = (
    "US", "CA", "UK", "DE", "FR", "JP", "AU", "BR", "MX", "KR", "IN", "ES", "IT", "NL", "SE",
)
SONG_ID_PATTERN = "^SONG[0-9]{6}$"


@dataclass(frozen=True)
class Expectation:
    """A boolean test; ``flag`` names the row column, ``total`` the summary column."""

    flag: str
    total: str
    test: Column


def matches(column: str, pattern: str, flag: str, total: str) -> Expectation:
    return Expectation(flag, total, F.col(column).cast("string").rlike(pattern))


def inside(column: str, low: float, high: float, flag: str, total: str) -> Expectation:
    """Open range: both ends are excluded."""
    return Expectation(flag, total, (F.col(column) > low) & (F.col(column) < high))


def member(column: str, domain: Sequence[str], flag: str, total: str) -> Expectation:
    return Expectation(flag, total, F.col(column).isin(list(domain)))


def default_rules() -> list[Expectation]:
    """The three expectations on play logs."""
    return [
        matches("song_id", SONG_ID_PATTERN, "is_valid_song_id", "valid_song_ids"),
        inside("duration_played", 0, 3600, "is_valid_duration", "valid_durations"),
        member("territory", TERRITORIES, "is_valid_territory", "valid_territories"),
    ]


def check_rows(df: DataFrame, rules: Sequence[Expectation]) -> DataFrame:
    """Add one boolean column per rule; NULL input gives NULL."""
    return df.withColumns({r.flag: r.test for r in rules})


def check_summary(df: DataFrame, rules: Sequence[Expectation]) -> DataFrame:
    """One row: all rows and rows passing each rule. NULL counts as a failure."""
    passing = [F.count_if(r.test).alias(r.total) for r in rules]
    return df.agg(F.count(F.lit(1)).alias("total_records"), *passing)


def volume_by(df: DataFrame, key: str, avg_col: str, avg_name: str = "avg_duration") -> DataFrame:
    """Plays and mean of a measure per key, busiest first."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("play_count"), F.avg(avg_col).alias(avg_name))
        .orderBy(F.desc("play_count"), key)
    )


def reach_by(
    df: DataFrame, key: str, distinct_col: str, distinct_name: str = "unique_songs"
) -> DataFrame:
    """Plays and distinct items per key, busiest first.

    Counting per (key, item) first spreads a hot key over its items.
    """
    per_item = df.groupBy(key, distinct_col).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_item.groupBy(key)
        .agg(F.sum("_n").alias("play_count"), F.count(distinct_col).alias(distinct_name))
        .orderBy(F.desc("play_count"), key)
    )


def cardinality(df: DataFrame, cols: Mapping[str, str], total: str = "total_records") -> DataFrame:
    """Row count and distinct values of several columns in one job.

    ``cols`` maps the column to the name of its result.
    """
    distinct = [F.count_distinct(F.col(c)).alias(name) for c, name in cols.items()]
    return df.agg(F.count(F.lit(1)).alias(total), *distinct)

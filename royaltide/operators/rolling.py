"""Play counts of a moving window, kept up to date day by day.

Plays are reduced once to counts per song and day, stored by day. The counts of a window move on
by adding the days that enter and taking off those that leave; no other day is read.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from royaltide.operators.features import scaled_popularity
from royaltide.session import durable
from royaltide.sources.partitioned import overwrite_partitions


def _day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text[:10])


def store_days(plays: DataFrame, path: str) -> None:
    """Counts per song and day of ``plays``; a day that comes again replaces the stored one."""
    daily = plays.groupBy("song_id", F.to_date("play_timestamp").alias("play_date")).agg(F.count(F.lit(1)).alias("plays"))
    overwrite_partitions(durable(daily), path, "play_date", ["song_id"])


def _days(spark: SparkSession, path: str, start: datetime.date, end: datetime.date) -> DataFrame:
    """Stored counts from ``start`` up to, not including, ``end``."""
    day = F.col("play_date")
    return spark.read.parquet(path).where((day >= F.lit(start)) & (day < F.lit(end)))


def window_counts(spark: SparkSession, path: str, as_of: str, days: int = 90) -> DataFrame:
    """``song_id, play_count_90d`` of the ``days`` full days before the day of ``as_of``."""
    end = _day(as_of)
    held = _days(spark, path, end - datetime.timedelta(days), end)
    return held.groupBy("song_id").agg(F.sum("plays").alias("play_count_90d"))


def advance(counts: DataFrame, path: str, before: str, as_of: str, days: int = 90) -> DataFrame:
    """``counts`` of the window before ``before`` moved on to the one before ``as_of``.

    Songs whose last play has left the window leave the table.
    """
    spark, old, new, width = counts.sparkSession, _day(before), _day(as_of), datetime.timedelta(days)
    if new < old:
        raise ValueError("a window only moves on")
    # Days that enter and leave at once, in a step longer than the window, are in neither.
    entering = _days(spark, path, max(old, new - width), new).select("song_id", F.col("plays").alias("n"))
    leaving = _days(spark, path, old - width, min(old, new - width)).select("song_id", (-F.col("plays")).alias("n"))
    moved = entering.union(leaving).groupBy("song_id").agg(F.sum("n").alias("n"))
    return (
        counts.join(moved, "song_id", "full_outer")
        .select("song_id", (F.coalesce("play_count_90d", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("play_count_90d"))
        .where("play_count_90d > 0")
    )


def rolling_popularity(counts: DataFrame, songs: DataFrame) -> DataFrame:
    """Popularity from the counts of a window."""
    return scaled_popularity(counts, songs)

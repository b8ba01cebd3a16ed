"""Reproducible table generators: any number of rows, any partitioning, same data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from royaltide.functions.columns import draw, draw_int, pick
from royaltide.operators.ordering import running_weight
from royaltide.operators.quality import TERRITORIES

# Licence fee range in dollars by type.
LICENSE_FEES = {
    "streaming": (2000, 15000),
    "radio": (1000, 8000),
    "live_venue": (5000, 30000),
    "digital": (1500, 10000),
    "sync": (5000, 500000),
    "mechanical": (500, 5000),
}
# Payment status weights in percent.
STATUS_WEIGHTS = {"completed": 80, "pending": 8, "processing": 6, "disputed": 4, "on_hold": 2}
# Payment years.
FIRST_YEAR, LAST_YEAR = 2022, 2025

LICENSEES = tuple(f"Licensee {i:02d}" for i in range(1, 21))
PLATFORMS = tuple(f"Platform {i:02d}" for i in range(1, 21))


def _rows(spark: SparkSession, n: int, songs: DataFrame, seed: int) -> DataFrame:
    """Row numbers 1..n with a uniformly drawn song each.

    Songs are numbered without a single-task window; the draw then is an
    equi-join on that number, uniform by construction.
    """
    numbered = running_weight(songs, ["song_id"], name="_song")
    total = songs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not total:
        return numbered.select(F.lit(0).cast("bigint").alias("row"), "*").limit(0)
    drawn = spark.range(1, n + 1).select(
        F.col("id").alias("row"), (draw("id", 0, seed) % total).alias("_song")
    )
    return drawn.join(numbered, "_song").drop("_song")


def _between(low: Column, high: Column, stream: int, seed: int) -> Column:
    return low + draw("row", stream, seed) % (high - low + 1)


def gen_licenses(
    spark: SparkSession,
    n: int,
    songs: DataFrame,
    as_of: str,
    seed: int = 42,
    licensees: Sequence[str] = LICENSEES,
    territories: Sequence[str] = TERRITORIES,
    fees: Mapping[str, tuple[int, int]] = LICENSE_FEES,
) -> DataFrame:
    """Licences of 1 to 5 years that began within the last five."""
    kinds = list(fees)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("_kind"))

    def bound(side: int) -> Column:
        values = F.array(*[F.lit(fees[k][side] * 100).cast("bigint") for k in kinds])
        return F.element_at(values, F.col("_kind"))

    start = F.date_sub(F.lit(as_of).cast("date"), draw_int("row", 4, seed, 0, 1825).cast("int"))
    years = draw_int("row", 5, seed, 1, 5).cast("int")
    fee = _between(bound(0), bound(1), 6, seed)
    return (
        _rows(spark, n, songs.select("song_id"), seed)
        .withColumn("_kind", draw_int("row", 2, seed, 1, len(kinds)).cast("int"))
        .select(
            F.format_string("LIC%07d", "row").alias("license_id"),
            "song_id",
            pick("row", 1, seed, licensees).alias("licensee_name"),
            kind.alias("license_type"),
            pick("row", 3, seed, territories).alias("territory"),
            start.alias("start_date"),
            F.date_add(start, years * 365).alias("end_date"),
            (fee / 100).alias("fee_amount"),
        )
    )


def gen_plays(
    spark: SparkSession,
    n: int,
    songs: DataFrame,
    as_of: str,
    seed: int = 42,
    platforms: Sequence[str] = PLATFORMS,
    territories: Sequence[str] = TERRITORIES,
    reporters: Sequence[str] = LICENSEES[:10],
) -> DataFrame:
    """Plays within the last 365 days, 30 to 420 seconds each."""
    hours = draw_int("row", 1, seed, 0, 365) * 24 + draw_int("row", 2, seed, 0, 23)
    played = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=hours.cast("int"))
    return _rows(spark, n, songs.select("song_id"), seed).select(
        F.format_string("LOG%08d", "row").alias("log_id"),
        "song_id",
        pick("row", 3, seed, platforms).alias("platform"),
        played.alias("play_timestamp"),
        pick("row", 4, seed, territories).alias("territory"),
        draw_int("row", 5, seed, 30, 420).alias("duration_played"),
        pick("row", 6, seed, reporters).alias("reported_by"),
    )


def gen_payments(
    spark: SparkSession,
    n: int,
    songs: DataFrame,
    seed: int = 42,
    weights: Mapping[str, int] = STATUS_WEIGHTS,
) -> DataFrame:
    """Payments to a drawn writer of a drawn song; ``songs(song_id, writers array)``."""
    quarters = (LAST_YEAR - FIRST_YEAR + 1) * 4
    rows = (
        _rows(spark, n, songs.select("song_id", "writers"), seed)
        .withColumn("_q", draw_int("row", 2, seed, 0, quarters - 1).cast("int"))
        .withColumn("_gross", draw_int("row", 3, seed, 10_000, 1_500_000))
        .withColumn("_rate", draw_int("row", 4, seed, 1_000, 2_500))
        .withColumn("_deducted", F.floor((F.col("_gross") * F.col("_rate") + 5_000) / 10_000))
        .withColumn("_luck", draw("row", 5, seed) % 100)
    )
    writer_at = (draw("row", 1, seed) % F.size("writers").cast("bigint")).cast("int")
    year = F.lit(FIRST_YEAR) + F.floor(F.col("_q") / 4).cast("int")
    quarter = F.col("_q") % 4 + 1
    below, choices = 0, []
    for status, weight in weights.items():
        below += weight
        choices.append(F.when(F.col("_luck") < below, F.lit(status)))
    paid_on = F.date_add(
        F.make_date(year, quarter * 3, F.lit(28)), draw_int("row", 6, seed, 30, 90).cast("int")
    )
    return rows.withColumn("payment_status", F.coalesce(*choices)).select(
        F.format_string("PAY%07d", "row").alias("payment_id"),
        "song_id",
        F.when(F.size("writers") > 0, F.get("writers", writer_at)).alias("songwriter_id"),
        F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string")).alias("payment_period"),
        (F.col("_gross") / 100).alias("gross_amount"),
        (F.col("_deducted") / 100).alias("deductions"),
        ((F.col("_gross") - F.col("_deducted")) / 100).alias("net_amount"),
        "payment_status",
        F.when(F.col("payment_status") == "completed", paid_on).alias("payment_date"),
    )

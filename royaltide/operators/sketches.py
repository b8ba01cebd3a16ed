"""Mergeable sketches of usage: distinct users and latency quantiles per hour, rolled up without a rescan.

A table of hourly sketches has a row of a few kilobytes per hour, whatever the traffic. Longer periods,
any run of days and late corrections are unions of those rows: the requests are read once.
Distinct counts are HyperLogLog sketches, quantiles are KLL sketches; both have fixed
size and an error that does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^14 registers: relative standard error 1.04 / 128, below 1 percent. A stream's state holds one per window.
LOG_REGISTERS = 14
#: Size parameter: a rank is off by less than 0.7 percent with 99 percent confidence.
QUANTILE_SIZE = 400
MARKS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def users_sketch(user: Column | str, log_registers: int = LOG_REGISTERS) -> Column:
    """Aggregate: sketch of the distinct values, in batch and as the state of a stream's window."""
    user = F.col(user) if isinstance(user, str) else user
    return F.hll_sketch_agg(user.cast("string"), F.lit(log_registers))


def usage_sketches(
    usage: DataFrame, period: str = "HOUR", time_col: str = "request_time", user_col: str = "requester",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Requests, successes and a sketch of the users per period (and ``keys``)."""
    return usage.groupBy(*keys, F.date_trunc(period, time_col).alias("period")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("status_code") == 200).alias("successful_requests"),
        users_sketch(user_col).alias("users"),
    )


def rolled_usage(sketches: DataFrame, period: str = "DAY", keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of a longer period from those of a shorter one, with the estimated users."""
    return (
        sketches.groupBy(*keys, F.date_trunc(period, "period").alias("period"))
        .agg(
            F.sum("total_requests").alias("total_requests"),
            F.sum("successful_requests").alias("successful_requests"),
            F.hll_union_agg("users").alias("users"),
        )
        .withColumn("unique_users", F.hll_sketch_estimate("users"))
    )


def usage_between(sketches: DataFrame, start: str, end: str) -> DataFrame:
    """One row: requests and estimated users of the periods from ``start`` up to, not including, ``end``."""
    inside = (F.col("period") >= F.lit(start).cast("timestamp")) & (F.col("period") < F.lit(end).cast("timestamp"))
    return sketches.where(inside).agg(
        F.sum("total_requests").alias("total_requests"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"),
    )


def latency_sketches(
    payload: DataFrame, period: str = "HOUR", time_col: str = "request_time", value_col: str = "execution_time_ms",
    keys: Sequence[str] = (), size: int = QUANTILE_SIZE,
) -> DataFrame:
    """Requests, largest latency and a quantile sketch per period."""
    return payload.groupBy(*keys, F.date_trunc(period, time_col).alias("period")).agg(
        F.count(value_col).alias("requests"),
        F.max(value_col).alias("max_latency_ms"),
        F.kll_sketch_agg_bigint(F.col(value_col).cast("bigint"), size).alias("latencies"),
    )


def rolled_latency(
    sketches: DataFrame, period: str = "DAY", marks: dict[str, float] = MARKS, keys: Sequence[str] = (),
    size: int = QUANTILE_SIZE,
) -> DataFrame:
    """Latency quantiles of a longer period from the sketches of a shorter one."""
    rolled = sketches.groupBy(*keys, F.date_trunc(period, "period").alias("period")).agg(
        F.sum("requests").alias("requests"),
        F.max("max_latency_ms").alias("max_latency_ms"),
        F.kll_merge_agg_bigint("latencies", size).alias("latencies"),
    )
    return rolled.withColumns({
        f"{name}_latency_ms": F.when(F.col("requests") > 0, F.kll_sketch_get_quantile_bigint("latencies", F.lit(q)))
        for name, q in marks.items()
    })


def rank_errors(
    rolled: DataFrame, payload: DataFrame, period: str = "DAY", time_col: str = "request_time",
    value_col: str = "execution_time_ms", marks: dict[str, float] = MARKS,
) -> DataFrame:
    """How far the true rank of each estimate is from the rank asked for: ``period, mark, estimate, rank_error``.

    An estimate of a repeated value covers a range of ranks; the nearest of them counts. The rows are
    reduced to counts per (period, value) before they meet the estimates.
    """
    counts = payload.where(F.col(value_col).isNotNull()).groupBy(
        F.date_trunc(period, time_col).alias("period"), F.col(value_col).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    asked = rolled.select("period", F.explode(F.array(*[
        F.struct(F.lit(name).alias("mark"), F.lit(float(q)).alias("q"), F.col(f"{name}_latency_ms").alias("estimate"))
        for name, q in marks.items()])).alias("m")).select("period", "m.*")
    below, upto = F.col("_value") < F.col("estimate"), F.col("_value") <= F.col("estimate")
    placed = counts.join(asked, "period").groupBy("period", "mark", "q", "estimate").agg(
        F.sum("_n").alias("_all"), F.sum(F.when(below, F.col("_n")).otherwise(0)).alias("_below"),
        F.sum(F.when(upto, F.col("_n")).otherwise(0)).alias("_upto"))
    low, high = F.col("_below") / F.col("_all"), F.col("_upto") / F.col("_all")
    return placed.select("period", "mark", "estimate", F.greatest(low - F.col("q"), F.col("q") - high, F.lit(0.0)).alias("rank_error"))

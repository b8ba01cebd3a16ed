"""Mergeable sketches and the streams that keep them or counters as state."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from royaltide.operators import guardrails as G
from royaltide.operators import sketches as K
from royaltide.streaming import ingest as I
from royaltide.streaming import live as V

from .conftest import rows

T = datetime.datetime
USAGE = "client_request_id int, request_time timestamp, requester string, status_code int"


@pytest.fixture(scope="module")
def usage(spark):
    """Three days; one user makes a third of all requests, 30,000 others make the rest."""
    rng = np.random.default_rng(31)
    n = 60_000
    user = np.where(rng.random(n) < 1 / 3, -1, rng.integers(0, 30_000, n))
    minute = rng.integers(0, 3 * 1440, n)
    frame = spark.createDataFrame(
        [(i, T(2024, 1, 1) + datetime.timedelta(minutes=int(m)), None if u % 997 == 0 else f"u{u}", 200 if i % 10 else 500)
         for i, (u, m) in enumerate(zip(user.tolist(), minute.tolist()))], USAGE)
    return frame.cache()


def test_days_united_from_hours_are_close_to_exact_counts(usage):
    hours = K.usage_sketches(usage)
    days = {r["period"]: r for r in K.rolled_usage(hours).collect()}
    exact = usage.groupBy(F.date_trunc("DAY", "request_time").alias("d")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status_code") == 200).alias("ok"), F.count_distinct("requester").alias("u")).collect()
    assert hours.count() == 72 and len(days) == 3
    for r in exact:
        got = days[r["d"]]
        assert (got["total_requests"], got["successful_requests"]) == (r["n"], r["ok"])
        assert abs(got["unique_users"] - r["u"]) <= 0.03 * r["u"]
    whole = K.usage_between(hours, "2024-01-01", "2024-01-03").first()
    part = usage.where("request_time < '2024-01-03'")
    assert whole["total_requests"] == part.count()
    assert abs(whole["unique_users"] / part.agg(F.count_distinct("requester")).first()[0] - 1) <= 0.03


def test_rolling_up_is_associative(usage):
    """Minutes to hours to days equals minutes to days: the same sketch either way."""
    minutes = K.usage_sketches(usage, "MINUTE")
    direct = K.rolled_usage(minutes).select("period", "unique_users")
    stepwise = K.rolled_usage(K.rolled_usage(minutes, "HOUR").drop("unique_users")).select("period", "unique_users")
    assert [r[0] for r in rows(direct)] == [r[0] for r in rows(stepwise)]
    for (_, a), (_, b) in zip(rows(direct), rows(stepwise)):
        assert abs(a - b) <= 0.01 * a


def test_quantiles_of_days_keep_their_rank_error(spark):
    rng = np.random.default_rng(32)
    n = 40_000
    slow = np.concatenate([np.full(n // 3, 250), rng.lognormal(6, 1.5, n - n // 3).astype(int)])
    payload = spark.createDataFrame(
        [(T(2024, 1, 1) + datetime.timedelta(seconds=int(s)), int(v)) for s, v in zip(rng.integers(0, 2 * 86400, n), slow)]
        + [(T(2024, 1, 1), None)], "request_time timestamp, execution_time_ms bigint")
    days = K.rolled_latency(K.latency_sketches(payload))
    errors = K.rank_errors(days, payload).collect()
    assert len(errors) == 8 and max(r["rank_error"] for r in errors) <= 0.015
    got = {r["period"].date(): r for r in days.collect()}
    want = payload.groupBy(F.to_date("request_time").alias("d")).agg(
        F.count("execution_time_ms").alias("n"), F.max("execution_time_ms").alias("m")).collect()
    for r in want:
        assert (got[r["d"]]["requests"], got[r["d"]]["max_latency_ms"]) == (r["n"], r["m"])


def test_sketches_of_nothing(usage, spark):
    assert K.rolled_usage(K.usage_sketches(usage.limit(0))).count() == 0
    blank = usage.withColumn("requester", F.lit(None).cast("string"))
    assert {r["unique_users"] for r in K.rolled_usage(K.usage_sketches(blank)).collect()} == {0}


def _run(spark, stream, table, offsets):
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", offsets)
             .trigger(availableNow=True).start(table))
    query.awaitTermination()
    return query


def test_live_windows_roll_up_to_days(spark, usage, tmp_path):
    source = str(tmp_path / "src")
    usage.repartition(4).write.parquet(source)
    stream = V.live_usage(spark.readStream.schema(USAGE).parquet(source))
    I.drain_to_table(stream, str(tmp_path / "live"), str(tmp_path / "offsets"))
    windows = spark.read.parquet(str(tmp_path / "live"))
    closed = usage.where("request_time < '2024-01-03'")
    hours = windows.select(F.col("window_start").alias("period"), "total_requests", "successful_requests", "users").where("period < '2024-01-03'")
    for r in K.rolled_usage(hours).collect():
        day = closed.where(F.date_trunc("DAY", "request_time") == F.lit(r["period"]))
        exact = day.agg(F.count_distinct("requester")).first()[0]
        assert r["total_requests"] == day.count() and abs(r["unique_users"] - exact) <= 0.03 * exact


def test_busy_window_and_state_that_ends_with_the_watermark(spark, tmp_path):
    """One key has most requests of a window; the counters leave when the watermark passes."""
    limit = G.RateLimit("user", 5, "requester", "MINUTE")
    source, table, offsets = (str(tmp_path / n) for n in ("src", "out", "offsets"))

    def load(start, count, minutes):
        data = [(start + i, T(2024, 1, 1, 10, minutes, i * 59 // count), "hot" if i % 3 else f"u{i % 7}", 200) for i in range(count)]
        spark.createDataFrame(data, USAGE).repartition(3).write.mode("append").parquet(source)

    def run():
        stream = V.rate_limit_stream(spark.readStream.schema(USAGE).parquet(source), limit, watermark="1 minute")
        return _run(spark, stream, table, offsets)

    load(0, 200, 0)
    run()
    load(1000, 90, 30)  # half an hour later: the first windows are over
    last = run()
    load(2000, 60, 59)
    last = run()
    requests = spark.read.parquet(source)
    want = rows(G.rate_limit(requests, [limit]).select("client_request_id", "admitted"))
    assert rows(spark.read.parquet(table).select("client_request_id", "admitted")) == want
    # Only the windows of the last load may still be open: one for each of 8 keys, in up to 8 parts and in the deciding step.
    kept = sum(op["numRowsTotal"] for op in last.recentProgress[-1]["stateOperators"])
    assert kept <= 3 * 8 * 9

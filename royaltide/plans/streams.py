"""Streaming queries; each drains the given tables through a real stream."""

from pyspark.sql import functions as F

from royaltide.operators.guardrails import RateLimit
from royaltide.plans.common import Catalogue, sql_round, sql_time
from royaltide.session import scratch_path
from royaltide.sources import partitioned as D
from royaltide.streaming import ingest as I
from royaltide.streaming import live as V
from royaltide.streaming.upsert import upsert_stream

CAT = Catalogue()


def _csv_folder(t):
    path = scratch_path(t.spark, "csv")
    source = t.events.select("event_id", "user_id", "event_type", "value")
    source.write.option("header", True).csv(path)
    return path


@CAT.add("csv_ingest", "SELECT event_id, user_id, event_type, value FROM {events}")
def _(t):
    folder = _csv_folder(t)
    table, side = scratch_path(t.spark, "ingested"), scratch_path(t.spark, "side")
    for _ in range(2):  # the second run finds nothing new
        I.drain_to_table(I.csv_stream(t.spark, folder, f"{side}/schema"), table, f"{side}/offsets")
    return t.spark.read.parquet(table)


@CAT.add(
    "csv_audit",
    """SELECT event_id, '2024-01-31 00:00:00.000000' AS _ingested_at, true AS has_source FROM {events}""",
)
def _(t):
    folder = _csv_folder(t)
    table, side = scratch_path(t.spark, "audited"), scratch_path(t.spark, "side")
    stream = I.with_audit(I.csv_stream(t.spark, folder, f"{side}/schema"), "2024-01-31")
    I.drain_to_table(stream, table, f"{side}/offsets")
    source = F.col("_source_file").endswith(".csv").alias("has_source")
    return t.spark.read.parquet(table).select("event_id", "_ingested_at", source)


@CAT.add(
    "csv_schema_evolution",
    """SELECT event_id, user_id, value, NULL AS event_type FROM {events} WHERE ts < TIMESTAMP '2024-01-15'
       UNION ALL SELECT event_id, user_id, value, event_type FROM {events} WHERE ts >= TIMESTAMP '2024-01-15'""",
)
def _(t):
    folder, side = scratch_path(t.spark, "csv"), scratch_path(t.spark, "side")
    table = scratch_path(t.spark, "evolved")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    loads = [
        t.events.where(early).select("event_id", "user_id", "value"),
        t.events.where(~early).select("event_type", "event_id", "value", "user_id"),
    ]
    for load in loads:
        load.write.mode("append").option("header", True).csv(folder)
        I.ingest_evolving(t.spark, folder, table, f"{side}/schema", f"{side}/offsets")
    return I.read_evolving(t.spark, table).select("event_id", "user_id", "value", "event_type")


def _usage_stream(t):
    """The usage log as a stream over the events file."""
    source = (
        t.spark.readStream.schema(t.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.sf_dir)
    )
    return source.select(
        F.col("event_id").alias("client_request_id"),
        F.col("ts").cast("timestamp").alias("request_time"),
        F.col("user_id").alias("requester"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
    )


def _drained(t, stream, label):
    """Run the stream to its end, with one state partition per core and the state in RocksDB."""
    table, offsets = scratch_path(t.spark, label), scratch_path(t.spark, "offsets")
    settings = dict([V.ROCKSDB, ("spark.sql.shuffle.partitions", str(t.spark.sparkContext.defaultParallelism))])
    before = {key: t.spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        t.spark.conf.set(key, value)
    try:
        I.drain_to_table(stream, table, offsets)
    finally:
        for key, value in before.items():
            t.spark.conf.set(key, value) if value is not None else t.spark.conf.unset(key)
    return t.spark.read.parquet(table)


@CAT.add(
    "live_usage",
    f"""WITH hours AS (
        SELECT date_trunc('hour', request_time) AS h, count(*) AS n,
               count(*) FILTER (status_code <> 200) AS bad, count(DISTINCT requester) AS users
        FROM {{endpoint_usage}} GROUP BY 1)
    SELECT {sql_time("h")} AS window_start, {sql_time("h + INTERVAL 1 HOUR")} AS window_end,
           n AS total_requests, n - bad AS successful_requests, bad AS error_count,
           {sql_round("CAST(bad AS DOUBLE) * 100 / n", 2)} AS error_rate_pct, true AS users_ok
    FROM hours WHERE h + INTERVAL 1 HOUR <=
        (SELECT max(request_time) FROM {{endpoint_usage}}) - INTERVAL 10 MINUTE""",
)
def _(t):
    """The windows of the stream; the users it estimates are held against an exact count."""
    windows = _drained(t, V.live_usage(_usage_stream(t)), "live")
    exact = t.endpoint_usage.groupBy(F.date_trunc("HOUR", "request_time").cast("timestamp").alias("window_start")).agg(
        F.count_distinct("requester").alias("exact"))
    near = F.abs(F.col("approx_users") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
    return windows.join(exact, "window_start").withColumn("users_ok", near).drop("users", "approx_users", "exact")


@CAT.add(
    "rate_limit_stream",
    """SELECT client_request_id, row_number() OVER (
           PARTITION BY requester, date_trunc('hour', request_time)
           ORDER BY request_time, client_request_id) <= 1 AS admitted FROM {endpoint_usage}""",
)
def _(t):
    limit = RateLimit("user_hour", 1, "requester", "HOUR")
    decided = _drained(t, V.rate_limit_stream(_usage_stream(t), limit), "limited")
    return decided.select("client_request_id", "admitted")


@CAT.add(
    "stream_upsert",
    """SELECT requester, client_request_id, status_code FROM {endpoint_usage}
       QUALIFY row_number() OVER (PARTITION BY requester ORDER BY request_time DESC, client_request_id DESC) = 1""",
)
def _(t):
    """The last request of every user, kept from a stream; the second run finds nothing new."""
    path, offsets = scratch_path(t.spark, "last"), scratch_path(t.spark, "offsets")
    for _ in range(2):
        upsert_stream(_usage_stream(t), path, offsets, ["requester"], ["request_time", "client_request_id"], buckets=16)
    return D.current(t.spark, path).select("requester", "client_request_id", "status_code")

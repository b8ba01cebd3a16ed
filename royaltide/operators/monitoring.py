"""Service-usage reports.

Usage operators read a request log ``(request_time, client_request_id,
requester, status_code, input_token_count, output_token_count,
served_entity_id)`` and keep the requests of one endpoint. Payload operators
read ``(request_id, request_time, execution_time_ms, request)``. ``as_of``
replaces "now", and ``days`` is the look-back from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from royaltide.functions.columns import TextRule, any_of, first_rule, percent

# Ordered request-typing rules; the first that fits wins.
REQUEST_RULES = (
    TextRule("Royalty Lookup", ["%royalt%"], ["%split%"]),
    TextRule("Song Search", ["%search%", "%find%"]),
    TextRule("Royalty Split", ["%split%"]),
    TextRule("Licensing", ["%licens%"]),
    TextRule("Catalog Overview", ["%overview%", "%catalog%"]),
    TextRule("Territory Revenue", ["%territory%"]),
    TextRule("Platform Performance", ["%platform%", "%streaming%"]),
    TextRule("Songwriter Earnings", ["%earn%", "%songwriter%"]),
    TextRule("Top Songs", [("%top%", "%song%")]),
)
# The tool each kind of request leads to. The search rule is narrower here.
TOOL_RULES = (
    TextRule("lookup_song_royalties", ["%royalt%"], ["%split%"]),
    TextRule("search_song_catalog", ["%search%", "%find%songs%"]),
    TextRule("calculate_royalty_split", ["%split%"]),
    TextRule("get_licensing_summary", ["%licens%"]),
    TextRule("get_catalog_overview", ["%overview%", "%catalog%"]),
    TextRule("get_revenue_by_territory", ["%territory%"]),
    TextRule("get_platform_performance", ["%platform%", "%streaming%"]),
    TextRule("lookup_songwriter_earnings", ["%earn%", "%songwriter%"]),
    TextRule("get_top_royalty_songs", [("%top%", "%song%")]),
)
# Text that hints at a guardrail.
GUARDRAIL_PATTERNS = {
    "PII_REQUEST": ("%email%", "%ipi%", "%phone%"),
    "OFF_TOPIC_REQUEST": ("%weather%", "%poem%", "%joke%"),
}
# Upper bounds (ms) of the latency buckets and their names.
LATENCY_BUCKETS = ((500, "< 500ms"), (1000, "500ms - 1s"), (2000, "1s - 2s"), (5000, "2s - 5s"))
LATENCY_REST = "> 5s"
# Prices in dollars per token.
INPUT_PRICE = 0.000003
OUTPUT_PRICE = 0.000015
SLA_MS = 2000

def _total() -> Column:
    return F.count(F.lit(1))


def _ok() -> Column:
    return F.count_if(F.col("status_code") == 200)


def _failed() -> Column:
    return F.count_if(F.col("status_code") != 200)


def _tokens() -> Column:
    return F.col("input_token_count") + F.col("output_token_count")


def _cost(input_price: float, output_price: float) -> Column:
    spent = F.sum("input_token_count") * input_price + F.sum("output_token_count") * output_price
    return F.round(spent, 4)


def _recent_days(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows since midnight ``days`` days before the day of ``as_of``."""
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    return df.where(F.col("request_time") >= start)


def _recent_time(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows since exactly ``days`` days before ``as_of``."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return df.where(F.col("request_time") >= start)


def _requests(
    usage: DataFrame, entities: DataFrame, endpoint: str, as_of: str, days: int
) -> DataFrame:
    """Recent requests served by the endpoint; no column of the dimension is kept."""
    served = entities.where(F.col("endpoint_name") == endpoint).select("served_entity_id")
    recent = _recent_days(usage, as_of, days)
    return recent.join(served, "served_entity_id").withColumn("date", F.to_date("request_time"))


def list_entities(entities: DataFrame, endpoint: str) -> DataFrame:
    """Served entities of one endpoint, newest first."""
    return (
        entities.where(F.col("endpoint_name") == endpoint)
        .select(
            "served_entity_id", "endpoint_name", "entity_name", "entity_version", "entity_type",
            "change_time",
        )
        .orderBy(F.desc("change_time"), "served_entity_id")
    )


def daily_volume(usage, entities, endpoint: str, as_of: str, days: int = 30) -> DataFrame:
    """Requests, sessions, users and successes per day."""
    return (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy("date")
        .agg(
            _total().alias("total_requests"),
            F.count_distinct("client_request_id").alias("unique_sessions"),
            F.count_distinct("requester").alias("unique_users"),
            _ok().alias("successful_requests"),
        )
        .orderBy("date")
    )


def hour_weekday(usage, entities, endpoint: str, as_of: str, days: int = 7) -> DataFrame:
    """Requests per hour of day and weekday (Sunday is 1)."""
    return (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy(
            F.hour("request_time").alias("hour_of_day"),
            F.dayofweek("request_time").alias("day_of_week"),
        )
        .agg(_total().alias("request_count"))
        .orderBy("day_of_week", "hour_of_day")
    )


def _latency_counts(payload: DataFrame, as_of: str, days: int) -> DataFrame:
    """Requests per (day, millisecond).

    Latencies repeat, so this reduction on the map side leaves one row per
    distinct millisecond of a day, whatever the traffic.
    """
    return (
        _recent_time(payload, as_of, days)
        .groupBy(F.to_date("request_time").alias("date"), "execution_time_ms")
        .agg(_total().alias("_n"))
    )


def _weighted_percentile(q: float) -> Column:
    return F.round(F.percentile("execution_time_ms", F.lit(q), F.col("_n")), 0)


def latency_percentiles(payload, as_of: str, days: int = 14) -> DataFrame:
    """Exact latency percentiles per day, computed over weighted values."""
    marks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return (
        _latency_counts(payload, as_of, days)
        .groupBy("date")
        .agg(
            F.sum("_n").alias("requests"),
            *[_weighted_percentile(q).alias(f"{name}_latency_ms") for name, q in marks.items()],
            F.max("execution_time_ms").alias("max_latency_ms"),
        )
        .orderBy("date")
    )


def latency_buckets(
    payload,
    as_of: str,
    days: int = 7,
    bounds: Sequence[tuple[int, str]] = LATENCY_BUCKETS,
    rest: str = LATENCY_REST,
) -> DataFrame:
    """Requests per latency bucket with their share, in bucket order."""
    place = F.coalesce(
        *[F.when(F.col("execution_time_ms") < top, i) for i, (top, _) in enumerate(bounds)],
        F.lit(len(bounds)),
    )
    names = F.array(*[F.lit(name) for _, name in bounds], F.lit(rest))
    counted = (
        _recent_time(payload, as_of, days)
        .groupBy(place.alias("_place"))
        .agg(_total().alias("request_count"))
    )
    # The window sees one row per bucket.
    whole = F.sum("request_count").over(W.partitionBy())
    return (
        counted.withColumn("percentage", percent(F.col("request_count"), whole))
        .orderBy("_place")
        .select(F.element_at(names, F.col("_place") + 1).alias("latency_bucket"), "request_count", "percentage")
    )


def daily_errors(usage, entities, endpoint: str, as_of: str, days: int = 14) -> DataFrame:
    """Errors and error rate per day."""
    return (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy("date")
        .agg(
            _total().alias("total_requests"),
            _failed().alias("error_count"),
            percent(_failed(), _total()).alias("error_rate_pct"),
        )
        .orderBy("date")
    )


def error_share(usage, entities, endpoint: str, as_of: str, days: int = 7) -> DataFrame:
    """How the errors divide over status codes."""
    failed = _requests(usage, entities, endpoint, as_of, days).where(F.col("status_code") != 200)
    counted = failed.groupBy("status_code").agg(_total().alias("error_count"))
    whole = F.sum("error_count").over(W.partitionBy())
    return counted.withColumn("percentage", percent(F.col("error_count"), whole)).orderBy(
        F.desc("error_count"), "status_code"
    )


def token_cost(
    usage,
    entities,
    endpoint: str,
    as_of: str,
    days: int = 30,
    input_price: float = INPUT_PRICE,
    output_price: float = OUTPUT_PRICE,
) -> DataFrame:
    """Tokens and their cost per day."""
    return (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy("date")
        .agg(
            F.sum("input_token_count").alias("total_input_tokens"),
            F.sum("output_token_count").alias("total_output_tokens"),
            F.sum(_tokens()).alias("total_tokens"),
            F.round(F.avg(_tokens()), 0).alias("avg_tokens_per_request"),
            _cost(input_price, output_price).alias("estimated_cost_usd"),
        )
        .orderBy("date")
    )


def _by_rule(
    payload, rules: Sequence[TextRule], default: str, as_of: str, days: int, label: str, count: str
) -> DataFrame:
    typed = _recent_time(payload, as_of, days).select(
        first_rule("request", rules, default).alias(label), "execution_time_ms"
    )
    return (
        typed.groupBy(label)
        .agg(_total().alias(count), F.round(F.avg("execution_time_ms"), 0).alias("avg_latency_ms"))
        .orderBy(F.desc(count), label)
    )


def request_types(
    payload, as_of: str, days: int = 7, rules: Sequence[TextRule] = REQUEST_RULES,
    default: str = "Other",
) -> DataFrame:
    """Requests and mean latency per kind of request."""
    return _by_rule(payload, rules, default, as_of, days, "query_type", "request_count")


def tool_usage(
    payload, as_of: str, days: int = 7, rules: Sequence[TextRule] = TOOL_RULES,
    default: str = "unknown",
) -> DataFrame:
    """Requests and mean latency per tool the text points to."""
    return _by_rule(payload, rules, default, as_of, days, "likely_tool", "invocation_count")


def guardrail_estimate(
    payload,
    as_of: str,
    days: int = 7,
    patterns: Mapping[str, Sequence[str]] = GUARDRAIL_PATTERNS,
) -> DataFrame:
    """Requests that look like each guardrail's target, all counted in one scan."""
    text = F.lower("request")
    counts = _recent_time(payload, as_of, days).agg(
        *[
            F.count_if(any_of([text.like(p) for p in entries])).alias(name)
            for name, entries in patterns.items()
        ]
    )
    return counts.unpivot([], list(patterns), "guardrail_type", "estimated_triggers")


def top_users(usage, entities, endpoint: str, as_of: str, days: int = 30, n: int = 20) -> DataFrame:
    """Most active users.

    Counting per (user, day) first keeps a very active user from filling one
    task and makes the distinct days a plain count.
    """
    per_day = (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy("requester", "date")
        .agg(
            _total().alias("_n"),
            F.min("request_time").alias("_first"),
            F.max("request_time").alias("_last"),
            F.sum(_tokens()).alias("_tokens"),
        )
    )
    return (
        per_day.groupBy(F.col("requester").alias("user_id"))
        .agg(
            F.sum("_n").alias("request_count"),
            F.count("date").alias("active_days"),
            F.min("_first").alias("first_request"),
            F.max("_last").alias("last_request"),
            F.sum("_tokens").alias("total_tokens"),
        )
        .orderBy(F.desc("request_count"), "user_id")
        .limit(n)
    )


def daily_engagement(usage, entities, endpoint: str, as_of: str, days: int = 30) -> DataFrame:
    """Users and requests per user per day."""
    per_user = (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy("date", "requester")
        .agg(_total().alias("_n"))
    )
    users = F.count("requester")
    return (
        per_user.groupBy("date")
        .agg(
            users.alias("unique_users"),
            F.sum("_n").alias("total_requests"),
            F.round(F.try_divide(F.sum("_n"), users), 1).alias("requests_per_user"),
        )
        .orderBy("date")
    )


def success_sla(usage, entities, endpoint: str, as_of: str, days: int = 14) -> DataFrame:
    """Successful requests per day."""
    return (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy("date")
        .agg(
            _total().alias("total_requests"),
            _ok().alias("successful"),
            percent(_ok(), _total()).alias("success_rate_pct"),
        )
        .orderBy("date")
    )


def latency_sla(payload, as_of: str, days: int = 14, limit_ms: int = SLA_MS) -> DataFrame:
    """Requests per day that stayed within the latency limit."""
    within = F.count_if(F.col("execution_time_ms") <= limit_ms)
    return (
        _recent_time(payload, as_of, days)
        .groupBy(F.to_date("request_time").alias("date"))
        .agg(
            _total().alias("total_requests"),
            within.alias("within_sla"),
            percent(within, _total()).alias("sla_compliance_pct"),
        )
        .orderBy("date")
    )


def executive_summary(
    usage,
    entities,
    endpoint: str,
    as_of: str,
    days: int = 7,
    input_price: float = INPUT_PRICE,
    output_price: float = OUTPUT_PRICE,
) -> DataFrame:
    """One row over the whole period."""
    return _requests(usage, entities, endpoint, as_of, days).agg(
        F.lit(f"Last {days} Days").alias("period"),
        _total().alias("total_requests"),
        F.count_distinct("requester").alias("unique_users"),
        percent(_ok(), _total()).alias("success_rate_pct"),
        F.sum("input_token_count").alias("total_input_tokens"),
        F.sum("output_token_count").alias("total_output_tokens"),
        F.sum(_tokens()).alias("total_tokens"),
        _cost(input_price, output_price).alias("estimated_cost_usd"),
    )


def alerts(
    usage,
    entities,
    endpoint: str,
    payload,
    as_of: str,
    days: int = 14,
    max_error_pct: float = 5.0,
    max_p95_ms: float = 5000.0,
) -> DataFrame:
    """Days on which the error rate or the p95 latency is above its limit."""
    errors = daily_errors(usage, entities, endpoint, as_of, days).select("date", "error_rate_pct")
    slow = latency_percentiles(payload, as_of, days).select("date", "p95_latency_ms")
    checked = errors.join(slow, "date", "full_outer").withColumns(
        {
            "error_alert": F.coalesce(F.col("error_rate_pct") > max_error_pct, F.lit(False)),
            "latency_alert": F.coalesce(F.col("p95_latency_ms") > max_p95_ms, F.lit(False)),
        }
    )
    return checked.where(F.col("error_alert") | F.col("latency_alert")).orderBy("date")


def hourly_volume(usage, entities, endpoint: str, as_of: str, days: int = 7) -> DataFrame:
    """Requests and users per hour."""
    per_user = (
        _requests(usage, entities, endpoint, as_of, days)
        .groupBy(F.date_trunc("hour", "request_time").alias("hour"), "requester")
        .agg(_total().alias("_n"))
    )
    return (
        per_user.groupBy("hour")
        .agg(F.sum("_n").alias("request_count"), F.count("requester").alias("unique_users"))
        .orderBy("hour")
    )


def guardrail_events_by_day(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Guardrail events ``(timestamp, guardrail_type)`` per day, busiest type first."""
    recent = _recent_days(events.withColumnRenamed("timestamp", "request_time"), as_of, days)
    return (
        recent.groupBy(F.to_date("request_time").alias("day"), "guardrail_type")
        .agg(_total().alias("trigger_count"))
        .orderBy("day", F.desc("trigger_count"), "guardrail_type")
    )


def recent_requests(payload, n: int = 10) -> DataFrame:
    """The newest requests."""
    return payload.orderBy(F.desc("request_time"), F.desc("request_id")).limit(n)

"""Service-usage reports on the bound usage and payload logs."""

from pyspark.sql import functions as F

from royaltide.functions.columns import TextRule
from royaltide.operators import guardrails as G
from royaltide.operators import monitoring as M
from royaltide.operators import sketches as K
from royaltide.plans.common import AS_OF_TIME, Catalogue, sql_round, sql_time, sql_int

CAT = Catalogue()
END = "agent"


def _served(days):
    return f"""served AS (
        SELECT u.*, CAST(request_time AS DATE) AS day FROM {{endpoint_usage}} u
        SEMI JOIN (SELECT * FROM {{served_entities}} WHERE endpoint_name = '{END}') e
            USING (served_entity_id)
        WHERE request_time >= DATE '2024-01-31' - {days})"""


def _paid(name, days):
    return f"""paid AS (SELECT *, CAST(request_time AS DATE) AS day FROM {{{name}}}
        WHERE request_time >= TIMESTAMP '{AS_OF_TIME}' - INTERVAL {days} DAY)"""


def _pct(part, whole, digits=2):
    return sql_round(f"CAST({part} AS DOUBLE) * 100 / {whole}", digits)


def _args(t):
    return t.endpoint_usage, t.served_entities, END, AS_OF_TIME


@CAT.add(
    "list_entities",
    f"""SELECT served_entity_id, endpoint_name, entity_name, entity_version, entity_type,
        {sql_time("change_time")} AS change_time
        FROM {{served_entities}} WHERE endpoint_name = '{END}'""",
)
def _(t):
    return M.list_entities(t.served_entities, END)


@CAT.add(
    "daily_volume",
    f"""WITH {_served(30)} SELECT CAST(day AS VARCHAR) AS date, count(*) AS total_requests,
        count(DISTINCT client_request_id) AS unique_sessions,
        count(DISTINCT requester) AS unique_users,
        count(*) FILTER (status_code = 200) AS successful_requests FROM served GROUP BY day""",
)
def _(t):
    return M.daily_volume(*_args(t))


@CAT.add(
    "hour_weekday",
    sql_int(f"""WITH {_served(7)} SELECT extract(hour FROM request_time) AS hour_of_day,
        extract(dayofweek FROM request_time) + 1 AS day_of_week, count(*) AS request_count
        FROM served GROUP BY 1, 2""", "hour_of_day", "day_of_week"),
)
def _(t):
    return M.hour_weekday(*_args(t))


_P = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_PERCENTILES = ", ".join(
    f"{sql_round(f'quantile_cont(execution_time_ms, {q})', 0)} AS {n}_latency_ms" for n, q in _P.items()
)


@CAT.add(
    "latency_percentiles",
    f"""WITH {_paid("payload_latency", 14)} SELECT CAST(day AS VARCHAR) AS date, count(*) AS requests,
        {_PERCENTILES}, max(execution_time_ms) AS max_latency_ms FROM paid GROUP BY day""",
)
def _(t):
    return M.latency_percentiles(t.payload_latency, AS_OF_TIME)


@CAT.add(
    "latency_buckets",
    f"""WITH {_paid("payload_latency", 7)},
    named AS (SELECT CASE WHEN execution_time_ms >= 5000 THEN '> 5s'
                          WHEN execution_time_ms >= 2000 THEN '2s - 5s'
                          WHEN execution_time_ms >= 1000 THEN '1s - 2s'
                          WHEN execution_time_ms >= 500 THEN '500ms - 1s'
                          ELSE '< 500ms' END AS latency_bucket FROM paid)
    SELECT latency_bucket, count(*) AS request_count,
           {_pct("count(*)", "(SELECT count(*) FROM named)")} AS percentage
    FROM named GROUP BY latency_bucket""",
)
def _(t):
    return M.latency_buckets(t.payload_latency, AS_OF_TIME)


@CAT.add(
    "daily_errors",
    f"""WITH {_served(14)} SELECT CAST(day AS VARCHAR) AS date, count(*) AS total_requests,
        count(*) FILTER (status_code <> 200) AS error_count,
        {_pct("count(*) FILTER (status_code <> 200)", "count(*)")} AS error_rate_pct
        FROM served GROUP BY day""",
)
def _(t):
    return M.daily_errors(*_args(t))


@CAT.add(
    "error_share",
    f"""WITH {_served(7)}, failed AS (SELECT status_code FROM served WHERE status_code <> 200)
    SELECT status_code, count(*) AS error_count,
           {_pct("count(*)", "(SELECT count(*) FROM failed)")} AS percentage
    FROM failed GROUP BY status_code""",
)
def _(t):
    return M.error_share(*_args(t))


_COST = sql_round(
    "CAST(sum(input_token_count) AS DOUBLE) * CAST(0.000003 AS DOUBLE) "
    "+ CAST(sum(output_token_count) AS DOUBLE) * CAST(0.000015 AS DOUBLE)", 4)
_SUMS = """CAST(sum(input_token_count) AS BIGINT) AS total_input_tokens,
        CAST(sum(output_token_count) AS BIGINT) AS total_output_tokens,
        CAST(sum(input_token_count + output_token_count) AS BIGINT) AS total_tokens"""


@CAT.add(
    "token_cost",
    f"""WITH {_served(30)} SELECT CAST(day AS VARCHAR) AS date, {_SUMS},
        {sql_round("avg(input_token_count + output_token_count)", 0)} AS avg_tokens_per_request,
        {_COST} AS estimated_cost_usd FROM served GROUP BY day""",
)
def _(t):
    return M.token_cost(*_args(t))


# Rules on words that do occur in the test texts.
SAMPLE_RULES = (
    TextRule("licence", ["%licens%"], ["%token%"]),
    TextRule("access", ["%token%", "%key%"]),
    TextRule("article pair", [("%the%", "%and%")], ["%der%"]),
    TextRule("german", ["%der%", "%und%"]),
    TextRule("french", ["%le%les%"]),
)


def _typed(label, other):
    return f"""CASE WHEN contains(x, 'licens') AND NOT contains(x, 'token') THEN 'licence'
        WHEN contains(x, 'token') OR contains(x, 'key') THEN 'access'
        WHEN contains(x, 'the') AND contains(x, 'and') AND NOT contains(x, 'der') THEN 'article pair'
        WHEN contains(x, 'der') OR contains(x, 'und') THEN 'german'
        WHEN x LIKE '%le%les%' THEN 'french' ELSE '{other}' END AS {label}"""


def _typed_sql(label, other, count):
    return f"""WITH {_paid("payload", 7)},
    typed AS (SELECT {_typed(label, other)}, execution_time_ms
              FROM (SELECT lower(request) AS x, execution_time_ms FROM paid))
    SELECT {label}, count(*) AS {count}, {sql_round("avg(execution_time_ms)", 0)} AS avg_latency_ms
    FROM typed GROUP BY {label}"""


@CAT.add("request_types", _typed_sql("query_type", "Other", "request_count"))
def _(t):
    return M.request_types(t.payload, AS_OF_TIME, rules=SAMPLE_RULES)


@CAT.add("tool_usage", _typed_sql("likely_tool", "unknown", "invocation_count"))
def _(t):
    return M.tool_usage(t.payload, AS_OF_TIME, rules=SAMPLE_RULES)


@CAT.add(
    "guardrail_estimate",
    f"""WITH {_paid("payload", 7)}, texts AS (SELECT lower(request) AS x FROM paid)
    SELECT 'PII_REQUEST' AS guardrail_type,
           (SELECT count(*) FROM texts WHERE regexp_matches(x, 'email|ipi|phone')) AS estimated_triggers
    UNION ALL SELECT 'OFF_TOPIC_REQUEST',
           (SELECT count(*) FROM texts WHERE regexp_matches(x, 'weather|poem|joke'))
    UNION ALL SELECT 'SECRETS', (SELECT count(*) FROM texts WHERE regexp_matches(x, 'token|key='))""",
)
def _(t):
    patterns = {**M.GUARDRAIL_PATTERNS, "SECRETS": ("%token%", "%key=%")}
    return M.guardrail_estimate(t.payload, AS_OF_TIME, patterns=patterns)


@CAT.add(
    "top_users",
    f"""WITH {_served(30)} SELECT requester AS user_id, count(*) AS request_count,
        count(DISTINCT day) AS active_days, {sql_time("min(request_time)")} AS first_request,
        {sql_time("max(request_time)")} AS last_request,
        CAST(sum(input_token_count + output_token_count) AS BIGINT) AS total_tokens
        FROM served GROUP BY requester ORDER BY count(*) DESC, requester LIMIT 20""",
)
def _(t):
    return M.top_users(*_args(t))


@CAT.add(
    "daily_engagement",
    f"""WITH {_served(30)} SELECT CAST(day AS VARCHAR) AS date,
        count(DISTINCT requester) AS unique_users, count(*) AS total_requests,
        {sql_round("CAST(count(*) AS DOUBLE) / count(DISTINCT requester)", 1)} AS requests_per_user
        FROM served GROUP BY day""",
)
def _(t):
    return M.daily_engagement(*_args(t))


@CAT.add(
    "success_sla",
    f"""WITH {_served(14)} SELECT CAST(day AS VARCHAR) AS date, count(*) AS total_requests,
        count(*) FILTER (status_code = 200) AS successful,
        {_pct("count(*) FILTER (status_code = 200)", "count(*)")} AS success_rate_pct
        FROM served GROUP BY day""",
)
def _(t):
    return M.success_sla(*_args(t))


@CAT.add(
    "latency_sla",
    f"""WITH {_paid("payload_latency", 14)} SELECT CAST(day AS VARCHAR) AS date,
        count(*) AS total_requests, count(*) FILTER (execution_time_ms <= 400) AS within_sla,
        {_pct("count(*) FILTER (execution_time_ms <= 400)", "count(*)")} AS sla_compliance_pct
        FROM paid GROUP BY day""",
)
def _(t):
    return M.latency_sla(t.payload_latency, AS_OF_TIME, limit_ms=400)


@CAT.add(
    "executive_summary",
    f"""WITH {_served(7)} SELECT 'Last 7 Days' AS period, count(*) AS total_requests,
        count(DISTINCT requester) AS unique_users,
        {_pct("count(*) FILTER (status_code = 200)", "count(*)")} AS success_rate_pct,
        {_SUMS}, {_COST} AS estimated_cost_usd FROM served""",
)
def _(t):
    return M.executive_summary(*_args(t))


@CAT.add(
    "alerts",
    f"""WITH {_served(14)}, {_paid("payload_latency", 14)},
    errors AS (SELECT day, {_pct("count(*) FILTER (status_code <> 200)", "count(*)")} AS rate
               FROM served GROUP BY day),
    slow AS (SELECT day, {sql_round("quantile_cont(execution_time_ms, 0.95)", 0)} AS p95
             FROM paid GROUP BY day)
    SELECT CAST(day AS VARCHAR) AS date, rate AS error_rate_pct, p95 AS p95_latency_ms,
           coalesce(rate > 26, false) AS error_alert, coalesce(p95 > 650, false) AS latency_alert
    FROM errors FULL JOIN slow USING (day) WHERE rate > 26 OR p95 > 650""",
)
def _(t):
    return M.alerts(
        t.endpoint_usage, t.served_entities, END, t.payload_latency, AS_OF_TIME,
        max_error_pct=26, max_p95_ms=650,
    )


@CAT.add(
    "hourly_volume",
    f"""WITH {_served(7)}
    SELECT {sql_time("date_trunc('hour', request_time)")} AS hour, count(*) AS request_count,
           count(DISTINCT requester) AS unique_users FROM served GROUP BY 1""",
)
def _(t):
    return M.hourly_volume(*_args(t))


@CAT.add(
    "recent_requests",
    f"""SELECT request_id, {sql_time("request_time")} AS request_time, execution_time_ms, request
        FROM {{payload}} ORDER BY {{payload}}.request_time DESC, request_id DESC LIMIT 10""",
)
def _(t):
    return M.recent_requests(t.payload)


@CAT.add(
    "usage_rollup",
    """SELECT CAST(CAST(request_time AS DATE) AS VARCHAR) AS date, count(*) AS total_requests,
       count(*) FILTER (status_code = 200) AS successful_requests, true AS users_ok
       FROM {endpoint_usage} GROUP BY 1""",
)
def _(t):
    """Days united from hourly sketches; the estimated users within 3 % of the exact count of the same day."""
    days = K.rolled_usage(K.usage_sketches(t.endpoint_usage))
    exact = t.endpoint_usage.groupBy(F.date_trunc("DAY", "request_time").alias("period")).agg(F.count_distinct("requester").alias("exact"))
    near = F.abs(F.col("unique_users") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
    return days.join(exact, "period").select(
        F.to_date("period").alias("date"), "total_requests", "successful_requests", near.alias("users_ok"))


@CAT.add(
    "latency_rollup",
    """SELECT CAST(CAST(request_time AS DATE) AS VARCHAR) AS date, count(execution_time_ms) AS requests,
       max(execution_time_ms) AS max_latency_ms, true AS ranks_ok FROM {payload_latency} GROUP BY 1""",
)
def _(t):
    """Days united from hourly sketches; the four quantiles within 1.5 % of the rank asked for."""
    days = K.rolled_latency(K.latency_sketches(t.payload_latency))
    worst = K.rank_errors(days, t.payload_latency).groupBy("period").agg((F.max("rank_error") <= 0.015).alias("ranks_ok"))
    return days.join(worst, "period").select(F.to_date("period").alias("date"), "requests", "max_latency_ms", "ranks_ok")

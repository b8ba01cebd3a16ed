"""Guardrail jobs over documents and the usage log."""

from pyspark.sql import functions as F

from royaltide.operators import guardrails as G
from royaltide.operators import monitoring as M
from royaltide.plans.common import AS_OF_TIME, Catalogue, sql_bucket, sql_round, sql_time, sql_int

CAT = Catalogue()

# The test texts hold e-mail addresses but none of the other default kinds, so
# three kinds that do occur are added.
PATTERNS = {
    **G.PII_PATTERNS,
    "long_phone": G.PiiPattern(r"\+1 \(\d{3}\) \d{3}-\d{4}", literal="+1 ("),
    "address": G.PiiPattern(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    "card": G.PiiPattern(r"\b\d{4} \d{4} \d{4} \d{4}\b"),
}
WORDS = ("license", "token", "der", "les")
LIMITS = (
    G.RateLimit("user_minute", 1, "requester", "MINUTE"),
    G.RateLimit("entity_hour", 2, "served_entity_id", "HOUR"),
    G.RateLimit("user_hour", 10, "requester", "HOUR"),
)


def _found(column, pattern):
    hits = f"len(regexp_extract_all({column}, '{pattern.regex}'))"
    if pattern.context:
        listed = "|".join(pattern.context)
        return f"CASE WHEN regexp_matches({column}, '\\b({listed})\\b') THEN {hits} ELSE 0 END"
    return hits


def _hits_sql(keys, table):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS pii_type, {_found('text', p)} AS hits FROM {table}"
        for name, p in PATTERNS.items()
    )


@CAT.add("detect_pii", sql_int(f"SELECT * FROM ({_hits_sql('doc_id', '{documents}')}) WHERE hits > 0", "hits"))
def _(t):
    return G.detect_pii(t.spread("documents"), "text", PATTERNS)


_KINDS = ", ".join(
    f"CASE WHEN ({_found('text', p)}) > 0 THEN '{name}' END" for name, p in PATTERNS.items()
)


@CAT.add(
    "pii_block",
    f"""WITH marked AS (SELECT doc_id, text, concat_ws(',', {_KINDS}) AS kinds FROM {{documents}})
    SELECT doc_id, CASE WHEN kinds = '' THEN md5(text) END AS text_md5,
           nullif(kinds, '') AS reason, kinds <> '' AS blocked FROM marked""",
)
def _(t):
    out = G.apply_pii_policy(t.spread("documents"), "text", PATTERNS, "BLOCK")
    return out.select("doc_id", F.md5("text").alias("text_md5"), "reason", "blocked")


def _redacted():
    text = "text"
    for name, p in PATTERNS.items():
        swapped = f"regexp_replace({text}, '{p.regex}', '[{name.upper()}]', 'g')"
        if p.context:
            listed = "|".join(p.context)
            swapped = (
                f"CASE WHEN regexp_matches(text, '\\b({listed})\\b') THEN {swapped} ELSE {text} END"
            )
        text = swapped
    return text


@CAT.add(
    "pii_redact",
    f"""SELECT doc_id, md5({_redacted()}) AS text_md5, nullif(concat_ws(',', {_KINDS}), '') AS reason
        FROM {{documents}}""",
)
def _(t):
    out = G.apply_pii_policy(t.spread("documents"), "text", PATTERNS, "REDACT")
    return out.select("doc_id", F.md5("text").alias("text_md5"), "reason")


_FIRST_WORD = "coalesce(" + ", ".join(
    f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in WORDS
) + ")"


@CAT.add(
    "block_keywords",
    f"""SELECT doc_id, {_FIRST_WORD} AS matched_keyword, {_FIRST_WORD} IS NOT NULL AS blocked
        FROM {{documents}}""",
)
def _(t):
    return G.block_keywords(t.spread("documents"), "text", WORDS).select(
        "doc_id", "matched_keyword", "blocked"
    )


def guardrail_events(t):
    """Guardrail hits in the request log: sensitive data and blocked keywords."""
    log = t.payload.select("request_id", F.col("request_time").alias("timestamp"), "request")
    pii = G.detect_pii(log, "request", PATTERNS, keys=["timestamp"]).select(
        "timestamp", F.col("pii_type").alias("guardrail_type")
    )
    words = (
        G.block_keywords(log, "request", WORDS)
        .where("blocked")
        .select("timestamp", F.concat(F.lit("keyword:"), "matched_keyword").alias("guardrail_type"))
    )
    return pii.unionByName(words)


@CAT.add(
    "guardrail_events_by_day",
    f"""WITH log AS (SELECT request_time AS ts, request AS text FROM {{payload}}
                     WHERE request_time >= DATE '2024-01-31' - 7),
    happened AS (SELECT ts, pii_type AS guardrail_type FROM ({_hits_sql('ts', 'log')}) WHERE hits > 0
                 UNION ALL
                 SELECT ts, 'keyword:' || word FROM (SELECT ts, {_FIRST_WORD} AS word FROM log)
                 WHERE word IS NOT NULL)
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, guardrail_type, count(*) AS trigger_count
    FROM happened GROUP BY ALL""",
)
def _(t):
    return M.guardrail_events_by_day(guardrail_events(t), AS_OF_TIME)


def _limit_sql(name, calls, key, period):
    return f"""row_number() OVER (PARTITION BY {key}, date_trunc('{period.lower()}', request_time)
        ORDER BY request_time, client_request_id) <= {calls} AS {name}"""


_FLAGS = ", ".join(_limit_sql(x.name, x.calls, x.key, x.period) for x in LIMITS)


@CAT.add(
    "rate_limit",
    f"""SELECT *, user_minute AND entity_hour AND user_hour AS admitted
        FROM (SELECT client_request_id, {_FLAGS} FROM {{endpoint_usage}})""",
)
def _(t):
    return G.rate_limit(t.endpoint_usage, LIMITS).select(
        "client_request_id", *[x.name for x in LIMITS], "admitted"
    )


@CAT.add(
    "split_traffic",
    f"""WITH placed AS (
        SELECT CASE WHEN {sql_bucket("client_request_id", 100)} < 90 THEN 'champion'
                    ELSE 'challenger' END AS arm, status_code, execution_time_ms
        FROM {{endpoint_usage}} JOIN {{payload_latency}} ON client_request_id = request_id)
    SELECT arm, count(*) AS requests, count(*) FILTER (status_code <> 200) AS errors,
           {sql_round("CAST(count(*) FILTER (status_code <> 200) AS DOUBLE) * 100 / count(*)", 2)}
               AS error_rate_pct,
           {sql_round("avg(execution_time_ms)", 2)} AS avg_latency_ms
    FROM placed GROUP BY arm""",
)
def _(t):
    timed = t.endpoint_usage.join(
        t.payload_latency.select(F.col("request_id").alias("client_request_id"), "execution_time_ms"),
        "client_request_id",
    )
    return G.split_traffic(timed, "client_request_id", {"champion": 90, "challenger": 10})

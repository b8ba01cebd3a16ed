"""Domain tables expressed over the generic test tables.

Each binding is one plain SQL query that Spark and DuckDB both accept. Names in
braces are other bindings or raw tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from royaltide.sources.registry import RAW_TABLES, read_table

BINDINGS: dict[str, str] = {
    "songs": """
        SELECT p_partkey AS song_id, p_name AS title, p_brand AS artist_name, p_type AS genre,
               'House ' || CAST(p_partkey % 9 AS VARCHAR(10)) AS publisher,
               'QZ-' || CAST(p_partkey AS VARCHAR(20)) AS isrc_code,
               DATE '1990-01-01' + CAST(p_partkey % 10950 AS INT) AS release_date,
               CAST(p_size * 10 AS BIGINT) AS duration_seconds
        FROM {part}""",
    "songwriters": """
        SELECT s_suppkey AS songwriter_id, s_name AS name, r_name AS pro_affiliation,
               CAST(25 + s_suppkey % 51 AS DOUBLE) / 100 AS split_percentage
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
             JOIN {region} ON n_regionkey = r_regionkey""",
    "song_writers": """
        SELECT DISTINCT l_partkey AS song_id, l_suppkey AS songwriter_id FROM {lineitem}""",
    "royalty_payments": """
        SELECT song_id, songwriter_id, payment_period, payment_status,
               CAST(gross_c AS DOUBLE) / 100 AS gross_amount,
               CAST(ded_c AS DOUBLE) / 100 AS deductions,
               CAST(gross_c - ded_c AS DOUBLE) / 100 AS net_amount,
               CASE WHEN payment_status = 'completed' THEN shipped + 30 END AS payment_date
        FROM (
            SELECT song_id, songwriter_id, payment_period, payment_status, shipped, gross_c,
                   CAST(floor((gross_c * rate + 50) / 100) AS BIGINT) AS ded_c
            FROM (
                SELECT l_partkey AS song_id, l_suppkey AS songwriter_id,
                       CAST(year(l_shipdate) AS VARCHAR(4)) || '-Q'
                           || CAST(quarter(l_shipdate) AS VARCHAR(1)) AS payment_period,
                       CASE WHEN l_returnflag = 'A' THEN 'completed'
                            WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'pending'
                            WHEN l_returnflag = 'N' THEN 'processing'
                            WHEN l_linestatus = 'F' THEN 'disputed'
                            ELSE 'on_hold' END AS payment_status,
                       CAST(l_shipdate AS DATE) AS shipped,
                       CAST(floor(l_extendedprice * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS gross_c,
                       10 + CAST(floor(l_discount * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS rate
                FROM {lineitem}) AS priced) AS charged""",
    "licenses": """
        SELECT l_partkey AS song_id, c_name AS licensee_name, o_orderpriority AS license_type,
               n_name AS territory, CAST(o_orderdate AS DATE) AS start_date,
               CAST(l_shipdate AS DATE) + 365 AS end_date, l_extendedprice AS fee_amount
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
             JOIN {customer} ON o_custkey = c_custkey
             JOIN {nation} ON c_nationkey = n_nationkey""",
    "performance_logs": """
        SELECT event_id AS log_id, user_id AS song_id, event_type AS platform,
               ts AS play_timestamp, CAST(floor(value) AS BIGINT) AS duration_played,
               'T' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 15
                           AS VARCHAR(2)) AS territory
        FROM {events}""",
    "endpoint_usage": """
        SELECT event_id AS client_request_id, ts AS request_time, user_id AS requester,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
               CAST(floor(value * 10) AS BIGINT) AS input_token_count,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS output_token_count,
               event_type AS served_entity_id
        FROM {events}""",
    "served_entities": """
        SELECT event_type AS served_entity_id,
               CASE WHEN event_type = 'view' THEN 'other' ELSE 'agent' END AS endpoint_name,
               'model-' || event_type AS entity_name, '1' AS entity_version,
               'CUSTOM' AS entity_type, min(ts) AS change_time
        FROM {events} GROUP BY event_type""",
    "payload_latency": """
        SELECT event_id AS request_id, ts AS request_time,
               CAST(floor(value * 20) AS BIGINT) AS execution_time_ms
        FROM {events}""",
    "payload": """
        SELECT event_id AS request_id, ts AS request_time,
               CAST(floor(value * 20) AS BIGINT) AS execution_time_ms, text AS request
        FROM {events} JOIN {documents}
             ON CAST(floor(event_id / 10) AS BIGINT) = doc_id""",
    "messages": "SELECT conv_id, turn, role, text AS content FROM {conversations}",
    "eval_pairs": """
        SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, b.text AS expected,
               CASE WHEN q.turn <= 1 THEN 'opening' ELSE 'follow_up' END AS query_type
        FROM {conversations} AS q
             JOIN {conversations} AS a
               ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
             JOIN {benchmark} AS b
               ON CAST(floor(q.conv_id / 5) AS BIGINT) = b.item_id
        WHERE q.role = 'user'""",
}

_SLOT = re.compile(r"\{([a-z_]+)\}")


def uses(sql: str) -> set[str]:
    return set(_SLOT.findall(sql))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table (or raw table) as a DataFrame."""
    if name in RAW_TABLES:
        return read_table(spark, sf_dir, name)
    sql = BINDINGS[name]
    inputs = {part: bind(spark, sf_dir, part) for part in uses(sql)}
    return spark.sql(sql, **inputs)


def with_bindings(sql: str) -> str:
    """Same query for the SQL check: ``{name}`` slots become CTE references."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in RAW_TABLES or name in ordered:
            return
        for part in sorted(uses(BINDINGS[name])):
            visit(part)
        ordered.append(name)

    for name in sorted(uses(sql)):
        visit(name)

    def plain(text: str) -> str:
        return _SLOT.sub(lambda m: m.group(1), text)

    if not ordered:
        return plain(sql)
    ctes = ",\n".join(f"{n} AS ({plain(BINDINGS[n])})" for n in ordered)
    body = plain(sql).strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

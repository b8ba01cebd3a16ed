"""Runs registered queries against DuckDB on the same parquet files."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from royaltide.sources.registry import RAW_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("f", repr(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return repr(value)


def compare(spark, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, otherwise a short description."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    left = sorted((tuple(_norm(r[n]) for n in names) for r in df.collect()), key=repr)
    con = connect(sf_dir)
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns differ: {names} vs {sorted(found)}"
    order = [found.index(n) for n in names]
    right = sorted((tuple(_norm(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    if len(left) != len(right):
        return f"rows differ: {len(left)} vs {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference in {names}:\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return None if left else "EMPTY on both sides"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from royaltide.session import build_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                problem = compare(spark, query, checks[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).collect() else "EMPTY (rows only)"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "sql " if name in checks else "rows"
        print(f"{mark} {kind} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

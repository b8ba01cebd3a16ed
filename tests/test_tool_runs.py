"""Tools are answered one after the other, and the search view holds large blocks."""

import datetime

from royaltide.functions.tablefuncs import term_weights
from royaltide.operators import evaluation as E

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def make(spark):
    return {
        "songs": spark.createDataFrame([("S1", "Red", "Ann", "Pop", "I1", "W1")], "song_id string, title string, artist_name string, genre string, isrc_code string, songwriters string"),
        "songwriters": spark.createDataFrame([("W1", "Zed", "P", 0.5)], "songwriter_id string, name string, pro_affiliation string, split_percentage double"),
        "royalty_payments": spark.createDataFrame(
            [("S1", "W1", "2024-Q1", "completed", 100.0, 15.0, 85.0, None)],
            "song_id string, songwriter_id string, payment_period string, payment_status string, gross_amount double, deductions double, net_amount double, payment_date date"),
        "licenses": spark.createDataFrame([("S1", "L1", "sync", "US", datetime.date(2025, 1, 1), 10.0)], "song_id string, licensee_name string, license_type string, territory string, end_date date, fee_amount double"),
        "performance_logs": spark.createDataFrame([("S1", "Radio", "US", 3600)], "song_id string, platform string, territory string, duration_played long"),
    }


def test_few_joins_are_left_for_the_result(spark):
    asked = [
        ("a", "lookup_song_royalties", '{"search_term": "red"}'), ("b", "get_licensing_summary", '{"search_term": "Red"}'),
        ("c", "get_catalog_overview", "{}"), ("d", "calculate_royalty_split", '{"input_song_id": "S1", "gross_amount": 10}'),
    ]
    before = spark.conf.get(THRESHOLD)
    out = E.run_tools(spark.createDataFrame(asked, "request_id string, tool string, arguments string"), make(spark), "2024-01-01")
    assert spark.conf.get(THRESHOLD) == before
    plan = E.rows_to_json(out)._jdf.queryExecution().executedPlan().toString()
    # The result kept the joins of all nine tools in one plan, and so their tables in the driver at once.
    assert plan.count("Join") <= 12
    assert {r["request_id"] for r in E.rows_to_json(out).collect()} == {"a", "b", "c", "d"}


def test_the_search_view_has_large_blocks(spark):
    songs = [(i, f"T{i}", "A", "g", "n", f"w{i % 11}") for i in range(2000)]
    view = term_weights(spark.createDataFrame(songs, "song_id long, title string, artist_name string, genre string, songwriter_names string, metadata_text string").coalesce(1))
    found = [len(r["songs"]) for r in view.collect()]
    assert sum(found) == 2000 and len(found) <= 4

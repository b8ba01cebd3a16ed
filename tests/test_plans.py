"""Shape of the physical plans that matter at scale."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL


def plan(spark, name):
    df = entry.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "top_royalty_songs", "licensing_summary", "catalog_overview", "revenue_by_territory",
    "resolve_terms", "rate_limit", "song_features", "vector_topk", "vector_topk_lsh",
    "licensee_risk", "sql_royalty_split",
])
def test_no_pairwise_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["top_per_group", "rate_limit", "revenue_by_territory"])
def test_rank_filters_cut_rows_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_top_songs_is_a_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_royalty_songs")


def test_scans_read_needed_columns_only(spark):
    text = plan(spark, "volume_by_platform")
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("ReadSchema: struct<event_type:string,value:double>" in s for s in scans)


def test_filters_reach_the_scan(spark):
    scans = [part.split("PushedFilters: ")[1].split("]")[0] for part in plan(spark, "daily_volume").split("FileScan")[1:]]
    assert any("GreaterThanOrEqual(ts," in s for s in scans), scans


def test_a_term_cuts_plays_before_they_are_counted(spark):
    from royaltide.operators import lookups as L
    from royaltide.plans.common import Tables

    t = Tables(spark, SMALL)
    tree = L.get_platform_performance(t.songs, t.performance_logs, "red")._jdf.queryExecution().optimizedPlan().toString()
    # The first aggregate over the plays stands above the semi join.
    assert "LeftSemi" in tree
    lines = tree.splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    assert any("Aggregate [platform" in line or "Aggregate [event_type" in line for line in lines[:semi])

"""Answers, windows and tables that are kept up to date instead of made anew."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from royaltide.operators import features as X
from royaltide.operators import rolling as R
from royaltide.operators import textops as O
from royaltide.sources import partitioned as D
from royaltide.streaming.upsert import upsert_stream

from .conftest import rows

T = datetime.datetime


def files_of(spark, path, column):
    found = spark.read.parquet(path).select(column, F.input_file_name().alias("f")).distinct().collect()
    return {(r[column], r["f"]) for r in found}


# --- answers -------------------------------------------------------------------------


def test_ledger_asks_each_prompt_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def backend(prompts: pd.Series) -> pd.Series:
        asked.add(len(prompts))
        return prompts.str.len().astype(str)

    ledger = O.Ledger(str(tmp_path / "answers"), "v1")
    df = spark.createDataFrame([(i, f"t{i % 7}" if i else None) for i in range(30)], "id int, t string")

    def run(frame, ledger=ledger):
        return rows(O.generate(frame, F.col("t"), backend, ["id"], "a", ledger).select("id", "a"))

    want = [(i, "2" if i else None) for i in range(30)]
    assert run(df) == sorted(want, key=repr) and asked.value == 7
    assert run(df) == sorted(want, key=repr) and asked.value == 7
    more = df.union(spark.createDataFrame([(99, "longer")], "id int, t string"))
    assert (99, "6") in run(more) and asked.value == 8
    # Another version of the backend has answers of its own; the old ones stay.
    run(df, O.Ledger(ledger.path, "v2"))
    assert asked.value == 15 and run(more) and asked.value == 15
    assert run(df.limit(0)) == [] and asked.value == 15


def test_backends_label_extract_and_notify(spark, tmp_path):
    ledger = O.Ledger(str(tmp_path / "answers"), "v1")
    df = spark.createDataFrame([(1, "a happy song"), (2, "x"), (3, None), (4, "odd")], "id int, t string")
    answers = {"a happy song": " upbeat ", "x": "No idea", "odd": None}
    body = lambda p: p.str.split("\n", n=1).str[1]
    got = O.classify(df, "t", O.MOODS, "Chill", "mood", lambda p: body(p).map(answers), ["id"], ledger)
    assert rows(got.select("id", "mood")) == [(1, "Upbeat"), (2, "Chill"), (3, "Chill"), (4, "Chill")]
    reply = {"a happy song": '{"territory": " Europe ", "fee_amount": ""}', "x": "no json", "odd": "{}"}
    got = O.extract(df, "t", O.LICENSE_FIELDS, "e", lambda p: body(p).map(reply), ["id"], ledger)
    assert rows(got.select("id", "e.territory", "e.fee_amount")) == [(1, "Europe", None), (2, None, None), (3, None, None), (4, None, None)]
    assert got.columns == ["id", "t", "e"]
    writers = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "songwriter_id int, name string")
    paid = spark.createDataFrame([(1, "2024-Q1", "completed", 5.0), (2, "2024-Q1", "completed", 7.5)],
                                 "songwriter_id int, payment_period string, payment_status string, net_amount double")
    got = O.notifications(writers, paid, "2024-Q1", backend=lambda p: p.map(lambda x: "Hi Bo, 7.50" if "Name: Bo" in x and "$7.50" in x else None), ledger=ledger)
    told = {r["songwriter_id"]: r["notification"] for r in got.collect()}
    assert told[2] == "Hi Bo, 7.50" and told[1].startswith("Dear Ann")


def test_a_later_sentence_can_be_the_summary():
    text = "Weather was fine. Royalty payments fell, royalty rates stayed! Payments of royalty rates matter? End."
    assert O.key_sentence(text) == "Royalty payments fell, royalty rates stayed"
    assert O.key_sentence("One two. Three") == "Three" and O.key_sentence("a b. c d") == "a b"
    assert O.key_sentence(" ..!") == "" and O.key_sentence(None) is None
    long = "filler words everywhere. " * 20_000 + "filler filler everywhere everywhere"
    assert O.key_sentence(long) == "filler words everywhere" or O.key_sentence(long).startswith("filler")


# --- windows -------------------------------------------------------------------------


def test_a_window_moved_for_thirty_days_equals_the_whole_count(spark, tmp_path):
    rng = np.random.default_rng(41)
    start = T(2024, 1, 1)
    data = [(f"L{i}", int(s), start + datetime.timedelta(minutes=int(m))) for i, (s, m) in enumerate(
        zip(np.where(rng.random(4000) < 0.3, 7, rng.integers(0, 300, 4000)), rng.integers(0, 60 * 1440, 4000)))]
    plays = spark.createDataFrame(data, "log_id string, song_id int, play_timestamp timestamp").cache()
    songs = spark.range(310).select(F.col("id").cast("int").alias("song_id"))
    path, width = str(tmp_path / "daily"), 10
    R.store_days(plays, path)
    day = datetime.date(2024, 1, 20)
    counts = spark.createDataFrame(R.window_counts(spark, path, str(day), width).toPandas(), "song_id int, play_count_90d bigint")
    for n in range(30):
        before, day = day, day + datetime.timedelta(1)
        moved = R.advance(counts, path, str(before), str(day), width)
        if n == 0:
            plan = moved._jdf.queryExecution().executedPlan().toString()
            filters = [line for line in plan.split("PartitionFilters: ")[1:]]
            assert len(filters) == 2 and all("play_date" in f[:200] for f in filters)
        counts = spark.createDataFrame(moved.toPandas(), "song_id int, play_count_90d bigint")
        inside = [(s,) for _, s, ts in data if day - datetime.timedelta(width) <= ts.date() < day]
        want = pd.Series([s for (s,) in inside]).value_counts()
        assert {r[0]: r[1] for r in rows(counts)} == want.to_dict()
    until = plays.where(F.col("play_timestamp") < F.lit(str(day)).cast("timestamp"))
    assert rows(R.rolling_popularity(counts, songs)) == rows(X.popularity(until, songs, f"{day} 00:00:00", width))
    # A step longer than the window, and no step at all.
    far = R.advance(counts, path, str(day), "2024-03-15", width)
    assert rows(far) == rows(R.window_counts(spark, path, "2024-03-15", width))
    assert rows(R.advance(counts, path, str(day), str(day), width)) == rows(counts)
    with pytest.raises(ValueError):
        R.advance(counts, path, str(day), "2024-01-01", width)
    # A day that comes again replaces the stored one.
    R.store_days(plays.where("to_date(play_timestamp) = '2024-02-01'"), path)
    assert rows(R.window_counts(spark, path, str(day), width)) == rows(counts)


def test_plays_by_date_are_pruned(spark, tmp_path):
    path = str(tmp_path / "plays")
    data = [(f"L{i}", i % 5, T(2024, 1, 1 + i % 28, i % 24)) for i in range(300)]
    plays = spark.createDataFrame(data, "log_id string, song_id int, play_timestamp timestamp")
    D.write_plays(plays, path)
    recent = D.recent_plays(spark, path, "2024-01-28 12:00:00", 3)
    assert rows(recent.select("log_id")) == rows(plays.where("play_timestamp >= '2024-01-25 12:00:00'").select("log_id"))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(play_date" in plan
    asked = spark.createDataFrame([(datetime.date(2024, 1, 3),), (datetime.date(2024, 1, 9),)], "play_date date")
    found = D.plays_of_days(spark, path, asked)
    assert rows(found.select("log_id")) == rows(plays.where("to_date(play_timestamp) in ('2024-01-03', '2024-01-09')").select("log_id"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    before = files_of(spark, path, "play_date")
    D.write_plays(plays.where("to_date(play_timestamp) = '2024-01-03'"), path)
    after = files_of(spark, path, "play_date")
    assert {d for d, _ in before ^ after} == {datetime.date(2024, 1, 3)} and spark.read.parquet(path).count() == 300


# --- keyed tables --------------------------------------------------------------------


CHANGES = "k int, at int, v string, gone boolean"


def test_upserts_touch_few_partitions_and_may_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, 1, f"a{i}", False) for i in range(200)], CHANGES)
    assert D.upsert(spark, first, path, ["k"], ["at"], buckets=16) == list(range(16))
    before = files_of(spark, path, "bucket")
    # Late, double, deleting and new rows.
    second = spark.createDataFrame([(3, 3, "new", False), (3, 2, "old", False), (3, 3, "new", False), (4, 0, "late", False),
                                    (5, 2, None, True), (900, 1, "x", None)], CHANGES)
    touched = D.upsert(spark, second, path, ["k"], ["at"], buckets=16)
    after = files_of(spark, path, "bucket")
    assert len(touched) <= 4 and {b for b, _ in before ^ after} == set(touched)
    want = {i: f"a{i}" for i in range(200) if i != 5} | {3: "new", 900: "x"}
    assert {r["k"]: r["v"] for r in D.current(spark, path, "gone").collect()} == want
    # The same changes again, and an older row of the deleted key, change nothing.
    D.upsert(spark, second, path, ["k"], ["at"], buckets=16)
    D.upsert(spark, first.where("k = 5"), path, ["k"], ["at"], buckets=16)
    assert {r["k"]: r["v"] for r in D.current(spark, path, "gone").collect()} == want
    assert D.upsert(spark, first.limit(0), path, ["k"], ["at"], buckets=16) == []


def test_a_stream_of_changes_restarts_where_it_was(spark, tmp_path):
    source, path, offsets = (str(tmp_path / n) for n in ("in", "t", "offsets"))
    want = {}
    for part in range(3):
        data = [(i, part * 10 + i % 3, f"p{part}-{i}", False) for i in range(part * 20, part * 20 + 40)]
        spark.createDataFrame(data, CHANGES).repartition(2).write.mode("append").parquet(source)
        want |= {k: v for k, _, v, _ in data}
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
        upsert_stream(stream, path, offsets, ["k"], ["at"], buckets=8)
        assert {r["k"]: r["v"] for r in D.current(spark, path, "gone").collect()} == want
    before = files_of(spark, path, "bucket")
    upsert_stream(spark.readStream.schema(CHANGES).parquet(source), path, offsets, ["k"], ["at"], buckets=8)
    assert files_of(spark, path, "bucket") == before

import datetime
import json

from pyspark.sql import functions as F

from royaltide.functions.columns import derive_email, parse_partial_date
from royaltide.operators import records as R
from royaltide.sources import generate as N
from royaltide.sources.files import replace_table
from tests.conftest import rows

D = datetime.date


def test_partial_dates(spark):
    texts = ["1975", "1975-10", "1975-10-31", "1975-10-31T00", "197", "abcd-ef", None, "0000", "1975-13"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_partial_date("t")).collect()]
    day = D(1975, 10, 31)
    assert got == [D(1975, 1, 1), D(1975, 10, 1), day, day, None, None, None, None, None]


def test_derive_email(spark):
    names = ["O'Neil J. Smith", "Prince", "Anna Maria Lopez", "  Two  Words ", " "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(derive_email("n")).collect()]
    assert got == [
        "oneil.j@email.com", "prince@email.com", "anna.maria@email.com", "two.words@email.com", None,
    ]


def _record(**parts):
    return json.dumps(parts)


def _work(kind, *people):
    artists = [{"type": t, "artist": {"name": n}} for t, n in people]
    return {"type": kind, "work": {"id": "w", "artist-relation-list": artists}}


def test_normalise_records(spark):
    hit = [{"id": "r", "title": "T", "artist-credit-phrase": "A", "length": "61999"}]
    cases = [
        (0, _record(**{
            "recording-list": hit, "release-list": [{}, {"date": "99"}, {"date": "1999-05"}],
            "work-relation-list": [
                {"type": "performance"},
                _work("performance", ("composer", "X"), ("producer", "P"), ("lyricist", "X"), ("writer", "Y")),
                _work("performance", ("writer", "Z")),
            ]})),
        (1, _record(**{"recording-list": [{"id": "r"}], "length": "2500", "isrc-list": ["I1", "I2"]})),
        (2, _record(**{"recording-list": []})),
        (3, "no json"),
    ]
    df = spark.createDataFrame([(i, j, "seed title", "seed artist") for i, j in cases],
                               "k int, j string, st string, sa string")
    got = {r["k"]: r for r in R.normalise_records(df, "j", "st", "sa").collect()}
    assert got[0]["writers"] == ["X", "Y"] and got[0]["duration_seconds"] == 61
    assert got[0]["release_date"] == "1999-05" and got[0]["isrc"] is None
    assert (got[1]["title"], got[1]["artist"]) == ("seed title", "seed artist")
    assert got[1]["duration_seconds"] == 2 and got[1]["isrc"] == "I1" and got[1]["writers"] == []
    assert not got[2]["is_match"] and got[2]["title"] is None and not got[3]["is_match"]


def test_enrich_is_stable_and_falls_back(spark):
    seeds = spark.createDataFrame([(1, "s1", "a1", "Pop"), (2, "s2", "a2", "Rock")],
                                  "seed_id long, title string, artist string, genre string")
    records = spark.createDataFrame(
        [(1, True, "T1", "A1", ["W"], "", "bad", 0)],
        "seed_id long, is_match boolean, title string, artist string, writers array<string>, "
        "isrc string, release_date string, duration_seconds long")
    first = R.enrich_with_fallback(seeds, records, "2020-01-01")
    assert rows(first) == rows(R.enrich_with_fallback(seeds.repartition(3), records, "2020-01-01"))
    got = {r["seed_id"]: r for r in first.collect()}
    assert got[1]["title"] == "T1" and got[1]["is_matched"] and len(got[1]["isrc_code"]) == 12
    assert 150 <= got[1]["duration_seconds"] <= 360
    assert got[2]["writers"] == ["a2"] and not got[2]["is_matched"]
    assert D(1990, 1, 1) <= got[2]["release_date"] <= D(2020, 1, 1)
    assert rows(R.match_report(first)) == [(1, 1)]


def test_assign_ids_are_dense_and_alphabetical(spark):
    names = [f"name {i:04d}" for i in range(500)]
    df = spark.createDataFrame([(i, names[i : i + 3]) for i in range(0, 498)], "k int, l array<string>")
    got = sorted(tuple(r) for r in R.assign_ids(df, "l").collect())
    assert got == [(f"SW{i + 1:05d}", n) for i, n in enumerate(names)]


def test_map_list_keeps_order_and_skips_unknown(spark):
    df = spark.createDataFrame([(1, ["b", "x", "a"]), (2, ["x"])], "k int, l array<string>")
    dim = spark.createDataFrame([("SW1", "a"), ("SW2", "b")], "id string, name string")
    assert [(r["k"], r["ids"]) for r in R.map_list_to_ids(df, "l", dim, "k").collect()] == [(1, "SW2,SW1")]


def test_snapshot_diff_applied_to_old_gives_new(spark):
    schema = "k int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, None, 3), (4, "z", 4)], schema)
    new = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "v", 3), (5, "n", None)], schema)
    diff = R.snapshot_diff(old, new, ["k"], ["a", "b"])
    assert {(r["k"], r["change"]) for r in diff.collect()} == {
        (2, "update"), (3, "update"), (4, "delete"), (5, "insert")}
    assert rows(R.apply_diff(old, diff, ["k"])) == rows(new)
    assert R.snapshot_diff(new, new, ["k"], ["a", "b"]).count() == 0


def test_generators_do_not_depend_on_partitioning(spark):
    songs = spark.createDataFrame([(f"S{i}", [f"W{i}", f"V{i}"]) for i in range(9)],
                                  "song_id string, writers array<string>")
    a = N.gen_payments(spark, 2000, songs)
    b = N.gen_payments(spark, 2000, songs.repartition(5))
    assert rows(a) == rows(b)
    got = a.toPandas()
    assert set(got["song_id"]) == {f"S{i}" for i in range(9)}
    assert 0.75 < (got["payment_status"] == "completed").mean() < 0.85
    assert (got["payment_date"].isna() == (got["payment_status"] != "completed")).all()
    share = got["deductions"] / got["gross_amount"]
    assert share.min() > 0.099 and share.max() < 0.251
    fees = N.gen_licenses(spark, 2000, songs, "2025-01-01").groupBy("license_type").agg(
        F.min("fee_amount"), F.max("fee_amount"))
    for kind, low, high in fees.collect():
        assert N.LICENSE_FEES[kind][0] <= low <= high <= N.LICENSE_FEES[kind][1]


def test_replace_table_may_read_its_own_target(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(5), path)
    replace_table(spark.read.parquet(path).withColumn("twice", F.col("id") * 2), path)
    assert spark.read.parquet(path).agg(F.sum("twice")).first()[0] == 20
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_record_is_parsed_once_when_seeds_are_filled(spark):
    seeds = spark.createDataFrame([(1, "a", "x", "g"), (2, "b", "y", "g")], "seed_id long, title string, artist string, genre string")
    text = ('{"recording-list": [{"title": "T"}], "work-relation-list": [{"type": "performance", "work": '
            '{"artist-relation-list": [{"type": "writer", "artist": {"name": "W"}}]}}]}')
    raw = spark.createDataFrame([(1, "a", "x", text), (2, "b", "y", "{}")], "seed_id long, title string, artist string, record string")
    filled = R.enrich_with_fallback(seeds, R.normalise_records(raw, "record", "title", "artist"), "2020-01-01")
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert rows(filled.select("seed_id", "title", "artist_name", "writers", "is_matched")) == [
        (1, "T", "x", ["W"], True), (2, "b", "y", ["y"], False)]

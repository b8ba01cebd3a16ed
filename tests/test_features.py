import datetime
import random
import statistics

from pyspark.sql import functions as F

from royaltide.operators import features as X
from royaltide.operators import quality as Q
from royaltide.operators.ordering import exact_quantiles, running_weight, spread_join
from tests.conftest import rows

NOW = "2024-01-31 00:00:00"


def _plays(spark, items):
    base = datetime.datetime(2024, 1, 30)
    data = [(s, t, base - datetime.timedelta(days=d)) for s, t, d in items]
    return spark.createDataFrame(data, "song_id int, territory string, play_timestamp timestamp")


def _songs(spark, n):
    return spark.createDataFrame([(i, f"t{i}", "a", "g") for i in range(1, n + 1)],
                                 "song_id int, title string, artist_name string, genre string")


def _payments(spark, items):
    return spark.createDataFrame(items, "song_id int, net_amount double, payment_status string")


def test_popularity_edges(spark):
    songs = _songs(spark, 3)
    plays = _plays(spark, [(1, "US", 1)] * 4 + [(2, "US", 1)] * 2 + [(3, "US", 200)])
    assert rows(X.popularity(plays, songs, NOW)) == [(1, 4, 100.0), (2, 2, 0.0), (3, 0, 0.0)]
    equal = _plays(spark, [(1, "US", 1), (2, "US", 1)])
    assert {r[2] for r in X.popularity(equal, songs, NOW).collect()} == {0.0}
    none = _plays(spark, [(1, "US", 300)])
    assert {(r[1], r[2]) for r in X.popularity(none, songs, NOW).collect()} == {(0, 0.0)}


def test_concentration_edges(spark):
    plays = _plays(spark, [(1, "US", 1)] * 3 + [(2, t, 1) for t in ("US", "DE", "FR", "JP")])
    got = rows(X.concentration(plays, universe=_songs(spark, 3)))
    assert got == [(1, 1.0, 1), (2, 0.25, 4), (3, 1.0, 0)]


def test_licensee_risk_keeps_unlicensed_songs(spark):
    payments = _payments(spark, [(1, 1.0, "completed"), (1, 1.0, "disputed"), (2, 1.0, "pending"), (9, 1.0, "on_hold")])
    licenses = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (1, "B")], "song_id int, licensee_name string")
    got = {r["licensee_name"]: r for r in X.licensee_risk(payments, licenses).collect()}
    assert got["A"]["total_payments"] == 3 and got["A"]["licensee_risk_score"] == 0.5
    assert got["B"]["total_payments"] == 2 and got["B"]["licensee_risk_score"] == 0.5
    assert got[None]["licensee_risk_score"] == 1.0


def test_single_pass_features_equal_the_assembled_ones(spark):
    rng = random.Random(1)
    songs = _songs(spark, 12)
    plays = _plays(spark, [(rng.randint(1, 10), rng.choice(["US", "DE", "FR"]), rng.randint(1, 200)) for _ in range(300)])
    payments = _payments(spark, [(rng.randint(3, 12), rng.randint(1, 9999) / 100, "completed") for _ in range(200)])
    parts = X.assemble_features(
        songs, X.popularity(plays, songs, NOW), X.royalty_per_play(plays, payments),
        X.concentration(plays, universe=songs), NOW)
    whole = X.song_features(songs, plays, payments, NOW)
    assert rows(parts.select(sorted(parts.columns))) == rows(whole.select(sorted(whole.columns)))
    for r in whole.collect():
        assert 0 <= r["song_popularity_score"] <= 100
        assert 1 / max(r["num_territories"], 1) - 1e-4 <= r["territory_concentration"] <= 1


def test_exact_quantiles_with_a_dominant_value(spark):
    rng = random.Random(2)
    values = [0.0] * 700 + [rng.random() for _ in range(1300)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)], "g string, v double")
    got = {(r[0], r[1]): r[2] for r in exact_quantiles(df, "g", "v", [0.25, 0.5, 0.99]).collect()}
    cuts = statistics.quantiles(values, n=100, method="inclusive")
    for q in (0.25, 0.5, 0.99):
        assert abs(got["a", q] - cuts[int(q * 100) - 1]) < 1e-12 and got["b", q] == 5.0


def test_running_weight_over_many_slices(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 3)
    got = {r["id"]: r["_before"] for r in running_weight(df, ["id"], F.col("w"), partitions=7).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 3


def test_spread_join_with_a_hot_key(spark):
    facts = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id")))
    dims = spark.createDataFrame([(0, "hot"), (1, "one"), (0, "hot2")], "k long, name string")
    joined = spread_join(facts, dims, ["k"], ["id"])
    plain = facts.join(dims, "k", "left")
    assert rows(joined.select("id", "name")) == rows(plain.select("id", "name"))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (0.5,), (None,)], "v double")
    got = {r["bin"]: r["count"] for r in X.histogram(df, "v", 4).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2}
    flat = X.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 30).where("count > 0").collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(15, 3)]


def test_quality_rules(spark):
    data = [("SONG000001", 0, "US"), ("SONG00001", 3600, "XX"), ("SONG0000001", None, None), ("SONG123456", 3599, "SE")]
    df = spark.createDataFrame(data, "song_id string, duration_played int, territory string")
    flags = rows(Q.check_rows(df, Q.default_rules()).select("is_valid_song_id", "is_valid_duration", "is_valid_territory"))
    assert sorted(flags, key=repr) == sorted(
        [(True, False, True), (False, False, False), (False, None, None), (True, True, True)], key=repr)
    assert rows(Q.check_summary(df, Q.default_rules())) == [(4, 2, 1, 2)]

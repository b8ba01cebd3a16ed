import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from royaltide.operators import search as S
from royaltide.operators import textops as X
from tests.conftest import rows


def _vectors(spark, n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, dim))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    if copies:
        data[:copies] = data[0]
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")


def _brute(items, queries, k):
    scores = np.round(queries @ items.T, S.SCORE_DIGITS)
    out = []
    for q, line in enumerate(scores):
        order = sorted(range(len(line)), key=lambda i: (-line[i], i))[:k]
        out += [(q, i, r + 1) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block_queries", [1000, 3])
def test_topk_equals_brute_force_with_many_copies(spark, block_queries):
    items, index = _vectors(spark, 400, 16, 1, copies=150)
    wanted, queries = _vectors(spark, 12, 16, 2)
    wanted[0] = items[0]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wanted)], "query_id long, query_vector array<double>")
    got = S.vector_topk(index.repartition(5), queries, 7, block_queries=block_queries, shards=20)
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == _brute(items, wanted, 7)
    big = S.vector_topk(index, queries, 1000, block_queries=block_queries)
    assert big.count() == 12 * 400


def test_lsh_scores_are_exact_and_hot_buckets_are_whole(spark):
    items, index = _vectors(spark, 300, 16, 3, copies=120)
    queries = index.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = S.vector_topk_lsh(index, queries, 5, tables=8, bits=3, dim=16, bucket_rows=20).collect()
    assert all(abs(r["score"] - float(items[r["query_id"]] @ items[r["vec_id"]])) < 1e-8 for r in got)
    copies = sorted(r["vec_id"] for r in got if r["query_id"] == 50)
    assert copies == [0, 1, 2, 3, 4]  # all copies met; ties go to the smaller id


def test_similar_to_leaves_the_item_out(spark):
    _, index = _vectors(spark, 30, 8, 4)
    got = S.similar_to(index, F.col("vec_id") == 3, 50)
    assert got.count() == 29 and got.where("vec_id = 3").count() == 0


def test_compose_drops_null_segments_and_cuts_minutes(spark):
    df = spark.createDataFrame([("T", None, 119), ("U", "Pop", 60)], "title string, genre string, s long")
    spec = [("Title", F.col("title")), ("Genre", F.col("genre")),
            ("Duration", F.concat((F.col("s") / 60).cast("int").cast("string"), F.lit(" minutes")))]
    assert sorted(r["metadata_text"] for r in S.compose_text(df, spec).collect()) == [
        "Title: T | Duration: 1 minutes", "Title: U | Genre: Pop | Duration: 1 minutes"]


def test_embed_is_unit_length_and_takes_a_backend(spark):
    df = spark.createDataFrame([(1, "Red red, blue!"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["embedding"] for r in S.embed(df, "t", 32).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-12 and sum(got[2]) == 0 == sum(got[3])
    plugged = S.embed(df, "t", backend=lambda texts: [[1.0, 2.0]] * len(texts))
    assert all(r["embedding"] == [1.0, 2.0] for r in plugged.collect())


def test_attach_writers_trims_ids(spark):
    songs = spark.createDataFrame([(1, "W2, W1"), (2, "W9")], "song_id int, songwriters string")
    writers = spark.createDataFrame([("W1", "Bo", "X"), ("W2", "Al", "X")], "songwriter_id string, name string, pro_affiliation string")
    got = rows(S.attach_writers(songs, writers).select("song_id", "songwriter_names", "pro_affiliations"))
    assert got == [(1, "Al, Bo", "X"), (2, "", "")]


def test_classify_ties_and_default(spark):
    df = spark.createDataFrame([("a b",), ("b",), ("zzz",), (None,)], "t string")
    got = [r["label"] for r in X.classify(df, "t", {"first": ["a"], "second": ["b"]}, "none").collect()]
    assert got == ["first", "second", "none", "none"]


MAILS = [
    ("positive", "Thank you for the quick resolution. We appreciate the flexibility."),
    ("negative", "We are extremely disappointed. The penalties seem excessive."),
    ("neutral", "Following up on the statement. Please advise on a time."),
    ("escalation", "URGENT: the system has been down for hours and we may miss the deadline."),
]


def test_triage_keeps_urgent_mail(spark):
    df = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(MAILS)], "id int, body string")
    got = {r["id"]: r for r in X.triage(df, "body").collect()}
    assert {i: r["sentiment"] for i, r in got.items()} == {1: "negative", 3: "escalation"}
    assert got[1]["issue_summary"] == "[negative] We are extremely disappointed"
    plugged = X.triage(df, "body", backend=lambda p: p.str.len().astype(str), spread_by=["id"])
    assert plugged.count() == 2 and all(r["issue_summary"].isdigit() for r in plugged.collect())


def test_extract_license_fields(spark):
    text = ("This License Agreement is entered into as of January 15, 2025, by and between A and "
            "Spotted USA Inc. The fee is $50,000.00 USD for the territory of United States and Canada.")
    df = spark.createDataFrame([(text,), ("nothing here",)], "t string")
    got = [r["extracted"] for r in X.extract(df, "t", X.LICENSE_FIELDS).collect()]
    assert got[0]["fee_amount"] == "$50,000.00" and got[0]["effective_date"] == "January 15, 2025"
    assert got[0]["territory"] == "United States and Canada"
    assert all(v is None for v in got[1])


def test_generate_asks_once_per_prompt(spark):
    df = spark.range(300).withColumn("t", F.when(F.col("id") % 3 == 0, "same. x").otherwise(F.concat(F.lit("n"), "id")))
    sizes = []

    def backend(prompts: pd.Series) -> pd.Series:
        assert prompts.is_unique
        return prompts.str.upper()

    got = X.generate(df, F.col("t"), backend, spread_by=["id"])
    assert got.count() == 300 and got.where(F.col("generated") != F.upper("t")).count() == 0
    assert not sizes


def test_sync_embeds_changed_rows_only(spark):
    schema = "k int, t string"
    index = S.embed(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema), "t", 16)
    source = spark.createDataFrame([(1, "a"), (2, "bb"), (4, "d")], schema)
    marked = S.sync_index(index, source, "k", ["t"], "t", backend=lambda texts: [[9.0]] * len(texts))
    got = {r["k"]: (r["t"], r["embedding"] == [9.0]) for r in marked.collect()}
    assert got == {1: ("a", False), 2: ("bb", True), 4: ("d", True)}


def test_items_stay_where_they_are_for_one_block_of_queries(spark):
    _, index = _vectors(spark, 60, 8, 5)
    queries = index.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plan = S.vector_topk(index, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan


def test_other_columns_of_a_song_move_once(spark):
    songs = spark.createDataFrame([(1, "x", "7,8"), (1, "x", "7,8"), (2, "y", "7"), (3, "z", None)], "song_id int, title string, songwriters string")
    writers = spark.createDataFrame([(7, "B", "P"), (8, "A", "P")], "songwriter_id int, name string, pro_affiliation string")
    out = S.attach_writers(songs, writers)
    assert rows(out) == [(1, "x", "7,8", "A, A, B, B", "P"), (2, "y", "7", "B", "P")]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("title" in line for line in text.split("\n") if "Generate " in line)

"""The vector queries ask for the neighbours of every row of the table."""

import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    x = np.random.default_rng(5).normal(size=(60, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    path = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i + 1, [float(v) for v in x[i]], i % 3) for i in range(len(x))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_every_row_is_a_query_of_the_exact_search(spark, folder):
    found = entry.queries()["vector_topk"](spark, folder).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {i: 10 for i in range(1, 61)}
    assert "% 50" not in entry.oracle_sql()["vector_topk"]


def test_every_row_is_a_query_of_the_coded_search(spark, folder):
    found = entry.queries()["vector_codes_recall"](spark, folder).collect()
    assert [(r["queries"], r["expected"]) for r in found] == [(60, 600)]
    assert "% 50" not in entry.oracle_sql()["vector_codes_recall"]

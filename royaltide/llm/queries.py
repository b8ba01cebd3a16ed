"""Registered queries of the training-data operators, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from royaltide.llm import (
    contexttree, conversations, decontam, graph, negatives, pieces, pii, quality, secrets, simhash, suffixes, toxicity, vectors,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        _QUERIES[name] = build
        if check is not None:
            _CHECKS[name] = check
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def checks() -> dict[str, str]:
    return dict(_CHECKS)


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark items."""
    found = decontam.find_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op5_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.detect(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_vectors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_contexttree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return contexttree.score(table(spark, sf_dir, "documents"), running=True)


@query("op10_suffixes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeated byte strings are removed."""
    found = suffixes.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every 20th embedding."""
    return graph.nearest(table(spark, sf_dir, "embeddings"))


@query("op12_conversations")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    found = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(found), found.select("conv_id"))


_HARD_NEGATIVES = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), score AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.c, b.c)]) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.c) = len(b.c)
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM score WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN score USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_negatives", _HARD_NEGATIVES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding."""
    rows = negatives.prepare(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 50 == 0)

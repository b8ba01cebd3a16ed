"""Global order without a single-task window, and skew-proof joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from royaltide.session import durable


def running_weight(
    df: DataFrame,
    order: Sequence[str],
    weight: Column | None = None,
    name: str = "_before",
    partitions: int | None = None,
) -> DataFrame:
    """Add the total weight of all rows that sort strictly ahead of each row.

    Range-partitions by ``order``, sums inside each slice and shifts every slice
    by the total of the slices before it. Only one row per slice ever meets in
    one task. Range bounds are sampled, so the sliced rows are made durable
    first; both later passes then see the same slices. Callers reduce repeated
    values to one weighted row beforehand, so that no value can fill a slice.
    """
    spark = df.sparkSession
    slices = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    weight = F.lit(1).cast("bigint") if weight is None else weight
    placed = durable(
        df.withColumn("_weight", weight)
        .repartitionByRange(slices, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    # One row per slice: the unpartitioned window is bounded by the slice count.
    per_slice = placed.groupBy("_slice").agg(F.sum("_weight").alias("_slice_weight"))
    offsets = per_slice.select(
        "_slice",
        (F.sum("_slice_weight").over(W.orderBy("_slice")) - F.col("_slice_weight")).alias("_offset"),
    )
    inside = F.sum("_weight").over(
        W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("_inside", F.coalesce(inside, F.lit(0)))
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_slice", "_weight", "_offset", "_inside")
    )


def exact_quantiles(
    df: DataFrame, group: str, value: str, quantiles: Sequence[float]
) -> DataFrame:
    """Interpolated quantiles per group: ``(group, quantile, value)``.

    Repeated values collapse into one weighted row during the map-side combine.
    The ranks come from :func:`running_weight`, so a group is never gathered in
    one task however many rows or values it has. ``group`` holds names the caller
    lists (such as feature names), which bounds the broadcast of their totals.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_weight(counts, [group, value], F.col("_n"))
    ends = ranked.groupBy(group).agg(
        F.min("_before").alias("_start"), F.sum("_n").alias("_total")
    )
    targets = (
        ends.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("_position", F.col("quantile") * (F.col("_total") - 1))
        .withColumn("_low", F.floor("_position"))
        .withColumn("_high", F.ceil("_position"))
    )
    first, last = F.col("_before") - F.col("_start"), F.col("_before") - F.col("_start") + F.col("_n")

    def holds(rank: str) -> Column:
        return (first <= F.col(rank)) & (F.col(rank) < last)

    hits = (
        ranked.join(F.broadcast(targets), group)
        .where(holds("_low") | holds("_high"))
        .groupBy(group, "quantile", "_position", "_low")
        .agg(
            F.max(F.when(holds("_low"), F.col(value))).alias("_a"),
            F.max(F.when(holds("_high"), F.col(value))).alias("_b"),
        )
    )
    step = F.col("_position") - F.col("_low")
    return hits.select(
        group,
        "quantile",
        (F.col("_a") + (F.col("_b") - F.col("_a")) * step).cast("double").alias(value),
    )


def spread_join(
    facts: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    salts: int = 32,
    hot_fraction: float = 1 / 256,
) -> DataFrame:
    """Equi-join that keeps a hot key of ``facts`` from filling one task.

    A key is hot when it holds more than ``hot_fraction`` of all rows, so there
    are at most ``1 / hot_fraction`` of them and their list is safe to
    broadcast. Rows of a hot key are spread over ``salts`` by a hash of
    ``spread_by`` (columns that tell the rows apart); the matching rows of
    ``keyed`` are repeated once per salt.
    """
    on = list(on)
    if how not in ("inner", "left"):
        raise ValueError("spread_join supports inner and left")
    sizes = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    # From the same reduced rows, so the facts are counted once.
    total = sizes.agg(F.sum("_rows")).scalar()
    hot = sizes.where(F.col("_rows") > total * F.lit(hot_fraction)).select(
        *on, F.lit(True).alias("_hot")
    )
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    # A NULL key matches nothing, so its rows may go anywhere.
    keyless = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    left = (
        facts.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot") | keyless, salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = keyed.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")

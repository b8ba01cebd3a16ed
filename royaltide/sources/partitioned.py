"""Tables in date or hash partitions: pruned reads, and rewrites of touched partitions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from royaltide.session import durable

ROWS_PER_FILE = 2_000_000


def overwrite_partitions(df: DataFrame, path: str, column: str, spread_by: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Replace the partitions that ``df`` has rows of and leave all others as they are.

    A large partition is dealt over several tasks by a hash of ``spread_by``. ``df`` may be
    derived from the table itself only if it has been made durable before.
    """
    # One row per partition value of this write.
    files = df.groupBy(column).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    dealt = df.join(F.broadcast(files), df[column].eqNullSafe(files[column])).drop(files[column])
    dealt = dealt.withColumn("_file", F.pmod(F.xxhash64(*spread_by), F.col("_files")))
    (dealt.repartition(column, "_file").drop("_files", "_file").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def drop_partitions(spark: SparkSession, path: str, column: str, values: Sequence) -> None:
    """Remove whole partitions."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for value in values:
        files.delete(hadoop(f"{path}/{column}={value}"), True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


# --- plays by date ---------------------------------------------------------------------


def write_plays(plays: DataFrame, path: str, time_col: str = "play_timestamp", spread_by: Sequence[str] = ("log_id",)) -> None:
    """Store plays by date. Writing a day again replaces it, so a load can be repeated."""
    overwrite_partitions(plays.withColumn("play_date", F.to_date(time_col)), path, "play_date", spread_by)


def recent_plays(spark: SparkSession, path: str, as_of: str, days: int, time_col: str = "play_timestamp") -> DataFrame:
    """Plays since exactly ``days`` days before ``as_of``; earlier dates are not read."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    plays = spark.read.parquet(path)
    return plays.where((F.col("play_date") >= F.to_date(start)) & (F.col(time_col) >= start))


def plays_of_days(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """Plays of the dates in ``days(play_date)``, known only when the query runs.

    The list of dates is small (a row per date) and is broadcast, so Spark prunes the
    other partitions at run time.
    """
    wanted = days.where(F.col("play_date") >= F.lit("0001-01-01").cast("date")).select("play_date").distinct()
    plays = spark.read.parquet(path)
    return plays.join(F.broadcast(wanted), "play_date")


# --- rows by key -----------------------------------------------------------------------


def upsert(spark: SparkSession, changes: DataFrame, path: str, key: Sequence[str], order: Sequence[str],
           buckets: int = 64) -> list[int]:
    """Bring a table of one row per key up to date and return the rewritten hash partitions.

    Of several rows of a key the one with the largest ``order`` wins, whether it is stored or new, so
    changes may come late, twice or out of order. Deletions are rows with a mark of their own and stay in the table,
    so that an older change of the key cannot bring it back; :func:`current` leaves them out.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    names = list(changes.columns)
    stored_cols = [c for c in names if c not in key]

    def newest(df: DataFrame) -> DataFrame:
        rank = F.struct(*order, *sorted(c for c in stored_cols if c not in order))
        row = F.max(F.struct(rank.alias("_rank"), F.struct(*stored_cols).alias("_row"))).alias("_top")
        return df.groupBy("bucket", *key).agg(row).select("bucket", *key, "_top._row.*").select("bucket", *names)

    arrived = durable(newest(changes.withColumn("bucket", bucket)))
    # At most ``buckets`` numbers.
    touched = sorted(r["bucket"] for r in arrived.select("bucket").distinct().collect())
    if not touched:
        return []
    if exists(spark, path):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select("bucket", *names)
        arrived = durable(newest(old.unionByName(arrived)))
    overwrite_partitions(arrived, path, "bucket", key)
    spark.catalog.refreshByPath(path)
    return touched


def current(spark: SparkSession, path: str, deleted: str | None = None) -> DataFrame:
    """Rows of a table kept by :func:`upsert`, without the deleted ones."""
    table = spark.read.parquet(path).drop("bucket")
    return table if deleted is None else table.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)

"""Batch sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a parquet table, schema included, without a half-written state.

    The new data is written beside the old and swapped in by two renames, so a
    reader never sees a partial table and ``df`` may read ``path`` itself. A
    failed job leaves the old table untouched.
    """
    spark = df.sparkSession
    base = path.rstrip("/")
    tag = uuid.uuid4().hex
    fresh, retired = f"{base}.new-{tag}", f"{base}.old-{tag}"
    df.write.mode("errorifexists").parquet(fresh)
    target = _path(spark, base)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had_old = files.exists(target)
    if had_old and not files.rename(target, _path(spark, retired)):
        raise OSError(f"cannot set {base} aside")
    if not files.rename(_path(spark, fresh), target):
        if had_old:
            files.rename(_path(spark, retired), target)
        raise OSError(f"cannot move the new data to {base}")
    if had_old:
        files.delete(_path(spark, retired), True)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per line, many part files."""
    df.write.mode("overwrite").json(path)

"""Incremental CSV ingestion: every file once, typed, with schema evolution."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_COLUMNS = ("_ingested_at", "_source_file")


# --- stored schemas ---------------------------------------------------------------


def load_schema(spark: SparkSession, schema_dir: str) -> tuple[int, T.StructType | None]:
    """Newest stored version, or ``(0, None)``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(schema_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0, None
    stored = spark.read.schema("version int, fields string").json(schema_dir)
    newest = stored.orderBy(F.desc("version")).first()
    if newest is None:
        return 0, None
    return newest["version"], T.StructType.fromJson(json.loads(newest["fields"]))


def save_schema(spark: SparkSession, schema_dir: str, version: int, schema: T.StructType) -> None:
    row = spark.createDataFrame([(version, schema.json())], "version int, fields string")
    row.coalesce(1).write.mode("append").json(schema_dir)


# --- headers -------------------------------------------------------------------------


def _layouts(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """Distinct header layouts and the files that have each.

    The first line of each file is found by a map-side combine; what reaches the
    driver is a file listing, as in any file source.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"),
    )
    found = (
        lines.where(F.col("at") == 0).groupBy("path").agg(F.min_by("value", "place").alias("header"))
    )
    grouped: dict[tuple[str, ...], list[str]] = {}
    for row in found.collect():
        names = tuple(next(csv.reader([row["header"].lstrip("﻿")])))
        grouped.setdefault(names, []).append(row["path"])
    return [(list(names), sorted(files)) for names, files in sorted(grouped.items())]


def _inferred(spark: SparkSession, files: Sequence[str], names: Sequence[str]) -> T.StructType:
    """Column types of files that share one header; whole numbers become long."""
    found = spark.read.option("header", True).option("inferSchema", True).csv(list(files)).schema
    wide = {"int": T.LongType(), "bigint": T.LongType()}
    fields = []
    for name, field in zip(names, found.fields):
        kind = wide.get(field.dataType.simpleString(), field.dataType)
        if isinstance(kind, T.DecimalType) or isinstance(kind, T.NullType):
            kind = T.StringType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def evolve_schema(
    spark: SparkSession, folder: str | Sequence[str], schema_dir: str
) -> T.StructType:
    """Stored schema plus any column that files of ``folder`` add; saved if it grew.

    Known columns keep their type, new ones go to the end.
    """
    version, schema = load_schema(spark, schema_dir)
    known = list(schema.fields) if schema else []
    start = len(known)
    for names, files in sorted(_layouts(spark, folder), key=lambda x: len(x[0])):
        missing = [n for n in names if n not in {f.name for f in known}]
        if missing:
            types = {f.name: f for f in _inferred(spark, files, names)}
            known.extend(types[n] for n in missing)
    grown = T.StructType(known)
    if len(known) > start:
        save_schema(spark, schema_dir, version + 1, grown)
    return grown


# --- streams -------------------------------------------------------------------------


def csv_stream(
    spark: SparkSession, folder: str, schema_dir: str, max_files: int | None = None
) -> DataFrame:
    """Stream of the CSV files of a folder, each read once, with the stored schema.

    The schema is inferred and stored on the first call. Columns are matched by
    position, so newer files may only append columns; call
    :func:`evolve_schema` between runs to pick those up, or use
    :func:`ingest_evolving`, which matches by name.
    """
    _, schema = load_schema(spark, schema_dir)
    if schema is None:
        schema = evolve_schema(spark, folder, schema_dir)
    reader = spark.readStream.format("csv").schema(schema).option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def with_audit(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Add when and from which file each row came."""
    when = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return df.withColumns({"_ingested_at": when, "_source_file": F.col("_metadata.file_path")})


def drain_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to a parquet table, then stop.

    Offsets and the sink log make a restart exactly-once.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def _typed(df: DataFrame, names: Sequence[str], schema: T.StructType) -> DataFrame:
    """Text columns cast to the stored types; a value that does not fit is kept as text."""
    present = set(names)

    def cast(field: T.StructField) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name)

    def misfit(field: T.StructField) -> Column:
        raw = F.col(f"`{field.name}`")
        lost = raw.isNotNull() & raw.try_cast(field.dataType).isNull()
        return F.when(lost, F.struct(F.lit(field.name).alias("column"), raw.alias("text")))

    checked = [f for f in schema if f.name in present and not isinstance(f.dataType, T.StringType)]
    misfits = F.array_compact(F.array(*[misfit(f) for f in checked])) if checked else F.array()
    kind = "array<struct<column: string, text: string>>"
    return df.select(
        *[cast(f) for f in schema],
        *[c for c in AUDIT_COLUMNS],
        F.when(F.size(misfits) > 0, misfits.cast(kind)).cast(kind).alias("_rescued"),
    )


def ingest_evolving(
    spark: SparkSession,
    folder: str,
    path: str,
    schema_dir: str,
    checkpoint: str,
    as_of: str | None = None,
    max_files: int = 1000,
) -> None:
    """Append new CSV files to a table whose schema grows with them.

    A stream of file names (contents are not read) decides which files are new.
    Each batch evolves the stored schema, reads its files layout by layout with
    columns matched by name, and replaces its own batch folder, so a replayed
    batch leaves no duplicates. Read the table with :func:`read_evolving`.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select("path")
    )

    def absorb(batch: DataFrame, epoch: int) -> None:
        files = [row["path"] for row in batch.collect()]
        if not files:
            return
        schema = evolve_schema(spark, files, schema_dir)
        written = "overwrite"
        for columns, group in _layouts(spark, files):
            text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
            rows = with_audit(spark.read.schema(text).option("header", True).csv(group), as_of)
            _typed(rows, columns, schema).write.mode(written).parquet(f"{path}/_batch={epoch}")
            written = "append"

    query = (
        names.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """Table written by :func:`ingest_evolving`; older rows have NULL in newer columns."""
    return spark.read.option("mergeSchema", True).parquet(path)

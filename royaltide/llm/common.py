"""Shared pieces: batched text maps, training split, span digests, scratch tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_CHARS = 2_000_000


def q(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, renamed, so that no other column of the caller can clash."""
    return df.select(*[q(source).alias(target) for target, source in columns.items()])


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``; a null text is the empty text."""
    return docs.select(
        q(id_col).cast("bigint").alias("doc_id"), F.coalesce(q(text_col), F.lit("")).alias("text")
    )


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``SLICE_CHARS`` of text, one document at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + (size or 0) > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if start < len(sizes):
            yield batch.slice(start)


def arrow_schema(spec: str | T.StructType) -> tuple[T.StructType, pa.Schema]:
    struct = T.StructType.fromDDL(spec) if isinstance(spec, str) else spec
    return struct, to_arrow_schema(struct)


def map_slices(
    df: DataFrame, make: Callable[[], Callable], spec: str, column: str = "text"
) -> DataFrame:
    """Apply ``make()`` once per task; its result turns each slice into columns.

    ``make`` runs in the task (to open broadcast models); the function it returns
    takes a RecordBatch of bounded size and returns a list of columns in the
    order of ``spec``.
    """
    struct, schema = arrow_schema(spec)

    def run(batches):
        work = make()
        for piece in slices(batches, column):
            columns = work(piece)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                 for c, f in zip(columns, schema)],
                schema=schema,
            )

    return df.mapInArrow(run, struct)


def gather_slices(
    df: DataFrame, make: Callable[[], tuple[Callable, Callable]], spec: str, column: str = "text"
) -> DataFrame:
    """Like :func:`map_slices`, but the task keeps bounded totals and emits them at its end."""
    struct, schema = arrow_schema(spec)

    def run(batches):
        add, finish = make()
        for piece in slices(batches, column):
            add(piece)
        arrays = [pa.array(c, type=f.type) for c, f in zip(finish(), schema)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, struct)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows of a sorted partition that end between groups, and the first row of each group."""
    held: list[pa.Table] = []
    count = 0

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for key in keys:
            column = table.column(key)
            change |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
        return np.r_[0, np.flatnonzero(change) + 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= rows:
            table = pa.concat_tables(held).combine_chunks()
            edges = starts(table)
            held = [table.slice(int(edges[-1]))]
            count = held[0].num_rows
            if len(edges) > 1:
                yield table.slice(0, int(edges[-1])), edges[:-1]
    if count:
        table = pa.concat_tables(held).combine_chunks()
        yield table, starts(table)


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def span_text(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(
    labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", fold: int = 5
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled training ids of each class, and the class sizes.

    The sample is what a classifier is fitted on; the bound is the caller's
    documented parameter. Ids whose remainder is 0 are never taken. The smallest
    hashes win, so the sample does not depend on partitioning.
    """
    rows = (
        labels.select(q(id_col).cast("bigint").alias("doc_id"), q(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(remainder(F.col("doc_id"), fold) != 0)
        .dropDuplicates(["doc_id"])
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [
        rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for k in (0, 1)
    ]
    taken = [r for part in parts for r in part.collect()]
    frame = labels.sparkSession.createDataFrame(
        [(r["doc_id"], r["label"]) for r in taken], "doc_id bigint, label int"
    )
    return frame, sizes

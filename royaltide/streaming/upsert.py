"""A keyed table kept up to date from a stream of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from royaltide.sources.partitioned import upsert


def upsert_stream(
    changes: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: Sequence[str], buckets: int = 64,
) -> None:
    """Apply all changes that are there, then stop.

    A micro-batch rewrites only the hash partitions of its keys. A batch that is run again after a
    failure finds its own rows and changes nothing, because the largest ``order`` of a key wins.
    """
    def apply(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, batch, path, key, order, buckets)

    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

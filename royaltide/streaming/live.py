"""Continuous forms of the usage report and the rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from royaltide.functions.columns import percent
from royaltide.operators.guardrails import RateLimit
from royaltide.operators.sketches import users_sketch

#: Setting that keeps streaming state in RocksDB, outside the heap.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass",
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HOUR = 3600
#: Hour and window of a request without a time.
NO_TIME = -(1 << 40)


def live_usage(stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Requests, errors and users per tumbling window of a request stream.

    In append mode a window appears once the watermark has passed its end; rows
    that arrive after that are dropped. Users are counted by a mergeable sketch, because
    streams allow no exact distinct count; :func:`royaltide.operators.sketches.rolled_usage`
    unites the sketches of the windows to those of days without reading requests again.
    """
    total, failed = F.count(F.lit(1)), F.count_if(F.col("status_code") != 200)
    return (
        stream.withWatermark("request_time", watermark)
        .groupBy(F.window("request_time", window).alias("_w"))
        .agg(
            total.alias("total_requests"),
            (total - failed).alias("successful_requests"),
            failed.alias("error_count"),
            percent(failed, total).alias("error_rate_pct"),
            users_sketch("requester").alias("users"),
        )
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "*")
        .drop("_w")
        .withColumn("approx_users", F.hll_sketch_estimate("users"))
    )


class _Admit(StatefulProcessor):
    """Admits the first ``calls`` rows of each (key, window) of a group.

    A group holds many keys for one hour, and its state is one value: the rows admitted so far of every window of
    a key in that hour. It is read and written once a batch, so that calls to the state store grow with groups and
    not with windows. A timer at the end of the hour removes it once the watermark is past. Inside a batch the
    earliest rows are admitted; only as many as are still allowed are held back while the rows pass by.
    """

    def __init__(self, calls: int, time_col: str, id_col: str, final: bool):
        self.calls, self.time_col, self.id_col, self.final = calls, time_col, id_col, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "keys array<string>, windows array<bigint>, counts array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.final and key[2] > 0:
            # Refused before; such rows come dealt out and need no state.
            for batch in rows:
                if not batch.empty:
                    yield self._out(batch.assign(admitted=False), 0)
            return
        state = self.used.get()
        used = {} if state is None else dict(zip(zip(state[0], state[1]), state[2]))
        held = None
        for batch in rows:
            if batch.empty:
                continue
            found = batch if held is None else pd.concat([held, batch])
            found = found.sort_values([self.time_col, self.id_col], kind="stable")
            before = np.array([used.get(w, 0) for w in self._windows(found)])
            admitted = found.groupby(["key_text", "window_number"], dropna=False).cumcount().to_numpy() + before < self.calls
            held, refused = found[admitted], found[~admitted]
            if len(refused):
                yield self._out(refused.assign(admitted=False), 1)
        if held is not None and len(held):
            for entry in self._windows(held):
                used[entry] = used.get(entry, 0) + 1
            self.used.update(([k for k, _ in used], [w for _, w in used], list(used.values())))
            if key[0] != NO_TIME:
                self.handle.registerTimer((key[0] + 1) * HOUR * 1000)
            yield self._out(held.assign(admitted=True), 0)

    def _windows(self, rows: pd.DataFrame) -> list[tuple]:
        return list(zip(rows["key_text"].tolist(), rows["window_number"].tolist()))

    def _out(self, rows: pd.DataFrame, refused: int) -> pd.DataFrame:
        """Refused rows keep their part, counted from 1, so that they stay dealt out; others go to part 0."""
        if self.final:
            return rows.drop(columns=["key_text", "window_number", "hour_number", "group_number", "part_number"])
        return rows.assign(part_number=(rows["part_number"] + 1) * refused)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(
    stream: DataFrame,
    limit: RateLimit,
    time_col: str = "request_time",
    id_col: str = "client_request_id",
    watermark: str = "10 minutes",
    spread: int = 8,
    groups: int = 4,
) -> DataFrame:
    """Admit or throttle the requests of a stream under one fixed-window limit.

    The keys of an hour are dealt to ``groups`` by a hash, and the requests of a key to ``spread`` parts of its
    group by a hash of their id. Each part lets through
    the first ``calls`` of a window, which no other part's rows can make fewer; only those, at most
    ``spread * calls`` rows a window, meet in one part that decides. A busy window so never
    passes one task, and the refused rows stay dealt out. The state of both steps is a counter per
    window, one value a part, and is removed by a timer when the watermark passes its hour. The result
    equals the batch operator when requests arrive in order. Needs the RocksDB state store
    (:data:`ROCKSDB`).
    """
    seconds = {"MINUTE": 60, "HOUR": HOUR}[limit.period]
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"`{id_col}` {fields[id_col]}, `{limit.key}` {fields[limit.key]}, `{time_col}` timestamp, admitted boolean"
    number = F.floor(F.unix_seconds(F.date_trunc(limit.period, time_col)) / seconds)
    dealt = (
        stream.select(id_col, limit.key, F.col(time_col).cast("timestamp").alias(time_col))
        .withWatermark(time_col, watermark)
        .withColumn("key_text", F.col(limit.key).cast("string"))
        .withColumn("window_number", F.coalesce(number, F.lit(NO_TIME)))
        .withColumn("hour_number", F.coalesce(F.floor(F.unix_seconds(time_col) / HOUR), F.lit(NO_TIME)))
        .withColumn("group_number", F.pmod(F.xxhash64(limit.key), F.lit(groups)).cast("int"))
        .withColumn("part_number", F.pmod(F.xxhash64(id_col), F.lit(spread)).cast("int"))
    )

    def step(rows: DataFrame, final: bool) -> DataFrame:
        spec = out if final else out + ", key_text string, window_number bigint, hour_number bigint, group_number int, part_number int"
        processor = _Admit(limit.calls, time_col, id_col, final)
        return rows.groupBy("hour_number", "group_number", "part_number").transformWithStateInPandas(
            processor, spec, "append", "eventTime", eventTimeColumnName="" if final else time_col)

    return step(step(dealt, False).drop("admitted"), True)

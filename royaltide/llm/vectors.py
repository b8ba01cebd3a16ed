"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Equal vectors of a label become one class with a size. Each class is hashed in
``tables`` tables by ``width``-quantised random projections of its unit vector. Buckets
with one class are dropped before any vector moves; others are cut into
chunks of about ``chunk`` classes, and every pair of chunks is one group. A task walks its sorted
partition: small buckets are multiplied many at a time, large ones in matrix blocks. A pair counts in the first table that it shares, so a task emits
one count per class and the edges of a spanning forest, never all pairs.

Defined cases: null, empty, zero or non-finite vectors, null labels and null ids link with
nothing (own component, null for a null id); vectors of different length never link;
repeated ids are repeated rows of one vector each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import pick, stored, whole_groups
from royaltide.llm.components import connected_components

#: Buckets of up to so many classes are compared many at a time.
SMALL = 64


def signatures(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit bucket number per row and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    planes = rng.normal(size=(unit.shape[1], tables * hashes))
    shift = rng.uniform(0, width, tables * hashes)
    mix = rng.integers(1, 2**62, tables * hashes, dtype=np.int64) | 1
    cells = np.floor((unit @ planes + shift) / width).astype(np.int64)
    with np.errstate(over="ignore"):
        return (cells * mix).reshape(len(unit), tables, hashes).sum(2)


def unit_rows(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the links of a block connect."""
    edges = []
    left = near.any(1)
    while left.any():
        rows = np.zeros_like(left)
        rows[left.argmax()] = True
        fresh, columns = rows.copy(), np.zeros(near.shape[1], dtype=bool)
        while fresh.any():
            reach = near[fresh]
            new = reach.any(0) & ~columns
            owner = np.flatnonzero(fresh)[reach[:, new].argmax(0)]
            edges += zip(owner.tolist(), np.flatnonzero(new).tolist())
            columns |= new
            hit = near[:, new].any(1) & left & ~rows
            where = np.flatnonzero(new)[near[np.ix_(hit, new)].argmax(1)] if hit.any() else []
            edges += zip(np.flatnonzero(hit).tolist(), where)
            rows |= hit
            fresh = hit
        left &= ~rows
    return edges


def _lists(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


class _Rows:
    """Some rows of a partition, all of one length, with what a comparison needs."""

    def __init__(self, table: pa.Table, least: float):
        x = _lists(table, "vector")
        x = x / np.abs(x).max(1, keepdims=True)
        self.x = x / np.sqrt((x * x).sum(1, keepdims=True))
        self.signs, self.least = _lists(table, "signs"), least
        self.ids, self.size, self.table, self.part, self.low, self.high = (
            table.column(c).to_numpy() for c in ("cls", "size", "tab", "part", "low", "high"))
        self.count = np.zeros(len(x), dtype=np.int64)
        self.edges: list[np.ndarray] = []

    def first_meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs share no bucket of a table before theirs."""
        earlier = np.arange(self.signs.shape[1]) < self.table[a][:, None]
        return ~((self.signs[a] == self.signs[b]) & earlier).any(1)

    def small(self, start: np.ndarray, size: np.ndarray, cells: int = 1 << 21) -> None:
        """Many groups of at most SMALL rows, padded to one width and multiplied together."""
        for width in (2, 4, 8, 16, 32, SMALL):
            these = (size <= width) & (size > width // 2)
            step = max(1, cells // (width * max(width, self.x.shape[1])))
            for at in range(0, int(these.sum()), step):
                first, n = start[these][at:at + step], size[these][at:at + step]
                place = np.arange(width)
                there = place < n[:, None]
                row = np.where(there, first[:, None] + place, 0)
                block = self.x[row]
                near = np.matmul(block, block.transpose(0, 2, 1)) >= self.least
                near &= there[:, :, None] & there[:, None, :] & np.triu(np.ones((width, width), dtype=bool), 1)
                g, i, j = np.nonzero(near)
                if len(g):
                    self.link(row[g, i], row[g, j])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count the pairs, and connect each row with the first row that its pairs reach."""
        new = self.first_meeting(a, b)
        a, b = a[new], b[new]
        np.add.at(self.count, a, self.size[b])
        np.add.at(self.count, b, self.size[a])
        root = np.arange(len(self.x))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (before == root).all():
                break
        moved = np.flatnonzero(root != np.arange(len(root)))
        self.edges.append(np.c_[moved, root[moved]])

    def large(self, start: int, stop: int, block: int = 512) -> None:
        """One bucket, or two chunks of one, in matrix blocks."""
        parts, same = self.part[start:stop], self.low[start] == self.high[start]
        first, second = start + np.flatnonzero(parts == self.low[start]), start + np.flatnonzero(parts == self.high[start])
        for at in range(0, len(first), block):
            rows = first[at:at + block]
            near = self.x[rows] @ self.x[second].T >= self.least
            if same:
                near &= np.arange(at, at + len(near))[:, None] < np.arange(len(second))
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 18):
                p, r = i[k:k + (1 << 18)], j[k:k + (1 << 18)]
                again = ~self.first_meeting(rows[p], second[r])
                near[p[again], r[again]] = False
            self.count[rows] += near @ self.size[second]
            self.count[second] += self.size[rows] @ near
            found = np.array(forest(near), dtype=np.int64).reshape(-1, 2)
            self.edges.append(np.c_[rows[found[:, 0]], second[found[:, 1]]])

    def out(self) -> pa.RecordBatch:
        counted = np.flatnonzero(self.count)
        edges = np.concatenate([np.zeros((0, 2), dtype=np.int64), *self.edges])
        a = np.r_[self.ids[counted], self.ids[edges[:, 0]]]
        b = np.r_[self.ids[counted], self.ids[edges[:, 1]]]
        links = np.r_[self.count[counted], np.zeros(len(edges), dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (a, b, links)], names=["a", "b", "links"])


def _compare(least: float, keys: list[str]):
    def run(batches):
        for table, start in whole_groups(batches, keys, 16_384):
            size = np.diff(np.r_[start, table.num_rows])
            dims = table.column("dim").to_numpy()[start]
            for dim in np.unique(dims).tolist():
                mine = np.repeat(dims == dim, size)
                rows = _Rows(table.filter(pa.array(mine)).combine_chunks(), least)
                n = size[dims == dim]
                at = np.cumsum(n) - n
                few = (rows.low[at] == rows.high[at]) & (n <= SMALL)
                rows.small(at[few], n[few])
                for begin, count in zip(at[~few].tolist(), n[~few].tolist()):
                    rows.large(begin, begin + count)
                yield rows.out()

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.98, tables: int = 16, hashes: int = 8, width: float = 1.0, chunk: int = 4096, seed: int = 29,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<double>"), F.col("label").cast("string"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    marked = stored(rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
                    .withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))), "vectors")
    classes = stored(
        marked.where("sound").groupBy("label", "vector")
        .agg(F.min("vec_id").alias("cls"), F.count("*").alias("size")), "vector-classes")

    def sign(batches):
        for frame in batches:
            frame = frame.reset_index(drop=True)
            frame["signs"] = None
            for _, part in frame.groupby(frame["vector"].map(len)):
                found = signatures(unit_rows(part["vector"]), tables, hashes, width, seed)
                frame.loc[part.index, "signs"] = pd.Series(list(found), index=part.index)
            yield frame

    signed = stored(classes.mapInPandas(
        sign, "label string, vector array<double>, cls bigint, size bigint, signs array<bigint>"), "vector-signs")
    entries = signed.select("label", F.size("vector").alias("dim"), "cls", F.posexplode("signs").alias("tab", "bucket"))
    key = ["label", "dim", "tab", "bucket"]
    full = entries.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / chunk).cast("int")
    placed = entries.join(full, key).withColumn("parts", pieces).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    paired = placed.select(*key, "cls", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    paired = paired.select(*key, "cls", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    fetched = paired.join(signed.select("cls", "vector", "size", "signs"), "cls")
    group = [*key, "low", "high"]
    found = stored(
        fetched.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(least, group), "a bigint, b bigint, links bigint"),
        "vector-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("others"))
    joined = connected_components(found.where("a <> b").select("a", "b").distinct())
    named = (
        classes.join(counts, "cls", "left")
        .join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                F.coalesce("component", "cls").alias("component_id"))
    )
    linked = marked.where("sound").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Hard-negative mining with rotated one-bit codes.

A vector is coded in ``stages`` steps. A step rotates what the steps before left over, keeps the signs
(one bit a component) and the alignment of code and vector, and leaves a shorter
residual. The inner product of an anchor with a row is estimated by popcounts of the code against the
bit planes of the rotated, quantised anchor. What the estimate can be wrong by is bounded without
chance: Cauchy-Schwarz on the residual and on the quantisation error. Only rows whose interval can
reach the answer are scored in integers, so the answer is exact.

Anchors meet the rows in (shard, block) pairs of bounded size; a task passes on its best few
rows of each anchor, and a window picks among those. No pair of vectors is ever a row of a shuffle.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component take no
part, nor do rows with a component so large that scores would not fit a long (beyond
2^28 / sqrt(length) in size). Vectors meet only those of equal length; empty vectors score 0.
Repeated ids are rows of their own, told apart by their place in the table; ties go to the smaller id, then place.
Anchors without positives, and positives without fitting rows, give no row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from royaltide.llm.common import arrow_schema, pick, stored

LEVELS = 6
CELLS = 1 << 19


def rotations(dim: int, stages: int, seed: int) -> np.ndarray:
    """One random orthogonal matrix a stage."""
    rng = np.random.default_rng([seed, dim])
    out = np.empty((stages, dim, dim))
    for k in range(stages):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        out[k] = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    width = -(-bits.shape[1] // 64) * 64
    full = np.zeros((len(bits), width), dtype=np.uint8)
    full[:, :bits.shape[1]] = bits
    return np.packbits(full, axis=1).view(np.uint64).reshape(len(bits), width // 64)


def encode(x: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words ``(rows, stages, words)`` and, a row, the length of each step's code part and of the last residual."""
    n, dim = x.shape
    codes = np.zeros((n, len(turns), -(-dim // 64)), dtype=np.uint64)
    parts = np.zeros((n, len(turns) + 1))
    left = x.astype(np.float64)
    for k, turn in enumerate(turns):
        turned = left @ turn
        sign = turned > 0
        codes[:, k] = _words(sign)
        unit = np.where(sign, 1.0, -1.0) / np.sqrt(max(dim, 1))
        parts[:, k] = (turned * unit).sum(1)
        left = (turned - parts[:, k, None] * unit) @ turn.T
    parts[:, -1] = np.sqrt((left * left).sum(1))
    return codes, parts


def intervals(anchors: np.ndarray, codes: np.ndarray, parts: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every inner product, anchors by rows."""
    dim = anchors.shape[1]
    a = anchors.astype(np.float64)
    length = np.sqrt((a * a).sum(1))
    middle, slack = np.zeros((len(a), len(codes))), np.zeros((len(a), len(codes)))
    across = np.zeros((len(a), len(codes)))
    top = (1 << LEVELS) - 1
    for k, turn in enumerate(turns):
        turned = a @ turn
        low = turned.min(1, initial=0)
        step = np.maximum((turned.max(1, initial=0) - low) / top, 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint64)
        wrong = turned - (low[:, None] + step[:, None] * level)
        off = np.sqrt((wrong * wrong).sum(1))
        total = (turned - wrong).sum(1)
        word = codes[:, k]
        ones = np.bitwise_count(word).sum(1, dtype=np.int64)
        hits = np.zeros((len(a), len(codes)), dtype=np.int32)
        for b in range(LEVELS):
            plane = _words(((level >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            for w in range(word.shape[1]):
                hits += np.bitwise_count(plane[:, w, None] & word[None, :, w]).astype(np.int32) << b
        inside = low[:, None] * ones + step[:, None] * hits
        along = (2 * inside - total[:, None]) / np.sqrt(max(dim, 1))
        middle += parts[:, k] * along
        slack += np.abs(parts[:, k]) * off[:, None]
        across = np.maximum(np.abs(along) - off[:, None], 0)
    # The residual is orthogonal to the last code: only the anchor's part across it counts.
    rest = np.sqrt(np.maximum(length[:, None] ** 2 - across ** 2, 0))
    size = np.sqrt((parts * parts).sum(1))
    slack += rest * parts[:, -1] + 1e-9 * length[:, None] * size + 1e-6
    return middle - slack, middle + slack


def integer_scores(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the anchors ``i`` with the rows ``j``."""
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 16):
        cut = slice(at, at + (1 << 16))
        out[cut] = (a[i[cut]] * x[j[cut]]).sum(1)
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: higher scores, smaller ids, earlier rows."""
    order = np.lexsort((rows, ids, -score, group))
    edge = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.array([], dtype=int)
    rank = np.arange(len(order)) - np.repeat(edge, np.diff(np.r_[edge, len(order)]))
    return order[rank < k]


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return (column.flatten() if isinstance(column, pa.ListArray) else column).to_numpy(zero_copy_only=False)


def _matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    return _flat(table, name).reshape(table.num_rows, dim)


def _shard(rows: pa.Table, dim: int, stages: int) -> tuple:
    words = -(-dim // 64)
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint64).reshape(rows.num_rows, stages, words)
    parts = _flat(rows, "parts").reshape(rows.num_rows, stages + 1)
    return _matrix(rows, "x", dim), codes, parts, _flat(rows, "label"), _flat(rows, "id"), _flat(rows, "row")


def _positives(key, anchors: pa.Table, rows: pa.Table, k: int, stages: int, seed: int, schema: pa.Schema) -> pa.Table:
    dim = key[0].as_py()
    if not anchors.num_rows or not rows.num_rows:
        return schema.empty_table()
    turns = rotations(dim, stages, seed)
    x, codes, parts, labels, ids, places = _shard(rows, dim, stages)
    a, kinds, own = _matrix(anchors, "x", dim), _flat(anchors, "label"), _flat(anchors, "row")
    out = []
    width = max(1, CELLS // len(x))
    for at in range(0, len(a), width):
        cut = slice(at, at + width)
        lower, upper = intervals(a[cut], codes, parts, turns)
        fits = (kinds[cut, None] == labels) & (own[cut, None] != places)
        floor = _kth(np.where(fits, lower, -np.inf), k)
        i, j = np.nonzero(fits & (upper >= floor[:, None]))
        score = integer_scores(a[cut], x, i, j)
        best = _best(i, score, ids[j], places[j], k)
        out.append((own[cut][i[best]], places[j[best]], ids[j[best]], score[best]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)


def _negatives(key, anchors: pa.Table, rows: pa.Table, k: int, stages: int, seed: int, schema: pa.Schema) -> pa.Table:
    dim = key[0].as_py()
    if not anchors.num_rows or not rows.num_rows:
        return schema.empty_table()
    turns = rotations(dim, stages, seed)
    x, codes, parts, labels, ids, places = _shard(rows, dim, stages)
    a, kinds, own = _matrix(anchors, "x", dim), _flat(anchors, "label"), _flat(anchors, "row")
    limits = anchors.column("limits").to_pylist()
    out = [(np.zeros(0, dtype=np.int64),) * 5]
    width = max(1, CELLS // len(x))
    for at in range(0, len(a), width):
        lower, upper = intervals(a[at:at + width], codes, parts, turns)
        for n in range(len(lower)):
            other = kinds[at + n] != labels
            asked = {}
            for place, low, high in ((p["place"], p["low"], p["high"]) for p in limits[at + n]):
                inside = other & (lower[n] >= low) & (upper[n] <= high)
                sure = lower[n][inside]
                floor = max(low, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else low
                asked[place] = (other & (upper[n] >= floor) & (lower[n] <= high), low, high)
            if not asked:
                continue
            j = np.flatnonzero(np.logical_or.reduce([m for m, _, _ in asked.values()]))
            score = integer_scores(a, x, np.full(len(j), at + n), j)
            for place, (mask, low, high) in asked.items():
                hit = mask[j] & (score >= low) & (score <= high)
                jj, s = j[hit], score[hit]
                best = _best(np.zeros(len(jj), dtype=np.int8), s, ids[jj], places[jj], k)
                out.append((np.full(len(best), own[at + n]), np.full(len(best), place), places[jj[best]], ids[jj[best]], s[best]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)


def _first(found: DataFrame, group: list[str], rank: str, k: int) -> DataFrame:
    order = W.partitionBy(*group).orderBy(F.desc("score"), "id", "row")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """``row, id, label, x`` of the rows that take part; components are ``floor(scale * x)``."""
    rows = pick(vectors, id=id_col, vector=vector_col, label=label_col)
    rows = rows.select(F.col("id").cast("bigint"), F.col("vector").cast("array<double>"), F.col("label").cast("bigint"))
    most = F.floor(F.lit(2.0**28) / F.sqrt(F.greatest(F.size("vector"), F.lit(1))))
    sound = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < most)))
    return rows.where(sound).select(
        F.monotonically_increasing_id().alias("row"), "id", "label",
        F.transform("vector", lambda v: F.floor(v * scale).cast("bigint")).alias("x"))


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    stages: int = 4, seed: int = 31, shard_rows: int = 16_384, block_anchors: int = 4_096,
) -> DataFrame:
    """Hard negatives of every anchor and positive among ``rows(row, id, label, x)``.

    A negative has another label and ``low * positive <= 100 * score <= high * positive``.
    """
    spark = rows.sparkSession
    spec = "row bigint, id bigint, label bigint, x array<bigint>, dim int, codes binary, parts array<double>"
    _, schema = arrow_schema(spec)

    def coded(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.diff(table.column("x").combine_chunks().offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = table.filter(pa.array(sizes == dim))
                codes, parts = encode(_matrix(part, "x", dim), rotations(dim, stages, seed))
                part = part.append_column("dim", pa.array(np.full(len(parts), dim, dtype=np.int32)))
                part = part.append_column("codes", pa.array([c.tobytes() for c in codes], type=pa.binary()))
                part = part.append_column("parts", pa.array(list(parts), type=pa.list_(pa.float64())))
                yield from part.cast(schema).to_batches()

    # Codes are made from the stored rows, so that each row keeps its number.
    marked = stored(stored(rows.select("row", "id", "label", "x"), "negative-rows").mapInArrow(coded, spec), "negative-codes")
    marked = marked.withColumn("anchor", is_anchor)
    n, asked = marked.agg(F.count("*"), F.count_if("anchor")).first()
    shards = max(spark.sparkContext.defaultParallelism, -(-n // shard_rows))
    blocks = max(1, -(-asked // block_anchors))

    def number(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    key = ["dim", "shard", "block"]
    spread = (marked.select("dim", "row", "id", "label", "x", "codes", "parts", number(shards).alias("shard"))
              .withColumn("block", every(blocks)).groupBy(*key))
    # Columns of their own, as the anchors are joined with the rows they come from.
    anchors = marked.where("anchor").select(*[F.col(c).alias(c) for c in ("dim", "row", "id", "label", "x")], number(blocks).alias("block"))

    def meet(left: DataFrame, work, spec: str, k: int) -> DataFrame:
        _, found = arrow_schema(spec)

        def pair(key, some: pa.Table, others: pa.Table) -> pa.Table:
            return work(key, some, others, k, stages, seed, found)

        return left.withColumn("shard", every(shards)).groupBy(*key).cogroup(spread).applyInArrow(pair, spec)

    best = meet(anchors, _positives, "anchor bigint, row bigint, id bigint, score bigint", positives)
    chosen = stored(_first(best, ["anchor"], "place", positives), "positives")
    # Integer bounds of the scores that fit, rounded inwards.
    limits = chosen.select(
        F.col("anchor").alias("row"), "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100").alias("low"),
        F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("high"))
    listed = limits.where("low <= high").groupBy("row").agg(F.collect_list(F.struct("place", "low", "high")).alias("limits"))
    found = meet(anchors.join(listed, "row"), _negatives,
                 "anchor bigint, place bigint, row bigint, id bigint, score bigint", negatives)
    named = _first(found, ["anchor", "place"], "rank", negatives)
    return (
        named.join(limits.select(F.col("row").alias("anchor"), "place", "positive_id", "positive_score"), ["anchor", "place"])
        .join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score")))

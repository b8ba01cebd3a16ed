"""Searchable text, embeddings and nearest-neighbour search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from royaltide.functions.columns import split_ids
from royaltide.operators.ordering import spread_join
from royaltide.operators.records import snapshot_diff

DIM = 1024
# Scores are ranked at this many decimals, so that copies of a vector tie
# exactly and the id decides, wherever each copy was scored.
SCORE_DIGITS = 9
BLOCK_QUERIES = 4096
SCORE_CELLS = 4 << 20


# --- text ----------------------------------------------------------------------


def attach_writers(songs: DataFrame, writers: DataFrame) -> DataFrame:
    """Names and affiliations of each song's writers, in order of name.

    Names are joined to the different lists of writers, so that of a song only its list is taken apart per writer;
    the other columns move once. A list travels as 16 bytes of its SHA-256, not as text with each of its writers.
    A writer on very many lists is joined in salted pieces. Rows that repeat are one row, which names its
    writers as often.
    """
    names = writers.select(
        F.col("songwriter_id").cast("string").alias("_writer"), "name", "pro_affiliation"
    )
    digest = F.substring(F.unhex(F.sha2(F.col("songwriters").cast("binary"), 256)), 1, 16)
    keyed = songs.withColumn("_list", digest)
    different = keyed.groupBy("_list").agg(F.first("songwriters").alias("songwriters"))
    listed = different.select("_list", F.explode(split_ids("songwriters")).alias("_writer"))
    lists = (
        spread_join(listed, names, ["_writer"], ["_list"])
        .groupBy("_list")
        .agg(
            F.sort_array(F.collect_list("name")).alias("_names"),
            F.sort_array(F.collect_set("pro_affiliation")).alias("_pros"),
        )
    )
    times = F.col("_times").cast("int")
    credited = (
        keyed.join(lists, "_list").groupBy("_list", *songs.columns, "_names", "_pros").agg(F.count(F.lit(1)).alias("_times"))
        .withColumn("_names", F.flatten(F.transform("_names", lambda n: F.array_repeat(n, times))))
    )
    return credited.select(
        *songs.columns,
        F.array_join("_names", ", ").alias("songwriter_names"),
        F.array_join("_pros", ", ").alias("pro_affiliations"),
    )


def song_text_spec() -> list[tuple[str, Column]]:
    """Segments of the searchable text of a song."""
    return [
        ("Title", F.col("title")),
        ("Artist", F.col("artist_name")),
        ("Genre", F.col("genre")),
        ("Songwriters", F.col("songwriter_names")),
        ("Publisher", F.col("publisher")),
        ("Released", F.col("release_date").cast("string")),
        ("ISRC", F.col("isrc_code")),
        ("Duration", F.concat((F.col("duration_seconds") / 60).cast("int").cast("string"), F.lit(" minutes"))),
        ("Popularity", F.concat(F.col("song_popularity_score").cast("string"), F.lit("/100"))),
        ("Territories", F.col("num_territories").cast("string")),
    ]


def compose_text(
    df: DataFrame, spec: Sequence[tuple[str, Column]], name: str = "metadata_text"
) -> DataFrame:
    """``Label: value`` segments joined by `` | ``; a NULL value drops its segment."""
    segments = [F.concat(F.lit(f"{label}: "), value) for label, value in spec]
    return df.withColumn(name, F.concat_ws(" | ", *segments))


# --- embeddings ----------------------------------------------------------------


def _hash_rows(dim: int, tokens: str, name: str):
    """Batch function: token lists to unit vectors of hashed word counts.

    A word is hashed once per batch, however often it occurs; everything per
    token runs inside Arrow and numpy.
    """

    def bucket(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim

    def vectors(lists: pa.ListArray) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        vocabulary = flat.dictionary.to_pylist()
        # Splitting leaves an empty string at the edges; it is no word.
        places = np.array([bucket(w) if w else -1 for w in vocabulary], dtype=np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        rows = np.repeat(np.arange(len(lists)), sizes)
        columns = places[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
        rows, columns = rows[columns >= 0], columns[columns >= 0]
        counts = np.bincount(rows * dim + columns, minlength=len(lists) * dim).astype(np.float64)
        counts = counts.reshape(len(lists), dim)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(length == 0, 1.0, length)
        ends = np.arange(0, len(lists) * dim + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))

    step = max(1, (4 << 20) // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                at = part.schema.get_field_index(tokens)
                arrays = [c for i, c in enumerate(part.columns) if i != at]
                names = [n for n in part.schema.names if n != tokens]
                yield pa.RecordBatch.from_arrays(
                    arrays + [vectors(part.column(at))], names=names + [name]
                )

    return run


def embed(
    df: DataFrame,
    text_col: str,
    dim: int = DIM,
    backend: Callable[[pd.Series], Sequence[Sequence[float]]] | None = None,
    name: str = "embedding",
) -> DataFrame:
    """Unit vector of each text; no shuffle.

    The default hashes every word into one of ``dim`` buckets and scales the
    counts to length 1. A ``backend`` maps a batch of texts to vectors instead.
    """
    if backend is None:
        tokens = F.split(F.lower(text_col), "[^a-z0-9]+")
        kept = [f for f in df.schema.fields if f.name != name]
        schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))])
        cut = df.select(*[f.name for f in kept], tokens.alias("_tokens"))
        return cut.mapInArrow(_hash_rows(dim, "_tokens", name), schema)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def call(texts: pd.Series) -> pd.Series:
        vectors = list(backend(texts))
        if len(vectors) != len(texts):
            raise ValueError("backend must return one vector per text")
        return pd.Series(vectors, index=texts.index, dtype=object)

    return df.withColumn(name, call(F.col(text_col)))


def sync_index(
    index: DataFrame,
    source: DataFrame,
    key: str,
    cols: Sequence[str],
    text_col: str,
    dim: int = DIM,
    backend: Callable[[pd.Series], Sequence[Sequence[float]]] | None = None,
    name: str = "embedding",
) -> DataFrame:
    """Index brought up to date with a new snapshot of its source.

    ``index`` holds ``key``, ``cols`` and the vectors. Only new and changed rows
    are embedded; unchanged rows keep their vector and removed rows leave.
    """
    columns = [key, *cols]
    diff = snapshot_diff(index.select(*columns), source.select(*columns), [key], cols)
    arrived = diff.where(F.col("change") != "delete").select(*columns)
    kept = index.join(diff.select(key), key, "left_anti")
    return kept.select(*columns, name).unionByName(embed(arrived, text_col, dim, backend, name))


# --- exact top-k -----------------------------------------------------------------


def _matrix(vectors: pd.Series) -> np.ndarray:
    flat = np.concatenate(vectors.to_numpy()) if len(vectors) else np.empty(0)
    return flat.astype(np.float64, copy=False).reshape(len(vectors), -1)


def _best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores of one query, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        pool = np.flatnonzero(scores >= cut)
    else:
        pool = np.arange(len(scores))
    return pool[np.lexsort((ids[pool], -scores[pool]))[:k]]


def _score_batch(
    items: pd.DataFrame, id_col: str, vec_col: str, keep: Sequence[str],
    query_ids: Sequence, query_matrix: np.ndarray, query_id: str, k: int,
) -> pd.DataFrame:
    """The k best items of the batch for every query.

    Queries go through in slices, so the score matrix stays below SCORE_CELLS.
    """
    matrix, ids = _matrix(items[vec_col]), items[id_col].to_numpy()
    width = max(1, SCORE_CELLS // len(items))
    rows, columns, found = [], [], []
    for start in range(0, len(query_ids), width):
        raw = query_matrix[start : start + width] @ matrix.T
        if len(items) > k:
            # Only scores that can be among the k best once rounded are rounded and sorted.
            cut = np.partition(raw, len(items) - k, axis=1)[:, len(items) - k]
            cut -= np.where(np.isfinite(cut), 2 * 10.0**-SCORE_DIGITS + 1e-15 * np.abs(cut), 0.0)
        for j, line in enumerate(raw):
            pool = np.flatnonzero(line >= cut[j]) if len(items) > k else np.arange(len(items))
            scores = np.round(line[pool], SCORE_DIGITS)
            best = _best_rows(scores, ids[pool], k)
            rows.append(pool[best])
            columns.append(np.full(len(best), start + j))
            found.append(scores[best])
    out = items[list(keep)].iloc[np.concatenate(rows)].reset_index(drop=True)
    out.insert(0, query_id, pd.Series(query_ids).iloc[np.concatenate(columns)].to_numpy())
    out["score"] = np.concatenate(found)
    return out


def vector_topk(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "query_vector",
    columns: Sequence[str] = (),
    shards: int | None = None,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` items with the highest dot product for every query, exactly.

    Vectors of unit length make this the cosine. Items and queries meet in (index shard, query
    block) pairs of bounded size; each pair is one matrix product in slices and passes on only
    its own k best per query, so scored pairs never reach a shuffle. There are as many shards
    as shuffle partitions, at least one a core; the items are not counted for it. Queries of one block are sent to
    the items instead, which then stay where they are.
    """
    keep = list(dict.fromkeys([id_col, *columns]))
    queries = queries.select(F.col(query_id), F.col(query_vec))
    items = index.select(*keep, *([] if vec_col in keep else [vec_col]))
    fields = [T.StructField(query_id, queries.schema[query_id].dataType)]
    fields += [index.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)

    blocks = max(1, -(-queries.count() // block_queries))
    if blocks == 1:
        partial = _beside(items, queries, schema, id_col, vec_col, keep, query_id, query_vec, k)
    else:
        partial = _blocked(items, queries, schema, id_col, vec_col, keep, query_id, query_vec, k, shards, blocks)
    order = W.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id_col))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(parts: Iterator[pd.DataFrame], query_id: str, id_col: str, k: int) -> Iterator[pd.DataFrame]:
    """The k best rows of each query among all parts; what is held back is cut again whenever it has doubled."""
    held, size, limit = [], 0, 100_000
    for part in parts:
        held.append(part)
        size += len(part)
        if size > limit:
            held = [_cut(held, query_id, id_col, k)]
            size = len(held[0])
            limit = max(100_000, 2 * size)
    if size:
        yield _cut(held, query_id, id_col, k)


def _cut(held: list[pd.DataFrame], query_id: str, id_col: str, k: int) -> pd.DataFrame:
    found = pd.concat(held, ignore_index=True).sort_values(["score", id_col], ascending=[False, True])
    return found[found.groupby(query_id, dropna=False).cumcount() < k]


def _beside(items, queries, schema, id_col, vec_col, keep, query_id, query_vec, k) -> DataFrame:
    """Partial top-k of each task's items for one block of queries, which every task gets."""
    asked = queries.toPandas()
    shared = items.sparkSession.sparkContext.broadcast((asked[query_id].tolist(), _matrix(asked[query_vec])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        parts = (
            _score_batch(batch, id_col, vec_col, keep, ids, matrix, query_id, k) for batch in batches if len(batch) and ids)
        return best_of(parts, query_id, id_col, k)

    return items.mapInPandas(run, schema)


def _blocked(
    items, queries, schema, id_col, vec_col, keep, query_id, query_vec, k, shards, blocks
) -> DataFrame:
    """Partial top-k over (index shard, query block) pairs.

    Shards and blocks come from a hash of the unique ids, so all are of like size.
    """
    spark = items.sparkSession
    shards = shards or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def number(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count).cast("bigint"))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    left = items.withColumn("_shard", number(id_col, shards)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", number(query_id, blocks)).withColumn("_shard", every(shards))

    def pair(block_items: pd.DataFrame, block_queries: pd.DataFrame) -> pd.DataFrame:
        if block_items.empty or block_queries.empty:
            return pd.DataFrame(columns=schema.fieldNames())
        return _score_batch(
            block_items, id_col, vec_col, keep,
            block_queries[query_id].tolist(), _matrix(block_queries[query_vec]), query_id, k,
        )

    return (
        left.groupBy("_shard", "_block")
        .cogroup(right.groupBy("_shard", "_block"))
        .applyInPandas(pair, schema)
    )


def similar_to(
    index: DataFrame,
    item: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    columns: Sequence[str] = (),
) -> DataFrame:
    """Items nearest to the one ``item`` selects (smallest id), itself left out.

    Cosine similarity; ties go to the smaller id.
    """
    scaled = index.withColumn("_unit", unit_vector(vec_col))
    reference = (
        scaled.where(item).orderBy(id_col).limit(1)
        .select(F.lit(0).alias("query_id"), F.col("_unit").alias("query_vector"))
    )
    others = scaled.where(~F.coalesce(item, F.lit(False)))
    found = vector_topk(others, reference, k, id_col, "_unit", columns=columns)
    return found.drop("query_id").withColumnRenamed("score", "similarity_score")


def unit_vector(vec_col: str) -> Column:
    """Vector scaled to length 1, as doubles; a zero vector stays zero."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scale(vectors: pd.Series) -> pd.Series:
        matrix = _matrix(vectors)
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return pd.Series(list(matrix / np.where(length == 0, 1.0, length)), dtype=object)

    return scale(F.col(vec_col))


def search_song_catalog(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    dim: int = DIM,
    text_col: str = "metadata_text",
) -> DataFrame:
    """Songs nearest to each text of ``queries(query_id, query)``."""
    columns = ["song_id", "title", "artist_name", "genre", "songwriter_names"]
    vectors = embed(index.select(*columns, text_col), text_col, dim)
    asked = embed(queries, "query", dim, name="query_vector")
    found = vector_topk(vectors, asked, k, "song_id", "embedding", columns=columns)
    return found.select("query_id", *columns, F.col("score").alias("similarity_score"))


# --- approximate top-k -------------------------------------------------------------


def _signatures(vec_col: str, tables: int, bits: int, dim: int, seed: int) -> Column:
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    powers = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(vectors: pd.Series) -> pd.Series:
        side = (_matrix(vectors) @ planes > 0).reshape(len(vectors), tables, bits)
        return pd.Series(list(side @ powers), dtype=object)

    return sign(F.col(vec_col))


def vector_topk_lsh(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    tables: int = 16,
    bits: int = 5,
    dim: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "query_vector",
    seed: int = 7,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Approximate top-k by random-hyperplane buckets with exact re-ranking.

    Items and queries that share a bucket of any table meet. Large buckets are
    dealt into pieces on both sides (say, for many copies of one vector): every
    item piece meets every query piece, so no task holds a whole hot bucket and
    no candidate is dropped. A pair of pieces is scored by matrix products and
    only its k best per query leave the task.
    """
    items = index.select(
        id_col, vec_col,
        F.posexplode(_signatures(vec_col, tables, bits, dim, seed)).alias("_table", "_bucket"),
    )
    asked = queries.select(
        query_id, query_vec,
        F.posexplode(_signatures(query_vec, tables, bits, dim, seed)).alias("_table", "_bucket"),
    )

    def pieces(side: DataFrame, rows: int, name: str) -> DataFrame:
        # At most tables * 2^bits rows, a bound the arguments fix.
        counted = side.groupBy("_table", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        return F.broadcast(
            counted.select("_table", "_bucket", F.ceil(F.col("_n") / rows).cast("int").alias(name))
        )

    def piece_of(key: str, name: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(name).cast("bigint")).cast("int")

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    item_pieces = pieces(items, bucket_rows, "_ip")
    query_pieces = pieces(asked, BLOCK_QUERIES, "_qp")
    # The inner joins also drop buckets that only one side has.
    both = ["_table", "_bucket"]
    group = [*both, "_i", "_q"]
    left = (
        items.join(query_pieces, both).join(item_pieces, both)
        .withColumn("_i", piece_of(id_col, "_ip")).withColumn("_q", every("_qp"))
        .select(*group, id_col, vec_col)
    )
    right = (
        asked.join(item_pieces, both).join(query_pieces, both)
        .withColumn("_q", piece_of(query_id, "_qp")).withColumn("_i", every("_ip"))
        .select(*group, query_id, query_vec)
    )
    schema = T.StructType(
        [queries.schema[query_id], index.schema[id_col], T.StructField("score", T.DoubleType())]
    )

    def meet(some_items: pd.DataFrame, some_queries: pd.DataFrame) -> pd.DataFrame:
        if some_items.empty or some_queries.empty:
            return pd.DataFrame(columns=schema.fieldNames())
        return _score_batch(
            some_items, id_col, vec_col, [id_col], some_queries[query_id].tolist(),
            _matrix(some_queries[query_vec]), query_id, k,
        )

    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, schema)
    order = W.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id_col))
    return (
        met.groupBy(query_id, id_col)
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def recall(exact: DataFrame, approximate: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    found = approximate.select(query_id, id_col, F.lit(1).alias("_hit"))
    return exact.join(found, [query_id, id_col], "left").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_hit").alias("found"),
        F.round(F.try_divide(F.count("_hit"), F.count(F.lit(1))), 4).alias("recall"),
    )

"""Nearest neighbours by inner product: an NN-descent graph and greedy graph search.

Equal vectors are one node, which keeps its smallest ids. Lists hold the nodes of largest inner
product, so that of uneven lengths too the list of a query is its answer. Hash cells
give each node some first neighbours. A round of NN-descent then joins every node's neighbours with each other and with the nodes that point to it; pairs with a new
edge are scored, and what beats a list's last entry enters it. A node that many
point to is cut into pieces of ``degree`` pointers; pointers meet its neighbours, and each other
through these. Rounds end when few entries change.

Nodes meet in blocks: a task gets the lists of a block and, once each, the vectors that
they name. Queries are nodes of the graph and search it greedily from their own: in each round the unopened
nodes of a beam are opened by a join with the lists, until nothing new enters any beam.

The graph works on half-precision unit vectors and their lengths; the best of each beam are scored again in double precision on the
original vectors. The result is approximate: ``degree``, ``beam`` and ``tables`` set its recall.

Defined cases: null ids and vectors that are null, empty, zero or hold null or non-finite components take
no part, neither as query nor as candidate. Vectors of different length never meet. Repeated
vectors tie, smaller ids first; rows with the query's id are never its neighbours. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from royaltide.llm.common import arrow_schema, pick, stored

CELLS = 1 << 20
_LISTS = "node bigint, dim int, cands array<bigint>, sims array<float>, fresh array<boolean>"


def _flat(table, name: str) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column.flatten() if isinstance(column, pa.ListArray) else column).to_numpy(zero_copy_only=False)


def _lengths(table, name: str) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(column.offsets.to_numpy())


def _codes(table, dim: int) -> np.ndarray:
    """Vectors of a table as single-precision rows."""
    data = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8).reshape(table.num_rows, 2 * dim + 4)
    unit, length = (np.ascontiguousarray(part) for part in np.split(data, [2 * dim], axis=1))
    return unit.view(np.float16).astype(np.float32) * length.view(np.float32)


def _padded(table, name: str, width: int, fill) -> np.ndarray:
    lengths = _lengths(table, name)
    out = np.full((len(lengths), width), fill)
    out[np.arange(width) < lengths[:, None]] = _flat(table, name)
    return out


def _top(node, cand, sim, fresh, k: int) -> tuple:
    """The k most similar candidates of each node, sorted; an entry that was known before is not fresh."""
    keep = node != cand
    node, cand, sim, fresh = node[keep], cand[keep], sim[keep], fresh[keep]
    order = np.lexsort((fresh, cand, node))
    node, cand, sim, fresh = node[order], cand[order], sim[order], fresh[order]
    first = np.ones(len(node), dtype=bool)
    first[1:] = (node[1:] != node[:-1]) | (cand[1:] != cand[:-1])
    node, cand, sim, fresh = node[first], cand[first], sim[first], fresh[first]
    order = np.lexsort((cand, -sim, node))
    node, cand, sim, fresh = node[order], cand[order], sim[order], fresh[order]
    edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, dtype=int)
    rank = np.arange(len(node)) - np.repeat(edge, np.diff(np.r_[edge, len(node)]))
    best = rank < k
    return node[best], cand[best], sim[best], fresh[best]


def _as_lists(node, dim: int, cand, sim, fresh, schema: pa.Schema) -> pa.Table:
    names, start = np.unique(node, return_index=True)
    offsets = pa.array(np.r_[start, len(node)].astype(np.int32))
    columns = [pa.ListArray.from_arrays(offsets, pa.array(c, type=f.type.value_type))
               for c, f in zip((cand, sim, fresh), list(schema)[2:])]
    return pa.table([pa.array(names), pa.array(np.full(len(names), dim, dtype=np.int32)), *columns], schema=schema)


def _merge(lists: DataFrame, degree: int) -> DataFrame:
    """One list of a node out of several."""
    _, schema = arrow_schema(_LISTS)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            nodes = _flat(table, "node")
            # The last node may go on in the next batch.
            cut = int(np.searchsorted(nodes, nodes[-1])) if len(nodes) else 0
            held = table.slice(cut)
            if cut:
                yield from merged(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield from merged(held)

    def merged(table):
        table = table.combine_chunks()
        dims = _flat(table, "dim")
        for dim in np.unique(dims).tolist():
            part = table.filter(pa.array(dims == dim)).combine_chunks()
            node = np.repeat(_flat(part, "node"), _lengths(part, "cands"))
            found = _top(node, _flat(part, "cands"), _flat(part, "sims"), _flat(part, "fresh"), degree)
            yield from _as_lists(found[0], dim, *found[1:], schema).to_batches()

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, _LISTS)


def _apart(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own, to be grouped together with the rows they come from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _number(key: Column, count: int | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count) if isinstance(count, int) else count).cast("int")


# --- nodes ---------------------------------------------------------------------------


def _nodes(rows: DataFrame, tables: int, cell: int, seed: int) -> DataFrame:
    """``node, dim, vector, code, keys`` of each distinct vector of ``rows(vec_id, vector)``."""
    classes = stored(
        rows.groupBy("vector").agg(F.min("vec_id").alias("least")).select(F.monotonically_increasing_id().alias("node"), "vector"),
        "graph-nodes")
    n = classes.count()
    scale = classes.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1.0
    bits = max(0, round(np.log2(max(1, n) / cell)))
    tables = tables if bits else 1
    spec = "node bigint, dim int, code binary, keys array<bigint>"
    _, schema = arrow_schema(spec)

    def code(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = _lengths(table, "vector")
            for dim in np.unique(sizes).tolist():
                part = table.filter(pa.array(sizes == dim)).combine_chunks()
                x = _flat(part, "vector").reshape(part.num_rows, dim)
                most = np.abs(x).max(1, keepdims=True)
                x = x / most
                length = np.sqrt((x * x).sum(1, keepdims=True))
                x = x / length
                length = (length * (most / scale)).astype(np.float32)
                planes = np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))
                side = (x @ planes > 0).reshape(len(x), tables, bits)
                keys = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(x), tables), dtype=np.int64)
                yield from pa.table([
                    part.column("node"), pa.array(np.full(len(x), dim, dtype=np.int32)),
                    pa.array([h.tobytes() + r.tobytes() for h, r in zip(x.astype(np.float16), length)], type=pa.binary()),
                    pa.array(list(keys), type=pa.list_(pa.int64()))], schema=schema).to_batches()

    coded = stored(classes.mapInArrow(code, spec), "graph-codes")
    return classes, coded, n


# --- NN-descent ----------------------------------------------------------------------


def _first_lists(coded: DataFrame, n: int, cell: int, first: int, degree: int) -> DataFrame:
    """Neighbours of each node within its hash cells, and among some nodes taken at random."""
    few = n <= cell
    _, schema = arrow_schema(_LISTS)
    cells = coded.select("node", "dim", "code", F.posexplode("keys").alias("tab", "key"))
    if not few:
        random = coded.select("node", "dim", "code", F.lit(-1).alias("tab"), _number(F.col("node"), -(-n // 64)).cast("bigint").alias("key"))
        cells = cells.union(random)
    key = ["dim", "tab", "key"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count("*") / (1.5 * cell)).cast("int").alias("pieces"))
    placed = cells.join(sizes, key).withColumn("piece", _number(F.col("node"), F.col("pieces")))

    def work(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        node, x = _flat(table, "node"), _codes(table, dim)
        score = x @ x.T
        np.fill_diagonal(score, -np.inf)
        k = min(degree if few else first, len(node) - 1)
        if k < 1:
            return schema.empty_table()
        j = np.argpartition(-score, k - 1, axis=1)[:, :k]
        i = np.repeat(np.arange(len(node)), k)
        j = j.ravel()
        found = _top(node[i], node[j], score[i, j], np.ones(len(i), dtype=bool), k)
        return _as_lists(found[0], dim, *found[1:], schema)

    return _merge(placed.groupBy(*key, "piece").applyInArrow(work, _LISTS), degree)


def _local(degree: int, schema: pa.Schema):
    """Neighbours of one node joined with each other and with the nodes that point to it."""

    def work(key, lists: pa.Table, nodes: pa.Table) -> pa.Table:
        if not lists.num_rows or not nodes.num_rows:
            return schema.empty_table()
        order = np.argsort(_flat(nodes, "node"), kind="stable")
        ids, x, least = _flat(nodes, "node")[order], _codes(nodes, key[0].as_py())[order], _flat(nodes, "least")[order]
        wide = max(1, int(_lengths(lists, "cands").max()))
        back = max(1, int(_lengths(lists, "rev").max()))

        def places(name: str, width: int) -> np.ndarray:
            found = _padded(lists, name, width, np.int64(-1))
            return np.where(found == -1, -1, np.searchsorted(ids, found))

        ahead, behind = places("cands", wide), places("rev", back)
        ahead_new, behind_new = _padded(lists, "fresh", wide, False), _padded(lists, "rev_fresh", back, False)
        again = _flat(lists, "piece") > 0
        both, both_new = np.c_[ahead, behind], np.c_[ahead_new, behind_new]
        upper = np.ones((wide, wide + back), dtype=bool)
        upper[:, :wide] = np.triu(np.ones((wide, wide), dtype=bool), 1)
        kept, held, room = [], 0, 500_000
        step = max(1, CELLS // (wide * (wide + back)))

        def reduced(parts):
            node, cand, sim = (np.concatenate(c) for c in zip(*parts))
            node, cand, sim, _ = _top(node, cand, sim, np.ones(len(node), dtype=bool), degree)
            return [(node, cand, sim)]

        for at in range(0, len(ahead), step):
            f, m = ahead[at:at + step], both[at:at + step]
            score = np.matmul(x[f], x[m].transpose(0, 2, 1))
            fit = (f >= 0)[:, :, None] & (m >= 0)[:, None, :] & upper
            fit &= ahead_new[at:at + step, :, None] | both_new[at:at + step, None, :]
            fit[again[at:at + step], :, :wide] = False
            for a, b, floor in ((0, 1, least[f][:, :, None]), (1, 0, least[m][:, None, :])):
                g, i, j = np.nonzero(fit & (score > floor))
                pair = (f[g, i], m[g, j])
                kept.append((pair[a], pair[b], score[g, i, j]))
                held += len(g)
            if held > room:
                kept = reduced(kept)
                held = len(kept[0][0])
                # What stays is sorted again only after as much has come anew.
                room = 2 * held + 500_000
        node, cand, sim = reduced(kept)[0]
        return _as_lists(ids[node], key[0].as_py(), ids[cand], sim, np.ones(len(node), dtype=bool), schema)

    return work


def _round(lists: DataFrame, coded: DataFrame, degree: int, blocks: int) -> DataFrame:
    _, schema = arrow_schema(_LISTS)
    edges = lists.select(F.col("node").alias("from"), F.explode(F.arrays_zip("cands", "fresh")).alias("e"))
    edges = edges.select("from", F.col("e.cands").alias("node"), F.col("e.fresh").alias("fresh"))
    pieces = edges.groupBy("node").agg(F.ceil(F.count("*") / degree).cast("int").alias("pieces"))
    back = (
        edges.join(pieces, "node").groupBy("node", _number(F.col("from"), F.col("pieces")).alias("piece"))
        .agg(F.collect_list(F.struct("from", "fresh")).alias("r"))
        .select("node", "piece", F.col("r.from").alias("rev"), F.col("r.fresh").alias("rev_fresh")))
    # Every node once without pointers, so that its own neighbours meet even if nobody points to it.
    alone = lists.select("node", F.lit(0).alias("piece"), F.array().cast("array<bigint>").alias("rev"), F.array().cast("array<boolean>").alias("rev_fresh"))
    asked = (
        lists.select("node", "dim", "cands", "fresh").join(back.withColumn("piece", F.col("piece") + 1).union(alone), "node")
        .where(F.exists("fresh", lambda f: f) | F.exists("rev_fresh", lambda f: f))
        .withColumn("block", F.pmod(F.xxhash64("node", "piece"), F.lit(blocks)).cast("int")))
    least = lists.select("node", F.when(F.size("sims") < degree, F.lit(float("-inf"))).otherwise(F.array_min("sims")).cast("float").alias("least"))
    needed = asked.select("dim", "block", F.explode(F.concat("cands", "rev")).alias("node")).distinct()
    nodes = coded.select("node", "code").join(least, "node")
    found = (
        asked.groupBy("dim", "block").cogroup(_apart(needed.join(nodes, "node")).groupBy("dim", "block"))
        .applyInArrow(_local(degree, schema), _LISTS))
    known = lists.withColumn("fresh", F.transform("fresh", lambda f: F.lit(False)))
    return _merge(known.union(found), degree)


def build(coded: DataFrame, n: int, degree: int, cell: int, first: int, least: float, rounds: int, block_bytes: int) -> DataFrame:
    """Neighbour lists of all nodes, descended until less than ``least`` of their entries change.

    A block has as many nodes as keeps the vectors that they can name below ``block_bytes``: the fewer
    blocks, the fewer lists does a node get in a round.
    """
    size = coded.agg(F.max(F.length("code"))).first()[0] or 1
    blocks = max(coded.sparkSession.sparkContext.defaultParallelism, -(-n * 2 * degree * size // block_bytes))
    lists = stored(_first_lists(coded, n, cell, first, degree), "graph-lists")
    for _ in range(rounds if n > cell else 0):
        lists = stored(_round(lists, coded, degree, blocks), "graph-lists")
        changed = lists.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        if changed < least * n * degree:
            break
    return lists


# --- search --------------------------------------------------------------------------

_BEAM = "q bigint, dim int, code binary, ids array<bigint>, sims array<float>, opened array<boolean>"


def _open(beam: int, schema: pa.Schema):
    """Candidates of each query scored and taken into its beam."""

    def work(key, asked: pa.Table, nodes: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return schema.empty_table()
        order = np.argsort(_flat(nodes, "node"), kind="stable")
        names, x = _flat(nodes, "node")[order], _codes(nodes, key[0].as_py())[order]
        aim = _codes(asked, key[0].as_py())
        parts = []
        lists = [np.split(_flat(asked, c), np.cumsum(_lengths(asked, c))[:-1]) for c in ("ids", "sims", "opened", "cands")]
        for i, (ids, sims, opened, cands) in enumerate(zip(*lists)):
            cands = np.setdiff1d(cands, ids)
            ids = np.r_[ids, cands]
            sims = np.r_[sims, x[np.searchsorted(names, cands)] @ aim[i]].astype(np.float32)
            opened = np.r_[opened, np.zeros(len(cands), dtype=bool)].astype(bool)
            best = np.lexsort((ids, -sims))[:beam]
            parts.append((ids[best], sims[best], opened[best]))
        offsets = pa.array(np.r_[0, np.cumsum([len(p[0]) for p in parts])].astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c), type=f.type.value_type))
                   for c, f in zip(zip(*parts), list(schema)[3:])]
        dims = pa.array(np.full(len(parts), key[0].as_py(), dtype=np.int32))
        return pa.table([asked.column("q").combine_chunks(), dims, asked.column("code").combine_chunks(), *columns], schema=schema)

    return work


def search(
    starts: DataFrame, lists: DataFrame, coded: DataFrame, beam: int, rounds: int, block_queries: int, least: float,
) -> DataFrame:
    """The beams in the end of every node ``starts(q)``: ``q, ids``, the most similar first.

    Rounds end when fewer nodes than ``least`` a query are left to open.
    """
    _, schema = arrow_schema(_BEAM)
    n = starts.count()
    blocks = max(coded.sparkSession.sparkContext.defaultParallelism, -(-n // block_queries))
    none = F.array()
    asked = (
        coded.select(F.col("node").alias("q"), "dim", "code").join(starts, "q")
        .join(lists.select(F.col("node").alias("q"), "cands"), "q", "left").select(
            "q", "dim", "code", none.cast("array<bigint>").alias("ids"), none.cast("array<float>").alias("sims"),
            none.cast("array<boolean>").alias("opened"),
            F.concat(F.array("q"), F.coalesce("cands", none.cast("array<bigint>"))).alias("cands")))
    nodes = coded.select("node", "code")
    closed = F.filter(F.arrays_zip("ids", "opened"), lambda e: ~e["opened"])
    for _ in range(rounds):
        asked = asked.withColumn("block", _number(F.col("q"), blocks))
        needed = asked.select("dim", "block", F.explode("cands").alias("node")).distinct()
        found = stored(
            asked.groupBy("dim", "block").cogroup(_apart(needed.join(nodes, "node")).groupBy("dim", "block"))
            .applyInArrow(_open(beam, schema), _BEAM), "graph-beams")
        left = found.agg(F.sum(F.size(closed))).first()[0] or 0
        if left <= least * n:
            break
        front = found.select("q", F.explode(closed).alias("e")).select("q", F.col("e.ids").alias("node"))
        fetched = (
            front.join(lists.select("node", "cands"), "node").groupBy("q")
            .agg(F.array_distinct(F.flatten(F.collect_list("cands"))).alias("cands")))
        # Queries without anything left to open stay as they are.
        asked = found.join(fetched, "q", "left").select(
            "q", "dim", "code", "ids", "sims", F.transform("opened", lambda o: F.lit(True)).alias("opened"),
            F.coalesce("cands", none.cast("array<bigint>")).alias("cands"))
    return found.select("q", "ids")


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", step: int = 20, k: int = 20,
    degree: int = 48, beam: int = 96, tables: int = 16, cell: int = 512, first: int = 12, least: float = 0.01,
    rounds: int = 12, search_rounds: int = 30, unopened: float = 0.2, block_bytes: int = 128 << 20, block_queries: int = 4_096, seed: int = 37,
) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id ``step`` divides."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col)
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<double>"))
    sound = (
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    rows = stored(rows.where(sound).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))), "graph-rows")
    classes, coded, n = _nodes(rows, tables, cell, seed)
    lists = build(coded, n, degree, cell, first, least, rounds, block_bytes)
    placed = stored(rows.join(classes, "vector").select("vec_id", "node"), "graph-members")
    by_id = W.partitionBy("node").orderBy("vec_id")
    members = placed.distinct().withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).drop("place")
    queries = placed.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).distinct()
    beams = search(queries.select("q").distinct(), lists, coded, beam, search_rounds, block_queries, unopened)
    near = beams.select("q", F.explode(F.slice("ids", 1, k + 12)).alias("node"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)
    scored = (
        near.join(classes.select("node", F.col("vector").alias("a")), "node")
        .join(classes.select(F.col("node").alias("q"), F.col("vector").alias("b")), "q").select("q", "node", dot.alias("score")))
    order = [F.desc("score"), "vec_id"]
    best = (
        scored.join(members, "node").withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(*order)))
        .where(F.col("place") <= k + 1).select("q", "vec_id", "score"))
    return (
        queries.join(best, "q").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

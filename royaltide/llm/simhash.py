"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed beside the scan and reduced to distinct ones before
anything is compared, so exact copies cost one entry. A fingerprint of 64 bits is
cut into ``segments`` parts. If two fingerprints differ in at most ``distance``
bits, some part differs in at most ``distance // segments`` bits: every part's
small Hamming ball is enumerated, looked up in the table of that part's values, and
the complete distance is verified inside the join, which therefore only passes on
true links.

Defined cases: a null, empty or blank text has no words and fingerprint zero, which
links like any other; repeated rows each get a row; a row with a null id keeps its
fingerprint, and its component is the smallest id reachable (null if there is none).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import doc_texts, map_slices, q, slices, stored, whole_groups
from royaltide.llm.components import connected_components

BITS = 64


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    count = len(words) - span + 1
    pairs = zip(starts[:count].tolist(), ends[span - 1:].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), dtype=">u8", count=count)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, 65_536):
        part = hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed 64-bit number."""

    def make():
        return lambda batch: [batch.column(0), [fingerprint(t) for t in batch.column(1).to_pylist()]]

    return map_slices(doc_texts(docs, id_col, text_col), make, "doc_id bigint, fp bigint")


def _balls(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits among ``width``."""
    masks = [0]
    frontier = [(0, 0)]
    for _ in range(radius):
        frontier = [(m | 1 << i, i + 1) for m, low in frontier for i in range(low, width)]
        masks += [m for m, _ in frontier]
    return masks


def links(codes: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of different codes ``fp``, a < b, at Hamming distance up to ``distance``."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    radius = distance // segments
    fp = F.col("fp")

    def part(i: int) -> Column:
        width = cuts[i + 1] - cuts[i]
        return F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1))

    entries = codes.select(
        fp.alias("b"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("part"), part(i).alias("key")) for i in range(segments)])).alias("e"),
    ).select("b", "e.part", "e.key")

    def ball(i: int) -> Column:
        masks = F.array(*[F.lit(m).cast("bigint") for m in _balls(cuts[i + 1] - cuts[i], radius)])
        keys = F.transform(masks, lambda m: part(i).bitwiseXOR(m))
        return F.transform(keys, lambda k: F.struct(F.lit(i).alias("part"), k.alias("key")))

    asked = codes.select(
        fp.alias("a"), F.explode(F.concat(*[ball(i) for i in range(segments)])).alias("e")
    ).select("a", "e.part", "e.key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return (
        asked.alias("x").join(
            entries.alias("y"),
            (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key"))
            & (F.col("a") < F.col("b")) & near,
        ).select("a", "b").distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    distance: int = 4, segments: int = 3,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    codes = marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    joined = connected_components(links(codes.select("fp"), distance, segments))
    named = joined.join(codes, joined["node"] == codes["fp"]).select("fp", "component", "smallest")
    lowest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    linked = named.join(lowest, "component").select("fp", "component_id")
    labels = codes.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "smallest").alias("component_id"))
    return marked.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by shingle similarity ------------------------------------------------

#: A first word of 64 bits stands for the whole in buckets: pairs up to LOOSE bits may be verified, TIGHT ones are likely links.
LOOSE, TIGHT, SMALL, LEADERS, NEAREST = 18, 8, 64, 2, 4


def shingles(text: str, width: int) -> tuple[bytes, np.ndarray]:
    """The words of a text joined by spaces, and the different 64-bit hashes of its shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.empty(0, dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words))
    count = len(words) - span + 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:count].tolist(), ends[span - 1:].tolist())
    return joined, np.unique(np.fromiter((digest(joined[a:b]) for a, b in pairs), dtype=np.uint64, count=count))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``64 * words`` bits; each word mixes the hashes anew."""
    ones = np.zeros(64 * words, dtype=np.int64)
    step = max(1, min(65_535, (1 << 20) // (64 * words)))
    salts = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(hashes), step):
        x = hashes[at:at + step, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def plan_segments(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a segment and number of segments for ``n`` fingerprints.

    A segment has so many bits that chance puts a few fingerprints into a bucket, whatever ``n``; there
    are so many of them that a pair at the limit shares one with probability ``recall``.
    """
    cosine = 2 * similarity / (1 + similarity)
    same = 1 - np.arccos(cosine) / np.pi
    bits = int(np.clip(np.ceil(np.log2(max(n, 2))) - 2, 6, 40))
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - same ** bits)))


def _bucket_edges(
    nodes: np.ndarray, word: np.ndarray, start: np.ndarray, size: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs of a sorted table of buckets that are to be verified first, and which buckets have more.

    A row that is TIGHT to an earlier one of its bucket is covered. Each row is paired with the
    first row that covers it and with the first LEADERS uncovered ones up to LOOSE bits away, so that a crowd of near
    copies gives a few pairs a row, mostly the same ones in every bucket, and not all pairs. A bucket that has
    further pairs up to LOOSE bits is marked; :func:`_across` finds those that may still matter.
    """
    out = []
    more = size > SMALL

    def pairs(these: np.ndarray, row: np.ndarray, there: np.ndarray) -> None:
        codes = word[row]
        apart = np.bitwise_count(codes[:, :, None] ^ codes[:, None, :])
        apart[~(there[:, :, None] & there[:, None, :])] = 255
        earlier = np.tril(np.ones(apart.shape[1:], dtype=bool), -1)
        tight = (apart <= TIGHT) & earlier
        covered = tight.any(2)
        first = tight.argmax(2)
        g, i = np.nonzero(covered)
        out.append(np.c_[nodes[row[g, i]], nodes[row[g, first[g, i]]]])
        near = (apart <= LOOSE) & ~covered[:, None, :] & earlier
        near &= np.cumsum(near, axis=2, dtype=np.int16) <= LEADERS
        taken = near.copy()
        g, i = np.nonzero(covered)
        taken[g, i, first[g, i]] = True
        more[these] = (((apart <= LOOSE) & earlier) & ~taken).any((1, 2))
        g, i, j = np.nonzero(near)
        out.append(np.c_[nodes[row[g, i]], nodes[row[g, j]]])

    for width in (2, 4, 8, 16, 32, SMALL):
        fitting = np.flatnonzero((size <= width) & (size > width // 2))
        step = max(1, (1 << 20) // (width * width))
        for at in range(0, len(fitting), step):
            these = fitting[at:at + step]
            begin, n = start[these], size[these]
            there = np.arange(width) < n[:, None]
            pairs(these, np.where(there, begin[:, None] + np.arange(width), 0), there)
    for begin, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        leaders = np.empty(0, dtype=np.int64)
        at = begin
        while at < begin + n:
            # So many rows that their distances to all leaders fit a few megabytes.
            rows = np.arange(at, min(at + max(1, min(512, (1 << 21) // (len(leaders) + 512))), begin + n))
            at += len(rows)
            # The leaders before this part, then the part itself.
            all_rows = np.r_[leaders, rows]
            apart = np.bitwise_count(word[rows][:, None] ^ word[all_rows][None, :])
            earlier = all_rows[None, :] < rows[:, None]
            tight = (apart <= TIGHT) & earlier
            covered = tight.any(1)
            out.append(np.c_[nodes[rows[covered]], nodes[all_rows[tight.argmax(1)[covered]]]])
            uncovered = np.r_[np.ones(len(leaders), dtype=bool), ~covered]
            near = (apart <= LOOSE) & earlier & uncovered[None, :]
            near &= np.cumsum(near, axis=1) <= LEADERS
            i, j = np.nonzero(near)
            out.append(np.c_[nodes[rows[i]], nodes[all_rows[j]]])
            leaders = np.r_[leaders, rows[~covered]]
    return out, more


def _candidates(batches):
    """First pairs ``(a, b)`` of the buckets, and the rows ``(key, a, word)`` of those that have more."""
    for table, start in whole_groups(batches, ["key"], 65_536):
        size = np.diff(np.r_[start, table.num_rows])
        nodes, word = table.column("node").to_numpy(), table.column("word").to_numpy().view(np.uint64)
        found, more = _bucket_edges(nodes, word, start, size)
        edges = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        if len(edges):
            edges = np.unique(np.sort(edges, axis=1), axis=0)
            none = pa.nulls(len(edges), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(edges[:, 0]), pa.array(edges[:, 1]), none], names=["key", "a", "b", "word"])
        if more.any():
            rows = table.filter(pa.array(np.repeat(more, size))).combine_chunks()
            key, node, words = (rows.column(c).combine_chunks() for c in ("key", "node", "word"))
            yield pa.RecordBatch.from_arrays([key, node, pa.nulls(len(key), pa.int64()), words], names=["key", "a", "b", "word"])


def _likely(pairs: tuple[np.ndarray, np.ndarray], total: np.ndarray, shared: np.ndarray, codes: np.ndarray, similarity: float, most: int):
    """The pairs ``(i, j)`` of rows of different parts that can reach the similarity, and the distances of their codes, ``most`` at most.

    ``total`` counts a row's shingles, ``shared`` those that rows of several parts have; only these can be in both.
    """
    i, j = pairs
    common = np.minimum(shared[i], shared[j])
    can = common >= similarity * (total[i] + total[j] - common)
    i, j = i[can], j[can]
    apart = np.zeros(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 16):
        to = at + (1 << 16)
        apart[at:to] = np.bitwise_count(codes[i[at:to]] ^ codes[j[at:to]]).sum(axis=1, dtype=np.int64)
    return i[apart <= most], j[apart <= most], apart[apart <= most]


def _across(batches, similarity: float = 0.0, most: int = 0, nearest: int = 0):
    """All pairs up to LOOSE bits of rows ``(key, part, node, word)`` in one bucket and different parts.

    With ``total``, ``shared`` (see :func:`across_parts`) and ``code`` in the rows, only pairs that can reach ``similarity``
    and whose codes are ``most`` bits apart at most; of each row's pairs the ``nearest`` by code, if given.
    """
    for table, start in whole_groups(batches, ["key"], 65_536):
        part, nodes = table.column("part").to_numpy(), table.column("node").to_numpy()
        word = table.column("word").to_numpy().view(np.uint64)
        if similarity:
            total, shared = table.column("total").to_numpy(), table.column("shared").to_numpy()
            codes = table.column("code").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        for begin, end in zip(start.tolist(), [*start[1:].tolist(), table.num_rows]):
            # Rows are sorted by part: each meets the rows of earlier parts only, or of all others to find its nearest.
            firsts = np.r_[begin, begin + 1 + np.flatnonzero(np.diff(part[begin:end])), end]
            if len(firsts) == 2:
                continue
            for low, high in [(end, end)] if nearest else zip(firsts[1:-1].tolist(), firsts[2:].tolist()):
                step = max(1, (1 << 21) // (low - begin))
                for at in range(begin if nearest else low, high, step):
                    # So many rows that their distances fit a few megabytes, or one with slices of the others.
                    rows = np.arange(at, min(at + step, high))
                    for there in range(begin, low, 1 << 21):
                        other = np.arange(there, min(there + (1 << 21), low))
                        close = np.bitwise_count(word[rows][:, None] ^ word[other][None, :]) <= LOOSE
                        if nearest:
                            close &= part[rows][:, None] != part[other][None, :]
                        i, j = np.nonzero(close)
                        i, j = rows[i], other[j]
                        if similarity:
                            i, j, apart = _likely((i, j), total, shared, codes, similarity, most)
                        if nearest and len(i):
                            order = np.lexsort((j, apart, i))
                            i, j = i[order], j[order]
                            place = np.arange(len(i)) - np.searchsorted(i, i)
                            i, j = i[place < nearest], j[place < nearest]
                        if len(i):
                            edges = np.sort(np.c_[nodes[i], nodes[j]], axis=1)
                            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])


def across_parts(spelt: DataFrame, similarity: float, rounds: int = 6) -> DataFrame:
    """``(node, part, hashes, shared)`` of the rows ``(node, part, hashes)`` that may be linked with one of another part.

    ``shared`` counts the hashes of a row that rows of other parts have too. What two rows of different parts have in common is
    among those, and the union is no smaller than either, so a row with less than ``similarity`` of its hashes
    shared has no link; without it fewer hashes are shared, so the rest is looked at again until few rows leave. Rows
    and hashes are counted by the cluster, no pair is made.
    """
    alive, left = spelt, None
    for _ in range(rounds):
        listed = alive.select("node", "part", F.explode("hashes").alias("h"))
        several = listed.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("h")
        shared = listed.join(several, "h", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
        alive = stored(
            alive.drop("shared").join(shared, "node").where(F.col("shared") >= similarity * F.size("hashes"))
            .select("node", "part", "hashes", "shared"), "copy-parts")
        before, left = left, alive.count()
        if not left or before and left > 0.9 * before:
            break
    return alive


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.95,
) -> DataFrame:
    """``(doc_id, component_id)`` for every row: groups linked by ``width``-word shingles of Jaccard similarity ``similarity``.

    Texts of equal words are one class. Fingerprints wide enough for the similarity are cut into segments, whose
    equal values (balls of radius 0: with many narrow segments, fewer rows than larger balls in few) give the pairs;
    the first word of the fingerprints, then their complete distance, then the exact similarity of the shingles verify
    them. Pairs at the limit meet with probability ``recall``, closer ones more often; no link is made below the limit.
    Before components are sought, each text goes to the smallest it is linked with, so that of the links of
    a crowd few are left. Crowded buckets give a few pairs a row at first; then all their pairs between
    different groups of the first links are verified too, so that no link that could join groups is left out, but for
    those that :func:`across_parts` rules out by the shingles of each text that no other group has.
    """
    rows = doc_texts(docs, id_col, text_col)
    bits, segments = plan_segments(rows.count(), similarity, recall)
    wide = -(-bits * segments // 64)

    def prints():
        def work(batch):
            digests, codes = [], []
            for text in batch.column(1).to_pylist():
                joined, hashes = shingles(text, width)
                digests.append(hashlib.blake2b(joined, digest_size=16).digest())
                codes.append(wide_fingerprint(hashes, wide).view(np.int64) if len(hashes) else [])
            return [batch.column(0), digests, codes]

        return work

    # One scan gives all that texts are compared by at first; of the texts themselves only candidates move later.
    marked = stored(map_slices(rows, prints, "doc_id bigint, words binary, code array<bigint>"), "copies")
    named = marked.select("doc_id", "words")
    classes = stored(
        marked.groupBy("words").agg(F.min("doc_id").alias("smallest"), F.first("code").alias("code"))
        .select(F.monotonically_increasing_id().alias("node"), "words", "smallest", "code"), "copy-classes")
    codes = classes.where("smallest is not null and size(code) > 0").select("node", "code")

    def entries(batches):
        at = np.arange(segments)[:, None] * bits + np.arange(bits)
        weights, place = np.int64(1) << np.arange(bits, dtype=np.int64), np.arange(segments, dtype=np.int64) << np.int64(bits)
        for batch in batches:
            codes = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, wide)
            for cut in range(0, batch.num_rows, 1000):
                part = codes[cut:cut + 1000]
                values = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1)[:, at] @ weights + place
                nodes = batch.column(0).slice(cut, len(part)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.ravel()), pa.array(np.repeat(nodes, segments)), pa.array(np.repeat(part[:, 0], segments))],
                    names=["key", "node", "word"])

    buckets = codes.mapInArrow(entries, "key bigint, node bigint, word bigint")
    met = stored(
        buckets.repartition("key").sortWithinPartitions("key", "node")
        .mapInArrow(_candidates, "key bigint, a bigint, b bigint, word bigint"), "copy-meetings")
    # Four standard deviations beyond the share of bits in which a pair at the limit differs.
    apart = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = int(64 * wide * apart + 4 * np.sqrt(64 * wide * apart * (1 - apart)))
    differ = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)

    def same_words(batches):
        for batch in batches:
            right = [hashlib.blake2b(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), digest_size=16).digest() == w
                     for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.select(["node", "text"]).filter(pa.array(right, pa.bool_()))

    def alike(batches):
        for batch in batches:
            keep = []
            known: dict[str, set] = {}
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                for text in (a, b):
                    if text not in known:
                        known[text] = set(shingles(text, width)[1].tolist())
                shared = len(known[a] & known[b])
                keep.append(shared >= similarity * (len(known[a]) + len(known[b]) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def texts_of(nodes: DataFrame) -> DataFrame:
        asked = nodes.join(classes.select("node", "words", F.col("smallest").alias("doc_id")), "node")
        # An id may stand for several texts; the one of the class counts, once.
        return (
            rows.join(asked, "doc_id").select("node", "text", "words").mapInArrow(same_words, "node bigint, text string")
            .dropDuplicates(["node"]))

    def spelt(batches):
        for batch in slices(batches):
            hashes = [shingles(text, width)[1].view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "hashes"])

    def verified(pairs: DataFrame) -> DataFrame:
        found = stored(
            pairs.join(codes.select(F.col("node").alias("a"), F.col("code").alias("p")), "a")
            .join(codes.select(F.col("node").alias("b"), F.col("code").alias("q")), "b").where(differ <= most).select("a", "b"), "copy-pairs")
        texts = stored(texts_of(found.select(F.col("a").alias("node")).union(found.select("b")).distinct()), "copy-texts")
        paired = (
            found.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b"))
        return stored(paired.select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint"), "copy-links")

    def grouped(linked: DataFrame) -> DataFrame:
        both = linked.union(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")), "copy-leads")
        leads = (
            linked.join(least.select(F.col("node").alias("a"), F.col("m").alias("x")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("m").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        joined = connected_components(leads).withColumnRenamed("node", "m")
        return least.join(joined, "m", "left").select("node", F.coalesce("component", "m").alias("component"))

    tried = met.where("key is null").select("a", "b").distinct()
    groups = stored(grouped(verified(tried)), "copy-groups")
    crowded = met.where("key is not null").select("key", F.col("a").alias("node"), "word")
    texts = texts_of(crowded.select("node").distinct()).select("node", "text")
    alive = stored(texts.mapInArrow(spelt, "node bigint, hashes array<bigint>"), "copy-shingles")
    # The nearest rows of other groups first: what they join needs no further pair. Then all that are left.
    for nearest in (NEAREST, 0):
        parts = alive.select("node", "hashes").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "hashes")
        alive = across_parts(parts, similarity)
        able = alive.select("node", "part", F.size("hashes").cast("bigint").alias("total"), "shared").join(codes, "node")

        def across(batches, nearest=nearest):
            return _across(batches, similarity, most, nearest)

        pairs = stored(
            crowded.join(able, "node").repartition("key").sortWithinPartitions("key", "part", "node")
            .mapInArrow(across, "a bigint, b bigint").distinct().join(tried, ["a", "b"], "left_anti"), "copy-meetings")
        tried = tried.union(pairs)
        # The groups found stand for their links.
        groups = stored(grouped(verified(pairs).union(groups.where("node <> component").select("node", "component"))), "copy-groups")
    smallest = groups.join(classes.select("node", "smallest"), "node")
    lowest = smallest.groupBy("component").agg(F.min("smallest").alias("component_id"))
    labels = classes.join(groups.join(lowest, "component"), "node", "left").select(
        "words", F.coalesce("component_id", "smallest").alias("component_id"))
    return named.join(labels, "words").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of :func:`near_copies`, the one with the smallest id; all columns are kept.

    Rows with a null id have no place in a group and stay. Of rows that
    repeat the id that stays, all stay.
    """
    groups = near_copies(docs, id_col, text_col, **options)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    name = "gone_id"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return docs.join(gone.withColumnRenamed("doc_id", name), q(id_col) == F.col(name), "left_anti")

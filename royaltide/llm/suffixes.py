"""Exact repeated substrings by sharded suffix arrays, built by induced sorting.

Every string of ``length`` bytes holds an anchor: the ``ANCHOR``-byte window of smallest hash
in it. Anchors depend on content alone, so equal strings hold equal anchors at the same
offset. Anchors seen once, counted by hash, cannot carry a repeat and are dropped before anything else is
kept of them. The fragment of an anchor is what the strings that it stands for reach. Equal
fragments that occur twice are repeated from end to end; anchors with
several different fragments are dealt to shards of bounded size; what shares a core around the
anchor with another fragment goes into a suffix array, and permuted common prefixes show
which strings start at least twice. An anchor with more than
``hot`` different fragments would make a shard of its own grow, so the digests of its strings are
counted by the cluster instead, for each offset of the anchor in the string; both ways count the same strings.

Texts are named by a 64-bit digest and their size, fragments by anchor and a 64-bit digest; strings of busy
anchors by 128 bits. Texts are read in pieces of ``PIECE`` bytes, so a very long one needs no more memory.

Defined cases: a null text is empty; texts under ``length`` bytes are kept whole; repeated
rows are copies of each other; ids may be null or repeat; empty tables give empty results; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import arrow_schema, doc_texts, map_slices, stored

LENGTH, ANCHOR = 200, 64
#: Bytes that are looked at together; the arrays over them stay in a core's cache.
PIECE = 1 << 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative numbers by induced sorting; an end smaller than all is implied."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    size = int(s.max()) + 1
    # A suffix is smaller (S) if its next different number is larger; the last suffix is L.
    change = np.flatnonzero(s[:-1] != s[1:])
    rises = np.append(s[change] < s[change + 1], False)
    small = np.repeat(rises, np.diff(np.concatenate(([-1], change, [n - 1]))))
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    heads = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=size))))
    if n > 64 * size:
        induce, (order, reduced) = _induce_buckets, _names_by_inducing(s, small, leftmost, heads)
    else:
        induce, (order, reduced) = _induce_symbols, _names_by_sorting(s, leftmost)
    if order is None:
        order = leftmost[suffix_array(reduced)]
    return induce(s, small, order, heads)


def _names_by_sorting(s: np.ndarray, leftmost: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Order of the leftmost small suffixes if their substrings differ, and the rank of each substring.

    A substring goes from one leftmost S to the next: a mark above every value ends each, as after the
    same values an L comes before an S; the last one meets the end of all.
    """
    raw = (s + 1).astype(">u4").tobytes()
    begin, stop = (4 * leftmost).tolist(), (4 * (leftmost[1:] + 1)).tolist()
    pieces = [raw[i:j] + b"\xff\xff\xff\xff" for i, j in zip(begin, stop)]
    pieces += [raw[i:] + b"\0\0\0\0" for i in begin[-1:]]
    names = {piece: k for k, piece in enumerate(sorted(set(pieces)))}
    reduced = np.fromiter(map(names.__getitem__, pieces), dtype=np.int64, count=len(pieces))
    return (leftmost[np.argsort(reduced)] if len(names) == len(pieces) else None), reduced


def _names_by_inducing(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The same for a long input of few symbols: inducing from the unsorted ones sorts the substrings."""
    if not len(leftmost):
        return leftmost, leftmost
    number = np.full(len(s), -1)
    number[leftmost] = np.arange(len(leftmost))
    found = _induce_buckets(s, small, leftmost[np.argsort(s[leftmost], kind="stable")], heads)
    ranked = number[found]
    ranked = ranked[ranked >= 0]
    # Substrings reach up to the next leftmost S; the last one is like no other.
    size = np.append(np.diff(leftmost) + 1, 0)[ranked]
    at = leftmost[ranked]
    same = np.concatenate(([False], (size[1:] == size[:-1]) & (size[1:] > 0)))
    k, open_ = 0, np.flatnonzero(same)
    while len(open_):
        differ = s[at[open_] + k] != s[at[open_ - 1] + k]
        same[open_[differ]] = False
        k += 1
        open_ = open_[~differ]
        open_ = open_[size[open_] > k]
    names = np.cumsum(~same) - 1
    reduced = np.empty(len(leftmost), dtype=np.int64)
    reduced[ranked] = names
    return (at if names[-1] + 1 == len(leftmost) else None), reduced


def _induce_symbols(s: np.ndarray, small: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the leftmost small ones, symbol by symbol."""
    n = len(s)
    values = s.tolist()
    out, ends = [n] * n, heads[1:].tolist()
    for i in reversed(order.tolist()):
        c = values[i]
        ends[c] -= 1
        out[ends[c]] = i
    starts = heads[:-1].tolist()
    last = values[n - 1]
    out[starts[last]] = n - 1
    starts[last] += 1
    # What stands before each place, if of the kind that is induced; an unset place holds n, which has nothing.
    place = np.arange(-1, n - 1)
    before = np.append(np.where(small[place], -1, place), -1)
    before[0] = -1
    before = before.tolist()
    # The list grows under the scan's eyes.
    for i in out:
        j = before[i]
        if j >= 0:
            c = values[j]
            out[starts[c]] = j
            starts[c] += 1
    before = np.where(small[place], place, -1)
    before[0] = -1
    before = before.tolist()
    ends = heads[1:].tolist()
    for i in reversed(out):
        j = before[i]
        if j >= 0:
            c = values[j]
            ends[c] -= 1
            out[ends[c]] = j
    return np.array(out)


def _induce_buckets(s: np.ndarray, small: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The same, a bucket at a time: what a bucket's suffixes induce is dealt to the buckets by one stable sort.

    A bucket is read again as long as it induces into itself, which only runs of one symbol do.
    """
    n = len(s)
    out = np.zeros(n, dtype=np.int32)
    keys = s.astype(np.uint16 if len(heads) < 1 << 16 else np.int32)
    firsts = np.searchsorted(s[order], np.arange(len(heads))).tolist()
    order, heads, count_up = order.astype(np.int32), heads.astype(np.int32), np.arange(n, dtype=np.int32)
    # What stands before each place, if of the kind that is induced.
    place = np.arange(-1, n - 1, dtype=np.int32)
    large_before, small_before = np.where(small[place], -1, place), np.where(small[place], place, -1)
    large_before[0] = small_before[0] = -1

    def deal(found: np.ndarray, ends: np.ndarray, step: int) -> None:
        found = found[found >= 0]
        size = len(found)
        if not size:
            return
        sign = keys[found]
        by_sign = sign.argsort(kind="stable")
        found, sign = found[by_sign], sign[by_sign]
        last = np.empty(size, dtype=bool)
        last[-1] = True
        np.not_equal(sign[1:], sign[:-1], out=last[:-1])
        edge = last.nonzero()[0]
        sign, count = sign[edge], edge + 1
        count[1:] -= edge[:-1] + 1
        # The first of each sign goes to the next place of its bucket, the others behind it.
        if step > 0:
            out[(ends[sign] - (edge + 1 - count)).repeat(count) + count_up[:size]] = found
            ends[sign] += count.astype(np.int32)
        else:
            out[(ends[sign] - 1 + (edge + 1 - count)).repeat(count) - count_up[:size]] = found
            ends[sign] -= count.astype(np.int32)

    starts = heads[:-1].copy()
    last = n - 1
    out[starts[s[last]]] = last
    starts[s[last]] += 1
    for c in range(len(starts)):
        read = heads[c]
        while read < starts[c]:
            fresh, read = large_before[out[read:starts[c]]], starts[c]
            deal(fresh, starts, 1)
        if firsts[c] < firsts[c + 1]:
            deal(large_before[order[firsts[c]:firsts[c + 1]]], starts, 1)
    ends = heads[1:].copy()
    for c in reversed(range(len(starts))):
        read = heads[c + 1]
        while read > ends[c]:
            fresh, read = small_before[out[ends[c]:read][::-1]], ends[c]
            deal(fresh, ends, -1)
        if heads[c] < starts[c]:
            deal(small_before[out[heads[c]:starts[c]][::-1]], ends, -1)
    return out.astype(np.int64)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, run: int = 64) -> np.ndarray:
    """For each place in ``sa``: common prefix with the suffix before, up to ``most``, by the permuted array.

    In text order the prefix loses one symbol per step while the suffix before moves along over
    equal symbols, so symbols are compared at the first place of each such run only (runs are
    cut after ``run``).
    """
    n, width = len(s), most + run
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    same = (before[:-1] >= 0) & (s[:-1] == s[np.maximum(before[:-1], 0)])
    along = np.concatenate(([False], (before[1:] == before[:-1] + 1) & same))
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(along, 0, place))
    first = np.flatnonzero(since % run == 0)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([s, np.full(width, -1)]).astype(np.int32), width)
    found = np.zeros(len(first), dtype=np.int64)
    for at in range(0, len(first), 2048):
        i = first[at:at + 2048]
        differ = rows[i] != rows[before[i]]
        found[at:at + 2048] = np.where(differ.any(1), differ.argmax(1), width)
    found[before[first] < 0] = 0
    plcp = found[np.cumsum(since % run == 0) - 1] - since % run
    return np.clip(plcp, 0, most)[sa]


def _mix(seed: int) -> tuple[np.ndarray, list[int]]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            (rng.integers(0, 2**62, 8, dtype=np.uint64) * np.uint64(4) + np.uint64(3)).tolist())


TABLE, FACTORS = _mix(17)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every ``width`` neighbours, by doubling."""
    out, done = x, 1
    while 2 * done <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[:len(x) - width + 1], out[width - done:]) if done < width else out


def anchors(data: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of some texts that stand side by side and end at ``ends``.

    Every window that is least in some string is an anchor, ties included. Also the first and last start of
    the strings in which it is.
    """
    reach, none = length - ANCHOR + 1, np.empty(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    h, width = TABLE[np.frombuffer(data, dtype=np.uint8)], 1
    for k in range(6):
        h = h[:-width] * np.uint64(FACTORS[k]) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(FACTORS[7])
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    least = _sliding(h, reach, np.minimum)
    # Strings across the end of a text count for none.
    fits = np.ones(len(least) + 1, dtype=np.int8)
    begins = np.concatenate(([0], ends[:-1]))
    np.subtract.at(fits, np.minimum(np.maximum(ends - length + 1, begins), len(least)), 1)
    np.add.at(fits, np.minimum(ends, len(least)), 1)
    least[np.cumsum(fits.astype(np.int64) - 1)[:-1] < 0] = 0
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, reach, np.maximum) == h)
    # Runs of starts with one least value, and the anchors of that value that their strings hold.
    edge = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    value, first = least[edge], edge
    last = np.append(edge[1:], len(least)) - 1
    first, last, value = first[value > 0], last[value > 0], value[value > 0]
    low, high = np.searchsorted(at, first), np.searchsorted(at, last + reach - 1, "right")
    run = np.repeat(np.arange(len(first)), high - low)
    place = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[run]
    own = h[at[place]] == value[run]
    run, at = run[own], at[place[own]]
    begin, end = np.maximum(first[run], at - reach + 1), np.minimum(last[run], at)
    good = begin <= end
    return at[good], h[at[good]].view(np.int64), begin[good], end[good]


def _numbers(parts, seeds=None) -> np.ndarray:
    """64-bit digests as longs."""
    seeds = seeds if seeds is not None else repeat(0)
    return np.array([xxhash.xxh3_64_intdigest(part, seed) for part, seed in zip(parts, seeds)], dtype=np.uint64).view(np.int64)


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _buffers(texts: list[bytes], length: int):
    """Texts side by side, about PIECE bytes at a time: ``(number, first byte, bytes)``; long texts overlap by a string."""
    held, size = [], 0
    for number, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - length + 1), PIECE):
            piece = raw[at:at + PIECE + length - 1]
            if len(piece) < length:
                continue
            held.append((number, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _found(texts: list[bytes], length: int):
    """``(numbers, hashes, places, first starts, last starts)`` of the anchors, buffer by buffer."""
    for held in _buffers(texts, length):
        sizes = np.array([len(piece) for _, _, piece in held])
        ends = np.cumsum(sizes)
        at, hashes, low, high = anchors(b"".join(piece for _, _, piece in held), ends, length)
        owner = np.searchsorted(ends, at, "right")
        shift = np.array([first for _, first, _ in held])[owner] - (ends - sizes)[owner]
        yield np.array([number for number, _, _ in held])[owner], hashes, at + shift, low + shift, high + shift


def repeated_anchors(rows: DataFrame, length: int) -> DataFrame:
    """``anchor`` of those seen at two places or more, by their hash alone."""

    def make():
        def work(batch):
            texts = [_raw(t) for t in batch.column(1).to_pylist()]
            hashes = [np.empty(0, dtype=np.int64)] + [h for _, h, _, _, _ in _found(texts, length)]
            return list(np.unique(np.concatenate(hashes), return_counts=True))

        return work

    counted = map_slices(rows, make, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    return stored(counted.where("n > 1").select("anchor"), "anchors")


def anchor_table(rows: DataFrame, length: int) -> DataFrame:
    """``(text_key, size, place, anchor, frag)`` for every anchor.

    ``place`` packs the first start of its strings, how far behind it the anchor and the last start are;
    ``frag`` stands for the bytes of the fragment and the offset in it.
    """

    def make():
        def work(batch):
            texts = [_raw(t) for t in batch.column(1).to_pylist()]
            keys = _numbers(texts)
            sizes = np.array([len(t) for t in texts], dtype=np.int32)
            out = []
            for number, hashes, at, low, high in _found(texts, length):
                data = (texts[i][a:b] for i, a, b in zip(number.tolist(), low.tolist(), (high + length).tolist()))
                out.append((keys[number], sizes[number], low << 16 | (at - low) << 8 | high - low, hashes,
                            _numbers(data, (at - low).tolist())))
            return [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5

        return work

    return map_slices(rows, make, "text_key bigint, size int, place bigint, anchor bigint, frag bigint")


def repeated_starts(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``(anchor, offset, fragment)``: numbers and ranges of what their strings cover that start in another one too."""
    none = np.empty(0, dtype=np.int64)
    if not group:
        return none, none, none
    sizes = np.array([len(data) for _, _, data in group])
    ends = np.cumsum(sizes + 1)
    s = np.frombuffer(b"".join(data + b"\0" for _, _, data in group), dtype=np.uint8).astype(np.int64) + 1
    s[ends - 1] = 0
    owner = np.repeat(np.arange(len(group)), sizes + 1)
    place = np.arange(len(s)) - np.repeat(ends - sizes - 1, sizes + 1)
    hashes, offset = np.array([a for a, _, _ in group], dtype=np.int64), np.array([o for _, o, _ in group])
    # Starts of strings that hold the anchor.
    fits = (place + length <= sizes[owner]) & (place <= offset[owner]) & (place + length >= offset[owner] + ANCHOR)
    sa = suffix_array(s)
    run = np.cumsum(common_prefixes(s, sa, length) < length)
    good = fits[sa]
    run, sa = run[good], sa[good]
    several = np.concatenate((run[1:] == run[:-1], [False])) | np.concatenate(([False], run[1:] == run[:-1])) if len(run) else good[:0]
    run, sa = run[several], sa[several]
    own, at = owner[sa], place[sa]
    anchor, shift = hashes[own], at - offset[own]
    order = np.lexsort((shift, anchor, run))
    run, anchor, shift, own, at = (x[order] for x in (run, anchor, shift, own, at))
    again = (run[1:] == run[:-1]) & (anchor[1:] == anchor[:-1]) & (shift[1:] == shift[:-1])
    twice = np.concatenate((again, [False])) | np.concatenate(([False], again)) if len(run) else run.astype(bool)
    own, at = own[twice], at[twice]
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    apart = (own[1:] != own[:-1]) | (at[1:] > at[:-1] + length)
    first = np.flatnonzero(np.concatenate(([True], apart))) if len(own) else none
    last = np.append(first[1:], len(own)) - 1 if len(own) else none
    return own[first], at[first], at[last] + length


def _classes(length: int, classes: int = 8) -> tuple[int, list[tuple[int, int]]]:
    """Strings classed by how far they reach to the left of the anchor: the step, and the core that all of a class hold."""
    side = length - ANCHOR
    step = -(-side // classes)
    return step, [(c * step, max(0, side - (c + 1) * step)) for c in range(-(-side // step))]


def _cores(off: int, data: bytes, reach: list[tuple[int, int]]) -> list[tuple[int, bytes]]:
    return [(c, data[off - left:off + ANCHOR + right])
            for c, (left, right) in enumerate(reach) if off >= left and off + ANCHOR + right <= len(data)]


def shared_parts(group: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """``(number, low, high)`` of the fragments, and of their bytes, that can hold a string found in another one too.

    Equal strings need equal cores.
    """
    step, reach = _classes(length)
    cores = [[(anchor, c, core) for c, core in _cores(off, data, reach)] for anchor, off, data in group]
    count = Counter(core for own in cores for core in own)
    out = []
    for i, (_, off, data) in enumerate(group):
        found = [core[1] for core in cores[i] if count[core] > 1]
        if found:
            out.append((i, max(0, off - (found[-1] + 1) * step), min(len(data), off + length - found[0] * step)))
    return out


def fragments(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(anchor, frag, kinds, off, data)`` of the wanted ``(text_key, anchor, frag, place, kinds)``.

    A fragment is cut only from a text in which its digest is right, so texts that share a key do no harm.
    """
    places = wanted.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "frag", "place", "kinds")).alias("places"))
    joined = keyed_texts(rows, length).where(f"size >= {length}").select("text_key", "text").join(places, "text_key")
    struct, schema = arrow_schema("anchor bigint, frag bigint, kinds bigint, off int, data binary")

    def run(batches):
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1)):
                raw, found = _raw(text.as_py()), places.values
                anchor, frag, place, kinds = (found.field(c).to_numpy() for c in ("anchor", "frag", "place", "kinds"))
                low, off, more = place >> 16, place >> 8 & 255, place & 255
                data = [raw[a:b] for a, b in zip(low.tolist(), (low + more + length).tolist())]
                right = _numbers(data, off.tolist()) == frag
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[right]), pa.array(frag[right]), pa.array(kinds[right]), pa.array(off[right].astype(np.int32)),
                     pa.array([d for d, r in zip(data, right.tolist()) if r], pa.binary())], schema=schema)

    cut = joined.select("text", "places").mapInArrow(run, struct)
    # Copies of a text each give its fragments.
    return cut.dropDuplicates(["anchor", "frag"])


def keyed_texts(rows: DataFrame, length: int) -> DataFrame:
    """``(doc_id, text_key, size, text)``; texts too short for a string, which match nothing, are dealt out by their place."""

    def make():
        def work(batch):
            raws = [_raw(t) for t in batch.column(1).to_pylist()]
            size = np.array([len(r) for r in raws], dtype=np.int32)
            return [batch.column(0), np.where(size >= length, _numbers(raws), np.arange(len(raws))), size, batch.column(1)]

        return work

    return map_slices(rows, make, "doc_id bigint, text_key bigint, size int, text string")


def repeated_ranges(rows: DataFrame, length: int = LENGTH, hot: int = 1000, shard: int = 1200) -> DataFrame:
    """``(text_key, size, spans)``: byte ranges of each text that repeated strings cover."""
    # The anchors of a partition are a small even share of all, so they are hashed and the places not sorted.
    several_times = repeated_anchors(rows, length).hint("shuffle_hash")
    table = stored(anchor_table(rows, length).join(several_times, "anchor", "left_semi"), "places")
    kinds = stored(table.groupBy("anchor", "frag").agg(
        F.count("*").alias("n"), F.min("text_key").alias("text_key"), F.min_by("place", "text_key").alias("place")), "fragments")
    # Where every fragment occurs twice, all of them are repeated from end to end already.
    several = (
        kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("rarest"))
        .where("kinds > 1 and rarest = 1").drop("rarest")
    )
    wanted = kinds.join(several, "anchor").select("anchor", "frag", "text_key", "place", "kinds")
    cut = stored(fragments(rows, wanted, length), "cut")
    shards = max(1, cut.where(F.col("kinds") <= hot).count() // shard)

    def induced(group: pa.Table) -> pa.Table:
        group = group.sort_by([("anchor", "ascending"), ("frag", "ascending")])
        anchor, frag, off, data = (group.column(c).to_pylist() for c in ("anchor", "frag", "off", "data"))
        rows = list(zip(anchor, off, data))
        out = []
        # Batches end between anchors, so that the arrays of a shard stay small.
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or i - start >= shard and anchor[i] != anchor[i - 1]:
                part = shared_parts(rows[start:i], length)
                own, a, b = repeated_starts(
                    [(rows[start + k][0], rows[start + k][1] - low, rows[start + k][2][low:high]) for k, low, high in part], length)
                number = np.array([k for k, _, _ in part], dtype=np.int64)[own] + start
                low = np.array([low for _, low, _ in part], dtype=np.int64)[own]
                out.append((number, low + a, low + b))
                start = i
        number, a, b = (np.concatenate(c) for c in zip(*out))
        taken = group.select(["anchor", "frag"]).take(pa.array(number))
        return taken.append_column("a", pa.array(a.astype(np.int32))).append_column("b", pa.array(b.astype(np.int32)))

    normal = (
        cut.where(F.col("kinds") <= hot).withColumn("shard", F.pmod("anchor", F.lit(shards)))
        .groupBy("shard").applyInArrow(induced, "anchor bigint, frag bigint, a int, b int")
    )

    step, reach = _classes(length)
    crowded = cut.where(F.col("kinds") > hot)
    core_spec, string_spec = "anchor bigint, frag bigint, class int, core bigint", "anchor bigint, frag bigint, a int, shift int, string binary"
    (_, core_schema), (_, string_schema) = arrow_schema(core_spec), arrow_schema(string_spec)

    def cores(batches):
        for batch in batches:
            found = [(r["anchor"], r["frag"], c, core) for r in batch.to_pylist() for c, core in _cores(r["off"], r["data"], reach)]
            if found:
                *named, parts = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, f.type) for c, f in zip(named, core_schema)), pa.array(_numbers(parts))], schema=core_schema)

    def strings(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows = []
            for r in batch.to_pylist():
                lefts = {left for c in r["classes"] for left in range(c * step, (c + 1) * step + 1)}
                rows += [(r["anchor"], r["frag"], r["off"] - left, -left,
                          xxhash.xxh3_128_digest(r["data"][r["off"] - left:r["off"] - left + length]))
                         for left in lefts if 0 <= r["off"] - left <= len(r["data"]) - length]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), string_schema)], schema=string_schema)

    # Only strings whose core is shared are listed. A string may hold an anchor at several offsets, as all
    # its copies do; so copies are counted for each offset.
    listed_cores = crowded.select("anchor", "frag", "off", "data").mapInArrow(cores, core_spec)
    often = listed_cores.groupBy("anchor", "class", "core").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = listed_cores.join(often, ["anchor", "class", "core"]).groupBy("anchor", "frag").agg(F.collect_list("class").alias("classes"))
    listed = stored(
        crowded.join(kept, ["anchor", "frag"]).select("anchor", "frag", "off", "data", "classes").mapInArrow(strings, string_spec), "strings")
    twice = listed.groupBy("anchor", "shift", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    busy = listed.join(twice, ["anchor", "shift", "string"]).select("anchor", "frag", "a", (F.col("a") + length).alias("b"))
    whole = kinds.where("n > 1").select("anchor", "frag", F.lit(0).alias("a"), F.lit(3 * length).alias("b"))
    # All strings of a fragment hold its anchor, so together they cover one range.
    marks = stored(whole.union(normal).union(busy).groupBy("anchor", "frag").agg(F.min("a").alias("a"), F.max("b").alias("b")), "marks")
    low, more = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(255))
    return (
        table.join(marks, ["anchor", "frag"])
        .select("text_key", "size", (low + F.col("a")).cast("int").alias("a"),
                (low + F.least("b", more + length)).cast("int").alias("b"))
        .groupBy("text_key", "size").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    )


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def drop_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; ``kept`` are the remaining bytes."""
    rows = doc_texts(docs)
    spans = repeated_ranges(rows, length, **options)
    joined = keyed_texts(rows, length).join(spans, ["text_key", "size"], "left").select("doc_id", "text", "spans")

    def make():
        def work(batch):
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = _raw(text)
                cuts = merge((s["a"], s["b"]) for s in spans or [])
                kept, done = [], 0
                for a, b in cuts:
                    kept.append(raw[done:a])
                    done = b
                kept = b"".join([*kept, raw[done:]])
                out.append((doc, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
            return list(zip(*out)) if out else [[]] * 6

        return work

    return map_slices(joined, make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")

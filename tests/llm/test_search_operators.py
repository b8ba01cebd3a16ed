"""Conversation repair, hard negatives and graph search against brute force."""

import hashlib
import heapq
import re
import zlib
from functools import reduce

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from royaltide.llm import conversations, graph, negatives, queries

SF = "/root/testdata/sf0.001"
CONV = "conv_id bigint, turn bigint, role string, text string, cost long, none string"


# --- conversation repair -----------------------------------------------------------


def cheapest(codes):
    """Least (cost, audit) by Dijkstra over (row, roles so far), audits compared as strings."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(codes) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        asked = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, asked))
        if i < len(codes):
            initial, fault = "sua?"[codes[i] & 3], codes[i] >> 2
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if fault in (0, 3):
                extra = 1 if fault == 3 else 0
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, asked))
                if initial == asked or (initial == "s" and not last):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial))


@pytest.mark.parametrize("piece", [1, 3, 32])
def test_plans_are_cheapest_and_ascii_least(monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    conversations._solved.cache_clear()
    rng = np.random.default_rng(12)
    for _ in range(300):
        codes = rng.integers(0, 16, rng.integers(0, 9)).astype(np.uint8)
        assert conversations.plan(codes.tobytes()) == cheapest(codes.tolist())
    long = rng.choice([1, 2, 1, 2, 1, 2, 0, 3, 5, 9, 13], 100).astype(np.uint8)
    assert conversations.plan(long.tobytes()) == cheapest(long.tolist())


def by_hand(rows):
    """The contract in plain Python: rows of (conv, turn, role, text) to a result per conversation."""
    out, told = {}, {}
    for conv, turn, role, text in rows:
        told.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        act = zlib.crc32(key.encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        role = "user" if act == 4 else role
        told[conv] += [(turn is not None, turn or 0, role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    for conv, found in told.items():
        found.sort(key=lambda r: (r[0], r[1], r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in found:
            signs = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(1 if not signs else 2 if (role, text) in seen else 3 if signs[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for dated, t, _, _ in found if dated]
        initials = [r[:1] or "?" for _, _, r, _ in found]
        cost, audit = cheapest([("sua".find(x) if x in "sua" else 3) + 4 * f for x, f in zip(initials, faults)])
        lines, last, i = [], "", 0
        for edit in audit:
            asked = "assistant" if last[:1] == "u" else "user"
            if edit == "D":
                i += 1
                continue
            role, text = (asked, "") if edit == "I" else (found[i][2] if edit == "K" else asked, found[i][3])
            i += edit != "I"
            last = role
            lines.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(frame):
    found = conversations.repair(conversations.damage(frame), frame.select("conv_id"))
    got = [tuple(r) for r in found.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_repair_against_plain_python(shared):
    frame = shared.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert repaired(frame) == by_hand([tuple(r) for r in frame.collect()])


def test_repair_of_odd_rows(shared):
    odd = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "x" * 50_000 + "."), (1, 5, "", ""),
           (1, 5, "assistant", "Yes. \n\t"), (1, 5, "assistant", "Yes. \n\t"), (2, 0, "tool", "é? "), (2, -4, "System", "Né."),
           (3, 1, "user", " \x0b\f")]
    # Half the rows belong to one conversation of many pieces.
    odd += [(9, t, ["user", "assistant", "system"][t * 7 % 3], f"Turn {t % 50}" + ".!? "[t % 4]) for t in range(400)]
    odd += [(c, 0, "user", "Gone?") for c in range(100, 160)]
    frame = shared.createDataFrame([(*r, 7, "n") for r in odd], CONV)
    want = by_hand(odd)
    assert "" in {w[6] for w in want.values()}
    assert repaired(frame) == want
    assert repaired(frame.limit(0)) == {}


# --- hard negatives ----------------------------------------------------------------


def test_intervals_hold_every_score():
    rng = np.random.default_rng(13)
    for dim in (1, 5, 64, 130):
        x = rng.integers(-300, 300, (200, dim))
        x[:3] = 0
        x[3:20] = x[20:37] * 2
        for stages in (1, 4):
            turns = negatives.rotations(dim, stages, 3)
            codes, parts = negatives.encode(x, turns)
            lower, upper = negatives.intervals(x, codes, parts, turns)
            exact = x @ x.T
            assert (lower <= exact).all() and (exact <= upper).all()
        size = np.sqrt((x * x).sum(1))
        if dim == 64:  # four steps leave about an eighth of the length open
            assert ((upper - lower) / (size[:, None] * size + 1)).mean() < 0.4


def all_pairs(rows, anchor, per=5, few=3):
    out = set()
    for n, (i, label, x) in enumerate(rows):
        if not anchor(i):
            continue
        score = [(-int(np.dot(x, y)), j, m, k) for m, (j, k, y) in enumerate(rows) if m != n and len(y) == len(x)]
        for s, j, _, _ in sorted(r for r in score if r[3] == label)[:per]:
            fits = sorted(r for r in score if r[3] != label and 50 * -s <= 100 * -r[0] <= 95 * -s)
            out |= {(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits[:few])}
    return out


def test_negatives_against_all_pairs(shared):
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(300, 20)), np.repeat(rng.normal(size=(3, 20)), 50, 0)]) / 3
    good = [(int(i), int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    good += [(450, 1, [0.0] * 20), (500, 1, [1.0, 2.0]), (501, 2, [1.0, 1.0]), (502, 1, [1.0, 0.5]), (550, 3, [])]
    odd = [(600, 1, None), (650, None, [1.0] * 20), (700, 1, [float("nan")] * 20), (750, 1, [None] * 20), (800, 1, [float("inf")] * 20), (None, 1, [1.0] * 20)]
    frame = shared.createDataFrame([(*r, 5, 0.5) for r in good + odd], "vec_id bigint, label int, embedding array<double>, row int, score double")
    for sizes in ({}, {"shard_rows": 20, "block_anchors": 2}):
        rows = negatives.prepare(frame)
        got = {tuple(r) for r in negatives.mine(rows, F.col("id") % 50 == 0, **sizes).collect()}
        want = all_pairs([(i, k, np.floor(256 * np.array(v)).astype(np.int64)) for i, k, v in good], lambda i: i % 50 == 0)
        assert got == want and len(got) > 50
    empty = negatives.mine(negatives.prepare(frame.limit(0)), F.col("id") % 50 == 0)
    assert empty.count() == 0


def test_negatives_against_sql(shared):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = {tuple(r) for r in con.execute(queries.checks()["op13_negatives"]).fetchall()}
    got = {tuple(r) for r in queries.queries()["op13_negatives"](shared, SF).collect()}
    assert got == want and got


# --- graph search --------------------------------------------------------------------


def by_scores(rows, step, k):
    """All candidates of every query: ``{query: [(score, id)]}`` in order."""
    out = {}
    for i, x in rows:
        if i % step == 0:
            found = [(reduce(lambda s, p: s + p[0] * p[1], zip(x, y), 0.0), j) for j, y in rows if j != i and len(x) == len(y)]
            out[i] = sorted(found, key=lambda r: (-r[0], r[1]))[:k]
    return out


def neighbours(frame, **settings):
    out = {}
    for r in sorted(graph.nearest(frame, **settings).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found = out.setdefault(r["query_id"], [])
        found.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found)
    return out


VECTORS = "vec_id bigint, embedding array<double>, node string, rank int"


def test_few_vectors_are_searched_exactly(shared):
    rng = np.random.default_rng(15)
    rows = [(int(i), (rng.normal(size=12) * rng.uniform(0.2, 5)).tolist()) for i in range(45)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200, [1.0, 2.0]), (201, [2.0, 1.0]), (220, [3.0])]
    odd = [(300, None), (320, []), (340, [0.0] * 12), (360, [float("nan")] * 12), (380, [None] * 12), (400, [float("-inf")] * 12), (None, rows[0][1])]
    frame = shared.createDataFrame([(*r, "n", 1) for r in rows + odd], VECTORS)
    want = {i: found for i, found in by_scores(rows, 20, 20).items() if found}
    assert neighbours(frame) == want and want[200] == [(4.0, 201)]
    assert neighbours(frame.limit(0)) == {}


def test_graph_search_finds_most_neighbours(shared):
    """Uneven lengths, tight groups and one vector that a third of all rows share."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(2400, 24)) * rng.uniform(0.5, 2, (2400, 1))
    x[1200:1500] = x[0] + rng.normal(size=(300, 24)) * 0.01
    x[1600:] = x[1]
    frame = shared.createDataFrame([(i, v.tolist(), "n", 1) for i, v in enumerate(x)], VECTORS)
    got = neighbours(frame, degree=24, beam=64, cell=64, tables=8, block_bytes=1 << 20)
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
    least = -np.sort(-score, axis=1)[:, 19]
    assert sorted(got) == list(range(0, len(x), 20)) and all(len(f) == 20 for f in got.values())
    hits = sum(s >= low - 1e-9 for f, low in zip(got.values(), least) for s, _ in f)
    assert hits >= 0.95 * 20 * len(got)
    for q, found in got.items():
        assert found == sorted(found, key=lambda r: (-r[0], r[1])) and q not in {i for _, i in found}
        for s, i in found:
            assert abs(s - x[q] @ x[i]) < 1e-9
    # Copies of one vector tie, so the smallest ids come first.
    shared_id = [i for i in range(1600, 1625) if i != 1600]
    copies = [i for s, i in got[1600] if abs(s - got[1600][0][0]) < 1e-12]
    assert copies == sorted(copies) and set(copies) <= {1, *shared_id}

"""SimHash, embeddings, suffix arrays, decontamination and the pipeline against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from royaltide.llm import decontam, pii, simhash, suffixes, toxicity, vectors

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_odd_and_empty(make_docs, shared):
    bench = shared.createDataFrame([(1, None), (2, ""), (None, "a b c d e f")], "item_id bigint, text string")
    for docs in (make_docs(ODD), make_docs([])):
        n = docs.count()
        for out in (simhash.near_duplicates(docs), suffixes.drop_repeats(docs), decontam.find_overlap(docs, bench)):
            assert out.count() == n
        assert decontam.find_overlap(docs, bench.limit(0)).where("contaminated").count() == 0


def test_links_are_all_pairs_within_four_bits(shared):
    rng = np.random.default_rng(3)
    codes = set()
    for start in rng.integers(-2**62, 2**62, 40).tolist():
        for k in (0, 2, 4, 5):
            code = start
            for bit in rng.choice(63, k, replace=False).tolist():
                code ^= 1 << bit
            codes.add(code)
    codes = sorted(codes)
    got = {(r["a"], r["b"]) for r in simhash.links(shared.createDataFrame([(c,) for c in codes], "fp bigint")).collect()}
    want = {(a, b) for a in codes for b in codes if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == want


def test_simhash_components(shared):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    fps = [int(x, 16) for x in got["fingerprint"]]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    ids = got["doc_id"].tolist()
    assert [ids[c] for c in components(len(ids), links)] == got["component_id"].tolist()


def test_vectors_against_all_pairs(shared):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 16))
    rows = [(i, (centre[i % 6] + rng.normal(size=16) * 0.05).tolist(), i % 2) for i in range(240)]
    rows += [(240, rows[0][1], 0), (241, rows[0][1], 1)]
    odd = [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[0][1], None), (304, [None] * 16, 0), (305, [], 0), (None, rows[0][1], 0)]
    frame = shared.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    got = vectors.near_duplicates(frame, chunk=16).toPandas().set_index("vec_id")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    have = got.loc[range(242)]
    assert (have["n_links"].to_numpy() <= near.sum(1)).all() and have["n_links"].sum() >= 0.97 * near.sum()
    assert have["component_id"].tolist() == components(242, np.argwhere(near))
    assert (got.loc[range(300, 306)]["n_links"] == 0).all() and len(got) == 249
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(6)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 50))
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_array(s).tolist() == want


@pytest.mark.parametrize("hot", [1, 1000])
def test_repeats_against_brute_force(make_docs, hot):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdé"), 6)) for _ in range(2000)]
    pick = lambda n: " ".join(rng.choice(words, n))
    shared_text, long_text = pick(60), pick(300)
    texts = [pick(20) + shared_text + pick(20) for _ in range(12)] + [long_text, long_text, long_text[100:1200] + pick(5)]
    texts += ["z" * 700, "xy" * 300, pick(10), None, shared_text[:199], shared_text[:250]]
    got = suffixes.drop_repeats(make_docs(list(enumerate(texts))), hot=hot, shard=4).toPandas().set_index("doc_id")
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + 200] for r in raws for i in range(len(r) - 199))
    for i, raw in enumerate(raws):
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for k in range(len(raw) - 199):
            if seen[raw[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got.loc[i, "kept_sha256"], got.loc[i, "n_spans"], got.loc[i, "n_removed"]) == (
            hashlib.sha256(kept).hexdigest(), spans, len(raw) - len(kept))


@pytest.mark.parametrize("hot", [1, 1000])
def test_runs_between_unique_texts_are_no_repeats(make_docs, hot):
    rng = np.random.default_rng(10)
    pick = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    texts = [pick(300) + run + pick(300) for run in ("=" * 100, "For " * 30, "-" * 150, "=" * 100, "For " * 30)]
    shared_text = pick(40) + "=" * 100 + pick(80)
    texts += [pick(50) + shared_text + pick(50), pick(70) + shared_text + pick(20), pick(90) + "_" * 230 + pick(90)]
    got = suffixes.drop_repeats(make_docs(list(enumerate(texts))), hot=hot, shard=4).toPandas().set_index("doc_id")
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    for i, text in enumerate(texts):
        gone = {k + j for k in range(len(text) - 199) if seen[text[k:k + 200]] > 1 for j in range(200)}
        kept = "".join(c for k, c in enumerate(text) if k not in gone)
        assert bytes(got.loc[i, "kept"]).decode() == kept
    assert got.loc[range(5), "n_removed"].sum() == 0 and (got.loc[[5, 6], "n_removed"] >= 220).all()


def test_overlap_against_brute_force(make_docs, shared):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4, n)]
    items = {str(i): word(n) for i, n in enumerate([20, 16, 3, 13, 5, 0])}
    texts = [" ".join([*word(6), *items[str(i % 6)][:14], *word(6)]).upper() for i in range(30)]
    bench = shared.createDataFrame([(int(k), "-".join(v)) for k, v in items.items()], "item_id bigint, text string")
    for row in decontam.find_overlap(make_docs(list(enumerate(texts))), bench).collect():
        ws = texts[row["doc_id"]].lower().split()
        hit, names = set(), set()
        for name, item in items.items():
            size = min(13, len(item))
            for window in (item[k:k + size] for k in range(len(item) - size + 1 if size else 0)):
                for at in range(len(ws) - size + 1):
                    if ws[at:at + size] == window:
                        hit |= set(range(at, at + size))
                        names.add(name)
        assert (row["n_words"], row["n_hit"], row["n_items"]) == (len(ws), len(hit), len(names))
        assert row["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert row["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(ws))


def sets_of(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else frozenset({b""})


def similar_groups(texts, similarity=0.8):
    """Smallest place of each text's group by brute force over all pairs."""
    sets = [sets_of(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return components(len(sets), links), links


def near_copies_of(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.integers(1e9)}" for w in words)


def test_near_copies_against_all_pairs(make_docs):
    rng = np.random.default_rng(17)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        texts.append(" ".join(words))
        texts += [near_copies_of(rng, words, share) for share in (0.004, 0.01, 0.02, 0.05)]
    # A crowd: a third of all rows are copies and near copies of one text.
    crowd = [f"c{x}" for x in rng.integers(0, 5000, 300)]
    texts += [near_copies_of(rng, crowd, 0.005) for _ in range(60)] + [" ".join(crowd)] * 40
    texts += ["", None, " \n ", "one two", "ONE  two", "one two three", "a b c d e", "A b c d\te", "long " * 30_000]
    order = rng.permutation(len(texts)).tolist()
    texts = [texts[i] for i in order]
    docs = make_docs([*enumerate(texts), (None, "one two"), (3, texts[3])])
    got = simhash.near_copies(docs).where("doc_id is not null").distinct().toPandas().set_index("doc_id")["component_id"]
    want, links = similar_groups(texts)
    # No link is made up, and at least 0.95 of the linked texts share their group.
    assert len(got) == len(texts) and all(want[got[i]] == want[i] and got[i] <= i for i in range(len(texts)))
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links) > 2000
    kept = simhash.drop_near_duplicates(docs.withColumnRenamed("label", "component_id").withColumnRenamed("score", "_gone_id"))
    assert kept.columns == ["doc_id", "text", "component_id", "n", "_gone_id"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {None, *(i for i in range(len(texts)) if got[i] == i)} and ids.count(None) == 1
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_crowded_buckets_lose_no_link_between_groups():
    """A row whose only partner comes after many closer-looking ones still meets it; against all pairs of each bucket."""
    import pyarrow as pa

    rng = np.random.default_rng(23)
    buckets = []
    for n in (2, 3, 7, 40, 64, 90, 700):
        seeds = rng.integers(0, 2**63, 1 + n // 20)
        buckets.append([int(rng.choice(seeds)) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 10), False)) for _ in range(n)])
    rows = [(key, node, word) for key, words in enumerate(buckets) for node, word in enumerate(words, 1000 * key)]
    place = {node: i for i, (_, node, _) in enumerate(rows)}
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "node", "word"])
    met = pa.Table.from_batches(list(simhash._candidates([batch]))).to_pylist()
    first = [(place[r["a"]], place[r["b"]]) for r in met if r["key"] is None]

    def alike(a, b):  # a rule the fingerprints cannot know
        return (rows[a][1] * 7 + rows[b][1] * 7) % 11 == 0

    links = [p for p in first if alike(*p)]
    group = components(len(rows), links)
    again = sorted((r["key"], group[place[r["a"]]], r["a"], r["word"]) for r in met if r["key"] is not None)
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*again)], names=["key", "part", "node", "word"])
    rest = [(place[a], place[b]) for out in simhash._across([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    assert all(group[a] != group[b] for a, b in rest)
    everything = [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows[:i])
                  if x[0] == y[0] and (x[2] ^ y[2]).bit_count() <= simhash.LOOSE and alike(i, j)]
    want = components(len(rows), everything)
    assert components(len(rows), links + [p for p in rest if alike(*p)]) == want != group


def test_segments_follow_the_number_of_texts():
    for n in (2, 10**4, 10**6, 10**9):
        bits, segments = simhash.plan_segments(n, 0.8, 0.95)
        same = 1 - np.arccos(1.6 / 1.8) / np.pi
        assert 1 - (1 - same**bits) ** segments >= 0.95 and (n < 2**8 or n / 2**bits <= 4)


def test_fingerprints_by_their_rule():
    """Bits by counting, word for word, without the operator's own arrays."""
    import xxhash

    def by_hand(text):
        words = text.lower().split(" ")
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = np.random.default_rng(18)
    for n in (1, 3, 4, 5, 50, 400):
        text = " ".join(f"W{x}é" for x in rng.integers(0, 30, n))
        assert simhash.fingerprint(text) & (2**64 - 1) == by_hand(text.replace("W", "w"))
    assert simhash.fingerprint(" \t") == 0


def test_pipeline_stages(shared):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (shared.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    clean = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 0").collect()}
    frame = docs.toPandas()
    frame = frame[frame["doc_id"].isin(clean)].sort_values("doc_id").reset_index(drop=True)
    group, links = similar_groups(frame["text"].tolist())
    ids = frame["doc_id"].tolist()
    dirty = {r["doc_id"] for r in decontam.find_overlap(docs, bench).where("contaminated").collect()}
    out = corpus_pipeline.run(shared, SF).toPandas()
    kept = set(out["doc_id"])
    assert len(out) == len(kept) and out["round_trip"].all()
    # What goes is toxic, dirty or has an earlier text in its group; of such texts at most a tenth stays.
    alone = {ids[i] for i, g in enumerate(group) if g == i}
    later = {ids[i] for i, g in enumerate(group) if g != i}
    assert alone - dirty <= kept <= clean - dirty and len(kept & later) <= 0.1 * len(later) and links
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(shared, docs.limit(0), SF).columns == docs.columns
    masked = corpus_pipeline.STAGES[3][1](shared, docs, SF).toPandas()["text"]
    assert not any(pii.base_spans(t or "") for t in masked)


def test_a_crowd_without_links_across_groups_makes_few_pairs(make_docs, monkeypatch):
    """Texts too far from a crowd of near copies are not held against each of them; what may join groups still is."""
    rng = np.random.default_rng(29)
    base = [f"c{x}" for x in rng.integers(0, 5000, 150)]

    def changed(*at):
        return " ".join(f"x{rng.integers(1e9)}" if i in at else w for i, w in enumerate(base))

    crowd = [" ".join(base), *(changed(10 + i % 130) for i in range(200))]
    far = [changed(12 + i % 10, 42 + i % 9, 72 + i % 8, 102 + i % 7, 132 + i % 6) for i in range(100)]
    # One that is close to a far one only.
    twin = far[0].replace(base[90], "y")
    texts = [*crowd, *far, twin]
    made = []

    def counting(df, label):
        out = stored(df, label)
        if label == "copy-pairs":
            made.append(out.count())
        return out

    stored = simhash.stored
    monkeypatch.setattr(simhash, "stored", counting)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(make_docs(enumerate(texts))).collect()}
    want, _ = similar_groups(texts)
    assert len(got) == len(texts) and all(want[got[i]] == want[i] for i in got)
    assert sum(got[i] == 0 for i in got) == len(crowd) and got[len(texts) - 1] == len(crowd)
    # Beyond the first pairs of the buckets.
    assert sum(made[1:]) <= 5 * len(texts)

"""Benchmark decontamination with a generalised suffix automaton over test items.

The test items are the stated query set. They are packed into blocks of at most
``block_words`` words; each block becomes one automaton of at most twice as many
states, so what is broadcast at once has a bound that is a parameter. Every
training document streams through every block in one scan, without a shuffle.

Defined cases: a null or empty text has no words and is clean; a null item text
has no words and no window; repeated items each count by their own id; an empty
benchmark leaves all documents clean; a null item id is reported as an empty string.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import doc_texts, map_slices, pick, sha256

WINDOW = 13
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and turns every byte outside words into a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
DIGEST = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
    "contaminated boolean, longest_match bigint, spans array<struct<first:bigint,past:bigint>>"
)


def clean_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with window and short-item marks."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in ws]) for name, ws in items]
        coded = [(name, ws) for name, ws in coded if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.shortest = min((min(len(ws), window) for _, ws in coded), default=0)
        self.items_at: dict[int, list[str]] = {}
        self.short_at: dict[int, list[tuple[int, str]]] = {}
        for name, ws in coded:
            state, matched = 0, 0
            for w in ws:
                state, matched = self.step(state, matched, w)
                if matched >= window:
                    names = self.items_at.setdefault(self._top(state, window), [])
                    if name not in names[-1:]:
                        names.append(name)
            if len(ws) < window:
                self.short_at.setdefault(self._top(state, len(ws)), []).append((len(ws), name))
        self._point()

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, w, known)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at != -1 and w not in self.next[at]:
            self.next[at][w] = state
            at = self.link[at]
        if at != -1:
            target = self.next[at][w]
            exact = self.length[target] == self.length[at] + 1
            self.link[state] = target if exact else self._split(at, w, target)
        return state

    def _split(self, at: int, w: int, target: int) -> int:
        """Divide a state so that the shorter strings get one of their own."""
        twin = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        self.link[target] = twin
        while at != -1 and self.next[at].get(w) == target:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def _top(self, state: int, length: int) -> int:
        """State of the suffix that has the given length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _point(self) -> None:
        """For each state: that of its window, and the next suffix state that ends a short item."""
        n = len(self.next)
        self.top, self.short = [0] * n, [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.top[s] = s if self.length[up] < self.window else self.top[up]
            self.short[s] = s if s in self.short_at else self.short[up]

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """Longest suffix of what was read, with ``w``, that occurs in an item."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, matched + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit intervals of word positions, items with occurring windows, longest match."""
        if not self.shortest:
            return [], set(), 0
        look = self.words.get
        codes = np.array([look(w, -1) for w in words], dtype=np.int64)
        # An occurrence has known words only, so the automaton runs over runs of those.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        hits, items, longest = [], set(), 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for i, w in enumerate(codes[a:b].tolist(), a):
                state, matched = self.step(state, matched, w)
                longest = max(longest, matched)
                if matched >= self.window:
                    hits.append((i - self.window + 1, i + 1))
                    items.update(self.items_at.get(self.top[state], ()))
                at, reach = self.short[state], matched
                while at > 0:
                    for size, name in self.short_at[at]:
                        if size <= reach:
                            hits.append((i - size + 1, i + 1))
                            items.add(name)
                    up = self.link[at]
                    reach, at = self.length[up], self.short[up]
        return hits, items, longest


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
    window: int = WINDOW, block_words: int = 1_000_000,
) -> list:
    """Broadcast automata of all items, each of at most ``block_words`` words or one item."""
    spark = benchmark.sparkSession
    out, block, size = [], [], 0
    rows = pick(benchmark, item=item_col, text=text_col).select(
        F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text"
    )
    for row in rows.orderBy("item", "text").toLocalIterator():
        ws = clean_words(row["text"] or "")
        if block and size + len(ws) > block_words:
            out.append(spark.sparkContext.broadcast(Automaton(block, window)))
            block, size = [], 0
        block.append((row["item"], ws))
        size += len(ws)
    return [*out, spark.sparkContext.broadcast(Automaton(block, window))]


def find_overlap(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    coverage: float = 0.05, block_words: int = 1_000_000,
) -> DataFrame:
    """One row per document: words, hit words, items seen, and whether it is contaminated.

    A document is contaminated if it has hit words and they are at least
    ``coverage`` of its words. ``spans`` are the hit word positions, end exclusive.
    """
    blocks = automata(benchmark, item_col, item_text_col, window, block_words)
    share = round(1 / coverage)

    def make():
        def work(batch):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = clean_words(text)
                hits, items, longest = [], set(), 0
                for block in blocks:
                    h, names, far = block.value.scan(ws)
                    hits += h
                    items |= names
                    longest = max(longest, far)
                spans = merged(hits)
                n_hit = sum(b - a for a, b in spans)
                rows.append((
                    doc, len(ws), n_hit, len(items), sha256(",".join(sorted(items))),
                    n_hit > 0 and share * n_hit >= len(ws), longest,
                    [{"first": a, "past": b} for a, b in spans],
                ))
            return list(zip(*rows)) if rows else [[]] * 8

        return work

    return map_slices(doc_texts(docs, id_col, text_col), make, DIGEST)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without those that are contaminated; all columns are kept.

    The verdict is computed beside each row in one scan, so repeated and null ids
    need no join.
    """
    blocks = automata(benchmark, window=options.get("window", WINDOW),
                      block_words=options.get("block_words", 1_000_000))
    share = round(1 / options.get("coverage", 0.05))
    at = docs.columns.index(options.get("text_col", "text"))

    def keep(batches):
        for batch in batches:
            flags = []
            for text in batch.column(at).to_pylist():
                ws = clean_words(text or "")
                n_hit = sum(b - a for a, b in merged([h for x in blocks for h in x.value.scan(ws)[0]]))
                flags.append(not (n_hit > 0 and share * n_hit >= len(ws)))
            yield batch.filter(pa.array(flags, type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def cut_spans(text: str, spans: list[tuple[int, int]], min_words: int = WINDOW) -> str:
    """The text without those hit spans that have at least ``min_words`` words."""
    at = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        if b - a >= min_words:
            out.append(text[done:at[a][0]])
            done = at[b - 1][1]
    return "".join([*out, text[done:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, text)`` with every hit span cut out of the text, however short the document."""
    blocks = automata(benchmark, window=window)

    def make():
        def work(batch):
            texts = batch.column(1).to_pylist()
            out = []
            for text in texts:
                ws = clean_words(text)
                spans = merged([h for x in blocks for h in x.value.scan(ws)[0]])
                out.append(cut_spans(text, spans, 1))
            return [batch.column(0), out]

        return work

    return map_slices(doc_texts(docs, id_col, text_col), make, "doc_id bigint, text string")

"""Toxicity by nearest labelled examples: exact TF-IDF cosine with a block-max inverted index.

The examples are a bounded, class-balanced sample of labelled documents (``per_class``
of each class; training folds only). Every word in at least ``least`` examples is a term;
no term is left out for telling too little. Weights are log(1+tf) times IDF times the squared
log-odds of the word's document frequencies in the two classes, so that words of one class
alone count most, however rare they are. Postings lie in blocks of examples with the largest
weight of each term in the block; blocks are scored only while their bound can still reach
the k best. Cosine-weighted votes are calibrated by an isotonic fit on leave-one-out
votes, weighted back to the class sizes.

Defined cases: null, empty and blank texts, and texts without any term, get the calibrated
vote of "no neighbour"; repeated rows each get a row; without labels of both
classes every score is 0; ties between neighbours go to the smaller example number.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm import calibrate
from royaltide.llm.common import bounded_sample, doc_texts, map_slices, remainder

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 256


def words_of(text: str) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


class BlockMaxIndex:
    """Inverted index of unit vectors in blocks, with each term's largest weight per block."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int) -> None:
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        example = np.repeat(np.arange(self.n, dtype=np.int32), [len(v) for v in vectors])
        term = np.fromiter((t for v in vectors for t in v), dtype=np.int64, count=len(example))
        weight = np.fromiter((w for v in vectors for w in v.values()), dtype=float, count=len(example))
        order = np.argsort(term, kind="stable")
        self.example, self.weight = example[order], weight[order]
        # Postings are sorted by term and example, so those of a term in a block lie together.
        cell = term[order] * self.blocks + self.example // BLOCK
        self.start = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1)).astype(np.int32)
        self.peak = np.zeros(n_terms * self.blocks)
        used = np.flatnonzero(self.start[1:] > self.start[:-1])
        if len(used):
            self.peak[used] = np.maximum.reduceat(self.weight, self.start[used])
        self.peak = self.peak.reshape(n_terms, self.blocks)

    def _similar(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines with the examples of some blocks, zero elsewhere."""
        cells = (terms[:, None] * self.blocks + blocks).ravel()
        size = self.start[cells + 1] - self.start[cells]
        held = np.flatnonzero(size)
        cells, size = cells[held], size[held]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[cells] - (ends - size), size)
        return np.bincount(
            self.example[at], self.weight[at] * np.repeat(np.repeat(weights, len(blocks))[held], size), minlength=self.n)

    def nearest(self, vector: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, exactly; block bounds only save work."""
        if not vector or not self.n:
            return []
        terms = np.fromiter(vector, dtype=np.int64, count=len(vector))
        weights = np.fromiter(vector.values(), dtype=float, count=len(vector))
        bounds = weights @ self.peak[terms]
        order = np.argsort(-bounds, kind="stable")
        first = 1 + k // BLOCK
        best: list[tuple[float, int]] = []
        for blocks in (order[:first], order[first:]):
            floor = -best[-1][0] - 1e-12 if len(best) == k else 0.0
            blocks = np.sort(blocks[(bounds[blocks] > 0) & (bounds[blocks] >= floor)])
            if not len(blocks):
                break
            sims = self._similar(terms, weights, blocks)
            if skip >= 0:
                sims[skip] = 0
            top = np.flatnonzero(sims >= np.partition(sims, -k)[-k]) if k < self.n else np.arange(self.n)
            top = top[np.argsort(-sims[top], kind="stable")[:k]]
            best = sorted(best + [(-s, i) for s, i in zip(sims[top].tolist(), top.tolist()) if s > 0])[:k]
        return [(-s, i) for s, i in best]


class Model:
    """Terms, index, labels and calibration; its size is bounded by the sample."""

    def __init__(self, texts: list[str], labels: list[int], sizes: dict[int, int],
                 k: int = 15, least: int = 3) -> None:
        self.k, self.labels = k, np.array(labels, dtype=float)
        counts = [words_of(t) for t in texts]
        ones = int(self.labels.sum())
        self.ready = 0 < ones < len(labels)
        self.terms: dict[str, int] = {}
        if not self.ready:
            return
        zeros, n = len(labels) - ones, len(labels)
        frequency = [Counter(), Counter()]
        for c, y in zip(counts, labels):
            frequency[y].update(c.keys())
        weight = []
        for word in sorted({*frequency[0], *frequency[1]}):
            a, b = frequency[1][word], frequency[0][word]
            if a + b >= least:
                self.terms[word] = len(weight)
                odds = np.log((a + 0.5) / (ones + 1)) - np.log((b + 0.5) / (zeros + 1))
                weight.append((np.log((1 + n) / (1 + a + b)) + 1) * odds * odds)
        self.weight = [float(w) for w in weight]
        vectors = [self.vector(c) for c in counts]
        self.index = BlockMaxIndex(vectors, len(self.terms))
        votes = np.array([self.vote(v, i)[0] for i, v in enumerate(vectors)])
        weight = np.where(self.labels == 1, sizes.get(1, 1) / ones, sizes.get(0, 1) / zeros)
        self.knots = calibrate.isotonic(votes, self.labels, weight)

    def vector(self, counts: Counter) -> dict[int, float]:
        hit = {self.terms[w]: 1 + math.log(c) for w, c in counts.items() if w in self.terms}
        hit = {t: tf * w for t, tf in sorted(hit.items()) if (w := self.weight[t])}
        norm = math.sqrt(sum(w * w for w in hit.values()))
        return {t: w / norm for t, w in hit.items()} if norm else {}

    def vote(self, vector: dict[int, float], skip: int = -1) -> tuple[float, list[tuple[float, int]]]:
        """Cosine-weighted share of label 1 among the nearest, -1 without any."""
        near = self.index.nearest(vector, self.k, skip)
        total = sum(s for s, _ in near)
        return (sum(s * self.labels[i] for s, i in near) / total if total else -1.0), near

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list]:
        if not self.ready:
            return np.zeros(len(texts)), [[] for _ in texts]
        seen = [self.vote(self.vector(words_of(t))) for t in texts]
        return calibrate.apply(self.knots, np.array([v for v, _ in seen])), [near for _, near in seen]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 1000) -> tuple[Model, list[int]]:
    """Model of at most ``per_class`` labelled documents of each class, and their ids."""
    sample, sizes = bounded_sample(labels, label_col, per_class)
    rows = doc_texts(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Model([r["text"] for r in rows], [r["label"] for r in rows], sizes), [r["doc_id"] for r in rows]


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row; evidence are the example ids."""
    model, ids = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast((model, ids))

    def make():
        model, ids = shared.value

        def work(batch):
            p, near = model.scores(batch.column(1).to_pylist())
            return [batch.column(0), p, [[ids[i] for _, i in n] for n in near]]

        return work

    out = map_slices(doc_texts(docs), make, "doc_id bigint, score double, evidence array<bigint>")
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Documents with a score below one half; all columns are kept, one scan, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options)[0])
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            p, _ = shared.value.scores(batch.column(at).to_pylist())
            yield batch.filter(pa.array(p < 0.5, type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

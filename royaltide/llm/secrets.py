"""Secrets: fixed patterns, widened by character Markov models.

One model of random strings and one of ordinary identifiers, both of order one over the
characters of a token, are compared by log-likelihood ratio. They are trained from labelled
samples: random strings are drawn from the named alphabets (seeded) and joined by the values that the
patterns find; ordinary identifiers are all other words of ``PLAIN`` in the documents, each counted once a text, and the
same words as identifiers write them (capitals, words joined by signs or humps, numbers behind a word), which the counts of
the words' beginnings, pairs and ends tell. Only counts leave the tasks, so all documents take part.

Every token of ``TOKEN`` beside the patterns is asked for. It is taken as random if the ratio of
the whole token is at least ``evidence`` and that of a character at least ``threshold``: a short token needs
a higher ratio a character than a long one. No other filter stands before the models.

Defined cases: null and empty texts have no spans; very long texts and words are read whole; repeated rows
each get a row (and count twice as examples); without ordinary words both models still exist (additive
smoothing). A token that touches a pattern match is left to the pattern. Empty tables give empty
results; only id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import doc_texts, map_slices, sha256, span_text

# The kinds in their order; "random" is the models' own.
KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{10,}")
PLAIN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABETS = ("0123456789abcdef", SIGNS[:62], SIGNS[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", SIGNS[:52], SIGNS[26:52], SIGNS[26:62])

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    folded = text.lower()
    if any(name in folded for name in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def by_start(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: A byte's number: 0 for what no token holds, which also stands before a first character.
PLACE = np.zeros(256, dtype=np.int64)
PLACE[[ord(c) for c in SIGNS]] = np.arange(1, len(SIGNS) + 1)
STATES = len(SIGNS) + 1


def pairs(words: list[str]) -> np.ndarray:
    """Counts of (character before, character) over the words; 0 stands before the first and behind the last."""
    at = PLACE[np.frombuffer(("\n" + "\n".join([*words, ""])).encode("ascii"), dtype=np.uint8)]
    counts = np.bincount(at[:-1] * STATES + at[1:], minlength=STATES * STATES).reshape(STATES, STATES)
    counts[0, 0] = 0
    return counts


def as_identifiers(counts: np.ndarray, share: float = 0.05) -> np.ndarray:
    """Pair counts of words together with those of identifiers made of them, each style at some share of the words."""
    small, great, digits = (np.array([PLACE[ord(c)] for c in SIGNS[a:b]]) for a, b in ((26, 52), (0, 26), (52, 62)))
    joints = np.array([PLACE[ord(c)] for c in "_-/"])
    lines = np.array([PLACE[ord(c)] for c in "_-/=+"])
    first, last = counts[0, small], counts[small, 0]
    words = max(first.sum(), 1.0)
    out = counts.astype(float)
    # All capitals, and a capital at the start or at a hump.
    out[np.ix_(great, great)] += share * counts[np.ix_(small, small)]
    out[np.ix_(great, small)] += share * np.outer(first, counts[np.ix_(small, small)].sum(0) / max(counts[np.ix_(small, small)].sum(), 1.0))
    out[0, great] += 2 * share * first
    out[np.ix_(small, great)] += share * np.outer(last, first) / words
    for sign in joints:
        for letters in (small, great):
            out[letters, sign] += share * last
            out[sign, letters] += share * first
            out[letters[:, None], digits] += share * last[:, None] / len(digits)
        out[sign, digits] += share * words / len(digits)
        out[digits, sign] += share * words / len(digits)
    out[np.ix_(digits, digits)] += share * words / len(digits)
    out[lines, lines] += share * words
    return out


def markov(counts: np.ndarray, smooth: float = 0.5, back: float = 2.0) -> np.ndarray:
    """Log-probabilities of a first-order model that backs off to smoothed single characters."""
    counts = counts.astype(float)
    counts[:, 0] = 0
    single = counts.sum(0) + smooth
    single[0] = 0
    full = counts + back * single / single.sum()
    full[:, 0] = 1e-300
    return np.log(full / full.sum(1, keepdims=True))


class Detector:
    """Both sides are words or their pair counts."""

    def __init__(self, random: list[str] | np.ndarray, plain: list[str] | np.ndarray, evidence: float = 7.0, threshold: float = 0.4,
                 made: int = 1000, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        drawn = ["".join(rng.choice(list(letters), 32)) for letters in ALPHABETS for _ in range(made)]
        random, plain = (x if isinstance(x, np.ndarray) else pairs(x) for x in (random, plain))
        self.ratio = markov(random + pairs(drawn)) - markov(as_identifiers(plain))
        self.evidence, self.threshold = evidence, threshold
        self.seen: dict[str, bool] = {}

    def llr(self, word: str) -> float:
        """Log-likelihood ratio of the whole word."""
        at = PLACE[np.frombuffer(("\n" + word).encode("ascii"), dtype=np.uint8)]
        return float(self.ratio[at[:-1], at[1:]].sum())

    def is_random(self, word: str) -> bool:
        found = self.seen.get(word)
        if found is None:
            found = self.llr(word) >= max(self.evidence, self.threshold * len(word))
            if len(self.seen) < 100_000 and len(word) < 200:
                self.seen[word] = found
        return found

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        out, at, done = [], 0, sorted((a, b) for _, a, b in base)
        for m in TOKEN.finditer(text):
            while at < len(done) and done[at][1] <= m.start():
                at += 1
            if (at == len(done) or done[at][0] >= m.end()) and self.is_random(m[0]):
                out.append(("random", *m.span()))
        return out


def samples(docs: DataFrame) -> DataFrame:
    """``(random, pair, n)``: character pairs of the labelled words of all documents."""

    def make():
        def work(batch):
            words: tuple[list[str], list[str]] = ([], [])
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                words[1].extend(text[a:b] for kind, a, b in base if kind != "assign")
                if base:
                    words[1].extend(m[2].replace(".", "") for m in ASSIGN.finditer(text) if len(m[2]) >= 16)
                    parts, done = [], 0
                    for a, b in sorted((a, b) for _, a, b in base):
                        parts.append(text[done:max(a, done)])
                        done = max(b, done)
                    text = " ".join([*parts, text[done:]])
                words[0].extend(set(PLAIN.findall(text)))
            counts = [pairs(found).ravel() for found in words]
            used = [np.flatnonzero(c) for c in counts]
            return [np.repeat([False, True], [len(u) for u in used]), np.concatenate(used),
                    np.concatenate([c[u] for c, u in zip(counts, used)])]

        return work

    found = map_slices(doc_texts(docs), make, "random boolean, pair bigint, n bigint")
    return found.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def detect(docs: DataFrame, **options) -> DataFrame:
    """Digest of the secrets of every row."""
    counts = np.zeros((2, STATES * STATES))
    # At most two rows for each pair of characters.
    for r in samples(docs).collect():
        counts[int(r["random"]), r["pair"]] = r["n"]
    detector = Detector(counts[1].reshape(STATES, STATES), counts[0].reshape(STATES, STATES), **options)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def make():
        def work(batch):
            texts = batch.column(1).to_pylist()
            base = [by_start(base_spans(t)) for t in texts]
            full = [by_start(b + shared.value.spans(t, b)) for t, b in zip(texts, base)]
            counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS[:3]]
            return [batch.column(0), *counts, [sha256(span_text(b)) for b in base], [span_text(s) for s in full],
                    [len(s) - len(b) for b, s in zip(base, full)]]

        return work

    return map_slices(doc_texts(docs), make, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                      "base_sha256 string, spans string, n_added bigint")

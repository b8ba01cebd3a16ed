"""Personal data: fixed patterns, widened by a character-level bidirectional LSTM with CRF.

The network is trained in numpy on windows around labelled spans (the pattern
matches of a bounded sample, ``train_windows`` windows). Texts are cut
into overlapping windows; each is decoded by Viterbi, and every character takes
the tag of the window it is most central in, so the spans of a whole text
agree. Windows without a digit and without ``@`` can hold no span of these kinds and
are not decoded; this loses nothing, as a span without either is not accepted.

Defined cases: null and empty texts have no spans; repeated rows each get a row;
without any labelled span in the corpus only the patterns are used. Pattern scans are
linear in the text, also on long runs of digits or letters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm.common import doc_texts, map_slices, sha256, span_text

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
WINDOW, STRIDE, SIGNS = 64, 32, 131

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind, then start; leftmost, not overlapping within a kind."""
    out: list[Span] = []
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            done = m.end()
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def signs(text: str) -> np.ndarray:
    """Character numbers below ``SIGNS``: ASCII as it is, other letters, the rest; the last pads."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, 129)).astype(np.int64)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """BiLSTM emissions and CRF transitions over O and the kinds."""

    def __init__(self, hidden: int = 12, width: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        tags = len(KINDS) + 1
        self.hidden = hidden
        self.p = {"embed": rng.normal(0, 0.3, (SIGNS, width)), "out": rng.normal(0, 0.3, (2 * hidden, tags)),
                  "bias": np.zeros(tags), "move": np.zeros((tags, tags))}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.3, (width, 4 * hidden))
            self.p["h" + side] = rng.normal(0, 0.3, (hidden, 4 * hidden))
            self.p["c" + side] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])

    def _pass(self, e: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        n, length, _ = e.shape
        h, c = np.zeros((n, self.hidden), e.dtype), np.zeros((n, self.hidden), e.dtype)
        gates = e @ self.p["x" + side] + self.p["c" + side]
        out = np.empty((n, length, self.hidden), e.dtype)
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = gates[:, t] + h @ self.p["h" + side]
            i, f, o = np.split(_sigmoid(z[:, :3 * self.hidden]), 3, axis=1)
            g = np.tanh(z[:, 3 * self.hidden:])
            before, past = c, h
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, past, c))
        return out

    def _back(self, e, dh_all, side, keep, grad):
        n = e.shape[0]
        dh, dc = np.zeros((n, self.hidden)), np.zeros((n, self.hidden))
        de = np.zeros_like(e)
        for t, i, f, o, g, before, past, c in reversed(keep):
            dh = dh + dh_all[:, t]
            th = np.tanh(c)
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad["h" + side] += past.T @ dz
            grad["x" + side] += e[:, t].T @ dz
            grad["c" + side] += dz.sum(0)
            de[:, t] = dz @ self.p["x" + side].T
            dh, dc = dz @ self.p["h" + side].T, dc * f
        return de

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        both = np.concatenate([self._pass(e, "f"), self._pass(e, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence of each window (Viterbi)."""
        s = self.emissions(x)
        best, trail = s[:, 0], []
        for t in range(1, x.shape[1]):
            paths = best[:, :, None] + self.p["move"]
            trail.append(paths.argmax(1))
            best = paths.max(1) + s[:, t]
        tags = [best.argmax(1)]
        for step in reversed(trail):
            tags.append(step[np.arange(len(x)), tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the CRF and its gradient."""
        n, length = x.shape
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        e, kept = self.p["embed"][x], {"f": [], "b": []}
        both = np.concatenate([self._pass(e, "f", kept["f"]), self._pass(e, "b", kept["b"])], axis=2)
        s, move = both @ self.p["out"] + self.p["bias"], self.p["move"]

        def lse(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)

        fore, aft = [s[:, 0]], [np.zeros_like(s[:, 0])]
        for t in range(1, length):
            fore.append(lse(fore[-1][:, :, None] + move, 1) + s[:, t])
        for t in range(length - 1, 0, -1):
            aft.append(lse(move + (s[:, t] + aft[-1])[:, None, :], 2))
        aft.reverse()
        z = lse(fore[-1], 1)
        rows = np.arange(n)
        ds = np.exp(np.stack(fore, 1) + np.stack(aft, 1) - z[:, None, None])
        gold = np.zeros(n)
        for t in range(length):
            ds[rows, t, y[:, t]] -= 1
            gold += s[rows, t, y[:, t]]
            if t:
                gold += move[y[:, t - 1], y[:, t]]
                pair = fore[t - 1][:, :, None] + move + (s[:, t] + aft[t])[:, None, :] - z[:, None, None]
                grad["move"] += np.exp(pair).sum(0)
                np.subtract.at(grad["move"], (y[:, t - 1], y[:, t]), 1)
        grad["out"] = np.einsum("ntk,ntj->kj", both, ds)
        grad["bias"] = ds.sum((0, 1))
        dboth = ds @ self.p["out"].T
        de = self._back(e, dboth[:, :, :self.hidden], "f", kept["f"], grad)
        de += self._back(e, dboth[:, :, self.hidden:], "b", kept["b"], grad)
        np.add.at(grad["embed"], x, de)
        return float((z - gold).mean()), {k: v / n for k, v in grad.items()}

    def train(self, x, y, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 3) -> float:
        """Adam; returns the loss of the last batch."""
        rng, step, loss = np.random.default_rng(seed), 0, 0.0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at:at + batch]
                loss, grad = self.gradient(x[part], y[part])
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        return loss


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or ``@``."""
    marks = {m.start() // STRIDE for m in MARK.finditer(text)}
    return sorted({w * STRIDE for m in marks for w in (m - 1, m) if w >= 0})


def cut(codes: np.ndarray, start: int) -> np.ndarray:
    part = codes[start:start + WINDOW]
    return np.concatenate([part, np.full(WINDOW - len(part), SIGNS - 1)]) if len(part) < WINDOW else part


def training_windows(docs: DataFrame, train_windows: int = 1500) -> DataFrame:
    """``(piece, tags)``: windows of labelled text, the smallest hashes of (text, tags) first."""

    def make():
        def work(batch):
            pieces, tags = [], []
            for text in batch.column(1).to_pylist():
                marks = np.zeros(len(text), dtype=np.uint8)
                spans = base_spans(text) if MARK.search(text) else []
                for kind, a, b in reversed(spans):
                    marks[a:b] = KINDS.index(kind) + 1
                if spans:
                    for at in windows(text):
                        pieces.append(text[at:at + WINDOW])
                        tags.append("".join(map(str, marks[at:at + WINDOW].tolist())))
            return [pieces, tags]

        return work

    found = map_slices(doc_texts(docs), make, "piece string, tags string")
    return found.orderBy(F.xxhash64("piece", "tags"), "piece", "tags").limit(train_windows)


def fit(docs: DataFrame, train_windows: int = 1500, epochs: int = 12) -> Tagger | None:
    rows = training_windows(docs, train_windows).collect()
    if not rows:
        return None
    x = np.stack([cut(signs(r["piece"]), 0) for r in rows])
    y = np.zeros_like(x)
    for i, r in enumerate(rows):
        y[i, :len(r["tags"])] = [int(c) for c in r["tags"]]
    tagger = Tagger()
    tagger.train(x, y, epochs)
    return tagger


def _plausible(kind: str, piece: str) -> bool:
    """Whether decoded text can be of its kind at all."""
    digits = len(_digits(piece))
    if kind == "email":
        return "@" in piece[1:-1] and not re.search(r"\s", piece)
    low, high = {"ip": (4, 12), "card": (13, 19), "phone": (7, 15)}[kind]
    if not low <= digits <= high or re.search(r"[^0-9+(). -]", piece):
        return False
    return kind != "card" or luhn(_digits(piece))


def added_spans(tagger: Tagger, texts: list[str], known: list[list[Span]], block: int = 1024) -> list[list[Span]]:
    """Decoded spans that touch no known span, for each text."""
    places = [windows(t) for t in texts]
    coded = [signs(t) if p else None for t, p in zip(texts, places)]
    flat = [(i, at) for i, p in enumerate(places) for at in p]
    best: dict[int, np.ndarray] = {}
    rank: dict[int, np.ndarray] = {}
    inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1
    for k in range(0, len(flat), block):
        part = flat[k:k + block]
        tags = tagger.decode(np.stack([cut(coded[i], at) for i, at in part]))
        for (i, at), row in zip(part, tags):
            if i not in best:
                best[i], rank[i] = (np.zeros(len(texts[i]), dtype=np.int8) for _ in range(2))
            size = min(WINDOW, len(texts[i]) - at)
            # A text's first characters are as central as those of an inner window can be.
            near = inner[:size] if at else np.maximum(inner[:size], 32 * (np.arange(size) < 32))
            better = near > rank[i][at:at + size]
            best[i][at:at + size][better] = row[:size][better]
            rank[i][at:at + size][better] = near[better]
    out: list[list[Span]] = [[] for _ in texts]
    for i, tags in best.items():
        taken = np.zeros(len(tags) + 1, dtype=bool)
        for _, a, b in known[i]:
            taken[a:b] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0]))))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if tags[a:b].any() and not taken[a:b].any():
                kind = KINDS[tags[a] - 1]
                piece = texts[i][a:b]
                a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
                if a < b and _plausible(kind, texts[i][a:b]):
                    out[i].append((kind, a, b))
    return out


def by_kind(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_spans(texts: list[str], tagger: Tagger | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Pattern spans, and all spans, of each text."""
    base = [base_spans(t) if MARK.search(t) else [] for t in texts]
    more = added_spans(tagger, texts, base) if tagger else [[] for _ in texts]
    return base, [by_kind(b + m) for b, m in zip(base, more)]


SPEC = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string, n_added bigint")


def detect(docs: DataFrame, **options) -> DataFrame:
    """Digest of the personal data of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    def make():
        def work(batch):
            base, full = find_spans(batch.column(1).to_pylist(), shared.value)
            counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS]
            return [batch.column(0), *counts, [sha256(span_text(b)) for b in base],
                    [span_text(s) for s in full], [len(s) - len(b) for b, s in zip(base, full)]]

        return work

    return map_slices(doc_texts(docs), make, SPEC)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The same rows with every span masked; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            _, full = find_spans([t or "" for t in texts], shared.value)
            masked = [t if t is None else mask(t, s) for t, s in zip(texts, full)]
            columns = [pa.array(masked, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)

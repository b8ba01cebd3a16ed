"""Quality scores: random Fourier features of document statistics, ridge and isotonic calibration.

Statistics of whole texts are written once. Moments, normal equations and calibration
counts are sums over partitions: the driver receives one row per matrix
entry or score bin, whatever the number of documents.

Defined cases: a null text is empty; empty and blank texts have the statistics of no words
(zero shares); repeated rows each get a row; without a training label every score is 0;
a document with two labels trains with both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from royaltide.llm import calibrate
from royaltide.llm.common import doc_texts, map_slices, pick, remainder, stored

SIZE = 14


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(len(raw), 1)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    high, blank = count[128:].sum(), count[32] + count[9:14].sum()
    signs = len(raw) - upper - lower - digits - high - blank
    plain = count[[44, 46]].sum()
    words = raw.split()
    m = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(upper + lower, 1)
    return [
        np.log1p(len(words)), upper / letters, lower / n, digits / n, high / n, blank / n,
        (signs - plain) / n, plain / n, len(set(words)) / m, len(raw) / m / 10,
        len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)),
        (count[33] + count[63]) / n, len({w[:4] for w in words}) / m,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    def make():
        return lambda batch: [batch.column(0), [list(map(float, statistics(t))) for t in batch.column(1).to_pylist()]]

    return map_slices(doc_texts(docs), make, "doc_id bigint, stats array<double>")


class Features:
    """cos(w.x + b) of standardised statistics, and a constant."""

    def __init__(self, mean, scale, count: int = 192, width: float = 3.0, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (SIZE, count))
        self.b = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _normal_sums(train: DataFrame, features: Features) -> dict[int, float]:
    """Entries of the normal equations, summed over partitions."""

    def run(batches):
        total = 0.0
        for batch in batches:
            z, y = features(_matrix(batch.column(0))), batch.column(1).to_numpy()
            total = total + np.concatenate([z, y[:, None]], axis=1).T @ z
        if not np.isscalar(total):
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    sums = train.select("stats", F.col("label").cast("double")).mapInArrow(run, "k bigint, v double")
    return {r["k"]: r["v"] for r in sums.groupBy("k").agg(F.sum("v").alias("v")).collect()}


class Model:
    def __init__(self, features: Features, weights: np.ndarray) -> None:
        self.features, self.weights = features, weights
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return calibrate.apply(self.knots, self.raw(x))


def _scores(stats: DataFrame, call, keep: str, ddl: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(call(_matrix(batch.column(0))))], names=[keep, "score"])

    return stats.select("stats", keep).mapInArrow(run, f"{keep} {ddl}, score double")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", ridge: float = 1e-3, bins: int = 2000) -> Model | None:
    known = pick(labels, doc_id="doc_id", label=label_col).where("doc_id is not null and label in (0, 1)")
    known = known.select(F.col("doc_id").cast("bigint"), F.col("label").cast("int")).where(remainder(F.col("doc_id"), 5) != 0)
    train = stored(stats.join(known.distinct(), "doc_id").select("stats", "label"), "quality-train")
    moments = train.agg(F.count("*"), *[f(F.col("stats")[i]) for i in range(SIZE) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1::2]), np.maximum(np.array(moments[2::2]), 1e-6)
    features = Features(mean, scale)
    sums = _normal_sums(train, features)
    size = len(features.b) + 1
    table = np.array([sums[k] for k in range(size * (size + 1))]).reshape(size + 1, size)
    model = Model(features, np.linalg.solve(table[:size] + ridge * moments[0] * np.eye(size) / size, table[size]))
    fitted = _scores(train, model.raw, "label", "int").groupBy(F.round(F.col("score") * bins).alias("bin"))
    rows = sorted(fitted.agg(F.avg("label").alias("y"), F.count("*").alias("n")).collect())
    model.knots = calibrate.isotonic([r["bin"] / bins for r in rows], [r["y"] for r in rows], [r["n"] for r in rows])
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    stats = stored(document_statistics(docs), "quality-stats")
    model = fit(stats, labels, **options)
    out = _scores(stats, (lambda x: np.zeros(len(x))) if model is None else model.score, "doc_id", "bigint")
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))

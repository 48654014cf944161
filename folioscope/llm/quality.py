"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is a bias, a linear part and all pairwise interactions with low-rank factors. For factors V the pairs
are summed in linear time as half of sum over factors of ((sum v x)^2 - sum (v x)^2). It is fitted with AdaGrad on a
bounded sample of labelled rows, ``PER_CLASS`` of each class at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _hashing as H
from folioscope.llm._tables import byte_views, tidied
from folioscope.llm._training import labelled_sample, texts_of

WORDS, FACTORS = 1 << 14, 8
PER_CLASS = 3000
STATISTICS = 16


def statistics(text: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_chars: float | None) -> np.ndarray:
    """Shares between 0 and 1, and a constant."""
    out = np.zeros(STATISTICS)
    out[0] = 1.0
    out[1] = 1.0 if n_chars is None else 0.0
    if n_chars is not None:
        out[2] = min(1.0, np.log1p(max(0.0, n_chars)) / 15)
        out[3] = 1.0 if n_chars > len(text) else 0.0
    if len(words) == 0:
        out[4] = 1.0
        return out
    counts = np.bincount(text, minlength=256)
    size = len(text)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    lengths = ends - starts
    lines = np.cumsum(text == 10)[starts]
    out[5] = counts[65:91].sum() / max(1, letters)
    out[6] = counts[48:58].sum() / size
    out[7] = min(1.0, 4 * (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / size)
    out[8] = min(1.0, 4 * counts[[35, 36, 37, 38, 42]].sum() / size)
    out[9] = min(1.0, 8 * counts[124] / size)
    out[10] = min(1.0, 4 * counts[33] / size)
    out[11] = min(1.0, lengths.mean() / 20)
    out[12] = len(np.unique(words)) / len(words)
    out[13] = 1 - len(np.unique(words[1:] + words[:-1] * np.uint64(3))) / max(1, len(words) - 1)
    out[14] = min(1.0, (lines[-1] + 1) / len(words) * 4)
    out[15] = min(1.0, np.log1p(len(words)) / 12)
    return out


def features(text: np.ndarray, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: the words at unit length together, then the statistics."""
    words, starts, ends = H.words(H.lower(text))
    stats = statistics(text, words, starts, ends, n_chars)
    index, counts = np.unique((words >> np.uint64(50)).astype(np.int64), return_counts=True)
    value = np.sqrt(counts)
    if len(value):
        value = value / np.sqrt(counts.sum())
    kept = np.flatnonzero(stats)
    return np.concatenate([index, kept + WORDS]), np.concatenate([value, stats[kept]])


@dataclass
class Model:
    linear: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        pairs = 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())
        z = self.bias + self.linear[index] @ value + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = 5, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """AdaGrad on the weighted log loss; deterministic."""
    draw = np.random.default_rng(7)
    size = WORDS + STATISTICS
    model = Model(np.zeros(size), draw.normal(0, 0.03, (size, FACTORS)), 0.0)
    n_lin, n_fac, n_bias = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            index, value = rows[i]
            v = model.factors[index]
            vx = v * value[:, None]
            total = vx.sum(axis=0)
            z = model.bias + model.linear[index] @ value + 0.5 * ((total**2).sum() - (vx**2).sum())
            error = weights[i] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[i])
            g = error * value + l2 * model.linear[index]
            n_lin[index] += g * g
            model.linear[index] -= rate * g / np.sqrt(n_lin[index])
            g = error * value[:, None] * (total[None, :] - vx) + l2 * v
            n_fac[index] += g * g
            model.factors[index] -= rate * g / np.sqrt(n_fac[index])
            n_bias += error * error
            model.bias -= rate * error / np.sqrt(n_bias)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows (0 or 1). Classes are sampled to a bound and weighted back to their true shares."""
    shares = {r[label]: r["n"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = labelled_sample(labels.where(F.col(label).isin(0, 1)).select(key, label), label, per_class, key, seed=10)
    picked = texts_of(docs.select(key, text, n_chars), sample.withColumnRenamed(label, "label"), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, n in zip(byte_views(batch.column(0)), batch.column(1)):
                index, value = features(raw if raw is not None else np.zeros(0, np.uint8), n.as_py())
                out.append((index.astype(np.int32), value.astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float32())), batch.column(2), batch.column(3)],
                ["index", "value", "label", "order"],
            )

    rows = (
        picked.select(F.col(text).alias("text"), F.col(n_chars).cast("double").alias("n"), F.col("label").cast("int").alias("label"), F.xxhash64(key).alias("order"))
        .mapInArrow(tidied(run), "index array<int>, value array<float>, label int, order long").toArrow().to_pandas().sort_values("order")
    )
    y = rows["label"].to_numpy(np.float64)
    had = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = {c: shares.get(c, 0) / had[c] for c in (0, 1)}
    scale = len(y) / max(1e-9, sum(weight[c] * (y == c).sum() for c in (0, 1)))
    xs = [(i.astype(np.int64), v.astype(np.float64)) for i, v in zip(rows["index"], rows["value"])]
    return fit(xs, y, np.where(y == 1, weight[1], weight[0]) * scale)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``key`` and ``score`` of every text, null and empty ones too (they have statistics but no words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [
                model.score(*features(raw if raw is not None else np.zeros(0, np.uint8), n.as_py()))
                for raw, n in zip(byte_views(batch.column(1)), batch.column(2))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(n_chars).cast("double").alias("n"))
    return picked.mapInArrow(tidied(run), f"key {kind}, score double").withColumnRenamed("key", key)

"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; n-grams of 1 to 4 characters are hashed to 32,768 features with weight
(1 + ln tf) * idf, scaled to unit length. Document frequencies are counted over all training rows. The
weights are fitted with follow-the-regularised-leader (per-coordinate FTRL-proximal with L1 and L2
penalties) on a bounded sample of ``PER_LANGUAGE`` rows of each language, four fifths of it; the rest
gives the temperature that the logits are divided by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._tables import tidied
from folioscope.llm._training import labelled_sample, texts_of

FEATURES, ORDERS = 1 << 15, 4
PER_LANGUAGE = 600
MOST_LANGUAGES = 500
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text. Long texts are worked on in pieces that overlap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    counts, step = np.zeros(FEATURES, np.int64), 1 << 20
    for low in range(0, max(1, len(points)), step):
        piece = points[low : low + step + ORDERS - 1].astype(np.uint64)
        h = np.zeros(len(piece), np.uint64)
        for order in range(ORDERS):
            if order >= len(piece):
                break
            h = (h[: len(piece) - order] * np.uint64(0x100000001B3)) ^ (piece[order:] + np.uint64(order << 32))
            own = h[: min(step, len(h))]
            bucket = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
            counts += np.bincount(bucket.astype(np.int64), minlength=FEATURES)
    return counts


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the unit-length TF-IDF vector."""
    counts = grams(text)
    index = np.flatnonzero(counts)
    value = (1 + np.log(counts[index])) * idf[index]
    size = np.sqrt(value @ value)
    return index, value / size if size else value


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many texts each feature occurs, over all rows; the last entry is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                if has_letter(t):
                    total += grams(t) > 0
                    n += 1
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, FEATURES)), pa.array(np.append(total[index], n))], ["feature", "n"])

    rows = docs.select(F.col(text)).mapInArrow(tidied(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1)  # at most FEATURES + 1 rows come back
    for r in rows:
        out[r["feature"]] = r["n"]
    return out


class Ftrl:
    """FTRL-proximal for a softmax: weights are read lazily from (z, n), zero inside the L1 band."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def read(self, index) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.read(index)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, epochs: int = 3) -> Model:
    """A model from the rows of ``docs`` that have a text with a letter and a language. No such row: a model that knows nothing.

    At most ``per_language`` rows of each of the ``MOST_LANGUAGES`` most frequent languages (ties: the smaller name) are fitted.
    """
    df = document_frequencies(docs, text)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull())
    common = named.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    named = named.join(F.broadcast(common.select("lang")), "lang", "left_semi")  # bounded by the limit
    sample = labelled_sample(named.select("key", "lang"), "lang", per_language, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lang, value in zip(*batch.columns):
                t = value.as_py()
                if has_letter(t):
                    index, x = weighted(t, idf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()], key.type), pa.array([lang.as_py()]), pa.array([index.tolist()], pa.list_(pa.int32())), pa.array([x.tolist()], pa.list_(pa.float32()))],
                        ["key", "lang", "index", "x"],
                    )

    kind = dict(named.dtypes)["key"]
    rows = (
        texts_of(named.drop("lang"), sample, "key").select("key", "lang", "text")
        .mapInArrow(tidied(run), f"key {kind}, lang string, index array<int>, x array<float>")
        .withColumn("order", F.xxhash64("key", F.lit(17))).toArrow().to_pandas().sort_values(["order", "key"])
    )
    languages = sorted(rows["lang"].unique())
    number = {name: i for i, name in enumerate(languages)}
    y = rows["lang"].map(number).to_numpy()
    xs = [(np.append(i, FEATURES).astype(np.int64), np.append(x, 1.0)) for i, x in zip(rows["index"], rows["x"])]
    model = Ftrl(FEATURES + 1, len(languages))
    checked = np.arange(len(xs)) % 5 == 4
    for _ in range(epochs):
        for i in np.flatnonzero(~checked):
            model.learn(*xs[i], y[i])
    w = model.read(slice(None))
    logits = np.zeros((int(checked.sum()), len(languages)))
    for row, j in enumerate(np.flatnonzero(checked)):
        logits[row] = xs[j][1] @ w[xs[j][0]]
    return Model(languages, idf, w[:-1].astype(np.float32), w[-1], temperature(logits, y[checked]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` (the calibrated probability of that language) of every text.

    A null text or one without a letter is ``und`` with score 0, and so is every text if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1):
                t = value.as_py()
                if not m.languages or not has_letter(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                index, x = weighted(t, m.idf)
                p = softmax((x @ m.weights[index] + m.bias) / m.temperature)
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(tidied(run), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)

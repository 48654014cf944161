"""Toxicity with noisy-channel deobfuscation.

A text is read as the output of a channel that writes letters as look-alike signs, repeats letters, and sets signs
between letters. Words that show such marks become a lattice: each sign may stand for itself or for the letters it
looks like, a run of one letter for one, two or all of its copies, a separator between single letters for
nothing. The best path under a character trigram model and the costs of the channel is found by Viterbi, its
states being the last two characters. The trigram counts are gathered from all documents. Restored texts are then
scored by logistic regression on five-character pieces of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._tables import tidied
from folioscope.llm import _hashing as H
from folioscope.llm._training import labelled_sample, texts_of

PER_CLASS = {0: 6000, 1: 3000}
FEATURES_BITS = 20
CLASSES = 128  # of characters in the trigram model
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = " .-_*"
SUBSTITUTED, SHORTENED, KEPT_RUN = -1.5, -0.5, -1.0
WIDEST_GAP = 3  # separators between spelled-out letters
LONGEST = 256  # a marked word beyond this is decoded in pieces of this length

_leet = np.zeros(1 << 16, bool)
_leet[[ord(c) for c in LOOKS_LIKE]] = True
_digit = np.zeros(1 << 16, bool)
_digit[48:58] = True
_sep = np.zeros(1 << 16, bool)
_sep[[ord(c) for c in SEPARATORS]] = True
_letter = np.zeros(1 << 16, bool)
_letter[97:123] = True
_letter[0xDF:] = True
_letter[[0xF7, 0x20AC]] = False
_letter[0x2000:0x2C00] = False
_letter[0x3000:0x3040] = False
_class = np.full(1 << 16, 1, np.int64)  # blanks
_class[33:97] = 2 + np.arange(64) % 26
_class[48:58] = 28 + np.arange(10)
_class[97:123] = 38 + np.arange(26)
_class[123:128] = 2
_class[128:] = 64 + np.arange((1 << 16) - 128) % 64


def points(text: str) -> np.ndarray:
    """Code points, lower-cased; those beyond the basic plane become one stand-in."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(p < 1 << 16, p, 0xFFFD).astype(np.int64)


def trigram_counts(p: np.ndarray) -> np.ndarray:
    c = _class[p]
    return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3) if len(c) > 2 else np.zeros(CLASSES**3, np.int64)


def gather_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram`` and ``n``: trigram counts over every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(CLASSES**3, np.int64), [], 0
        blank = np.array([32, 32])
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                for low in range(0, len(t or ""), 1 << 20):
                    held += [blank, points(t[low : low + (1 << 20)])]
                    size += len(held[-1])
                    if size > 1 << 20:
                        total += trigram_counts(np.concatenate(held))
                        held, size = [], 0
        if held:
            total += trigram_counts(np.concatenate(held))
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(total[gram])], ["gram", "n"])

    return docs.select(F.col(text)).mapInArrow(tidied(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities of a character after two others (at most ``CLASSES``^3 counts come back), smoothed by shorter contexts."""
    tri = np.zeros(CLASSES**3)
    for r in counts.toLocalIterator():
        tri[r["gram"]] = r["n"]
    tri = tri.reshape(CLASSES, CLASSES, CLASSES)
    bi, one = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * CLASSES)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def marked_spans(p: np.ndarray) -> list[tuple[int, int]]:
    """Ranges to decode: words with look-alikes beside letters or a letter three times, words of look-alikes alone with
    two signs that are no digits after their first, and words spelled out in at least three characters with gaps of one width."""
    n = len(p)
    if n < 3:
        return []
    letter, leet = _letter[p], _leet[p]
    edge = np.zeros(1, bool)
    left, right = np.concatenate([edge, letter[:-1]]), np.concatenate([letter[1:], edge])
    hits = leet & (right | left)
    hits[:-2] |= letter[:-2] & (p[:-2] == p[1:-1]) & (p[1:-1] == p[2:])
    spans: list[tuple[int, int]] = []
    unit = letter | leet
    # a sign after another look-alike, and one that differs from the look-alike before it
    after = leet & ~_digit[p] & np.concatenate([edge, leet[:-1]])
    if hits.any() or after.any():
        turns = np.flatnonzero(np.diff(np.concatenate([edge, unit, edge]).astype(np.int8)))
        starts, ends = turns[::2], turns[1::2]
        marked = np.zeros(len(starts), bool)
        marked[np.searchsorted(starts, np.flatnonzero(hits), "right") - 1] = True
        if after.any():
            within = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), turns)[::2]
            differs = unit & np.concatenate([edge, unit[:-1] & (p[1:] != p[:-1])])
            marked |= (within(letter) == 0) & (within(after) >= 2) & (within(differs) > 0)
        for i in np.flatnonzero(marked):
            spans.append((int(starts[i]), int(ends[i])))
    alone = unit & ~np.concatenate([edge, unit[:-1]]) & ~np.concatenate([unit[1:], edge])
    at = np.flatnonzero(alone)
    if len(at) >= 3:
        seps = np.concatenate([[0], np.cumsum(_sep[p])])
        gaps, between = np.diff(at) - 1, seps[at[1:]] - seps[at[:-1] + 1]
        for gap in range(1, WIDEST_GAP + 1):
            joined = (gaps == gap) & (between == gap)
            turns = np.flatnonzero(np.diff(np.concatenate([edge, joined, edge]).astype(np.int8)))
            for a, b in zip(turns[::2], turns[1::2]):
                if b - a >= 2 and letter[at[a : b + 1]].any():
                    spans.append((int(at[a]), int(at[b]) + 1))
    spans.sort()
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            a = out[-1][1]
            while a < b and _sep[p[a]]:
                a += 1
        while b - a > LONGEST:
            out.append((a, a + LONGEST))
            a += LONGEST
        if a < b:
            out.append((a, b))
    return out


def lattice(word: str) -> list[list[tuple[str, float, str]]]:
    """For each run of equal characters what it may have been, with the channel's cost and what the trigram model sees of it:
    of exclamation marks at the end of a word nothing, for they may just end it."""
    steps, i = [], 0
    spelled = len(word) > 2 and word[1] in SEPARATORS
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        run = j - i
        if spelled and c in SEPARATORS:
            steps.append([("", 0.0, "")])
        else:
            options = [(c * run, 0.0 if run < 3 else KEPT_RUN)]
            if run >= 3:
                options += [(c, SHORTENED), (c * 2, SHORTENED)]
            for d in LOOKS_LIKE.get(c, ""):
                options.append((d * min(run, 2), SUBSTITUTED))
                if run > 1:
                    options.append((d, SUBSTITUTED + SHORTENED))
            seen = [letters for letters, _ in options]
            if c == "!" and i > 0 and j == len(word) and not spelled:
                options[0], seen[0] = (c * run, 0.0), ""
            steps.append([(*o, x) for o, x in zip(options, seen)])
        i = j
    return steps


def decode(word: str, lm: np.ndarray) -> str:
    """The best reading of a marked word, by Viterbi over the last two characters."""
    cls = lambda ch: int(_class[min(ord(ch), 0xFFFD)])
    best: dict[tuple[int, int], tuple[float, str]] = {(1, 1): (0.0, "")}
    for options in lattice(word):
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, so_far) in best.items():
            for letters, cost, seen in options:
                x, y, s = a, b, score + cost
                for ch in seen:
                    c = cls(ch)
                    s += float(lm[x, y, c])
                    x, y = y, c
                if (x, y) not in reached or s > reached[x, y][0]:
                    reached[x, y] = (s, so_far + letters)
        best = reached
    return max(((s + float(lm[a, b, 1]), text) for (a, b), (s, text) in best.items()))[1]


class Restorer:
    """Restores texts; readings of recent marked words are remembered."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.known = lm, {}

    def __call__(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text with every marked span read anew."""
        p = points(text)
        pieces, done = [], 0
        for a, b in marked_spans(p):
            word = "".join(map(chr, p[a:b].tolist()))
            got = self.known.get(word)
            if got is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                read = decode(word, self.lm)
                got = self.known[word] = np.array([ord(c) for c in read], np.int64)
            pieces += [p[done:a], got]
            done = b
        return np.concatenate([*pieces, p[done:]]) if pieces else p


def pieces(p: np.ndarray) -> np.ndarray:
    """Hashed five-character pieces of words, the blank before and after a word included. Repeats stay."""
    letter = _letter[np.concatenate([[32], p, [32]])]
    c = np.where(letter, np.concatenate([[32], p, [32]]), 32).astype(np.uint64)
    if len(c) < 5:
        return np.zeros(0, np.int64)
    h = np.zeros(len(c) - 4, np.uint64)
    for i in range(5):
        h = h * np.uint64(0x100000001B3) + c[i : len(c) - 4 + i]
    inside = letter[1:-3] & letter[2:-2] & letter[3:-1]
    return (H.mix(h[inside]) >> np.uint64(64 - FEATURES_BITS)).astype(np.int64)


@dataclass
class Model:
    lm: np.ndarray
    weights: np.ndarray  # by feature, mostly zero
    bias: float

    def score(self, p: np.ndarray) -> float:
        found = pieces(p)
        found = np.unique(found[self.weights[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(), -35, 35))))


def _signal(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of the two shares of documents."""
    share = (pos + neg) / (n_pos + n_neg)
    term = lambda k, n, q: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * q, 1e-9)), 0.0)
    return 2 * (term(pos, n_pos, share) + term(neg, n_neg, share) + term(n_pos - pos, n_pos, 1 - share) + term(n_neg - neg, n_neg, 1 - share))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_class: dict[int, int] | None = None, corpus: DataFrame | None = None) -> Model:
    """A model from the labelled rows (0 or 1), at most ``per_class`` of each; ``corpus`` (default ``docs``) gives the trigram counts.

    Pieces are kept that are clearly commoner in toxic documents (log-likelihood ratio over 15, at least three documents
    and eightfold share). Without labelled rows the score is 0.5 or less for every text.
    """
    lm = language_model(gather_counts(docs if corpus is None else corpus, text))
    shared = docs.sparkSession.sparkContext.broadcast(lm)
    known = labels.where(F.col(label).isin(0, 1))
    sample = labelled_sample(known.select(key, label), label, per_class or PER_CLASS, key, seed=2)
    picked = texts_of(docs.select(key, text), sample.withColumnRenamed(label, "label"), key, text).where(F.col(text).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            for value, label, order in zip(*batch.columns):
                found = np.unique(pieces(restore(value.as_py()))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.int32())), pa.array([label.as_py()], pa.int32()), pa.array([order.as_py()])], ["found", "label", "order"])

    made = picked.select(F.col(text).alias("text"), F.col("label").cast("int"), F.xxhash64(F.col(text)).alias("order"))
    # a copied text counts once, with its largest label
    made = made.groupBy("order").agg(F.first("text").alias("text"), F.max("label").alias("label"))
    rows = made.select("text", "label", "order").mapInArrow(tidied(run), "found array<int>, label int, order long").toArrow().to_pandas().sort_values("order")
    y = rows["label"].to_numpy()
    size = 1 << FEATURES_BITS
    pos, neg = np.zeros(size), np.zeros(size)
    for found, label_ in zip(rows["found"], y):
        (pos if label_ else neg)[found] += 1
    n_pos, n_neg = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    kept = (_signal(pos, neg, n_pos, n_neg) > 15) & (pos >= 3) & ((pos + 0.5) / (n_pos + 1) > 8 * (neg + 0.5) / (n_neg + 1))
    # start from the log ratio of the shares, which a piece of few documents keeps, and mend it where it errs
    ratio = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    weights, bias = np.where(kept, ratio, 0.0), -3.0
    grown, grown_bias = np.full(size, 1e-2), 1e-2
    xs = [found[kept[found]] for found in rows["found"]]
    draw = np.random.default_rng(3)
    for _ in range(10):
        for i in draw.permutation(len(xs)):
            x = xs[i]
            error = 1 / (1 + np.exp(-np.clip(bias + weights[x].sum(), -35, 35))) - y[i]
            g = error + 1e-3 * weights[x]
            grown[x] += g * g
            weights[x] = np.maximum(0.0, weights[x] - 0.5 * g / np.sqrt(grown[x]))
            grown_bias += error * error
            bias -= 0.5 * error / np.sqrt(grown_bias)
    return Model(lm, weights.astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all of the input) and ``out``, the score of each text between 0 and 1.

    A null or empty text is scored like a text without any marked piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns if carry is None else carry
    if out in kept:
        raise ValueError(f"the input already has a column {out!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restore = Restorer(model.lm)
        for batch in batches:
            scores = [model.score(restore(value.as_py() or "")) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    picked = docs.select(*kept, F.col(text).alias("_restored"))
    return picked.mapInArrow(tidied(run), ", ".join([*fields, f"`{out}` double"]))

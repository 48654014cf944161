"""Model hooks. Callers plug in real models; the defaults are deterministic and need none.

An *embedder* maps a text column to a unit-vector column, a *scorer* maps (query, text) columns
to a relevance in (0, 1). Both are plain column functions, so native expressions and iterator
pandas UDFs are interchangeable and compose.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.markup import normalize_marked, normalize_markup
from folioscope.functions.tokens import split_rows

try:  # without the set-up of the library's cryptography, which takes longer than a token
    from _md5 import md5
except ImportError:
    from hashlib import md5

Embedder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]

_BLANKED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_KEPT_TOKENS, _KEPT_BYTES = 1 << 17, 32  # tokens whose hashes a worker keeps, and the longest of them

_hashes: dict[bytes, int] = {}
_last: list = [None, None]  # the texts a worker tokenised last, and their tokens


def embedder_from_model(load: Callable[[], Callable[[list[str]], np.ndarray]], normalize: bool = True) -> Embedder:
    """Embedder around a model: ``load`` runs once per task, its result encodes lists of texts.

    Its ``encoder`` makes the same vectors of lists of texts, for tasks that run several embedders over one batch.
    """
    encoder = partial(_encoder, load, normalize)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors_of = encoder()
        for texts in batches:
            yield pd.Series(list(vectors_of(texts.fillna("").tolist())), index=texts.index)

    encode.encoder = encoder
    return encode


def _encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], normalize: bool) -> Callable[[list[str]], np.ndarray]:
    model = load()

    def vectors_of(texts: list[str]) -> np.ndarray:
        vectors = np.asarray(model(texts), dtype=np.float64)
        if normalize and len(vectors):
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        return vectors.astype(np.float32)

    return vectors_of


def scorer_from_model(load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch: int = 32) -> Scorer:
    """Scorer around a joint (query, text) model, called with at most ``batch`` pairs at a time."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            pairs = list(zip(queries.fillna(""), texts.fillna("")))
            parts = [np.asarray(model(pairs[i : i + batch]), dtype=float) for i in range(0, len(pairs), batch)]
            yield pd.Series(np.concatenate(parts) if parts else [], index=queries.index, dtype=float)

    return score


def _hashes_of(words: pa.Array) -> np.ndarray:
    """The first four bytes of each word's md5; those of short words are kept for the next batch."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    # slices of the column's bytes: a Python object made by Arrow for each word takes several times as long
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).tolist()
    raw = words.buffers()[2].to_pybytes()
    tokens = [raw[a:b] for a, b in zip(ends, ends[1:])]
    found = list(map(_hashes.get, tokens))
    for n in [n for n, known in enumerate(found) if known is None]:
        found[n] = int.from_bytes(md5(tokens[n]).digest()[:4], "big")
        if len(tokens[n]) <= _KEPT_BYTES:
            if len(_hashes) >= _KEPT_TOKENS:
                _hashes.clear()
            _hashes[tokens[n]] = found[n]
    return np.array(found, dtype=np.int64)


def _hashed_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each alphanumeric token. Embedders handed the same list share what the first of them found."""
    if _last[0] is not texts:
        # all bytes of a character beyond ASCII are blanks, as it is no part of a token
        blanked = pa.array([text.lower().encode("utf-8", "replace").translate(_BLANKED) for text in texts], pa.binary()).cast(pa.string())
        tokens, rows = split_rows(blanked)
        coded = tokens.dictionary_encode()
        # each distinct token of the batch is hashed once
        _last[:] = texts, (rows, _hashes_of(coded.dictionary)[coded.indices.to_numpy()])
    return _last[1]


def hashed_tf_embedder(dim: int = 64) -> Embedder:
    """Default embedder: counts of alphanumeric tokens hashed onto ``dim`` axes, unit length."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            rows, hashes = _hashed_tokens(texts)
            at = rows * dim + hashes % dim
            return np.bincount(at, minlength=len(texts) * dim).astype(np.float64).reshape(len(texts), dim)

        return encode

    embedder = embedder_from_model(load)
    embedder.ignores_blanks = True
    return embedder


def normalizing(embedder: Embedder, normalize: Callable[[Column], Column] = normalize_markup) -> Embedder:
    """Wrap an embedder so that only what it encodes is normalised; stored text stays raw."""
    if normalize is normalize_markup and getattr(embedder, "ignores_blanks", False):
        normalize = normalize_marked

    def encode(c: Column) -> Column:
        return embedder(normalize(c))

    encode.encoder, encode.reads = getattr(embedder, "encoder", None), normalize
    return encode


@dataclass(frozen=True)
class OverlapScorer:
    """Share of the question's tokens found in the text, through a logistic."""

    steepness: float = 8.0
    midpoint: float = 0.35

    def of_share(self, share: Column) -> Column:
        return F.round(1 / (1 + F.exp(-F.lit(self.steepness) * (share - F.lit(self.midpoint)))), 9)

    def __call__(self, query: Column, text: Column) -> Column:
        return self.of_sets(T.alnum_set(query), T.alnum_set(text))

    def of_sets(self, wanted: Column, held: Column) -> Column:
        """The score of token sets made before, for tables that meet the same text many times."""
        return self.of_share(
            F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, held)) / F.size(wanted)).otherwise(F.lit(0.0))
        )

    def needs_a_token(self, floor: float) -> bool:
        """Whether a text that shares no token with the question stays below ``floor``."""
        return self.steepness > 0 and round(1 / (1 + math.exp(self.steepness * self.midpoint)), 9) < floor

    def least_hits(self, n: Column, floor: float) -> Column:
        """Fewest of a question's ``n`` tokens a text must hold to reach ``floor``; ``n + 1`` if all are too few."""
        return F.size(F.filter(F.sequence(F.lit(0), n), lambda hits: self.of_share(hits / n) < F.lit(floor)))


def overlap_scorer(steepness: float = 8.0, midpoint: float = 0.35) -> Scorer:
    """Default scorer."""
    return OverlapScorer(steepness, midpoint)

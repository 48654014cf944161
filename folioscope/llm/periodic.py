"""Periodic runs of words by recursive frequency splitting and a lag scan of what survives.

A run of period q is at least 4 q words long, so each of its words occurs four times in it. A word that occurs less
often in the current segment joins no run and splits the segment; pieces under six words go. Pieces that lost a
word are counted anew, until all are stable. Natural text is gone after two or three rounds.

Survivors are scanned for lags, an octave of them at a time. For the lags from c/2 to below c, windows of c words are
compared with their nearest earlier occurrence in the segment. Inside a run of such a period that occurrence is
exactly one period back: a window of at least q words fixes its place in the period. So a run is a stretch of windows
with one and the same lag, and a stretch that is long enough is a whole run with its smallest period. Windows that
occur once in their segment are left out of the wider octaves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _hashing as H
from folioscope.llm._tables import byte_views, small_batches, tidied

SHORTEST, TIMES = 6, 4  # a run has so many words, and so many periods
BATCH_WORDS = 1 << 18

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
Rearrange = Callable[[object, int], np.ndarray | None]


def surviving(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that can be in a run, rising, and the number of each one's segment (rising, a new number for
    each stretch of neighbouring places). ``segment`` numbers the texts the words come from, rising."""
    at, owner = np.arange(len(words)), segment.astype(np.int64)
    span = int(words.max()) + 1 if len(words) else 1
    done = []
    while len(at):
        _, which, many = np.unique(owner * span + words[at], return_inverse=True, return_counts=True)
        often = many[which] >= TIMES
        lost = np.zeros(int(owner[-1]) + 1, bool)
        lost[owner[~often]] = True
        stable = ~lost[owner]
        done.append(at[stable])
        going = often & ~stable
        at, owner = at[going], owner[going]
        if len(at) == 0:
            break
        owner = _stretches(at, owner)
        enough = np.bincount(owner)[owner] >= SHORTEST
        at = at[enough]
        owner = _dense(owner[enough])
    at = np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)
    owner = _stretches(at, segment[at]) if len(at) else np.zeros(0, np.int64)
    return at, owner


def _stretches(at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the stretches of neighbouring places with one owner."""
    return np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(owner) != 0))])


def _dense(owner: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.diff(owner) != 0)]) if len(owner) else owner


def runs(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """``start, length, period`` of every run, as rows; starts are places in ``words``. Words are numbers below 2^32."""
    at, owner = surviving(words, segment)
    found = [np.zeros((0, 3), np.int64)]
    if len(at) == 0:
        return found[0]
    kept = words[at]
    size = np.bincount(owner)
    ends = np.cumsum(size)[owner]
    left, size = ends - np.arange(len(at)), size[owner]
    prefix = H.running(H.mix(kept.astype(np.uint64) + np.uint64(1)), H.WORD_BASE)
    mark = H.mix(owner.astype(np.uint64) + np.uint64(H.BYTE_BASE))
    alive, width = np.arange(len(at)), 2
    while len(alive):
        # lags from width / 2 to width - 1
        alive = alive[(left[alive] >= width) & (size[alive] >= max(SHORTEST, TIMES * width // 2))]
        if len(alive) == 0:
            break
        window = H.ranges(prefix, alive, alive + width, H.WORD_BASE) ^ mark[alive]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        later, earlier = alive[order[1:][same]], alive[order[:-1][same]]
        lag = np.zeros(len(at), np.int64)
        lag[later] = later - earlier
        again = np.zeros(len(at), bool)
        again[later] = again[earlier] = True
        alive = np.flatnonzero(again)
        here = np.flatnonzero((lag >= width // 2) & (lag < width))
        if len(here):
            new = (np.diff(here) != 1) | (np.diff(lag[here]) != 0) | (np.diff(owner[here]) != 0)
            first = here[np.concatenate([[True], new])]
            last = here[np.concatenate([new, [True]])]
            period = lag[first]
            length = last - first + width + period
            whole = length >= np.maximum(SHORTEST, TIMES * period)
            found.append(np.stack([at[first] - period, length, period], axis=1)[whole])
        width *= 2
    rows = np.concatenate(found)
    true = [np.array_equal(words[s : s + n - q], words[s + q : s + n]) for s, n, q in rows]  # hashes chose, words decide
    rows = rows[np.array(true, bool)]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rearrange: Rearrange | None = None) -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length and period in words, by start, then period), ``collapsed`` (the words
    that are in no run behind its first period, joined by one space) and ``n_dropped``, one row per input row.

    Words are separated by the space and the bytes 09-0D. A null text has no words and an empty ``collapsed``. Rows are
    read by themselves, so null or repeated keys change nothing, and other columns are left behind.
    ``rearrange(key, n)`` may give the places of the words to be read instead of the first n. Every text is in one task;
    its working memory is about 100 bytes a word.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    out = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string()), ("n_dropped", pa.int64())])

    def worked(keys: list, texts: list[list[bytes]]) -> list[pa.Array]:
        number: dict[bytes, int] = defaultdict(count().__next__)
        sizes = np.array([len(t) for t in texts], np.int64)
        words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        rows = runs(words, np.repeat(np.arange(len(texts)), sizes))
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
        np.add.at(drop, rows[:, 0] + rows[:, 1], -1)
        stays = np.cumsum(drop[:-1]) == 0
        of = np.searchsorted(begins, rows[:, 0], "right") - 1
        starts = rows[:, 0] - begins[of]
        offsets = np.searchsorted(of, np.arange(len(texts) + 1))
        dropped = sizes - np.add.reduceat(np.append(stays, False), begins[:-1]) * (sizes > 0) if len(texts) else sizes
        collapsed = []
        for i, t in enumerate(texts):
            mine = stays[begins[i] : begins[i + 1]]
            collapsed.append(b" ".join(t if dropped[i] == 0 else compress(t, mine.tolist())).decode("utf-8", "replace"))
        structs = pa.StructArray.from_arrays([pa.array(starts), pa.array(rows[:, 1]), pa.array(rows[:, 2])], ["start", "length", "period"])
        return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(collapsed, pa.string()), pa.array(dropped, pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts, many, low = [], 0, 0
            for i, raw in enumerate(byte_views(batch.column(1))):
                words = raw.tobytes().split() if raw is not None else []
                places = rearrange(keys[i], len(words)) if rearrange is not None else None
                texts.append(words if places is None else [words[p] for p in places.tolist()])
                many += len(texts[-1])
                if many >= BATCH_WORDS or i == batch.num_rows - 1:
                    columns = worked(keys[low : i + 1], texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, i + 1 - low), *columns], ["key", *out.names])
                    texts, many, low = [], 0, i + 1

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(tidied(run), f"key {kind}, n_words long, runs {RUNS}, collapsed string, n_dropped long").withColumnRenamed("key", key)

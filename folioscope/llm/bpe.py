"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every pre-token is merged by itself. Each adjacent pair that has a merge rank is filed under that rank: a
bucket holds the positions of the pair in the linked list of parts, and two levels of bitmaps say
which buckets are filled. Find-first-set on the bitmaps gives the lowest rank, its bucket the leftmost
position. Entries whose pair has changed meanwhile are skipped when they come up. A merge costs a
constant number of word operations however long the pre-token is.

Ranks, pattern and texts come from the caller; the rank file is read on the driver and shipped to the
executors as a broadcast of fixed size (the vocabulary).
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._tables import tidied

CACHE = 300_000
BATCH_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder(dict):
    """Ids of pre-tokens as packed 32-bit integers; recent ones are remembered: ``cache`` of them, and as many before
    those, which come back when they are met again.

    The rank queue lives here, empty between pre-tokens: ``filled`` has a bit for every block of 256 ranks with a
    filled bucket, ``blocks`` a bit for every such rank, ``buckets`` the positions of each rank as a heap.
    """

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE):
        super().__init__()
        self.ranks, self.cache = ranks, cache
        self.older: dict[str, bytes] = {}
        size = max(ranks.values(), default=0) + 1
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.blocks = [0] * ((size >> 8) + 1)
        self.bytes = [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = array("i", (whole,) if whole is not None else self.merge(raw)).tobytes()
        if len(piece) < 256:
            if len(self) >= self.cache:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> tuple[int, ...]:
        rank_of, buckets, blocks, pairs, n = self.ranks.get, self.buckets, self.blocks, self.bytes, len(raw)
        after = list(range(1, n + 1))  # start of the next part; n at the end
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of a part joined with the next one
        filled = live = 0  # live: parts that can be joined with the next one
        used = []  # ranks whose bits and buckets must be empty in the end
        last = raw[0]
        for i in range(1, n):
            byte = raw[i]
            rank = pairs[(last << 8) | byte]
            last = byte
            if rank >= 0:
                pair[i - 1] = rank
                live += 1
                bucket = buckets[rank]
                if not bucket:
                    blocks[rank >> 8] |= 1 << (rank & 255)
                    filled |= 1 << (rank >> 8)
                    used.append(rank)
                bucket.append(i - 1)  # rising positions are a heap
        while live:
            block = (filled & -filled).bit_length() - 1
            word = blocks[block]
            rank = (block << 8) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                word = blocks[block] = word & (word - 1)
                if not word:
                    filled &= filled - 1
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[i] = after[j]
            live -= 1 if pair[j] < 0 else 2
            pair[j] = pair[i] = -1
            if end < n:
                before[end] = i
                rank = rank_of(raw[i : after[end]])
                if rank is not None:
                    pair[i] = rank
                    live += 1
                    bucket = buckets[rank]
                    if not bucket:
                        blocks[rank >> 8] |= 1 << (rank & 255)
                        filled |= 1 << (rank >> 8)
                        used.append(rank)
                    heappush(bucket, i)
            h = before[i]
            if h >= 0:
                if pair[h] >= 0:
                    live -= 1
                rank = rank_of(raw[h:end])
                if rank is None:
                    pair[h] = -1
                else:
                    pair[h] = rank
                    live += 1
                    bucket = buckets[rank]
                    if not bucket:
                        blocks[rank >> 8] |= 1 << (rank & 255)
                        filled |= 1 << (rank >> 8)
                        used.append(rank)
                    heappush(bucket, h)
        for rank in used:  # only stale entries are left
            buckets[rank].clear()
            blocks[rank >> 8] = 0
        ids, i = [], 0
        while i < n:
            ids.append(rank_of(raw[i : after[i]]))
            i = after[i]
        return tuple(ids)


#: Characters whose categories the standard library names like the pattern does; they hold no number but 0-9.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7e\xa0-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u024f]")


_remembered: list[Encoder] = []


def _encoder(ranks: dict[bytes, int], remember: bool) -> Encoder:
    if remember and _remembered and _remembered[0].ranks is ranks:
        return _remembered[0]
    _remembered.clear()
    made = Encoder(ranks, 3 * CACHE if remember else CACHE)
    if remember:
        _remembered.append(made)
    return made


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text. Where a text has plain characters only, letters and numbers are spelled out in classes
    that the faster standard library knows."""
    import regex

    full = regex.compile(pattern).findall
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in spelled:
        return full
    quick = re.compile(spelled).findall
    return lambda text: full(text) if _PLAIN.search(text) else quick(text)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False,
    remember: bool = False,
) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every text, one row per input row; with ``decoded`` also the bytes that the
    ids decode to, as :func:`decode` gives them, without a second way through Python.

    ``remember`` keeps the pre-tokens a worker has met from task to task, three times as many, at the cost of its memory (up to
    about 400 MB).

    A null or empty text has no ids. Special tokens are never produced. All single bytes must have ranks.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must hold all 256 single bytes")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        encoder = _encoder(shared.value, remember)
        table = {i: t for t, i in shared.value.items()} if decoded else {}

        def packed(keys: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns = [pa.array(keys, key_type), ids]
            if decoded:
                columns.append(pa.array([_bytes(p, table) for p in parts], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"][: len(columns)])

        for batch in batches:
            key_type = batch.column(0).type
            keys, parts, size = [], [], 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                ids = np.frombuffer(b"".join(map(encoder.__getitem__, split(value or ""))), np.int32)
                keys.append(k)
                parts.append(ids)
                size += len(ids)
                if size > BATCH_IDS:
                    yield packed(keys, parts)
                    keys, parts, size = [], [], 0
            if keys:
                yield packed(keys, parts)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), f"key {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("key", key)


def _bytes(ids: np.ndarray, table: dict[int, bytes]) -> bytes:
    return b"".join([table[x] for x in ids.tolist()])


def decode(encoded: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``decoded`` (binary) of every id list; a null list decodes to no bytes.

    An id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in shared.value.items()}
        for batch in batches:
            lists = batch.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy()
            out = []
            for i in range(len(lists)):
                out.append(_bytes(flat[at[i] : at[i + 1]], table) if lists[i].is_valid else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], ["key", "ids", "decoded"])

    picked = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return picked.mapInArrow(tidied(run), f"key {kinds[key]}, ids array<int>, decoded binary").withColumnRenamed("key", key)

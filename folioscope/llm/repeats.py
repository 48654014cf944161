"""Substring dedup by level-wise doubling.

A word is removed if a window of ``size`` words that covers it also starts earlier: in a document with a
smaller id, or earlier in its own. Finding such windows starts at a short length. Windows of that
length that occur more than once anywhere are the only ones extended: a window of twice the length is
a candidate if both its halves were repeated. This goes on up to ``size``, or ends before if no
candidates survive. The short lengths only rule windows out, so they compare truncated hashes; at the full
length 96 bits and the place of the first occurrence are compared.

Documents are dealt to buckets once, and every level works on that one shuffle of the texts. A
bucket sends each hash range the sorted distinct hashes of its windows, packed into one row, and gets
back one bit per hash. A passage that a third of all documents share is thus one hash per bucket, not one
row per document.
"""

from __future__ import annotations

import struct
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _hashing as H
from folioscope.llm._tables import byte_views, release, shuffle_width

SIZE, DOUBLINGS = 20, 1
BUCKET_BYTES = 4 << 20
SECOND_BASE = 0xB5297A4D3F84D5B5

BLOB, STATE, REPLY = 0, 1, 2
MESSAGE = "to int, kind int, sender int, data binary"
_message = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("sender", pa.int32()), ("data", pa.binary())])


def lengths(size: int, doublings: int = DOUBLINGS) -> list[int]:
    """The lengths of the levels: ``size`` and up to so many halves of it, as long as they are whole."""
    out = [size]
    while len(out) <= doublings and out[0] % 2 == 0 and out[0] > 2:
        out.insert(0, out[0] // 2)
    return out


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes: the low 16 bits as they are, the rest as differences."""
    high = sorted_hashes >> np.uint64(16)
    steps = np.diff(high)
    most = int(steps.max()) if len(steps) else 0
    kind = 1 if most < 256 else 2 if most < 65536 else 8
    low = (sorted_hashes & np.uint64(0xFFFF)).astype("<u2").tobytes()
    return struct.pack("<IQB", len(high), int(high[0]), kind) + low + zlib.compress(steps.astype(f"<u{kind}").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    n, first, kind = struct.unpack_from("<IQB", data)
    low = np.frombuffer(data, "<u2", n, 13).astype(np.uint64)
    high = np.full(n, first, np.uint64)
    high[1:] += np.cumsum(np.frombuffer(zlib.decompress(data[13 + 2 * n :]), f"<u{kind}").astype(np.uint64), dtype=np.uint64)
    return (high << np.uint64(16)) | low


def pack_first(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """Full hashes with the first place of each."""
    base, span = int(doc.min()), int(doc.max()) - int(doc.min())
    wide_doc, wide_start = ("<u4" if span < 1 << 32 else "<u8"), ("<u2" if int(start.max()) < 1 << 16 else "<u8")
    shifted = (doc.astype(np.uint64) - np.uint64(base & H.MASK)).astype(wide_doc)
    head = struct.pack("<IqBB", len(h1), base, int(wide_doc[2]), int(wide_start[2]))
    return head + h1.astype("<u8").tobytes() + h2.astype("<u4").tobytes() + shifted.tobytes() + start.astype(wide_start).tobytes()


def unpack_first(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, base, wide_doc, wide_start = struct.unpack_from("<IqBB", data)
    at = 14
    h1 = np.frombuffer(data, "<u8", n, at)
    h2 = np.frombuffer(data, "<u4", n, at + 8 * n)
    doc = np.frombuffer(data, f"<u{wide_doc}", n, at + 12 * n).astype(np.uint64) + np.uint64(base & H.MASK)
    start = np.frombuffer(data, f"<u{wide_start}", n, at + (12 + wide_doc) * n).astype(np.int64)
    return h1, h2, doc.view(np.int64), start


class Bucket:
    """The words of a bucket's documents, end to end, in the order of (id, hash of the text)."""

    def __init__(self, table: pa.Table):
        ids, marks = table.column("_d").to_numpy(), table.column("_mark").to_numpy()
        self.order = np.lexsort((marks, ids))
        texts = list(byte_views(table.column("_text").combine_chunks()))
        self.texts = [texts[i] for i in self.order]
        parts = [H.words(t)[0] if t is not None else np.zeros(0, np.uint64) for t in self.texts]
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        self.left = np.repeat(self.begins[1:], self.counts) - np.arange(len(self.words))  # words up to the document's end
        self.ids = ids[self.order]

    def hashes(self, at: np.ndarray, size: int, base: int = H.WORD_BASE) -> np.ndarray:
        return H.ranges(H.running(self.words, base), at, at + size, base)

    def candidates(self, size: int, survived: np.ndarray | None) -> np.ndarray:
        """Starts of windows within one document, both halves of which survived the level before."""
        fits = self.left >= size
        if survived is not None:
            half = size // 2
            shifted = np.zeros(len(survived), bool)
            shifted[: len(survived) - half] = survived[half:]
            fits &= survived & shifted
        return np.flatnonzero(fits)


def _short(bucket: Bucket, at: np.ndarray, size: int, bits: int) -> np.ndarray:
    return bucket.hashes(at, size) >> np.uint64(64 - bits)


def _owner(hashes: np.ndarray, bits: int, many: int) -> np.ndarray:
    """The hash range of each hash, rising with it."""
    top = (hashes >> np.uint64(bits - 32)) if bits > 32 else hashes << np.uint64(32 - bits)
    return ((top * np.uint64(many)) >> np.uint64(32)).astype(np.int64)


def _split(owner: np.ndarray):
    """(range, slice) of the runs of equal owners."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield int(owner[a]), slice(a, b)


def _replies(messages: pa.Table) -> tuple[np.ndarray | None, np.ndarray]:
    """The state and the answers a bucket was sent, answers in the order of the hash ranges."""
    rows = sorted(zip(*(messages.column(c).to_pylist() for c in ("kind", "sender", "data"))))
    state = next((np.frombuffer(d, np.uint8) for k, _, d in rows if k == STATE), None)
    bits = []
    for kind, _, data in rows:
        if kind == REPLY:
            n = struct.unpack_from("<I", data)[0]
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=n).astype(bool))
    return state, np.concatenate(bits) if bits else np.zeros(0, bool)


def _reply(flags: np.ndarray) -> bytes:
    return struct.pack("<I", len(flags)) + np.packbits(flags).tobytes()


def _survivors(bucket: Bucket, size: int, earlier: np.ndarray | None, answers: np.ndarray, bits: int) -> np.ndarray:
    """Which starts have a window of this length that is repeated in the bucket or elsewhere."""
    at = bucket.candidates(size, earlier)
    _, inverse, counts = np.unique(_short(bucket, at, size, bits), return_inverse=True, return_counts=True)
    out = np.zeros(len(bucket.words), bool)
    if len(at):
        out[at] = (answers | (counts > 1))[inverse]
    return out


def _firsts(bucket: Bucket, at: np.ndarray, size: int):
    """Candidates in the order of their full hashes and places, and where each distinct hash begins."""
    h1, h2 = bucket.hashes(at, size), bucket.hashes(at, size, SECOND_BASE) >> np.uint64(32)
    row = np.searchsorted(bucket.begins, at, "right") - 1
    doc, start = bucket.ids[row], at - bucket.begins[row]
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start, at = h1[order], h2[order], doc[order], start[order], at[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(at) else np.zeros(0, bool)
    return h1, h2, doc, start, at, new


def _then_release(out: pa.Table) -> pa.Table:
    release()
    return out


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, doublings: int = DOUBLINGS, carry: list[str] | None = None
) -> DataFrame:
    """``key``, ``kept`` (the kept words joined by one space), ``n_words``, ``n_removed`` and the ``carry`` columns, one
    row per input row.

    A null text has no words and a null ``kept``. A null key counts as smaller than all others; rows with the same key
    are the same document: a window is not earlier than the same place of another such row. ``carry`` must not
    hold names that begin with ``_``.
    """
    carry = list(carry or [])
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    many = max(shuffle_width(docs), -(-total // BUCKET_BYTES))
    bits = min(60, max(32, (total // 4 + 1).bit_length() + 10))
    levels = lengths(size, doublings)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(many)).cast("int").alias("to"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_d"),
        F.xxhash64(F.col(text)).alias("_mark"),
        F.col(text).alias("_text"),
        F.col(key).alias("_key"),
        *[F.col(c) for c in carry],
    )
    by_bucket = dealt.groupBy("to")

    def rows(out: list[tuple[int, int, int, bytes]]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _message)], schema=_message) if out else _message.empty_table()

    def ask(bucket: Bucket, me: int, level: int, survived: np.ndarray | None) -> pa.Table:
        at = bucket.candidates(levels[level], survived)
        out = []
        if survived is not None:
            out.append((me, STATE, me, np.packbits(survived).tobytes()))
        if level < len(levels) - 1:
            hashes = np.unique(_short(bucket, at, levels[level], bits))
            for to, part in _split(_owner(hashes, bits, many)):
                out.append((to, BLOB, me, pack(hashes[part])))
        else:
            h1, h2, doc, start, _, new = _firsts(bucket, at, levels[level])
            h1, h2, doc, start = h1[new], h2[new], doc[new], start[new]
            for to, part in _split(_owner(h1, 64, many)):
                out.append((to, BLOB, me, pack_first(h1[part], h2[part], doc[part], start[part])))
        return rows(out)

    def answer(last: bool):
        def run(messages: pa.Table) -> pa.Table:
            out, blobs, senders = [], [], []
            for to, kind, sender, data in zip(*(messages.column(c).to_pylist() for c in ("to", "kind", "sender", "data"))):
                if kind == STATE:
                    out.append((sender, STATE, sender, data))
                else:
                    me = to
                    blobs.append(unpack_first(data) if last else unpack(data))
                    senders.append(sender)
            if not blobs:
                return rows(out)
            if last:
                h1, h2, doc, start = (np.concatenate(c) for c in zip(*blobs))
                sizes = [len(b[0]) for b in blobs]
                order = np.lexsort((start, doc, h2, h1))
                a, b = h1[order], h2[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                flags = np.empty(len(order), bool)
                flags[order] = (doc[first] == doc[order]) & (start[first] == start[order])
            else:
                sizes = [len(b) for b in blobs]
                every = np.concatenate(blobs)
                ordered = np.sort(every)
                again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
                flags = np.zeros(len(every), bool)
                if len(again):
                    found = np.minimum(np.searchsorted(again, every), len(again) - 1)
                    flags = again[found] == every
            for sender, part in zip(senders, np.split(flags, np.cumsum(sizes)[:-1])):
                out.append((sender, REPLY, me, _reply(part)))
            return rows(out)

        return run

    def first_ask(key: tuple, table: pa.Table) -> pa.Table:
        return _then_release(ask(Bucket(table), key[0].as_py(), 0, None))

    def bits_of(state: np.ndarray | None, n: int) -> np.ndarray | None:
        return None if state is None else np.unpackbits(state, count=n).astype(bool)

    def next_ask(level: int):
        def run(key: tuple, table: pa.Table, messages: pa.Table) -> pa.Table:
            if table.num_rows == 0:
                return rows([])
            bucket = Bucket(table)
            state, answers = _replies(messages)
            survived = _survivors(bucket, levels[level - 1], bits_of(state, len(bucket.words)), answers, bits)
            return _then_release(ask(bucket, key[0].as_py(), level, survived))

        return run

    kinds = {f.name: f.dataType for f in docs.schema}
    fields = [f"`{key}` {kinds[key].simpleString()}", "kept string", "n_words long", "n_removed long", *[f"`{c}` {kinds[c].simpleString()}" for c in carry]]

    def apply(table: pa.Table, messages: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        state, answers = _replies(messages)
        at = bucket.candidates(size, bits_of(state, len(bucket.words)))
        _, _, doc, start, at, new = _firsts(bucket, at, size)
        delta = np.zeros(len(bucket.words) + 1, np.int64)
        if len(at):
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            earliest = answers[np.cumsum(new) - 1] & (doc == doc[head]) & (start == start[head])
            hit = at[~earliest]
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + size, -1)
        gone = np.cumsum(delta[:-1]) > 0
        kept, removed = [], np.zeros(len(bucket.texts), np.int64)
        for i, t in enumerate(bucket.texts):
            if t is None:
                kept.append(None)
                continue
            mine = gone[bucket.begins[i] : bucket.begins[i + 1]]
            removed[i] = mine.sum()
            parts = t.tobytes().split()
            kept.append(b" ".join(compress(parts, (~mine).tolist()) if removed[i] else parts).decode("utf-8", "replace"))
        ordered = table.take(pa.array(bucket.order))
        columns = [ordered.column("_key"), pa.array(kept, pa.string()), pa.array(bucket.counts), pa.array(removed), *[ordered.column(c) for c in carry]]
        return _then_release(pa.Table.from_arrays(columns, names=[key, "kept", "n_words", "n_removed", *carry]))

    messages = by_bucket.applyInArrow(first_ask, MESSAGE)
    for level in range(len(levels)):
        messages = messages.groupBy("to").applyInArrow(answer(level == len(levels) - 1), MESSAGE)
        if level < len(levels) - 1:
            messages = by_bucket.cogroup(messages.groupBy("to")).applyInArrow(next_ask(level + 1), MESSAGE)
    return by_bucket.cogroup(messages.groupBy("to")).applyInArrow(apply, ", ".join(fields))

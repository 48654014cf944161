"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs (its lines, blank ones left out). Every paragraph is hashed to a wide
vector, and the fingerprint is the sum of the vectors: 8 lanes of 64 bits modulo 2^64, which tell texts
apart, and 256 lanes of 32 bits modulo 2^32 for likeness. Sums do not depend on order, and a paragraph
is inserted or deleted by adding or subtracting its vector.

For likeness a paragraph is cut into runs of words wherever a word's hash says so, so an edit only changes
the runs it touches. Each run adds +1 or -1 to one lane; the cosine of two such sums estimates how
much of the two texts is shared (standard error about 1/16). A text of at most 2 GB, which is all that a string column holds, has
under 2^30 runs, so no lane of it wraps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _hashing as H
from folioscope.llm._tables import shuffle_width, tidied

WIDE, LANES = 8, 256
CUT = 8  # one word in so many ends a run
_SEEDS = (np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))[:, None]

Fingerprint = tuple[np.ndarray, np.ndarray]


def zero() -> Fingerprint:
    return np.zeros(WIDE, np.uint64), np.zeros(LANES, np.uint32)


def fingerprint(raw: bytes) -> Fingerprint:
    """The sum over all paragraphs of a UTF-8 text; nothing but blanks gives the zero fingerprint."""
    text = np.frombuffer(raw, np.uint8)
    words, starts, ends = H.words(text)
    if len(words) == 0:
        return zero()
    # a paragraph ends at the last word before a line feed
    feeds = np.flatnonzero(text == 10)
    line = np.searchsorted(feeds, starts)
    last = np.append(line[1:] != line[:-1], True)
    firsts = np.append(0, np.flatnonzero(last)[:-1] + 1)
    prefix = H.running(words, H.WORD_BASE)
    paragraphs = H.ranges(prefix, firsts, np.flatnonzero(last) + 1, H.WORD_BASE)
    wide = H.mix(paragraphs[None, :] ^ _SEEDS).sum(axis=1, dtype=np.uint64)
    stops = np.flatnonzero(last | (H.mix(words) % np.uint64(CUT) == 0)) + 1
    runs = H.ranges(prefix, np.append(0, stops[:-1]), stops, H.WORD_BASE)
    lane = (runs % np.uint64(LANES)).astype(np.int64)
    sign = np.where((runs >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    lanes = np.bincount(lane, sign, LANES).astype(np.int64).astype(np.uint32)
    return wide, lanes


def add(a: Fingerprint, b: Fingerprint) -> Fingerprint:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: Fingerprint, b: Fingerprint) -> Fingerprint:
    return a[0] - b[0], a[1] - b[1]


def to_text(f: Fingerprint) -> str:
    return f[0].astype(">u8").tobytes().hex() + f[1].astype(">u4").tobytes().hex()


def from_text(s: str) -> Fingerprint:
    raw = bytes.fromhex(s)
    return np.frombuffer(raw[: 8 * WIDE], ">u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], ">u4").astype(np.uint32)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1 for equal fingerprints, else the cosine of the lanes, at least 0."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].astype(np.int32).astype(np.float64), b[1].astype(np.int32).astype(np.float64)
    size = float(x @ x) * float(y @ y)
    return min(1.0, max(0.0, float(x @ y) / size**0.5)) if size else 0.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` (hex) of every text; a null text is an empty one."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [to_text(fingerprint((t.as_py() or "").encode())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["key", "fingerprint"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def _edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def edit_probe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text.

    The next text is the one with the next smaller integer key (null last; rows with equal keys follow each
    other by text); after the last comes the first. A table of one row follows itself.

    Keys are cut into ranges of about equal size. Each range is read in order by one task, one row at a time, and
    the first rows of a range are also sent to the end of the range before it, so whole texts move once.
    """
    from hashlib import sha256

    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = rows.select("key")
    width = 4 * shuffle_width(rows)
    steps = [i / width for i in range(1, width)]
    cuts = keys.agg(F.percentile_approx("key", steps, 10 * width).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    # range 0 has the largest keys; null keys follow the smallest
    number = F.lit(len(cuts) + 1)
    if cuts:
        ordered = F.array(*[F.lit(c).cast("long") for c in cuts])
        number = F.when(F.col("key").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(ordered, lambda c: c > F.col("key"))))
    heads = sorted(
        (r["part"], r["head"]) for r in keys.withColumn("part", number).groupBy("part").agg(F.max("key").alias("head")).collect()
    )
    # one row per range: the range that its first rows are copied to
    before = spark.createDataFrame(
        [(p, h, heads[i - 1][0]) for i, (p, h) in enumerate(heads)], "part int, head long, previous int"
    )
    placed = rows.withColumn("part", number.cast("int")).join(F.broadcast(before), "part")
    copied = F.col("key").eqNullSafe(F.col("head"))
    own = F.struct(F.col("part"), F.lit(False).alias("copy"))
    also = F.struct(F.col("previous").alias("part"), F.lit(True).alias("copy"))
    dealt = placed.select("key", "text", F.explode(F.when(copied, F.array(own, also)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("key", "text", F.col("to.part").alias("part"), F.col("to.copy").alias("copy"))
    dealt = dealt.repartition(shuffle_width(rows), "part").sortWithinPartitions(
        "part", "copy", F.col("key").desc_nulls_last(), "text"
    )

    schema = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, text, part and fingerprint of the row before
        for batch in batches:
            out = []
            for k, t, part, copy in zip(*(batch.column(i) for i in range(4))):
                k, t, part, copy = k.as_py(), t.as_py(), part.as_py(), copy.as_py()
                if held is None and copy:
                    continue
                mine = fingerprint(t.encode())
                if held is not None:
                    text = held[1]
                    edited = _edited(text, t).encode()
                    other = fingerprint(edited)
                    out.append(
                        (
                            held[0], len(text), sha256(edited).hexdigest(), to_text(held[3]), to_text(other),
                            likeness(held[3], other), likeness(held[3], mine),
                        )
                    )
                held = None if copy else (k, t, part, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.select("key", "text", "part", "copy").mapInArrow(tidied(run), OUT).withColumnRenamed("key", key)


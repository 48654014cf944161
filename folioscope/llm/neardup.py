"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find grouping.

SuperMinHash gives every element a random permutation of the slots and a random fraction for each rank; a slot keeps
the least ``rank + fraction`` it is offered. Ranks are worked on one after the other for all elements at once, and as a
rank can no longer lower a slot that is below it, the work stops at the first rank that all slots are below:
after two or three ranks for a text of some hundred shingles.

Texts with the same set of shingles form a class, and one text stands for it. Classes that share a band are
candidates. Each is first verified against one partner, the class with the most company of those it shares a
band with. After grouping, pairs that share a band but lie in different groups are verified too, unless their
bitmaps prove them too far apart. That completes the grouping: a pair left out is in one group already or
not alike. Verification computes both whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _hashing as H
from folioscope.llm._graph import components
from folioscope.llm._tables import byte_views, cut_lineage, tidied

SHINGLE, BANDS, ROWS, PERCENT = 5, 32, 4, 75
SLOTS = BANDS * ROWS
WORDS64 = 16  # 64-bit words of a set's bitmap
CHUNK = 1 << 14


def shingles(text: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z lower-cased; a shorter text is one shingle."""
    words = H.words(H.lower(text))[0]
    return np.unique(H.windows(words, min(size, len(words)))) if len(words) else words


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a non-empty set of 64-bit hashes."""
    least = np.full(slots, np.inf)
    names = np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int64)
    for low in range(0, len(elements), CHUNK):
        part = elements[low : low + CHUNK]
        row, places = np.arange(len(part)), None
        for rank in range(slots):
            if least.max() < rank:
                break
            x = H.mix(part + np.uint64(((rank + 1) * H.BYTE_BASE) & H.MASK))
            fraction = (x >> np.uint64(24)).astype(np.float64) * 2.0**-40
            pick = rank + (((x & np.uint64(0xFFFFFF)) * np.uint64(slots - rank)) >> np.uint64(24)).astype(np.int64)
            if rank == 0:
                slot, first = pick, pick
            else:
                if places is None:  # permutations after the swap of rank 0
                    places = np.tile(names, (len(part), 1))
                    places[row, first] = 0
                    places[:, 0] = first
                slot = places[row, pick].astype(np.int64)
                places[row, pick] = places[:, rank]
                places[:, rank] = slot
            np.minimum.at(least, slot, fraction + rank)
    return least


def bands(signature: np.ndarray, many: int = BANDS) -> np.ndarray:
    """One key for each band, the band's number mixed in."""
    parts = signature.view(np.uint64).reshape(many, -1)
    key = np.zeros(many, np.uint64)
    for i in range(parts.shape[1]):
        key = H.mix(key * np.uint64(H.WORD_BASE) + parts[:, i])
    return H.mix(key + np.arange(many, dtype=np.uint64))


def digest(elements: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order."""
    a = H.mix(elements ^ np.uint64(0x1B873593CC9E2D51)).sum(dtype=np.uint64)
    b = H.mix(elements ^ np.uint64(0x85EBCA6BC2B2AE35)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def bitmap(elements: np.ndarray) -> np.ndarray:
    """One bit for each element's hash modulo the size. A bit that only one of two sets has stands for an element
    that the other lacks, which bounds their intersection from above."""
    bits = np.zeros(64 * WORDS64, np.uint8)
    bits[(elements % np.uint64(64 * WORDS64)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key``, ``n`` (shingles), ``cls`` (digest of the set), ``bands``, ``bits`` and ``mark`` (hash of the text) of every
    row; no class, bands or bits without words."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, keys, bits = [], [], [], []
            for raw in byte_views(batch.column(1)):
                found = shingles(raw, size) if raw is not None else np.zeros(0, np.uint64)
                n.append(len(found))
                cls.append(digest(found) if len(found) else None)
                keys.append(bands(super_minhash(found)).view(np.int64) if len(found) else None)
                bits.append(bitmap(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(bits, pa.list_(pa.int64())), batch.column(2)],
                ["key", "n", "cls", "bands", "bits", "mark"],
            )

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    return picked.mapInArrow(tidied(run), f"key {kind}, n long, cls binary, bands array<long>, bits array<long>, mark long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of classes whose whole sets have ``100 * intersection >= percent * union``."""
    both = (
        pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def of(cls: bytes, raw: np.ndarray) -> np.ndarray:
            got = known.get(cls)
            if got is None:
                if len(known) >= 64:
                    known.clear()
                got = known[cls] = shingles(raw, size)
            return got

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_views(batch.column(2)), byte_views(batch.column(3))):
                one, two = of(a, x), of(b, y)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidied(run), "a binary, b binary")


def _may_reach(percent: int) -> Column:
    """False only for classes a and b that their sizes and bitmaps show to be too far apart."""

    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"bits_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[i]))) for i in range(WORDS64)), F.lit(0))

    common = F.least(F.col("n_a") - lacking("a", "b"), F.col("n_b") - lacking("b", "a"))
    return 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (the smallest key of its group) and ``kept`` (it is that key), one row per
    input row.

    Documents without words, or with a null text, are linked with nothing. Equal texts are one class, so copies cost one
    row each. Null keys take part but only name a group that has no other; rows that share a key are kept or not
    by that key. With 32 bands of 4 rows a pair at 75 percent is missed with probability 6e-6.
    """
    rows = cut_lineage(signatures(docs, key, text, size))
    classes = (
        rows.where("cls is not null").groupBy("cls")
        .agg(
            F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("row"),
            F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"),
        )
        .select("cls", "row.key", "row.mark", "n", "bands", "bits")
    )
    spread = classes.select("cls", "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = cut_lineage(spread.join(shared, "band"))
    wanted = classes.select("cls", "key", "mark").join(members.select("cls").distinct(), "cls", "left_semi")
    texts = cut_lineage(_class_texts(docs, wanted, key, text))

    # the first partner of a class is the one with the most company among those it shares a band with
    company = members.groupBy("cls").agg(F.sum("many").alias("company"))
    hubs = members.join(company, "cls").groupBy("band").agg(F.max(F.struct("company", "cls")).alias("hub"))
    partner = members.join(hubs, "band").groupBy("cls").agg(F.max("hub").alias("hub")).where("cls <> hub.cls")
    first_pairs = cut_lineage(partner.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b")).distinct())
    links = cut_lineage(verified(first_pairs, texts, size, percent))
    groups = components(links)

    # what shares a band across groups and may still be alike; within a group nothing is left to find
    named = members.select("band", "cls", "n").join(groups.select(F.col("u").alias("cls"), F.col("v").alias("grp")), "cls", "left")
    named = named.withColumn("grp", F.coalesce("grp", "cls"))
    split = named.groupBy("band").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2")).where("g1 <> g2").select("band")
    mixed = cut_lineage(named.join(split, "band").join(classes.select("cls", "bits"), "cls"))
    one, two = mixed.select(*[F.col(c).alias(f"{c}_a") for c in mixed.columns]), mixed.select(*[F.col(c).alias(f"{c}_b") for c in mixed.columns])
    across = (
        one.join(two, (F.col("band_a") == F.col("band_b")) & (F.col("cls_a") < F.col("cls_b")) & (F.col("grp_a") != F.col("grp_b")) & _may_reach(percent))
        .select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct().join(first_pairs, ["a", "b"], "left_anti")
    )
    more = cut_lineage(verified(across, texts, size, percent))
    groups = components(links.unionByName(more))

    linked = groups.unionByName(groups.select(F.col("v").alias("u"), "v").distinct()).withColumnRenamed("u", "cls")
    heads = linked.join(classes.select("cls", "key"), "cls").groupBy("v").agg(F.min("key").alias("head"))
    heads = linked.join(heads, "v").select("cls", "head")
    own = classes.select("cls", F.col("key").alias("own")).join(heads, "cls", "left").select("cls", F.coalesce("head", "own").alias("component_id"))
    found = rows.select("key", F.col("n").alias("n_shingles"), "cls").join(own, "cls", "left")
    found = found.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")))
    return found.select(
        F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _class_texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``cls`` and ``text`` of the row that stands for each wanted class, one row a class however often that row is repeated."""
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_m"))
    met = rows.join(wanted, (F.col("_m") == F.col("mark")) & F.col("_k").eqNullSafe(F.col("key")))
    return met.groupBy("cls").agg(F.first("text").alias("text"))

"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; two link if they differ in at most four. The bits are cut into five segments on a ring.
Four differences over five segments leave a segment from which every chain of l consecutive segments holds at most
l - 1 of them: none in the first, one in the first two, two in the first three, three in the first four. Pairs that
have such a chain are the candidates. The chain's first two segments are the join key: a fingerprint stands under its
own key, and asks under that key and under those that differ from it in one bit of the second segment. The longer
parts of the chain are checked on the pairs that meet, and the whole distance only on what is left.

Equal fingerprints are one node. Before the join, nodes that share a key are linked with the node of the key that most
documents have, which gathers most large groups; the join then only looks for links between different groups. A key
that many nodes stand under is cut into blocks, and pairs of blocks are compared with NumPy in tasks of their own that
return a spanning forest of the links between groups, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _hashing as H
from folioscope.llm._graph import components
from folioscope.llm._tables import byte_views, cut_lineage, tidied

SHINGLE, SEED, BITS, DIFFER = 4, 42, 64, 4
PIECE = 1 << 15  # shingles whose bits are counted at once
CROWD = 512  # a key with more nodes is worked on in blocks
BLOCK = 8192
HOT = 1000  # a fingerprint with more than this part of the documents is shipped to them; there are at most so many


def fingerprint(raw: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's shingles, repeats included; a text of fewer words is one shingle, one without words is 0."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    starts, ends, n = starts.tolist(), ends[size - 1 :].tolist(), len(words) - size + 1
    set_bits = np.zeros(BITS, np.int64)
    for low in range(0, n, PIECE):
        part = [hashed(joined[a:b], seed) for a, b in zip(starts[low : low + PIECE], ends[low : low + PIECE])]
        set_bits += np.unpackbits(np.array(part, ">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``key`` and ``bits``, the fingerprint as a signed long, of every row; a null text is an empty one."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(raw.tobytes(), size, seed) if raw is not None else 0 for raw in byte_views(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["key", "bits"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidied(run), f"key {kind}, bits long")


def segments(differ: int = DIFFER) -> list[tuple[int, int]]:
    """The lowest bit and the width of each of ``differ + 1`` segments."""
    many = differ + 1
    cuts = [BITS * i // many for i in range(many + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_mask(start: int, long: int, differ: int = DIFFER) -> int:
    """The bits of ``long`` consecutive segments on the ring from ``start``, as a signed long."""
    ring = segments(differ)
    mask = sum(((1 << width) - 1) << low for low, width in (ring[(start + i) % len(ring)] for i in range(long)))
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def standing(nodes: DataFrame, differ: int) -> DataFrame:
    """The rows of ``nodes`` once for each chain: its ``chain``, ``key`` (first and second segment) and ``width`` of the second."""
    ring = segments(differ)

    def piece(i: int) -> Column:
        low, width = ring[i % len(ring)]
        return F.shiftrightunsigned("bits", low).bitwiseAND(F.lit((1 << width) - 1))

    rows = [
        F.struct(F.lit(i).alias("chain"), F.shiftleft(piece(i), ring[(i + 1) % len(ring)][1]).bitwiseOR(piece(i + 1)).alias("key"), F.lit(ring[(i + 1) % len(ring)][1]).alias("width"))
        for i in range(len(ring))
    ]
    return nodes.select("*", F.explode(F.array(*rows)).alias("_at")).select(*nodes.columns, "_at.*")


def chain_holds(difference: Column, chain: Column, differ: int) -> Column:
    """The parts of three segments and more of the chain keep within their budgets, and so does the whole."""
    fits = F.lit(False)
    for i in range(differ + 1):
        here = chain == i
        for long in range(3, differ + 1):
            here = here & (F.bit_count(difference.bitwiseAND(F.lit(chain_mask(i, long, differ)))) < long)
        fits = fits | here
    return fits & (F.bit_count(difference) <= differ)


def _between_blocks(differ: int):
    """Links between groups among the rows of one pair of blocks: a spanning forest of them."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        chain = table.column("chain")[0].as_py()
        bits, group, asks = (table.column(c).to_numpy() for c in ("bits", "grp", "asks"))
        plain, bits = bits, bits.view(np.uint64)
        names, group = np.unique(group, return_inverse=True)
        own, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        masks = [np.uint64(chain_mask(chain, long, differ) & H.MASK) for long in range(3, differ + 1)] + [np.uint64(H.MASK)]
        budgets = [long - 1 for long in range(3, differ + 1)] + [differ]
        for low in range(0, len(own), 256):
            part = own[low : low + 256]
            apart = bits[part][:, None] ^ bits[asking][None, :]
            x, y = np.nonzero((np.bitwise_count(apart & masks[0]) <= budgets[0]) & (group[part][:, None] != group[asking][None, :]))
            for mask, budget in zip(masks[1:], budgets[1:]):
                near = np.bitwise_count(apart[x, y] & mask) <= budget
                x, y = x[near], y[near]
            x, y = part[x], asking[y]
            _, first = np.unique(group[x] * len(names) + group[y], return_index=True)
            for i, j in zip(x[first].tolist(), y[first].tolist()):
                p, q = find(group[i]), find(group[j])
                if p != q:
                    root[p] = q
                    a.append(int(plain[i]))
                    b.append(int(plain[j]))
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return run


def links(nodes: DataFrame, differ: int = DIFFER, crowd: int = CROWD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links (``a``, ``b``) between ``bits`` of ``nodes`` (distinct, with ``n``) that join up all that differ in at most
    ``differ`` bits, in two tables: those with the largest node of a key, and those between the groups these make."""
    stand = standing(nodes, differ)
    heads = stand.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("n", "bits")).alias("head")).where("many > 1")
    met = stand.join(heads, ["chain", "key"]).where(F.col("bits") != F.col("head.bits"))
    first = met.where(F.bit_count(F.col("bits").bitwiseXOR(F.col("head.bits"))) <= differ)
    first = cut_lineage(first.select(F.col("bits").alias("a"), F.col("head.bits").alias("b")).distinct())
    groups = components(first).select(F.col("u").alias("bits"), F.col("v").alias("grp"))
    named = cut_lineage(nodes.select("bits").join(groups, "bits", "left").select("bits", F.coalesce("grp", "bits").alias("grp")))

    stand = standing(named, differ)
    flips = F.coalesce(*[F.when(F.col("width") == w, F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(w)])) for w in sorted({w for _, w in segments(differ)})])
    asks = stand.select("bits", "grp", "chain", "key", F.explode(flips).alias("flip")).withColumn("key", F.col("key").bitwiseXOR(F.col("flip")))
    crowds = cut_lineage(stand.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > crowd))
    crowded = not crowds.isEmpty()
    calm = stand.select("chain", "key", F.col("bits").alias("b"), F.col("grp").alias("grp_b"))
    if crowded:
        calm = calm.join(crowds, ["chain", "key"], "left_anti")
    pairs = asks.join(calm.hint("shuffle_hash"), ["chain", "key"]).where(
        (F.col("grp") != F.col("grp_b")) & ((F.col("flip") != 0) | (F.col("bits") < F.col("b")))
        & chain_holds(F.col("bits").bitwiseXOR(F.col("b")), F.col("chain"), differ)
    ).select(F.col("bits").alias("a"), "b")
    if crowded:
        asked = asks.join(crowds.select("chain", "key"), ["chain", "key"])
        sizes = asked.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("asked")).join(crowds, ["chain", "key"])
        sizes = sizes.select("chain", "key", F.ceil(F.col("many") / block).cast("int").alias("rows"), F.ceil(F.col("asked") / block).cast("int").alias("cols"))

        def dealt(df: DataFrame, mine: str, other: str, asking: bool) -> DataFrame:
            at = df.join(sizes, ["chain", "key"]).select(
                "chain", "key", "bits", "grp", F.lit(asking).alias("asks"),
                F.pmod(F.xxhash64("bits"), F.col(mine)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
            )
            return at.select("chain", "key", "rows", "cols", "bits", "grp", "asks")

        both = dealt(stand, "rows", "cols", False).unionByName(dealt(asked, "cols", "rows", True))
        between = both.groupBy("chain", "key", "rows", "cols").applyInArrow(_between_blocks(differ), "a long, b long")
        pairs = pairs.unionByName(between)
    return groups.select(F.col("bits").alias("a"), F.col("grp").alias("b")), cut_lineage(pairs)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED, differ: int = DIFFER, crowd: int = CROWD, block: int = BLOCK
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest key of its group), one row per input row.

    A null text is an empty one; texts without words have fingerprint zero, which links like any other. A null key only
    names a group that has no other. Repeated rows and keys are rows of their own. ``differ`` is at least 2.
    """
    rows = cut_lineage(fingerprints(docs, key, text, size, seed))
    nodes = cut_lineage(rows.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")))
    near, far = links(nodes.select("bits", "n"), differ, crowd, block)
    groups = components(near.unionByName(far)).select(F.col("u").alias("bits"), F.col("v").alias("grp"))
    named = nodes.join(groups, "bits", "left").withColumn("grp", F.coalesce("grp", "bits"))
    least = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    named = cut_lineage(named.join(least, "grp").select("bits", "n", "component_id"))

    # the few fingerprints that many documents have are shipped, so that no task gathers those documents
    large = max(HOT, rows.count() // HOT)
    hot = F.broadcast(named.where(F.col("n") > large).select("bits", "component_id"))
    rest = rows.join(hot, "bits", "left_anti").join(named.where(F.col("n") <= large).select("bits", "component_id"), "bits")
    found = rows.join(hot, "bits").unionByName(rest)
    return found.select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )

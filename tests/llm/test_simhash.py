"""SimHash fingerprints and their grouping against plain bit counting and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    said = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(bits, differ):
    """The smallest index reachable over pairs at most so far apart, for each of ``bits``."""
    root = list(range(len(bits)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    b = np.array(bits, np.uint64)
    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(b ^ b[i]) <= differ).tolist():
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(bits))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {(r["doc_id"], r["text"]): r["fingerprint"] for r in simhash.near_duplicates(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    for d, t in rows:
        if d is not None:
            assert got[(d, t)] == f"{brute_fingerprint(t):016x}"
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_every_close_pair_has_a_chain():
    draw = random.Random(1)
    for _ in range(3000):
        x = 0
        for b in draw.sample(range(64), draw.randint(0, 4)):
            x |= 1 << b
        fits = []
        for i in range(5):
            counts = [bin(x & (simhash.chain_mask(i, n, 4) % (1 << 64))).count("1") for n in range(1, 6)]
            fits.append(all(c < n for n, c in enumerate(counts, 1)))
        assert any(fits)


@pytest.mark.parametrize("differ, crowd, block", [(4, 512, 8192), (4, 3, 7), (3, 5, 1000), (2, 2, 5)])
def test_groups_equal_all_pairs(spark, differ, crowd, block):
    draw = random.Random(differ + crowd)
    bits = {0, (1 << 64) - 1, 1, 7}
    for _ in range(40):
        at = draw.getrandbits(64)
        bits.add(at)
        for _ in range(draw.choice([0, 1, 3, 40])):  # chains of near ones, and balls
            near = at
            for b in draw.sample(range(64), draw.randint(1, 6)):
                near ^= 1 << b
            bits.add(near)
            at = near if draw.random() < 0.4 else at
    bits = sorted(bits)
    nodes = spark.createDataFrame([(signed(b), draw.randint(1, 3)) for b in bits], "bits long, n long").repartition(5)
    near, far = simhash.links(nodes, differ, crowd, block)
    groups = {r["u"]: r["v"] for r in simhash.components(near.unionByName(far)).collect()}
    wanted = brute_groups(bits, differ)
    named = {}
    for b, w in zip(bits, wanted):
        named.setdefault(w, set()).add(groups.get(signed(b), signed(b)))
    assert all(len(g) == 1 for g in named.values()) and len(named) == len({x for g in named.values() for x in g})
    assert len(named) < len(bits)


def test_crowded_keys_return_forests(spark):
    """One group of many near fingerprints: far fewer links come back than there are close pairs."""
    draw, centre = random.Random(5), random.Random(6).getrandbits(64)
    bits = sorted({centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in (draw.sample(range(64), 3) for _ in range(1500))})
    nodes = spark.createDataFrame([(signed(b), 1) for b in bits], "bits long, n long")
    near, far = simhash.links(nodes, 4, 16, 128)
    assert near.count() + far.count() < 20 * len(bits)
    assert simhash.components(near.unionByName(far)).select("v").distinct().count() == len(set(brute_groups(bits, 4)))


def test_odd_rows(spark, docs, none):
    assert simhash.near_duplicates(none).collect() == []
    got = simhash.near_duplicates(docs.withColumn("bits", F.lit(1)).withColumn("component_id", F.lit("x"))).collect()
    assert len(got) == docs.count()
    found = [(r["doc_id"], r["component_id"]) for r in got]
    # 4, 5 and 7 have no words; 1 and 3 are equal; the two rows of 6 and a row with a null key are equal
    assert {(4, 4), (5, 4), (7, 4), (1, 1), (3, 1), (6, 6), (None, 6)} <= set(found)
    alone = spark.createDataFrame([(None, "only null keys here"), (None, "only null keys here")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(alone).collect()] == [None, None]


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)  # so that the largest groups are shipped
    draw, rows = random.Random(2), [(d, "copied text of many documents here") for d in range(100, 160)]
    for d in range(300, 420):
        words = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(0, 120))]
        rows.append((d, " ".join(words)))
        rows += [(1000 * i + d, " ".join(words[:-1] + ["Z"] * i)) for i in range(1, draw.randint(1, 4))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows.sort()
    prints = [brute_fingerprint(t) for _, t in rows]
    wanted = [(d, f"{p:016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, brute_groups(prints, 4))]
    got = queries.QUERIES["op11_simhash_near_dedup"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == wanted

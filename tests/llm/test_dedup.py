"""Near-dedup, substring dedup, mixing and the pipeline against brute force."""

import random
import re
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing, neardup, queries, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows, size):
    seen, out = {}, []
    words = [WORD.findall(t or "") for _, t in rows]
    low = -(1 << 63)
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            key, at = tuple(w[i : i + size]), (low if d is None else d, i)
            seen[key] = min(seen.get(key, at), at)
    for (d, t), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] < (low if d is None else d, i):
                gone[i : i + size] = [True] * size
        kept = None if t is None else " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, kept, len(w), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, doublings", [(20, 1), (4, 2), (5, 1)])
def test_repeats(docs, size, doublings):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = repeats.remove_repeats(docs, size=size, doublings=doublings)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, size)


def test_repeats_with_shared_passages(spark):
    draw = random.Random(4)
    shared = [[str(draw.randint(0, 9)) for _ in range(60)] for _ in range(3)]
    rows = []
    for d in range(150):
        parts = [[str(draw.randint(0, 30)) for _ in range(draw.randint(0, 80))], draw.choice(shared)[draw.randint(0, 20) :], ["x"] * draw.randint(0, 40)]
        draw.shuffle(parts)
        rows.append((d, " ".join(sum(parts, []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for size in (20, 8):
        assert sorted(map(tuple, repeats.remove_repeats(docs, size=size, doublings=2).collect()), key=repr) == brute_repeats(rows, size)


def test_packing():
    draw = np.random.default_rng(1)
    for high in (100, 1 << 20, 1 << 38, 1 << 62):
        h = np.unique(draw.integers(0, high, 500).astype(np.uint64))
        assert (repeats.unpack(repeats.pack(h)) == h).all()
    doc, start = draw.integers(-(1 << 63), 1 << 62, 9), draw.integers(0, 1 << 40, 9)
    back = repeats.unpack_first(repeats.pack_first(h[:9], h[:9] >> np.uint64(32), doc, start))
    assert (back[2] == doc).all() and (back[3] == start).all()
    assert repeats.lengths(20) == [10, 20] and repeats.lengths(20, 9) == [5, 10, 20] and repeats.lengths(7) == [7]


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    heads = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            heads[find(i)] = min(d, heads.get(find(i), d))
    return sorted(((d, len(s), heads.get(find(i)) if s else d, d == (heads.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_near_duplicates_on_odd_rows(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr) == brute_groups(rows)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_chains_and_large_groups(spark):
    draw = random.Random(9)
    base = [str(draw.random()) for _ in range(200)]
    rows = []
    for d in range(120):  # variants of one text, some too far from all others
        w = list(base)
        for _ in range(draw.choice([0, 1, 3, 6, 12])):
            w[draw.randrange(len(w))] = str(draw.random())
        rows.append((d, " ".join(w)))
    rows += [(1000 + i, " ".join(base[i * 3 : i * 3 + 60]) + " tail") for i in range(40)]  # a chain
    rows += [(2000 + i, rows[i][1].replace("0", "0")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr) == brute_groups(rows)


def test_super_minhash_estimates_and_stops():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 1 << 62, 600).astype(np.uint64)
    b = np.concatenate([a[:450], draw.integers(0, 1 << 62, 150).astype(np.uint64)])
    x, y = neardup.super_minhash(a), neardup.super_minhash(b)
    assert abs((x == y).mean() - 450 / 750) < 0.15 and x.max() < 3
    assert (neardup.super_minhash(draw.permutation(a)) == x).all()
    one = neardup.super_minhash(a[:1])
    assert len(set(np.floor(one))) == len(one)  # one element fills every slot with another rank


def edf(quota, period):
    nexts, out = dict.fromkeys(quota, 1), []
    for t in range(period):
        free = [(-(-nexts[s] * period // q), (nexts[s] - 1) * period // q, s) for s, q in quota.items() if (nexts[s] - 1) * period // q <= t]
        due, release, s = min(free)
        out.append((s, nexts[s], release, due, t))
        nexts[s] += 1
    return out


def test_schedule_is_pfair(spark):
    weights = spark.createDataFrame([("a", 500), ("b", 3), ("c", 120), ("d", 377), (None, 40)], "source string, weight long")
    quota = {r["source"] or "": (r["q"], r["period"]) for r in mixing.quotas(weights, 97).collect()}
    assert sum(q for q, _ in quota.values()) == 97 and min(q for q, _ in quota.values()) >= 1
    got = [(r["source"] or "", r["k"], r["release"], r["deadline"], r["slot"]) for r in mixing.schedule(mixing.quotas(weights, 97)).orderBy("slot").collect()]
    assert got == edf({s: q for s, (q, _) in sorted(quota.items())}, 97)
    served = dict.fromkeys(quota, 0)
    for t, (s, k, release, due, slot) in enumerate(got):
        assert release <= slot < due
        served[s] += 1
        for x, (q, period) in quota.items():
            assert abs(served[x] - Fraction(q * (t + 1), period)) < 1


def test_mix_keeps_every_row(docs, none):
    got = mixing.mix(docs, mixing.root_weights(docs), period=7, block=2)
    assert got.count() == docs.count() and got.where("slot is null").count() == 0
    assert got.groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("source", F.lit("?"))).alias("s")).where("n > 2 or s > 1").count() == 0
    assert mixing.mix(none, mixing.root_weights(none)).count() == 0
    some = mixing.mix(docs, mixing.root_weights(docs).where("source = 's0'"))
    assert some.where("source = 's1' and slot is not null").count() == 0 and some.count() == docs.count()


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_exact_top_k", "op6_minhash_near_dedup", "op8_mixing_pfair"])
def test_matches_sql(spark, sf, name):
    from oracle_check import compare, connect

    verdict, _, diff = compare(spark, connect(sf), sf, queries.QUERIES[name], queries.SQL[name])
    assert verdict == "match", diff


def test_pipeline_stages(spark, sf, docs, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "substring_dedup", "mixing_sources", "byte_bpe"]
    for rows in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert name == "byte_bpe" or out.columns == columns
            n = out.count()
            assert n == rows.count() or name in ("minhash_near_dedup", "substring_dedup")
    given = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, given, sf)
    want = {r[0] for r in brute_groups([(r["doc_id"], r["text"]) for r in given.collect()]) if r[3]}
    assert {r["doc_id"] for r in kept.collect()} == want
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeats(spark, kept, sf).collect()}
    for d, text, n, removed in brute_repeats(rows, 20):
        assert (d not in cut) if n and removed == n else cut[d] == (text if removed else dict(rows)[d])
    final = corpus_pipeline.run(spark, sf)
    assert final.where("not lossless").count() == 0 and 0 < final.count() < given.count()


def test_pipeline_keeps_the_mixture(spark, sf, tmp_path):
    sizes = {"a": 640, "b": 160, "c": 40}
    rows = [(i, f"text {i} of {s}", "en", s, 9) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows.append((0, "another text under the first id", "en", "a", 9))
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mix_sources(spark, given, sf).write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.tokenize(spark, spark.read.parquet(str(tmp_path / "mixed")), sf)
    source = {r[0]: r[3] for r in rows}
    order = [(r["slot"], r["place"], source[r["doc_id"]]) for r in out.orderBy("slot", "place").collect()]
    assert len(order) == len(rows) == len({(slot, place) for slot, place, _ in order})
    quota = {r["source"]: Fraction(r["q"], r["period"]) for r in mixing.quotas(mixing.root_weights(given)).collect()}
    served = dict.fromkeys(sizes, 0)
    for slot, place, s in order:
        served[s] += 1
        if served["c"] == sizes["c"]:
            break
        if place == mixing.BLOCK - 1:
            for x, share in quota.items():
                assert abs(Fraction(served[x], mixing.BLOCK) - share * (slot + 1)) < 1
    assert served["b"] < sizes["b"] and served["a"] < sizes["a"]


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    """Two alike texts, a thousand rows each, under one id, under null ids and under ids of their own."""
    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words), " ".join([*words[:-1], "other"])
    for ids in (lambda i: 7, lambda i: None, lambda i: i):
        rows = [(ids(2 * i), one) for i in range(1000)] + [(ids(2 * i + 1), two) for i in range(1000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        pairs, verified = [], neardup.verified

        def counted(given, texts, size, percent):
            pairs.append((given.join(texts.withColumnRenamed("cls", "a"), "a").join(texts.withColumnRenamed("cls", "b"), "b")).count())
            return verified(given, texts, size, percent)

        monkeypatch.setattr(neardup, "verified", counted)
        found = neardup.near_duplicates(docs).collect()
        monkeypatch.setattr(neardup, "verified", verified)
        assert len(found) == 2000 and len({r["component_id"] for r in found}) == 1 and sum(pairs) == 1


def test_pipeline_keeps_one_row_of_each_group_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    alike = [" ".join(words), " ".join([*words[:-1], "x"])]
    rows = [(1, alike[0]), (2, alike[1]), (2, "a text of its own that stands under the id of a copy"), (None, alike[0]), (None, "alone under a null id"), (3, "repeated row"), (3, "repeated row"), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "extra") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=repr) == sorted([
        (1, alike[0]), (2, "a text of its own that stands under the id of a copy"), (None, "alone under a null id"), (3, "repeated row"), (4, ""), (4, ""), (5, None)
    ], key=repr)

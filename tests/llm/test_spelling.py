"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import queries, spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts):
    words = sorted(counts)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w in words:
        met = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(met, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * counts[w] else None
        out[w] = [form, None, counts[w], len(met), counts[form] if form else None]
    for w in words:
        end = w
        while out[end][0] is not None:
            end = out[end][0]
        out[w][1] = end
    return sorted((w, *v) for w, v in out.items())


def brute_counts(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def vocabulary(seed, letters, many):
    draw, words = random.Random(seed), set()
    while len(words) < many:
        w = "".join(draw.choice(letters) for _ in range(draw.randint(5, 12)))
        words.add(w)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(w))
            w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice(letters) + w[at:], w[:at] + draw.choice(letters) + w[at + 1 :]])
            if len(w) >= 5:
                words.add(w)
    return {w: 3 + int(draw.paretovariate(0.6)) for w in words}


@pytest.mark.parametrize("letters, gathered", [("ab", 1 << 17), ("abcdeéÿz", 1 << 17), ("ab", 10), ("abcdeéÿz", 6)])
def test_variants_equal_all_pairs(spark, monkeypatch, letters, gathered):
    monkeypatch.setattr(spelling, "CELLS", 64)
    counts = vocabulary(len(letters), letters, 500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(words, gathered=gathered).collect())
    assert got == brute_variants(counts)
    assert sum(r[4] > 1 for r in got) > 50


def test_few_groups_at_once_and_halves_that_agree():
    words = ["aaaaa", "aaaa", "aaaaaa", "abaaa", "aabaa", "bbbbb", "aaaab"]
    for longer in (5, 6):
        mine = [w for w in words if longer - len(w) in (0, 1)]
        found = []
        for first in (True, False):
            key = {w: (w[: longer // 2] if first else w[longer // 2 - (len(w) < longer) :]) for w in mine}
            names = sorted(set(key.values()))
            places = spelling.np.array([names.index(key[w]) for w in mine])
            a, b = spelling.near_words(places, first, longer, mine)
            found += [(mine[x], mine[y]) for x, y in zip(a.tolist(), b.tolist())]
        wanted = [(x, y) for x in mine for y in mine if near(x, y) and max(len(x), len(y)) == longer]
        assert sorted(found) == sorted(wanted)


def test_long_chains_and_very_long_words(spark):
    counts = {"abcdefgh"[:k] + "z" * (9 - k): 3 * 2**k for k in range(9)}
    long = "lorem" * 4000
    counts |= {long: 9, long[:7] + long[8:]: 3, long[:-1]: 4, long[:30] + "é" + long[31:]: 40}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted(tuple(r) for r in spelling.variants(words).collect())
    assert got == brute_variants(counts)
    assert {r[2] for r in got if r[0].endswith("zz")} == {"abcdefghz"}


def test_odd_rows(spark, docs, none):
    assert spelling.variants(spelling.word_counts(none)).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]+", (t or "").translate(LOWER)))
    wanted = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = spelling.word_counts(docs.withColumn("word", F.lit("x")).withColumn("n", F.lit(1)))
    assert {r["word"]: r["n"] for r in got.collect()} == wanted and "é" * 3000 not in wanted


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(8)
    words = [w for w in vocabulary(3, "abcdeÀé", 300)]
    rows = [(None, "Hello hello HELLO helo jello"), (1, None), (2, ""), (2, "×÷×÷× ×÷×÷× ×÷×÷×!"), (2, "×÷×÷× ×÷×÷× ×÷×÷×!")]
    for d in range(3, 160):
        said = [draw.choice(words[: draw.choice([20, 300])]) for _ in range(draw.randint(1, 150))]
        rows.append((d, draw.choice(["_", " ", "-1\n"]).join(w.upper() if draw.random() < 0.1 else w for w in said)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect())
    assert got == brute_variants(brute_counts(rows))
    assert sum(r[1] is not None for r in got) > 40

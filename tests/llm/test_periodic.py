"""Periodic runs against a scan of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch with its smallest period, by comparing words at every lag."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            part = words[s : s + length]
            if length >= max(6, 4 * q) and all(part[p:] != part[: length - p] for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("letters", [1, 2, 4, 12])
def test_runs_equal_a_scan_of_every_lag(letters):
    draw, found = random.Random(letters), 0
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 3)):
            words = []
            for _ in range(draw.randint(0, 6)):
                block = [draw.randint(0, letters) for _ in range(draw.randint(1, 9))]
                words += (block * 9)[: draw.randint(1, 60)] if draw.random() < 0.6 else block
            texts.append(words)
        begins = np.cumsum([0] + [len(t) for t in texts])
        wanted = [(s + b, n, q) for t, b in zip(texts, begins) for s, n, q in brute_runs(t)]
        segment = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        got = periodic.runs(np.array(sum(texts, []), np.int64), segment)
        assert [tuple(r) for r in got.tolist()] == wanted
        found += len(wanted)
    assert found > 100


def test_rare_words_split_until_all_are_stable():
    # x occurs four times in all, but twice in each piece that the rare words leave
    words = [1, 2, 1, 2, 1, 2, 1, 2, 9, 7, 7, 5, 5, 8, 7, 7, 5, 5, 3, 1, 1, 1, 1, 1, 1]
    at, owner = periodic.surviving(np.array(words), np.zeros(len(words), int))
    assert at.tolist() == [*range(8), *range(19, 25)] and owner.tolist() == [0] * 8 + [1] * 6


def test_long_texts_with_long_periods():
    block = np.arange(30_000)
    got = periodic.runs(np.concatenate([np.tile(block, 5), block[:7], [1] * 50]), np.zeros(150_057, int))
    assert got.tolist() == [[0, 150_007, 30_000], [150_007, 50, 1]]


def test_operator_on_odd_rows(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(20, "a b " * 9 + "c " + "d\x0be\r\nf\x1cg  " * 4), (21, "z " * 6 + "y " * 5), (22, "x " * 6), (22, "x " * 6), (None, "n " * 7)]
    table = spark.createDataFrame([(t, d, 1, "r") for d, t in rows], "text string, doc_id long, start int, runs string").repartition(3)
    wanted = []
    for d, t in rows:
        words = WORD.findall(t or "")
        runs = brute_runs(words) if len(words) < 3000 else [(0, len(words), 1)]
        kept = brute_collapsed(words, runs)
        wanted.append((d, len(words), runs, kept, len(words) - len(kept.split(" ") if kept else [])))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["n_dropped"]) for r in periodic.periodic_runs(table).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert periodic.periodic_runs(none).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    draw, rows = random.Random(3), [(None, "p " * 8), (0, None), (1, ""), (1, " \n")]
    for d in range(2, 400):
        words = [f"w{draw.randint(0, 40)}" for _ in range(draw.randint(1, 60))]
        rows.append((d, " ".join(words * draw.choice([1, 1, 1, 5]))))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for d, t in rows:
        words = brute_looped(d, WORD.findall(t or ""))
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        wanted.append((d, len(runs), *shown, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(brute_collapsed(words, runs))))
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert sum(w[1] > 0 for w in wanted) > 60

"""Floor-bounded recall against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope import session
from folioscope.functions.models import overlap_scorer
from folioscope.operators import context as C
from folioscope.operators.recall import candidate_pairs, floor_pairs


def tables(spark, n_items=120, n_asked=25, seed=3):
    """Two users, one with most rows; some words are in nearly every text, some texts are null, empty or without words."""
    r = random.Random(seed)
    words = [f"w{min(int(r.paretovariate(0.7)), 60)}" for _ in range(4000)]
    say = lambda top: " ".join(r.choice(words) for _ in range(r.randint(1, top)))
    odd = [None, "", "?!", "w1 w1 w1", "unheard of"]
    items = [("hot" if i % 5 else "u", i, odd[i] if i < 5 else say(12)) for i in range(n_items)]
    asked = [("hot" if i % 4 else "u", i, odd[i] if i < 5 else say(15)) for i in range(n_asked)]
    return (
        spark.createDataFrame(asked, "user string, qid long, text string"),
        spark.createDataFrame(items, "user string, seq long, fact string"),
    )


@pytest.mark.parametrize("shipped", [True, False])
@pytest.mark.parametrize("floor", [0.06, 0.15, 0.5, 0.9, 0.9999])
def test_floor_pairs_equal_all_pairs_scored(spark, monkeypatch, shipped, floor):
    asked, items = tables(spark)
    scorer = overlap_scorer()
    every = asked.join(items, "user").withColumn("score", scorer(F.col("text"), F.col("fact"))).where(F.col("score") >= floor)
    want = sorted(map(tuple, every.select("user", "qid", "seq", "score").collect()))
    if not shipped:
        monkeypatch.setattr(session, "fits_broadcast", lambda *_: False)
    got = floor_pairs(asked, items, "fact", scorer, floor, "seq").select("user", "qid", "seq", "score")
    assert sorted(map(tuple, got.collect())) == want
    met = candidate_pairs(asked, items, "fact", scorer, floor, "seq").select("user", "qid", "seq").collect()
    assert len(met) == len(set(met)) and {tuple(m) for m in met} >= {w[:3] for w in want}


def test_a_floor_every_pair_reaches_and_a_plain_scorer_see_every_pair(spark):
    asked, items = tables(spark, 20, 8)
    every = asked.join(items, "user")
    length = lambda q, t: F.round(1 / (1 + F.length(t)), 9)
    for scorer, floor in ((overlap_scorer(), 0.05), (length, 0.0)):
        n = every.where(scorer(F.col("text"), F.col("fact")) >= floor).count()
        assert n > 50 and floor_pairs(asked, items, "fact", scorer, floor, "seq").count() == n


def test_empty_tables(spark):
    asked, items = tables(spark, 20, 8)
    none = floor_pairs(asked.where("false"), items, "fact", overlap_scorer(), 0.15, "seq")
    assert none.count() == 0 and floor_pairs(asked, items.where("false"), "fact", overlap_scorer(), 0.15, "seq").count() == 0


def test_commonest_tokens_do_not_make_pairs(spark):
    items = spark.createDataFrame([("u", i, f"the rest is alone{i}") for i in range(200)], "user string, seq long, fact string")
    asked = spark.createDataFrame([("u", 1, "the lesson alone7")], "user string, qid long, text string")
    met = candidate_pairs(asked, items, "fact", overlap_scorer(), 0.5, "seq").collect()
    assert [r.seq for r in met] == [7]


def test_pinned_facts_past_the_budget_end_the_list(spark):
    rows = [("u", i, f"pinned {i} " + "x" * 10, True) for i in range(40)] + [("u", 100, "short sign", False)]
    facts = spark.createDataFrame(rows, "user string, seq long, fact string, pinned boolean")
    asked = spark.createDataFrame([("u", 1, "short sign")], "user string, qid long, text string")
    got = [r.fact for r in C.recall_facts(asked, facts, overlap_scorer(), 25).orderBy("rank").collect()]
    lines, want = 0, []
    for _, _, fact, _ in rows:
        lines += len(fact) + 3
        if lines - 1 > 100:
            break
        want.append(fact)
    assert got == want and "short sign" not in got

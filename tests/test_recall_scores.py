"""Pairs carry a score made from tokens that were taken once a question and once an item."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope import session
from folioscope.functions.models import overlap_scorer
from folioscope.operators.recall import candidate_pairs


@pytest.mark.parametrize("shipped", [True, False])
def test_pairs_come_with_the_score_of_their_texts(spark, monkeypatch, shipped):
    if not shipped:
        monkeypatch.setattr(session, "fits_broadcast", lambda *a, **kw: False)
    draw, words = random.Random(8), [f"W{n}" for n in range(20)]
    said = lambda: ", ".join(draw.choices(words, k=draw.randint(0, 8)))
    asked = spark.createDataFrame([("ann", n, said()) for n in range(12)], "user string, qid long, text string")
    items = spark.createDataFrame([("ann", n, said(), 7.0) for n in range(40)] + [("ann", 99, None, 7.0)], "user string, seq long, fact string, score double")
    scorer = overlap_scorer()
    met = candidate_pairs(asked, items, "fact", scorer, 0.15, "seq")
    rows = met.select("qid", "seq", "score", scorer(F.col("text"), F.col("fact")).alias("wanted")).collect()
    assert len(rows) > 50 and len({(r.qid, r.seq) for r in rows}) == len(rows)
    assert all(r.score == r.wanted for r in rows)
    # the texts are met as tokens: none is read again for a pair
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "regexp_extract_all" not in top

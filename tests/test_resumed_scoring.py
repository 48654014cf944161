"""Scoring that continues after a stop."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.functions.models import overlap_scorer
from folioscope.operators import calibration as CA
from folioscope.session import finished_parts

PAIRS = "qid string, did string, grade int, qtext string, text string"


def todo(spark, n=90, extra=()):
    """Most pairs belong to one question; some texts are null or empty."""
    rows = [("hot" if i % 4 else f"q{i}", f"d{i}", i % 3, "signs of one", None if i == 7 else "" if i == 8 else f"one sign {i}") for i in range(n)]
    return spark.createDataFrame([*rows, *extra], PAIRS)


def logged(path, bad=None):
    """A scorer that notes every text it is given, and fails at ``bad``."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        with open(path, "a") as log:
            log.writelines(f"{x}\n" for x in t)
        if bad is not None and (t == bad).any():
            raise ValueError("stopped")
        return t.fillna("").str.len() / 100.0

    return score


def rows(df):
    return sorted(map(tuple, df.select("qid", "did", "grade", F.round("score", 9)).collect()))


def test_a_stopped_run_continues_and_scores_nothing_twice(spark, tmp_path):
    path, log = str(tmp_path / "scores"), tmp_path / "log"
    pairs = todo(spark)
    with pytest.raises(Exception, match="stopped"):
        CA.score_resumably(pairs, logged(str(log), "one sign 33"), path, slices=6)
    before = CA.scored_so_far(spark, path)
    kept = {r.did for r in before.collect()} if before is not None else set()
    assert "d33" not in kept and len(finished_parts(spark, path, "part")) < 6
    log.write_text("")
    got = CA.score_resumably(pairs, logged(str(log)), path, slices=4)
    assert rows(got) == rows(CA.score_pairs(pairs, logged(str(tmp_path / "other"))))
    assert len(log.read_text().splitlines()) == 90 - len(kept)


def test_a_call_may_end_early_and_new_pairs_join_later(spark, tmp_path):
    path = str(tmp_path / "scores")
    some = CA.score_resumably(todo(spark), overlap_scorer(), path, slices=5, at_most=2)
    assert 0 < some.count() < 90
    more = todo(spark, extra=[("new", "d1", 2, "one", "one"), ("new", "d1", 2, "one", "one"), ("hot", "d1", 1, "signs of one", "one sign 1")])
    got = CA.score_resumably(more, overlap_scorer(), path)
    assert rows(got) == rows(CA.score_pairs(more.dropDuplicates(["qid", "did"]), overlap_scorer()))
    again = CA.score_resumably(more, overlap_scorer(), path, slices=2)
    assert again.count() == 91


def test_nothing_to_score(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert CA.scored_so_far(spark, path) is None
    assert CA.score_resumably(todo(spark).where("false"), overlap_scorer(), path, slices=2).count() == 0

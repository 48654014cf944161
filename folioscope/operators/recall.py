"""Pairs of questions and short texts that reach a score floor, found through their rare shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import session
from folioscope.functions import text as T
from folioscope.functions.models import OverlapScorer, Scorer
from folioscope.session import cut_lineage, join_items, meet


def floor_pairs(
    questions: DataFrame, items: DataFrame, text: str, scorer: Scorer, floor: float, item_key: str
) -> DataFrame:
    """``items`` with the questions of their user and a ``score`` of at least ``floor``.

    ``questions(user, qid, text)``; ``(user, item_key)`` is unique in ``items``, whose scored column is ``text``.
    A scorer whose floor implies shared tokens only sees :func:`candidate_pairs`; any other has to see every pair.
    Null texts and questions without tokens reach no floor above the score of no shared token.
    """
    if isinstance(scorer, OverlapScorer) and scorer.needs_a_token(floor):
        pairs = candidate_pairs(questions, items, text, scorer, floor, item_key)
    else:
        pairs = join_items(questions, items, "user", item_key).withColumn("score", scorer(F.col("text"), F.col(text)))
    return pairs.where(F.col("score") >= floor)


def rare_tokens(
    questions: DataFrame, items: DataFrame, text: str, scorer: OverlapScorer, floor: float, item_key: str
) -> DataFrame:
    """Per question the tokens of which a text above the floor holds at least one, and all of them: ``user, qid, text, _rare, _q``.

    A text that must hold ``h`` of ``n`` tokens misses at most ``n - h``, so it holds one of any ``n - h + 1``: the rarest
    ones among the user's items are taken. Tokens no item holds are the rarest of all and need no join.
    """
    asked = questions.select("user", "qid", "text", T.alnum_set(F.col("text")).alias("_q"))
    words = asked.select("user", "qid", F.size("_q").alias("_n"), F.explode("_q").alias("_word"))
    held = items.select("user", F.explode(T.alnum_set(F.col(text))).alias("_word"))
    counts = cut_lineage(held.groupBy("user", "_word").agg(F.count(F.lit(1)).alias("_df")))
    found = meet(words, counts, ["user", "_word"], "qid").groupBy("user", "qid").agg(
        F.array_sort(F.collect_list(F.struct("_df", "_word"))).alias("_found"), F.first("_n").alias("_n")
    )
    spare = F.size("_found") - scorer.least_hits(F.col("_n"), floor) + 1
    rare = F.slice(F.col("_found._word"), F.lit(1), F.greatest(spare, F.lit(0)))
    return found.select("user", "qid", rare.alias("_rare")).join(asked, ["user", "qid"])


def candidate_pairs(
    questions: DataFrame, items: DataFrame, text: str, scorer: OverlapScorer, floor: float, item_key: str
) -> DataFrame:
    """Every (question, item) pair that can reach ``floor``, once: ``items`` with ``qid``, the question's ``text`` and the ``score``.

    Pairs meet by an equality join on (user, rare token). If the questions' rare tokens can be shipped, the items never move
    and a pair is made at the first rare token it shares. Otherwise keys alone are joined, salted by item, and the
    distinct pairs fetch their texts. Tokens are taken from a question and from an item once, not once a pair.
    """
    rare = cut_lineage(rare_tokens(questions, items, text, scorer, floor, item_key))
    keys = rare.withColumn("_word", F.explode("_rare"))
    columns = ["qid", "text", *[c for c in items.columns if c != "score"], scorer.of_sets(F.col("_q"), F.col("_held")).alias("score")]
    tokens = items.withColumn("_held", T.alnum_set(F.col(text)))
    if session.fits_broadcast(keys):
        met = tokens.withColumn("_word", F.explode("_held")).join(F.broadcast(keys), ["user", "_word"])
        first = F.get(F.array_intersect("_rare", "_held"), F.lit(0))
        return met.where(first == F.col("_word")).select(*columns)
    held = items.select("user", item_key, F.explode(T.alnum_set(F.col(text))).alias("_word"))
    pairs = meet(held, keys.select("user", "qid", "_word"), ["user", "_word"], item_key)
    pairs = pairs.select("user", "qid", item_key).distinct()
    both = meet(pairs, rare.select("user", "qid", "text", "_q"), ["user", "qid"], item_key)
    return both.join(tokens, ["user", item_key]).select(*columns)

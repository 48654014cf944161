"""Rank fusion and reranking of candidate lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.models import Scorer, overlap_scorer

RRF_K = 60
TOP_K = 10
RERANK_POOL = 20
TOP_N = 5
KEY_CHARS = 120


def stack_lists(lists: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Ranked lists → one long table with ``list_no`` and ``weight``.

    A weight per list is required when weights are given at all.
    """
    if weights is not None and len(weights) != len(lists):
        raise ValueError(f"{len(weights)} weights for {len(lists)} ranked lists")
    if not lists:
        raise ValueError("no ranked list to fuse")
    stacked = None
    for no, ranked in enumerate(lists):
        tagged = ranked.withColumns(
            {"list_no": F.lit(no), "weight": F.lit(float(weights[no]) if weights else 1.0)}
        )
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def content_key(text: Column) -> Column:
    return F.substring(text, 1, KEY_CHARS)


def reciprocal_rank_fusion(
    stacked: DataFrame, by: Sequence[str], key: str = "key", doc: str = "ord", k: int = RRF_K
) -> DataFrame:
    """Fuse by rank position: score = Σ weight / (k + rank) per content key.

    A key met twice in one list adds twice, the document seen last represents it, and ties keep
    first-seen order. Groups are small: a key occurs at most once per list position.
    """
    seen = F.struct("list_no", "rank")
    fused = stacked.groupBy(*by, key).agg(
        F.array_sort(F.collect_list(F.struct("list_no", "rank", (F.col("weight") * (1 / (k + F.col("rank")))).alias("part"))))
        .alias("_parts"),
        F.max_by(doc, seen).alias(doc),
        F.min(seen).alias("_first"),
    )
    # summed in list order, so that float rounding matches a sequential fold
    scored = fused.withColumn("score", F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["part"]))
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("_first").asc())
    return scored.withColumn("rank", F.row_number().over(w)).select(*by, "rank", doc, key, "score")


def candidate_pool(fused: DataFrame, top_c: int = RERANK_POOL) -> DataFrame:
    """First ``top_c`` fused rows of every question."""
    return fused.where(F.col("rank") <= top_c)


def rerank(
    pairs: DataFrame,
    by: Sequence[str],
    scorer: Scorer | None = None,
    top_n: int | None = TOP_N,
    query: str = "qtext",
    text: str = "text",
) -> DataFrame:
    """Rescore (question, chunk) pairs jointly and re-rank best first; equal scores keep their order."""
    scored = pairs.withColumn("score", (scorer or overlap_scorer())(F.col(query), F.col(text)))
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("rank").asc())
    ranked = scored.withColumn("_new", F.row_number().over(w)).drop("rank").withColumnRenamed("_new", "rank")
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)

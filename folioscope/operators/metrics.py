"""Retrieval metrics over long ranked tables ``(config, qid, rank, chunk columns)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.ordering import quantiles

OVERLAP_STRICT = 0.7
OVERLAP_SOFT = 0.5
BENCH_HIT = 0.70


def containment(gold: Column, text: Column) -> Column:
    """Share of the gold text's tokens present in ``text``; 0 for an empty gold text."""
    wanted = T.alnum_set(gold)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wanted, T.alnum_set(text))) / F.size(wanted)
    )


def ws_containment(gold: Column, text: Column) -> Column:
    """The same on case-kept whitespace tokens, as the scorer bench matches."""
    wanted = F.array_distinct(T.ws_tokens(gold))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wanted, T.ws_tokens(text))) / F.size(wanted)
    )


def neighbour_ids(gold_id: Column) -> Column:
    """The id and its ±1 neighbours; an id without a number is its own only neighbour."""
    parsed = r"\A(.*)::(\d+)\z"
    source = F.regexp_extract(gold_id, parsed, 1)
    n = F.regexp_extract(gold_id, parsed, 2).try_cast("long")
    around = F.filter(F.array(n, n - 1, n + 1), lambda i: i >= 0)
    return F.when(gold_id.rlike(parsed), F.transform(around, lambda i: F.concat(source, F.lit("::"), i.cast("string")))).otherwise(
        F.array(gold_id)
    )


def rank_of_ids(ranked: DataFrame, targets: DataFrame, by: Sequence[str], out: str = "gold_rank") -> DataFrame:
    """First rank per question whose ``chunk_id`` is among ``targets(qid, chunk_id)``."""
    return ranked.join(targets.distinct(), ["qid", "chunk_id"]).groupBy(*by).agg(F.min("rank").alias(out))


def with_containment(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked rows with text gain ``overlap`` against ``gold(qid, gold_text)``."""
    return ranked.join(gold, "qid").withColumn("overlap", containment(F.col("gold_text"), F.col("text"))).drop(
        "text", "gold_text"
    )


def exam_rows(
    questions: DataFrame, ranked: DataFrame, pool: DataFrame, by: Sequence[str],
    strict: Column | None = None, soft: Column | None = None,
) -> DataFrame:
    """One row per question of the exam: ``gold_rank``, ``gold_rank_soft``, ``in_pool``, ``pool_size``.

    ``questions`` holds every (config, question), so misses stay in; ``ranked`` and ``pool`` carry
    ``overlap``, or the caller passes its own hit conditions.
    """
    strict = F.col("overlap") >= OVERLAP_STRICT if strict is None else strict
    soft = F.col("overlap") >= OVERLAP_SOFT if soft is None else soft
    ranks = ranked.groupBy(*by).agg(
        F.min(F.when(strict, F.col("rank"))).alias("gold_rank"),
        F.min(F.when(soft, F.col("rank"))).alias("gold_rank_soft"),
    )
    pools = pool.groupBy(*by).agg(
        F.coalesce(F.bool_or(strict), F.lit(False)).alias("in_pool"), F.count(F.lit(1)).alias("pool_size")
    )
    return (
        questions.join(ranks, list(by), "left")
        .join(pools, list(by), "left")
        .withColumns(
            {"in_pool": F.coalesce("in_pool", F.lit(False)), "pool_size": F.coalesce("pool_size", F.lit(0))}
        )
    )


def ndcg_at(rank: Column, k: int = 5) -> Column:
    """One relevant document: 1/log2(rank+1) inside the cut, else 0."""
    return F.when(rank <= k, 1 / F.log2(rank + F.lit(1.0))).otherwise(F.lit(0.0))


def within(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def summarize_exam(exam: DataFrame, by: Sequence[str] = ("config",)) -> DataFrame:
    """Recall, MRR, nDCG and pool size per configuration; every question counts in ``n``."""
    rank = F.col("gold_rank")
    return exam.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("pool_size"), 1).alias("pool_size"),
        within(rank, 1).alias("recall_1"),
        within(rank, 5).alias("recall_5"),
        within(F.col("gold_rank_soft"), 5).alias("recall_5_soft"),
        F.avg(F.col("in_pool").cast("double")).alias("recall_pool"),
        F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"),
        F.avg(ndcg_at(rank)).alias("ndcg_5"),
    )


def failures(exam: DataFrame, final: DataFrame, by: Sequence[str]) -> DataFrame:
    """Questions whose gold chunk missed the top five, with what was returned instead."""
    missed = exam.where(F.col("gold_rank").isNull() | (F.col("gold_rank") > 5))
    shown = final.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "chunk_id", F.round("score", 4).alias("score"),
                                    T.one_line(F.col("text"), 120).alias("preview")))
        ).alias("retrieved_instead")
    )
    return missed.join(shown, list(by), "left")


def stage_latency(timings: DataFrame, by: Sequence[str]) -> DataFrame:
    """``timings(.., seconds map<stage, double>)`` → mean milliseconds per stage and their total."""
    per_stage = (
        timings.select(*by, F.explode("seconds").alias("stage", "s"))
        .groupBy(*by, "stage")
        .agg(F.round(F.avg("s") * 1000, 2).alias("ms"))
    )
    total = per_stage.groupBy(*by).agg(F.round(F.sum("ms"), 2).alias("ms")).withColumn(
        "stage", F.lit("retrieval_total")
    )
    return per_stage.unionByName(total)


def judge_score(reply: Column) -> Column:
    """First digit of a judge's reply, clamped to 1..5; null without one."""
    digit = F.regexp_extract(reply, r"(\d)", 1).try_cast("int")
    return F.when(digit.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), digit)))


def judge_summary(replies: DataFrame, by: Sequence[str]) -> DataFrame:
    score = judge_score(F.col("reply"))
    return replies.groupBy(*by).agg(F.round(F.avg(score), 2).alias("answer_score"), F.count(score).alias("n_judged"))


def config_verdicts(summary: DataFrame) -> DataFrame:
    """Does reranking pay, and does the lexical list help? One row per comparison."""
    pick = lambda name, col: F.max(F.when(F.col("config") == name, F.col(col)))
    wide = summary.agg(
        *[
            pick(name, col).alias(f"{short}_{col}")
            for name, short in (("hybrid", "h"), ("hybrid+rerank", "hr"), ("dense+rerank", "dr"))
            for col in ("recall_5", "mrr")
        ]
    )
    d5, dm = F.col("hr_recall_5") - F.col("h_recall_5"), F.col("hr_mrr") - F.col("h_mrr")
    b5 = F.col("hr_recall_5") - F.col("dr_recall_5")
    bm = F.col("hr_mrr") - F.col("dr_mrr")
    row = lambda name, r, m, verdict: F.struct(
        F.lit(name).alias("comparison"), r.alias("delta_recall_5"), m.alias("delta_mrr"), verdict.alias("verdict")
    )
    rows = F.array(
        row("rerank vs hybrid", d5, dm, F.when((d5 <= 0) & (dm <= 0.01), "not paying").otherwise("paying")),
        row("hybrid vs dense", b5, bm, F.when(b5 < 0, "hurting").when(b5 == 0, "adds nothing").otherwise("helping")),
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*").where(F.col("delta_recall_5").isNotNull())


def unrelated_prior(gold: DataFrame, order: str = "pos") -> DataFrame:
    """Each gold question with the next row's question as its prior one, the last wrapping to the first.

    ``order`` is a dense 0-based position, so the neighbour is an equality join, not a global window.
    """
    nxt = gold.select((F.col(order) - 1).alias(order), F.col("q").alias("_next"))
    first = gold.where(F.col(order) == 0).select(F.col("q")).scalar()
    return gold.join(nxt, order, "left").withColumn("prior", F.coalesce("_next", first)).drop("_next")


def arm_deltas(summary: DataFrame, clean: str, contaminated: str) -> DataFrame:
    """Recall deltas of the contaminated arm and whether the rewrite is too eager."""
    at = lambda arm, col: F.max(F.when(F.col("arm") == arm, F.col(col)))
    d = summary.agg(
        F.round(at(contaminated, "recall_5") - at(clean, "recall_5"), 4).alias("recall_5_delta"),
        F.round(at(contaminated, "recall_1") - at(clean, "recall_1"), 4).alias("recall_1_delta"),
    )
    return d.withColumn("too_eager", F.col("recall_5_delta") < -0.05)


def bench_hits(pools: DataFrame, gold: DataFrame) -> DataFrame:
    """Pool rows that count as the gold chunk: same id, or enough shared whitespace tokens."""
    return pools.join(gold, "qid").where(
        (F.col("chunk_id") == F.col("gold_chunk_id"))
        | (ws_containment(F.col("gold_text"), F.col("text")) >= BENCH_HIT)
    ).select("qid", "chunk_id").distinct()


def top5_agreement(ranked: DataFrame, base: str) -> DataFrame:
    """Mean share of the base scorer's top five each scorer also returns, over all questions."""
    top = ranked.where(F.col("rank") <= 5).select("scorer", "qid", "chunk_id").distinct()
    ref = top.where(F.col("scorer") == base).select("qid", "chunk_id", F.lit(1).alias("_hit"))
    per_q = top.join(ref, ["qid", "chunk_id"], "left").groupBy("scorer", "qid").agg(
        (F.coalesce(F.sum("_hit"), F.lit(0)) / 5).alias("shared")
    )
    return per_q.groupBy("scorer").agg(F.avg("shared").alias("agreement"))


def latency_profile(runs: DataFrame, base: str) -> DataFrame:
    """``runs(scorer, qid, ms)``: p50 of per-question medians, the tail value, and speed against ``base``.

    A question is timed a handful of times, so its own median is a plain small-group aggregate.
    """
    per_q = runs.groupBy("scorer", "qid").agg(F.median("ms").alias("ms"))
    p50 = quantiles(per_q, ["scorer"], "ms", {"p50_ms": 0.5})
    p95 = quantiles(per_q, ["scorer"], "ms", {"p95_ms": 0.95}, kind="tail")
    base_ms = p50.where(F.col("scorer") == base).select("p50_ms").scalar()
    return p50.join(p95, "scorer").withColumn("speed_up", base_ms / F.col("p50_ms"))


def score_range(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    ends = scores.groupBy(*by).agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"))
    return ends.join(quantiles(scores, by, score, {"score_median": 0.5}), list(by))


def rank_in_group(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))

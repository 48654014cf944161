"""Choosing a relevance floor from scored pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.ordering import quantiles, running_sum, top_k
from folioscope.session import finished_parts, scratch_path

# The floors swept on judged pairs and on the deployed corpus, and the other cut-offs compared.
FLOORS = [
    0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98,
    0.985, 0.99, 0.993, 0.995, 0.997, 0.999,
]
CORPUS_FLOORS = [0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8, 0.9, 0.95]
GRADE_QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
CUTOFFS = [0.15, 0.5, 0.8]
NUCLEI = [0.8, 0.9, 0.95]
POOLS = [5, 20, None]


def unscored_pairs(judged: DataFrame, scored: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Judged pairs still to score whose question and document both exist, with their texts."""
    todo = judged.join(scored.select("qid", "did").distinct(), ["qid", "did"], "left_anti")
    return todo.join(queries.select("qid", "qtext"), "qid").join(docs.select("did", "text"), "did")


def score_pairs(todo: DataFrame, scorer) -> DataFrame:
    return todo.select("qid", "did", "grade", scorer(F.col("qtext"), F.col("text")).alias("score"))


def scored_so_far(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the finished parts below ``path``; None if there are none. A part that was stopped halfway is not read."""
    done = finished_parts(spark, path, "part")
    return spark.read.parquet(*[f"{path}/part={n}" for n in done]) if done else None


def score_resumably(todo: DataFrame, scorer, path: str, slices: int = 16, at_most: int | None = None) -> DataFrame | None:
    """Score ``todo(qid, did, grade, qtext, text)`` slice by slice into ``path`` and return all that is scored there.

    Pairs are dealt to slices by a hash of their key, so a slice has no hot question. Each slice is a part of its own and
    counts once it is written to its end; the next call scores what is in no finished part, with any number of slices. A
    stopped call thus loses one slice at most. ``at_most`` ends a call after so many slices. Repeated pairs are scored
    once. Calls over one path take turns.

    What is left is written once with its texts, by slice, so a slice reads its own rows and not the tables again.
    """
    spark = todo.sparkSession
    done = scored_so_far(spark, path)
    left = todo.dropDuplicates(["qid", "did"])
    if done is not None:
        left = left.join(done.select("qid", "did"), ["qid", "did"], "left_anti")
    work = scratch_path(spark, "to-score")
    dealt = left.withColumn("slice", F.pmod(F.xxhash64("qid", "did"), F.lit(slices)).cast("int"))
    dealt.write.partitionBy("slice").parquet(work)
    listed = spark.read.schema(dealt.schema).parquet(work)
    for n in range(slices if at_most is None else min(at_most, slices)):
        part = max(finished_parts(spark, path, "part"), default=-1) + 1
        score_pairs(listed.where(F.col("slice") == n), scorer).write.mode("overwrite").parquet(f"{path}/part={part}")
    return scored_so_far(spark, path)


def grade_quantiles(scored: DataFrame) -> DataFrame:
    n = scored.groupBy("grade").agg(F.count("score").alias("n"))
    return n.join(quantiles(scored, ["grade"], "score", GRADE_QUANTILES, kind="nearest"), "grade")


def pairwise_auc(scored: DataFrame, rel_min: int = 1) -> DataFrame:
    """Probability that a relevant pair outscores an irrelevant one, ties counting half.

    Computed on distinct scores with their counts, so equal scores never meet in one task.
    """
    usable = scored.where((F.col("grade") >= rel_min) | (F.col("grade") == 0))
    sides = usable.groupBy("score").agg(
        F.sum(F.when(F.col("grade") >= rel_min, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("grade") == 0, 1).otherwise(0)).alias("neg"),
    )
    ranked = running_sum(sides.withColumn("_g", F.lit(0)), ["_g"], ["score"], "neg", "below")
    return ranked.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        (F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5)) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
    )


def abstention_inputs(scored: DataFrame, rel_min: int = 1, pools: Sequence[int | None] = tuple(POOLS), seed: int = 0) -> DataFrame:
    """Per (pool, question): best relevant score and best score of a sampled irrelevant pool.

    The sample order is the hash of (seed, question, document). Questions lacking either side drop out.
    """
    best = scored.where(F.col("grade") >= rel_min).groupBy("qid").agg(F.max("score").alias("pos_max"))
    irrelevant = scored.where(F.col("grade") == 0).withColumn(
        "_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("qid"), F.col("did")))
    )
    out = None
    sized = [p for p in pools if p]
    if sized:
        drawn = top_k(irrelevant, ["qid"], [F.col("_h"), F.col("did")], max(sized), "_rn")
        sizes = F.explode(F.array(*[F.lit(p) for p in sized]))
        out = (
            drawn.withColumn("pool", sizes).where(F.col("_rn") <= F.col("pool"))
            .groupBy(F.col("pool").cast("string").alias("pool"), "qid").agg(F.max("score").alias("neg_max"))
        )
    if None in pools:
        whole = irrelevant.groupBy("qid").agg(F.max("score").alias("neg_max")).select(
            F.lit("all").alias("pool"), "qid", "neg_max"
        )
        out = whole if out is None else out.unionByName(whole)
    return out.join(best, "qid")


def floor_sweep(inputs: DataFrame, by: Sequence[str] = ("pool",), floors: Sequence[float] = tuple(FLOORS)) -> DataFrame:
    """Correct and false abstention and their difference at every floor.

    The floors are aggregate columns of one pass, so the input is never multiplied by them.
    """
    grid = inputs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg((F.col("neg_max") < f).cast("double")).alias(f"ca{i}") for i, f in enumerate(floors)],
        *[F.avg((F.col("pos_max") < f).cast("double")).alias(f"fa{i}") for i, f in enumerate(floors)],
    )
    return _melt_sweep(grid, by, floors)


def _melt_sweep(grid: DataFrame, by: Sequence[str], floors: Sequence[float]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(float(f)).alias("floor"), F.col(f"ca{i}").alias("correct_abstain"),
                     F.col(f"fa{i}").alias("false_abstain"))
            for i, f in enumerate(floors)
        ]
    )
    return grid.select(*by, "n", F.explode(rows).alias("r")).select(
        *by, "n", "r.*", (F.col("r.correct_abstain") - F.col("r.false_abstain")).alias("youden_j")
    )


def best_floors(sweep: DataFrame, by: Sequence[str] = ("pool",), max_false_abstain: float = 0.10) -> DataFrame:
    """Floor with the largest J, and the most abstention within the false-abstention budget; first floor wins ties."""
    j = F.struct(F.round("youden_j", 12), -F.col("floor"))
    ca = F.when(F.col("false_abstain") <= max_false_abstain, F.struct(F.round("correct_abstain", 12), -F.col("floor")))
    return sweep.groupBy(*by).agg(
        F.max_by("floor", j).alias("best_floor"), F.max("youden_j").alias("best_j"),
        F.max_by("floor", ca).alias("budget_floor"),
        F.max(F.when(F.col("false_abstain") <= max_false_abstain, F.col("correct_abstain"))).alias("budget_abstain"),
    )


def logit(p, eps: float):
    return F.log(F.greatest(p, F.lit(eps)) / F.greatest(1 - p, F.lit(eps)))


def top1_softmax_share(scored: DataFrame, pool: int = 5) -> DataFrame:
    """Median share of the best of each question's top scores under softmax, on scores and on logits."""
    top = top_k(scored.select("qid", "did", "score"), ["qid"], [F.col("score").desc(), F.col("did")], pool)
    values = top.withColumn("logit", logit(F.col("score"), 1e-9))
    peak = values.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("ms"), F.max("logit").alias("ml")
    ).where(F.col("n") >= pool)
    shares = values.join(peak, "qid").groupBy("qid").agg(
        (1 / F.sum(F.exp(F.col("score") - F.col("ms")))).alias("raw_share"),
        (1 / F.sum(F.exp(F.col("logit") - F.col("ml")))).alias("logit_share"),
    )
    long = shares.select(F.explode(F.array(
        F.struct(F.lit("raw").alias("scale"), F.round("raw_share", 12).alias("share")),
        F.struct(F.lit("logit").alias("scale"), F.round("logit_share", 12).alias("share")),
    )).alias("s")).select("s.*")
    return quantiles(long, ["scale"], "share", {"median_share": 0.5}, kind="upper")


def topic_bracket(best: DataFrame) -> DataFrame:
    """``best(topic on|off, qid, score)``: range per topic plus the gap and its geometric midpoint."""
    stats = best.groupBy("topic").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    quarter = _quarter(best)
    median = quantiles(best, ["topic"], "score", {"median": 0.5})
    table = stats.join(quarter, "topic").join(median, "topic")
    gap_lo = F.max(F.when(F.col("topic") == "off", F.col("hi"))).over(W.partitionBy(F.lit(1)))
    gap_hi = F.min(F.when(F.col("topic") == "on", F.col("lo"))).over(W.partitionBy(F.lit(1)))
    return table.withColumns({"gap_lo": gap_lo, "gap_hi": gap_hi}).withColumn(
        "midpoint", F.sqrt(F.col("gap_lo") * F.col("gap_hi"))
    )


def _quarter(best: DataFrame) -> DataFrame:
    """``sorted[n//4]`` per topic."""
    return quantiles(best, ["topic"], "score", {"p25": 0.25}, kind="nearest")


def corpus_floor_sweep(best: DataFrame, floors: Sequence[float] = tuple(CORPUS_FLOORS)) -> DataFrame:
    """Abstention of off-topic (correct) and on-topic (false) questions at each floor, ``best(topic, score)``."""
    on, off = F.col("topic") == "on", F.col("topic") == "off"
    rate = lambda side, f: F.avg(F.when(side, (F.col("score") < f).cast("double")))
    grid = best.agg(
        F.count(F.lit(1)).alias("n"),
        *[rate(off, f).alias(f"ca{i}") for i, f in enumerate(floors)],
        *[rate(on, f).alias(f"fa{i}") for i, f in enumerate(floors)],
    )
    return _melt_sweep(grid, [], floors)


def cutoff_vs_nucleus(final: DataFrame) -> DataFrame:
    """Chunks kept per question by a score cut-off and by a softmax nucleus over logits.

    ``final(qid, rank, score)`` holds at most five rows per question.
    """
    x = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    lg = final.withColumn("_l", F.log(x / (1 - x)))
    w = W.partitionBy("qid")
    share = F.exp(F.col("_l") - F.max("_l").over(w))
    probs = lg.withColumn("_e", share).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    cum = probs.withColumn("_cum", F.sum("_p").over(w.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    kept = cum.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col("score") >= f).cast("int")).alias(f"cut{i}") for i, f in enumerate(CUTOFFS)],
        *[F.min(F.when(F.round("_cum", 9) >= p, F.col("rank"))).alias(f"nuc{i}") for i, p in enumerate(NUCLEI)],
    )
    rows = F.array(
        *[F.struct(F.lit(f"cutoff {f}").alias("mechanism"), F.col(f"cut{i}").cast("long").alias("kept")) for i, f in enumerate(CUTOFFS)],
        *[
            F.struct(F.lit(f"nucleus {p}").alias("mechanism"), F.coalesce(F.col(f"nuc{i}"), F.col("n")).cast("long").alias("kept"))
            for i, p in enumerate(NUCLEI)
        ],
    )
    return kept.select(F.explode(rows).alias("r")).select("r.*").groupBy("mechanism").agg(
        F.avg("kept").alias("mean_kept"),
        F.avg((F.col("kept") == 5).cast("double")).alias("keeps_all"),
        F.avg((F.col("kept") == 1).cast("double")).alias("keeps_one"),
    )


def worst_off_topic(best: DataFrame, n: int = 4) -> DataFrame:
    """Off-topic questions nearest to a false grounding."""
    return best.where(F.col("topic") == "off").orderBy(F.col("score").desc(), F.col("qid")).limit(n)


def reapply_floor(events: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Logged events under other floors: sources kept and the mode each floor would have given."""
    kept = lambda f: F.size(F.filter(F.coalesce("sources", F.array()), lambda s: s["score"] >= f))
    rows = F.array(*[F.struct(F.lit(float(f)).alias("floor"), kept(f).alias("n_kept")) for f in floors])
    return events.select("event_id", F.col("mode").alias("logged_mode"), F.explode(rows).alias("r")).select(
        "event_id", "logged_mode", "r.*",
        F.when(F.col("r.n_kept") > 0, "grounded").otherwise("general").alias("mode"),
    )

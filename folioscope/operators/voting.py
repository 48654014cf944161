"""Majority voting over sampled answers and paired comparison of models.

``samples(model, item_id, sample_no, answer)`` is long, ``sample_no`` dense from 0 per
(model, item) and ``answer`` null where nothing could be parsed. ``gold(item_id, gold)`` carries
``array<struct<form, value>>``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from folioscope.session import cut_lineage, shuffle_width
from folioscope.functions.answers import answer_value, is_correct, normalize_answer

TRIALS = 400
KS = (1, 5, 10)
PACKED = 100_000  # samples of the largest item that a task gathers
MAX_PARSE_SPREAD = 0.05
ITEM = ["model", "item_id"]

# Published few-shot chain-of-thought scores of the compared models.
PUBLISHED = [
    ("t1c/deepseek-math-7b-rl:Q4", "DeepSeekMath-7B-RL", 88.2, 52.4, 4096),
    ("hf.co/bartowski/Qwen2.5-Math-7B-Instruct-GGUF:Q4_K_M", "Qwen2.5-Math-7B-Instruct", 95.2, 83.6, 4096),
    ("qwen2.5:7b-instruct-q4_K_M", "Qwen2.5-7B-Instruct", 91.6, 75.5, 131072),
    ("qwen2-math:7b-instruct-q4_K_M", "Qwen2-Math-7B-Instruct", 89.9, 75.1, 4096),
]


def gold_forms(items: DataFrame) -> DataFrame:
    """``items(item_id, answer, aliases)`` → the distinct canonical forms of each item with their values."""
    raw = items.select(
        "item_id", F.explode(F.concat(F.array("answer"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw")
    )
    forms = raw.select("item_id", normalize_answer(F.col("raw")).alias("form")).where("form IS NOT NULL").distinct()
    valued = forms.withColumn("value", answer_value(F.col("form")))
    return valued.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("form", "value"))).alias("gold"))


def vote_counts(samples: DataFrame, by: Sequence[str], order: str = "sample_no") -> DataFrame:
    """Votes per answer with its first appearance; counted map-side, so a hot item is no hot task."""
    return samples.where(F.col("answer").isNotNull()).groupBy(*by, "answer").agg(
        F.count(F.lit(1)).alias("votes"), F.min(order).alias("first_seen")
    )


def majority_vote(samples: DataFrame, by: Sequence[str], order: str = "sample_no") -> DataFrame:
    """Most frequent answer per group, ties to the one seen first; groups without any vote drop out."""
    rank = F.struct("votes", -F.col("first_seen"))
    return vote_counts(samples, by, order).groupBy(*by).agg(
        F.max_by("answer", rank).alias("answer"), F.max("votes").alias("votes"),
        F.count(F.lit(1)).alias("distinct_answers"),
    )


def mark(answers: DataFrame, gold: DataFrame, out: str = "correct") -> DataFrame:
    """Add whether ``answer`` is correct for its item; an item without gold forms is never correct."""
    joined = answers.join(gold, "item_id", "left").withColumn("_value", answer_value(F.col("answer")))
    return joined.withColumn(out, F.coalesce(is_correct(F.col("answer"), F.col("_value"), F.col("gold")), F.lit(False))).drop(
        "_value", "gold"
    )


def mark_distinct(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """``mark`` by way of the distinct (item, answer) pairs: each answer is judged once."""
    judged = mark(samples.where("answer IS NOT NULL").select("item_id", "answer").distinct(), gold)
    return samples.join(judged, ["item_id", "answer"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def item_stats(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """Pass rate, unparseable count, modal answer, its share and correctness, answer diversity."""
    per_answer = samples.groupBy(*ITEM, "answer").agg(
        F.count(F.lit(1)).alias("votes"), F.min("sample_no").alias("first_seen")
    )
    judged = mark(per_answer, gold)
    voted = F.col("answer").isNotNull()
    rank = F.when(voted, F.struct("votes", -F.col("first_seen")))
    n = F.sum("votes")
    return judged.groupBy(*ITEM).agg(
        n.alias("n_samples"),
        (F.sum(F.when(F.col("correct"), F.col("votes")).otherwise(0)) / n).alias("pass_rate"),
        F.sum(F.when(~voted, F.col("votes")).otherwise(0)).alias("unparseable"),
        F.max_by("answer", rank).alias("modal_answer"),
        (F.coalesce(F.max(F.when(voted, F.col("votes"))), F.lit(0)) / n).alias("modal_share"),
        F.coalesce(F.max_by("correct", rank), F.lit(False)).alias("modal_correct"),
        F.sum(voted.cast("int")).alias("distinct_answers"),
    )


def _draw(n: Column, k: int, trial: Column, *key: Column) -> Column:
    """``k`` distinct positions below ``n``, uniform over subsets, from hashes of (key, trial, step).

    The j-th step draws from one more position than the step before; a repeat takes the newest one.
    """

    def step(acc: Column, j: Column) -> Column:
        top = n - k + j
        h = F.conv(F.substring(F.md5(F.concat_ws(":", *key, trial, j)), 1, 8), 16, 10).cast("long")
        r = F.pmod(h, top + 1)
        return F.array_append(acc, F.when(F.array_contains(acc, r), top).otherwise(r))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), F.array().cast("array<long>"), step)


def _steps(prefix: str, trials: int, k: int) -> np.ndarray:
    """The hashes behind ``_draw`` for all trials and steps of one key: (trials, k)."""
    md5, tails = hashlib.md5, [f":{j}".encode() for j in range(k)]
    heads = (f"{prefix}:{t}".encode() for t in range(trials))
    said = b"".join([md5(head + tail).digest()[:4] for head in heads for tail in tails])
    return np.frombuffer(said, ">u4").astype(np.int64).reshape(trials, k)


def _positions(steps: np.ndarray, n: int, k: int) -> np.ndarray:
    """``_draw`` for all trials at once: k distinct positions below n > k for each row."""
    out = np.empty((len(steps), k), np.int64)
    for j in range(k):
        top = n - k + j
        r = steps[:, j] % (top + 1)
        out[:, j] = np.where((out[:, :j] == r[:, None]).any(axis=1), top, r)
    return out


def _majority_correct(codes: np.ndarray, correct: np.ndarray) -> np.ndarray:
    """For each row of answer codes (-1: none), whether its most frequent answer, the first of equals, is correct."""
    votes = np.stack([(codes == codes[:, [j]]).sum(axis=1) * (codes[:, j] >= 0) for j in range(codes.shape[1])], axis=1)
    best = votes.argmax(axis=1)
    row = np.arange(len(codes))
    return (votes[row, best] > 0) & correct[codes[row, best]]


def _resampled(ks: Sequence[int], trials: int):
    """Accuracies of packed items, all ``ks`` in one pass; answers are numbered within a batch."""
    ks = [int(k) for k in ks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column("answers")
            at = packed.offsets.to_numpy()
            answers = packed.values.field("answer").dictionary_encode()
            codes = answers.indices.fill_null(-1).to_numpy()
            marks = packed.values.field("correct").to_numpy(zero_copy_only=False).astype(bool)
            keys = [batch.column(c).to_pylist() for c in ITEM]
            rows: list[tuple] = []
            for model, item, low, high in zip(*keys, at[:-1], at[1:]):
                n, mine = int(high - low), codes[low:high]
                names, mine = np.unique(mine, return_inverse=True)  # nulls, if any, come first
                mine = mine - int(names[0] < 0)
                correct = np.zeros(max(1, len(names)), bool)
                correct[mine[mine >= 0]] = marks[low:high][mine >= 0]
                drawn = [k for k in ks if k < n]
                prefix = ":".join(str(x) for x in (model, item) if x is not None)
                steps = _steps(prefix, trials, max(drawn)) if drawn else None
                for k in ks:
                    if k < n:
                        share = _majority_correct(mine[_positions(steps, n, k)], correct).sum() / trials
                    else:
                        votes = np.bincount(mine[mine >= 0], minlength=1)
                        seen = np.flatnonzero((mine >= 0) & (votes[mine] == votes.max()))
                        share = float(correct[mine[seen[0]]]) if votes.max() else 0.0
                    rows.append((model, item, k, float(share)))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("model").type, batch.schema.field("item_id").type, pa.int32(), pa.float64()))], [*ITEM, "k", "accuracy"])

    return run


def vote_accuracy(samples: DataFrame, gold: DataFrame, ks: Sequence[int] = KS, trials: int = TRIALS, packed: int = PACKED) -> DataFrame:
    """Share of ``trials`` random k-subsets per item whose majority is correct; one exact vote when k ≥ n.

    A trial draws its k positions directly instead of ranking all samples. An item is one packed array of its answers,
    and one pass over these draws all trials for all ``ks``. Items with more than ``packed`` samples are not gathered: their
    trials are rows that meet the drawn samples in a join. Whether there are such items is a job of its own.
    """
    judged = cut_lineage(
        mark_distinct(samples, gold).select(*ITEM, F.col("sample_no").cast("long").alias("pos"), "answer", "correct")
    )
    sizes = judged.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > packed))
    found = None
    if not large.isEmpty():
        found = _joined_trials(judged.join(large.select(*ITEM), ITEM, "left_semi"), large, ks, trials)
        judged = judged.join(large.select(*ITEM), ITEM, "left_anti")
    answers = F.sort_array(F.collect_list(F.struct("pos", "answer", "correct")))
    kinds = dict(judged.dtypes)
    # little to ship, much to draw: the number of partitions is given, as sizes would have it narrowed
    spread = judged.repartition(shuffle_width(samples), *ITEM)
    small = spread.groupBy(*ITEM).agg(answers.alias("answers")).mapInArrow(_resampled(ks, trials), f"model {kinds['model']}, item_id {kinds['item_id']}, k int, accuracy double")
    return small if found is None else small.unionByName(found)


def _joined_trials(judged: DataFrame, sizes: DataFrame, ks: Sequence[int], trials: int) -> DataFrame:
    """The same for items too large to be gathered."""
    out = None
    for k in ks:
        trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))
        drawn = (
            sizes.where(F.col("n") > k)
            .withColumn("trial", trial)
            .select(*ITEM, "trial", F.posexplode(_draw(F.col("n"), k, F.col("trial"), *[F.col(c) for c in ITEM])).alias("step", "pos"))
        )
        subset = drawn.join(judged, [*ITEM, "pos"])
        part = _share(subset, [*ITEM, "trial"], "step").groupBy(*ITEM).agg(
            (F.sum(F.col("correct").cast("int")) / trials).alias("accuracy")
        )
        part = sizes.where(F.col("n") > k).join(part, ITEM, "left")
        whole = judged.join(sizes.where(F.col("n") <= k).select(*ITEM), ITEM, "left_semi")
        exact = _share(whole, ITEM, "pos").select(*ITEM, F.col("correct").cast("double").alias("accuracy"))
        exact = sizes.where(F.col("n") <= k).join(exact, ITEM, "left")
        both = part.unionByName(exact).select(*ITEM, F.lit(k).alias("k"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
        out = both if out is None else out.unionByName(both)
    return out


def _share(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Whether each group's majority answer is correct."""
    counts = rows.where(F.col("answer").isNotNull()).groupBy(*by, "answer").agg(
        F.count(F.lit(1)).alias("votes"), F.min(order).alias("first_seen"), F.max("correct").alias("correct")
    )
    return counts.groupBy(*by).agg(F.max_by("correct", F.struct("votes", -F.col("first_seen"))).alias("correct"))


def run_accuracy(items: DataFrame, accuracy: DataFrame, seconds: DataFrame) -> DataFrame:
    """Greedy accuracy, voting accuracy per k and the estimated seconds per question, one row per model and k."""
    greedy = items.groupBy("model").agg(F.avg(F.col("greedy_correct").cast("double")).alias("greedy_accuracy"))
    per_k = accuracy.groupBy("model", "k").agg(F.avg("accuracy").alias("vote_accuracy"))
    pace = seconds.groupBy("model").agg(F.avg("mean_sample_s").alias("_s"))
    return per_k.join(greedy, "model").join(pace, "model").select(
        "model", "k", "greedy_accuracy", "vote_accuracy", (F.col("_s") * F.col("k")).alias("est_seconds")
    )


def stably_wrong() -> Column:
    return ~F.col("modal_correct") & (F.col("modal_share") >= 0.8)


def never_right() -> Column:
    return (F.col("pass_rate") <= 0.1) & ~F.col("modal_correct")


def error_structure(items: DataFrame) -> DataFrame:
    """What voting fixes, what it breaks, and what no amount of sampling can reach."""
    count = lambda cond: F.sum(cond.cast("int"))
    return items.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        count(~F.col("greedy_correct") & F.col("modal_correct")).alias("fixed"),
        count(F.col("greedy_correct") & ~F.col("modal_correct")).alias("broken"),
        count(stably_wrong()).alias("confidently_wrong"),
        count(never_right()).alias("never_right"),
        count(stably_wrong() | never_right()).alias("beyond"),
        F.avg("distinct_answers").alias("mean_distinct"),
        (F.sum("unparseable") / F.sum("n_samples")).alias("unparseable_rate"),
    )


def beyond_reach(items: DataFrame) -> DataFrame:
    return items.where(stably_wrong() | never_right()).groupBy("model").agg(F.countDistinct("item_id").alias("beyond"))


def tool_use(items: DataFrame) -> DataFrame:
    """``items(model, item_id, greedy_rounds, greedy_errors, mean_rounds, errors, samples)`` → tool statistics."""
    programs = F.sum("greedy_rounds") + F.sum(F.col("mean_rounds") * F.col("samples"))
    failed = F.sum(F.col("errors") + F.col("greedy_errors"))
    used = F.sum((F.col("greedy_rounds") > 0).cast("int"))
    return items.groupBy("model").agg(
        used.alias("used"), F.avg("mean_rounds").alias("mean_rounds"), failed.alias("failures"),
        programs.alias("programs"), ((used > 0) & (failed > programs * 0.25)).alias("alert"),
    )


def voting_verdict(accuracy: DataFrame) -> DataFrame:
    """Best k per model (the first of equals) and whether its gain over greedy is worth it."""
    best = accuracy.groupBy("model").agg(
        F.max_by(F.struct("k", "vote_accuracy", "greedy_accuracy"), F.struct(F.round("vote_accuracy", 9), -F.col("k"))).alias("b")
    ).select("model", F.col("b.k").alias("best_k"), (F.col("b.vote_accuracy") - F.col("b.greedy_accuracy")).alias("gain"))
    gain = F.round("gain", 9)
    return best.withColumn(
        "verdict",
        F.when(gain <= 0, "no").when(gain < 0.05, "not yet").when(gain < 0.10, "marginal").otherwise("yes"),
    )


def paired(items: DataFrame, incumbent: str, key: str) -> DataFrame:
    """Wins, losses and ties of every model against the incumbent on a boolean column, item by item."""
    base = items.where(F.col("model") == incumbent).select("item_id", F.col(key).alias("_base"))
    both = items.where(F.col("model") != incumbent).join(base, "item_id")
    win, loss = F.col(key) & ~F.col("_base"), F.col("_base") & ~F.col(key)
    counted = both.groupBy("model").agg(
        F.sum(win.cast("int")).alias("wins"), F.sum(loss.cast("int")).alias("losses"),
        F.sum((~win & ~loss).cast("int")).alias("ties"),
    )
    return counted.withColumn("p", mcnemar_p(F.col("wins"), F.col("losses")))


def _beta_share(a: int, b: int) -> float:
    """The regularised incomplete beta function at a half, for a ≥ b: a continued fraction of some hundred terms at
    most, whatever the size of ``a`` and ``b``."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * 0.5 / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h, m = d, 0
    while True:
        m += 1
        for factor in (m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + factor * d
            c = 1.0 + factor / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15 or m > 100_000:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2)
    return math.exp(front) * h / a


@F.pandas_udf(TY.DoubleType())
def mcnemar_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Two-sided exact binomial p-value of the discordant pairs; 1 when there are none."""

    def p(b: int, c: int) -> float:
        # the lower tail up to min(b, c) is the incomplete beta function at a half
        low, n = min(b, c), b + c
        return min(1.0, 2 * _beta_share(n - low, low + 1)) if low < n - low else 1.0

    return pd.Series([p(int(b), int(c)) if b + c else 1.0 for b, c in zip(wins, losses)], index=wins.index, dtype=float)


def parse_spread(items: DataFrame) -> DataFrame:
    """Unparseable rate per model, its spread over models and whether that blocks a verdict."""
    rates = items.groupBy("model").agg((F.sum("unparseable") / F.sum("n_samples")).alias("rate"))
    spread = rates.agg((F.max("rate") - F.min("rate")).alias("spread"))
    return rates.withColumn("spread", spread.scalar()).withColumn("blocks_verdict", F.col("spread") > MAX_PARSE_SPREAD)


def ranking_verdict(items: DataFrame, incumbent: str) -> DataFrame:
    """Which model leads on greedy accuracy and whether the exam supports switching to it."""
    greedy = items.groupBy("model").agg(F.avg(F.col("greedy_correct").cast("double")).alias("acc"))
    ordered = greedy.withColumn("_rank", F.struct(F.round("acc", 9), (F.col("model") == incumbent)))
    best = ordered.agg(F.max_by("model", "_rank").alias("best"), F.max("acc").alias("best_accuracy"))
    test = paired(items, incumbent, "greedy_correct").select(F.col("model").alias("best"), "p")
    spread = parse_spread(items).select("spread").limit(1).scalar()
    return best.join(test, "best", "left").withColumn("spread", spread).withColumn(
        "verdict",
        F.when(F.col("best") == incumbent, "keep incumbent")
        .when((F.col("p") < 0.05) & (F.col("spread") <= MAX_PARSE_SPREAD), "switch")
        .when(F.col("spread") > MAX_PARSE_SPREAD, "not decidable")
        .otherwise("not supported"),
    )


def bakeoff_summary(runs: DataFrame, published: DataFrame) -> DataFrame:
    """One row per model with its published scores where there are any."""
    return runs.join(published, runs["model"] == published["tag"], "left").drop("tag")


def check_answer_key(items: DataFrame, computed: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """Problems of an answer key: wrong answers, aliases that do not parse or match, ids on one side only.

    ``items(item_id, answer, aliases)``, ``computed(item_id, want)``.
    """
    stated = items.withColumn("_got", answer_value(F.col("answer"))).withColumn("_in_file", F.lit(True))
    both = stated.join(computed, "item_id", "full_outer")
    absent = both.where("_in_file IS NULL").select("item_id", F.lit("absent from file").alias("problem"))
    unverified = both.where("_in_file AND want IS NULL").select("item_id", F.lit("unverified").alias("problem"))
    present = both.where("_in_file AND want IS NOT NULL")
    wrong = F.coalesce(F.abs(F.col("want") - F.col("_got")) > tolerance, F.lit(True))
    answers = present.where(wrong).select("item_id", F.lit("answer differs").alias("problem"))
    aliases = present.where(~wrong).select("item_id", "want", F.explode("aliases").alias("alias"))
    valued = aliases.withColumn("_v", answer_value(F.col("alias")))
    bad = valued.select(
        "item_id",
        F.when(F.col("_v").isNull(), F.concat(F.lit("alias does not parse: "), F.col("alias")))
        .when(F.abs(F.col("_v") - F.col("want")) > tolerance, F.concat(F.lit("alias differs: "), F.col("alias")))
        .alias("problem"),
    ).where("problem IS NOT NULL")
    return absent.unionByName(unverified).unionByName(answers).unionByName(bad)

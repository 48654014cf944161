"""Gold sets, metrics, calibration, answers and voting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import answers as A
from folioscope.operators import calibration as CA
from folioscope.operators import goldset as G
from folioscope.operators import metrics as M
from folioscope.operators import voting as VO


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", fn(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_answer_extraction(spark):
    cases = {
        "thus \\boxed{\\frac{1}{4}}": "0.2500", "\\boxed{3} then \\boxed{\\text{Yes}}": "yes", "Final answer: $5/16$\nbye": "0.3125",
        "final answer = 2\\pi": "6.2832", "we get 12 and\nso 1,250": "1250.0000", "only 7 here\nnothing": "7.0000", "none": None, "": None,
        "\\boxed{50\\%}": "0.5000", "\\boxed{-0}": "0.0000", "\\boxed{\\frac12}": "0.5000", "\\boxed{x^2 + 1}": "x^2 + 1",
        "\\boxed{\\0.05}": "0.0500",
    }
    assert column(spark, list(cases), A.extract_answer) == list(cases.values())


@pytest.mark.parametrize(
    "text,value",
    [("1,000", 1000.0), ("3/4", 0.75), ("(3)/(4)", 0.75), ("1/0", None), ("12.5%", 0.125), ("pi", math.pi), ("-2pi/3", -2 * math.pi / 3),
     ("2*pi*3", 6 * math.pi), ("\\pi/2", math.pi / 2), ("2e", 2 * math.e), ("π", math.pi), ("x", None), ("2*", None), ("/2", None),
     ("1/0*2", None), (".", None), ("-", None), ("-pi", -math.pi), ("2*-3", None), ("1e3", 1000.0), ("", None), (None, None)],
)
def test_number_parsing(text, value):
    got = A.parse_number(text)
    assert (got is None) == (value is None) and (value is None or math.isclose(got, value))


def test_near_matches_count(spark):
    gold = VO.gold_forms(spark.createDataFrame([("a", "1/6", ["0.1667"]), ("b", "yes", None)], "item_id string, answer string, aliases array<string>"))
    tries = spark.createDataFrame([("a", "0.1666"), ("a", "0.17"), ("b", "yes"), ("b", None), ("c", "1")], "item_id string, answer string")
    got = {(r.item_id, r.answer): r.correct for r in VO.mark(tries, gold).collect()}
    assert got == {("a", "0.1666"): True, ("a", "0.17"): False, ("b", "yes"): True, ("b", None): False, ("c", "1"): False}


def vote_samples(spark, answers, model="m"):
    return spark.createDataFrame(
        [(model, item, i, a) for item, seq in answers.items() for i, a in enumerate(seq)],
        "model string, item_id string, sample_no long, answer string",
    )


def test_majority_vote_ties_go_to_the_first(spark):
    s = vote_samples(spark, {"i": ["b", "a", None, "a", "b", None, None], "j": [None, None]})
    got = {r.item_id: r.answer for r in VO.majority_vote(s, VO.ITEM).collect()}
    assert got == {"i": "b"}


def test_item_stats_and_exact_vote(spark):
    s = vote_samples(spark, {"i": ["x", "x", "y", None], "j": [None, None]})
    gold = VO.gold_forms(spark.createDataFrame([("i", "x", None), ("j", "x", None)], "item_id string, answer string, aliases array<string>"))
    got = {r.item_id: r for r in VO.item_stats(s, gold).collect()}
    i, j = got["i"], got["j"]
    assert (i.pass_rate, i.unparseable, i.modal_answer, i.modal_share, i.modal_correct, i.distinct_answers) == (0.5, 1, "x", 0.5, True, 2)
    assert (j.pass_rate, j.unparseable, j.modal_answer, j.modal_share, j.modal_correct) == (0.0, 2, None, 0.0, False)
    acc = {(r.item_id, r.k): r.accuracy for r in VO.vote_accuracy(s, gold, [1, 10], 200).collect()}
    assert acc["i", 10] == 1.0 and acc["j", 10] == 0.0 and acc["j", 1] == 0.0
    assert 0.4 < acc["i", 1] < 0.6  # half of the single samples are right


def test_draws_are_distinct_and_even(spark):
    df = spark.range(2000).select(F.col("id").alias("t"), VO._draw(F.lit(6).cast("long"), 3, F.col("id"), F.lit("k")).alias("d"))
    seen = [0] * 6
    for r in df.collect():
        assert len(set(r.d)) == 3 and all(0 <= x < 6 for x in r.d)
        for x in r.d:
            seen[x] += 1
    assert max(seen) - min(seen) < 150


def test_packed_and_joined_trials_agree(spark):
    draw = random.Random(4)
    rows = [(f"m{m}", f"i{i}", s, draw.choice(["x", "y", "z", None]) if i else None) for m in range(2) for i in range(9) for s in range(draw.choice([1, 4, 5, 12, 40]))]
    samples = spark.createDataFrame(rows, "model string, item_id string, sample_no int, answer string").repartition(3)
    gold = VO.gold_forms(spark.createDataFrame([(f"i{i}", "x", ["y"] if i % 2 else None) for i in range(8)], "item_id string, answer string, aliases array<string>"))
    got = [sorted(map(tuple, VO.vote_accuracy(samples, gold, (1, 5, 10), 60, packed).collect())) for packed in (100, 6, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 54 and len({r[3] for r in got[0]}) > 10
    assert VO.vote_accuracy(samples.limit(0), gold).collect() == []


def test_mcnemar_of_many_pairs(spark):
    df = spark.createDataFrame([(10**9, 10**9 - 10**5), (10**9, 10**9), (3 * 10**8, 10**8)], "b long, c long")
    far, even, gone = [r.p for r in df.select(VO.mcnemar_p("b", "c").alias("p")).collect()]
    z = (10**5 - 1) / math.sqrt(2 * 10**9 - 10**5)
    assert math.isclose(far, math.erfc(z / math.sqrt(2)), rel_tol=1e-3) and even == 1.0 and gone == 0.0


@pytest.mark.parametrize("b,c", [(0, 0), (5, 1), (3, 3), (12, 2), (400, 350), (0, 9), (1, 0), (7, 8)])
def test_mcnemar(spark, b, c):
    n = b + c
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    df = spark.createDataFrame([(b, c)], "b int, c int")
    assert math.isclose(df.select(VO.mcnemar_p("b", "c").alias("p")).first().p, want, rel_tol=1e-9)


def test_answer_key(spark):
    items = spark.createDataFrame(
        [("a", "0.5", ["1/2"]), ("b", "1", []), ("c", "2", ["two", "3"]), ("d", "9", [])], "item_id string, answer string, aliases array<string>"
    )
    want = spark.createDataFrame([("a", 0.5), ("b", 2.0), ("c", 2.0), ("e", 1.0)], "item_id string, want double")
    got = {(r.item_id, r.problem.split(":")[0]) for r in VO.check_answer_key(items, want).collect()}
    assert got == {("b", "answer differs"), ("c", "alias does not parse"), ("c", "alias differs"), ("d", "unverified"), ("e", "absent from file")}


def test_answerable_gate(spark):
    prose = "The derivative measures how fast a function changes. It is found by taking a limit of secant slopes! " * 3
    cases = [prose, "Figure 3 " + prose, "References\n" + prose, prose[:150], "1234 5678 " * 60,
             "Short one. " * 40, "A. (1999). B. (2001). 123456789012345678901234567890 (1987) (2010) " + prose]
    assert column(spark, cases, G.is_answerable)[:6] == [True, False, False, False, False, False]


def test_clean_question_and_reasons(spark):
    raw = ['Question: "What is a limit?"\nBecause', "q - why?", '  "How so?"  ']
    assert column(spark, raw, G.clean_question) == ["What is a limit?", "why?", "How so?"]
    df = spark.createDataFrame(
        [("short?", 0.0), ("What does the figure show about growth?", 0.0), ("How do limits define derivatives?", 0.75), ("How do limits define derivatives?", 0.1)],
        "q string, leak double",
    )
    got = [r.r for r in df.select(G.reject_reason(F.col("q"), F.col("leak")).alias("r")).collect()]
    assert got == ["not a question", "refers to the chunk itself", "leaks chunk wording (75% of distinctive words)", None]


def test_sample_fills_from_either_side(spark):
    prose = "The derivative measures how fast a function changes here. It is found by taking a limit of many slopes. " * 3
    rows = [(f"c{i}", prose + (" $$x$$" if i < 3 else "")) for i in range(20)] + [("bad", "x")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = G.sample_chunks(df, 10, seed=1).collect()
    assert len(got) == 10 and sum(r.is_math for r in got) == 3
    mathy = df.where("chunk_id IN ('c0', 'c1', 'c2', 'c3')")
    assert G.sample_chunks(mathy, 4).count() == 4
    again = {r.chunk_id for r in G.sample_chunks(df, 10, seed=1).collect()}
    assert again == {r.chunk_id for r in got} != {r.chunk_id for r in G.sample_chunks(df, 10, seed=2).collect()}


def test_followup_without_gold_is_an_error(spark):
    f = spark.createDataFrame([("a::0", "q", "w"), ("b::0", "q", "w")], "gold_chunk_id string, q1 string, q2 string")
    g = spark.createDataFrame([("a::0", "old", "s", 0), ("a::0", "new", "s", 1)], "gold_chunk_id string, chunk_text string, source string, pos int")
    with pytest.raises(KeyError):
        G.followup_pairs(f, g)
    assert [r.chunk_text for r in G.followup_pairs(f, g, strict=False).collect()] == ["new"]


def test_exam_counts_misses(spark):
    qs = spark.createDataFrame([("c", i) for i in range(4)], "config string, qid long")
    ranked = spark.createDataFrame(
        [("c", 0, 1, 0.9), ("c", 1, 1, 0.1), ("c", 1, 3, 0.7), ("c", 2, 7, 0.8), ("c", 2, 2, 0.55)], "config string, qid long, rank int, overlap double"
    )
    exam = M.exam_rows(qs, ranked, ranked.where("rank <= 5"), ["config", "qid"])
    r = M.summarize_exam(exam).first()
    assert (r.n, r.recall_1, r.recall_5, r.recall_5_soft, r.recall_pool) == (4, 0.25, 0.5, 0.75, 0.5)
    assert math.isclose(r.mrr, (1 + 1 / 3 + 1 / 7) / 4) and math.isclose(r.ndcg_5, (1 + 0.5) / 4)


def test_neighbours_and_containment(spark):
    got = column(spark, ["a.mmd::0", "a::b::5", "legacy"], M.neighbour_ids)
    assert [set(g) for g in got] == [{"a.mmd::0", "a.mmd::1"}, {"a::b::4", "a::b::5", "a::b::6"}, {"legacy"}]
    df = spark.createDataFrame([("A b", "a, B! c", 1.0), ("", "x", 0.0), ("a b c d", "a b", 0.5)], "g string, t string, w double")
    for r in df.select(M.containment(F.col("g"), F.col("t")).alias("o"), "w").collect():
        assert r.o == r.w
    assert column(spark, ["Score: 7", "0", "none", "3/5"], M.judge_score) == [5, 1, None, 3]


def scored(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = [(f"q{rng.randrange(12)}", i, rng.choice([0, 0, 0, 1, 2, 3]), round(rng.random(), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "qid string, did long, grade int, score double")


def test_auc_and_grade_quantiles(spark):
    rows, df = scored(spark)
    pos, neg = [s for _, _, g, s in rows if g >= 1], [s for _, _, g, s in rows if g == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = CA.pairwise_auc(df).first()
    assert math.isclose(got.auc, want) and (got.n_pos, got.n_neg) == (len(pos), len(neg))
    for r in CA.grade_quantiles(df).collect():
        s = sorted(x for _, _, g, x in rows if g == r.grade)
        assert [r.p05, r.p25, r.p50, r.p75, r.p95] == [s[min(len(s) - 1, int(q * len(s)))] for q in (0.05, 0.25, 0.5, 0.75, 0.95)]


def test_abstention_sweep(spark):
    rows, df = scored(spark)
    inputs = CA.abstention_inputs(df)
    whole = {r.qid: (r.pos_max, r.neg_max) for r in inputs.where("pool = 'all'").collect()}
    for q, (p, n) in whole.items():
        assert p == max(s for x, _, g, s in rows if x == q and g >= 1) and n == max(s for x, _, g, s in rows if x == q and g == 0)
    sweep = CA.floor_sweep(inputs).where("pool = 'all'").collect()
    assert len(sweep) == len(CA.FLOORS)
    for r in sweep:
        assert math.isclose(r.correct_abstain, sum(n < r.floor for _, n in whole.values()) / len(whole))
    best = {r.pool: r for r in CA.best_floors(CA.floor_sweep(inputs)).collect()}["all"]
    first = next(f for f in CA.FLOORS if math.isclose(next(r.youden_j for r in sweep if r.floor == f), max(r.youden_j for r in sweep), abs_tol=1e-12))
    assert best.best_floor == first


def test_nucleus(spark):
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate([0.99, 0.79, 0.77, 0.1, 0.05])], "qid long, rank int, score double")
    got = {r.mechanism: r.mean_kept for r in CA.cutoff_vs_nucleus(df).collect()}
    assert got["cutoff 0.15"] == 3 and got["cutoff 0.8"] == 1 and got["nucleus 0.9"] == 1 and got["nucleus 0.95"] == 2

"""Registered queries: answer voting, model comparison and usage-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import answers as A
from folioscope.operators import calibration as CA
from folioscope.operators import goldset as G
from folioscope.operators import telemetry as TL
from folioscope.operators import voting as VO
from folioscope.operators.ordering import number_by_key
from folioscope.plans import bindings as B
from folioscope.plans.registry import register, table


def r6(name):
    return F.round(name, 6).alias(name)


def events(spark, sf):
    return table(spark, sf, "events")


# ---- answers and voting -----------------------------------------------------------------------


def solutions(spark, sf):
    """Events as generated solutions stating their value in different ways."""
    v = F.col("value").cast("string")
    r = F.col("event_id") % 6
    text = (
        F.when(r == 0, F.concat(F.lit("So 3 + 4 = 7.\nFinal answer: \\boxed{"), v, F.lit("}")))
        .when(r == 1, F.concat(F.lit("Final answer: $"), v, F.lit("$.\nthanks")))
        .when(r == 2, F.concat(F.lit("we try 12\nand get x = "), v))
        .when(r == 3, F.concat(F.lit("\\boxed{1} no, \\boxed{\\frac{"), F.col("user_id").cast("string"), F.lit("}{8}}")))
        .when(r == 4, F.concat(F.lit("\\boxed{\\text{"), F.upper("event_type"), F.lit("} }")))
        .otherwise("no idea")
    )
    return events(spark, sf).select("event_id", text.alias("text"))


@register(
    "answer_extraction",
    """SELECT event_id, CASE event_id % 6 WHEN 3 THEN format('{:.4f}', user_id / 8.0::DOUBLE) WHEN 4 THEN event_type WHEN 5 THEN NULL
         ELSE format('{:.4f}', value) END AS answer FROM events""",
)
def answer_extraction(spark, sf):
    return solutions(spark, sf).select("event_id", A.extract_answer(F.col("text")).alias("answer"))


@register(
    "answer_values",
    """SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN value / 100 WHEN 1 THEN user_id * pi() / 3 WHEN 2 THEN user_id::DOUBLE / 7
         WHEN 3 THEN user_id::DOUBLE END, 6) AS value FROM events""",
)
def answer_values(spark, sf):
    r, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    text = (
        F.when(r == 0, F.concat(F.col("value").cast("string"), F.lit("%")))
        .when(r == 1, F.concat(u, F.lit("\\pi/3")))
        .when(r == 2, F.concat(F.lit("("), u, F.lit(") / (7)")))
        .when(r == 3, F.concat(u, F.lit(",000 / 1000")))
        .otherwise(F.concat(F.lit("x^"), u))
    )
    return events(spark, sf).select("event_id", F.round(A.answer_value(text), 6).alias("value"))


def samples(spark, sf):
    """Two models answer every user's item: even and odd events; an error is an unparseable sample."""
    rows = events(spark, sf).select(
        F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("model"), F.col("user_id").alias("item_id"),
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("answer"), "value",
    )
    return number_by_key(rows, ["model", "item_id"], "event_id", "sample_no")


def gold(spark, sf):
    items = events(spark, sf).select(F.col("user_id").alias("item_id")).distinct()
    names = F.array(*[F.lit(n) for n in ("click", "view", "purchase", "signup")])
    return VO.gold_forms(items.select(
        "item_id", F.element_at(names, (F.col("item_id") % 4 + 1).cast("int")).alias("answer"),
        F.array(F.when(F.col("item_id") % 3 == 0, "SIGNUP")).alias("aliases"),
    ))


SAMPLES = """
samples AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, user_id AS item_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS answer,
   value, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY event_id) - 1 AS sample_no FROM events),
goldf AS (SELECT DISTINCT item_id, unnest([['click', 'view', 'purchase', 'signup'][item_id % 4 + 1], CASE WHEN item_id % 3 = 0 THEN 'signup' END]) AS form FROM samples),
marked AS (SELECT s.*, EXISTS (SELECT 1 FROM goldf g WHERE g.item_id = s.item_id AND g.form = s.answer) AS correct FROM samples s),
votes AS (SELECT model, item_id, answer, bool_or(correct) AS correct, count(*) AS votes, min(sample_no) AS first_seen FROM marked WHERE answer IS NOT NULL GROUP BY ALL),
modal AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY model, item_id ORDER BY votes DESC, first_seen) = 1),
stats AS (SELECT s.model, s.item_id, count(*) AS n_samples, avg(s.correct::INTEGER) AS pass_rate, count_if(s.answer IS NULL)::BIGINT AS unparseable,
   max(m.answer) AS modal_answer, coalesce(max(m.votes), 0) / count(*) AS modal_share, coalesce(bool_or(m.correct), false) AS modal_correct,
   count(DISTINCT s.answer) AS distinct_answers, bool_or(s.correct AND s.sample_no = 0) AS greedy_correct,
   avg(s.value) AS mean_value FROM marked s LEFT JOIN modal m USING (model, item_id) GROUP BY ALL)
"""


@register("gold_forms", B.ctes(SAMPLES) + "SELECT item_id, string_agg(form, '|' ORDER BY form) AS forms FROM goldf WHERE form IS NOT NULL GROUP BY item_id")
def gold_forms(spark, sf):
    return gold(spark, sf).select("item_id", F.array_join(F.transform("gold", lambda g: g["form"]), "|").alias("forms"))


@register("answer_correctness", B.ctes(SAMPLES) + "SELECT model, item_id, sample_no, correct FROM marked")
def answer_correctness(spark, sf):
    return VO.mark_distinct(samples(spark, sf), gold(spark, sf)).select("model", "item_id", "sample_no", "correct")


@register("majority_votes", B.ctes(SAMPLES) + "SELECT model, item_id, answer, votes FROM modal")
def majority_votes(spark, sf):
    return VO.majority_vote(samples(spark, sf), VO.ITEM).select("model", "item_id", "answer", "votes")


def stats(spark, sf):
    s = samples(spark, sf)
    g = gold(spark, sf)
    first = VO.mark(s.where("sample_no = 0").select("model", "item_id", "answer"), g, "greedy_correct").drop("answer")
    pace = s.groupBy("model", "item_id").agg(F.avg("value").alias("mean_value"))
    return VO.item_stats(s, g).join(first, VO.ITEM).join(pace, VO.ITEM)


@register(
    "item_vote_stats",
    B.ctes(SAMPLES)
    + """SELECT model, item_id, n_samples, round(pass_rate, 6) AS pass_rate, unparseable, modal_answer, round(modal_share, 6) AS modal_share, modal_correct, distinct_answers,
         greedy_correct FROM stats""",
)
def item_vote_stats(spark, sf):
    return stats(spark, sf).select(
        "model", "item_id", "n_samples", r6("pass_rate"), "unparseable", "modal_answer", r6("modal_share"),
        "modal_correct", "distinct_answers", "greedy_correct",
    )


TRIALS, KS = VO.TRIALS, VO.KS


def _draw_sql(k: int) -> str:
    """k draws unrolled: each step repeats the rule of the Spark side."""
    d = f"d{k}_"
    parts = [f"{d}0 AS (SELECT model, item_id, n, t AS trial, []::BIGINT[] AS acc FROM "
             f"(SELECT model, item_id, n_samples AS n FROM stats WHERE n_samples > {k}), range({TRIALS}) r(t))"]
    for j in range(k):
        h = f"('0x' || substr(md5(model || ':' || item_id || ':' || trial || ':' || {j}), 1, 8))::UBIGINT::BIGINT % (n - {k} + {j} + 1)"
        parts.append(
            f"{d}{j + 1} AS (SELECT model, item_id, n, trial, list_append(acc, CASE WHEN list_contains(acc, {h}) THEN n - {k} + {j} ELSE {h} END) AS acc FROM {d}{j})"
        )
    parts.append(f"dr{k} AS (SELECT model, item_id, trial, unnest(acc) AS sample_no, unnest(range({k})) AS step FROM {d}{k})")
    parts.append(
        f"""dv{k} AS (SELECT model, item_id, trial, correct FROM (SELECT d.model, d.item_id, d.trial, m.answer, bool_or(m.correct) AS correct, count(*) AS v, min(step) AS f
            FROM dr{k} d JOIN marked m USING (model, item_id, sample_no) WHERE m.answer IS NOT NULL GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY model, item_id, trial ORDER BY v DESC, f) = 1)"""
    )
    parts.append(
        f"""acc{k} AS (SELECT s.model, s.item_id, {k} AS k, CASE WHEN n_samples <= {k} THEN coalesce(modal_correct::INTEGER::DOUBLE, 0)
            ELSE coalesce(c, 0) / {TRIALS} END AS accuracy FROM stats s
            LEFT JOIN (SELECT model, item_id, count_if(correct)::BIGINT AS c FROM dv{k} GROUP BY ALL) v ON v.model = s.model AND v.item_id = s.item_id)"""
    )
    return ",\n".join(parts)


DRAWS = ",\n".join([*map(_draw_sql, KS), "acc AS (" + " UNION ALL ".join(f"SELECT * FROM acc{k}" for k in KS) + ")"])


@register(
    "vote_accuracy",
    B.ctes(SAMPLES, DRAWS) + "SELECT model, item_id, k, round(accuracy, 6) AS accuracy FROM acc",
)
def vote_accuracy(spark, sf):
    acc = VO.vote_accuracy(samples(spark, sf), gold(spark, sf), KS, TRIALS)
    return acc.select("model", "item_id", "k", r6("accuracy"))


def run(spark, sf):
    acc = VO.vote_accuracy(samples(spark, sf), gold(spark, sf), KS, TRIALS)
    s = stats(spark, sf)
    return VO.run_accuracy(s, acc, s.withColumn("mean_sample_s", F.col("mean_value")))


_RUN = """
run AS (SELECT model, k, greedy_accuracy, vote_accuracy, s * k AS est_seconds FROM (SELECT model, k, avg(accuracy) AS vote_accuracy FROM acc GROUP BY ALL)
   JOIN (SELECT model, avg(greedy_correct::INTEGER) AS greedy_accuracy, avg(mean_value) AS s FROM stats GROUP BY model) USING (model))
"""


@register(
    "run_accuracy",
    B.ctes(SAMPLES, DRAWS, _RUN)
    + """SELECT model, k, round(greedy_accuracy, 6) AS greedy_accuracy, round(vote_accuracy, 6) AS vote_accuracy, round(est_seconds, 6) AS est_seconds FROM run""",
)
def run_accuracy(spark, sf):
    return run(spark, sf).select("model", "k", r6("greedy_accuracy"), r6("vote_accuracy"), r6("est_seconds"))


@register(
    "voting_verdict",
    B.ctes(SAMPLES, DRAWS, _RUN)
    + """SELECT model, k AS best_k, round(vote_accuracy - greedy_accuracy, 6) AS gain, CASE WHEN round(vote_accuracy - greedy_accuracy, 9) <= 0 THEN 'no'
         WHEN round(vote_accuracy - greedy_accuracy, 9) < 0.05 THEN 'not yet' WHEN round(vote_accuracy - greedy_accuracy, 9) < 0.1 THEN 'marginal' ELSE 'yes' END AS verdict FROM run
         QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(vote_accuracy, 9) DESC, k) = 1""",
)
def voting_verdict(spark, sf):
    return VO.voting_verdict(run(spark, sf)).select("model", "best_k", r6("gain"), "verdict")


@register(
    "error_structure",
    B.ctes(SAMPLES)
    + """SELECT model, count(*) AS n, count_if(NOT greedy_correct AND modal_correct)::BIGINT AS fixed, count_if(greedy_correct AND NOT modal_correct)::BIGINT AS broken,
         count_if(NOT modal_correct AND modal_share >= 0.8)::BIGINT AS confidently_wrong, count_if(NOT modal_correct AND pass_rate <= 0.1)::BIGINT AS never_right,
         count_if(NOT modal_correct AND (modal_share >= 0.8 OR pass_rate <= 0.1))::BIGINT AS beyond, round(avg(distinct_answers), 6) AS mean_distinct,
         round(sum(unparseable) / sum(n_samples), 6) AS unparseable_rate FROM stats GROUP BY model""",
)
def error_structure(spark, sf):
    e = VO.error_structure(stats(spark, sf))
    return e.withColumns({c: F.round(c, 6) for c in ("mean_distinct", "unparseable_rate")})


@register(
    "beyond_reach",
    B.ctes(SAMPLES)
    + """SELECT model, count(*) AS beyond FROM stats WHERE NOT modal_correct AND (modal_share >= 0.8 OR pass_rate <= 0.1) GROUP BY model""",
)
def beyond_reach(spark, sf):
    return VO.beyond_reach(stats(spark, sf))


@register(
    "tool_use",
    """WITH i AS (SELECT event_type AS model, user_id AS item_id, count_if(event_id % 3 = 0) AS greedy_rounds, count_if(event_id % 9 = 0) AS greedy_errors, avg(event_id % 4) AS mean_rounds,
         count_if(event_id % 5 = 0) AS errors, count(*) AS samples FROM events GROUP BY ALL),
       a AS (SELECT model, count_if(greedy_rounds > 0)::BIGINT AS used, round(avg(mean_rounds), 6) AS mean_rounds, sum(errors + greedy_errors)::BIGINT AS failures,
         round(sum(greedy_rounds) + sum(mean_rounds * samples), 6) AS programs FROM i GROUP BY model)
       SELECT *, used > 0 AND failures > programs * 0.25 AS alert FROM a""",
)
def tool_use(spark, sf):
    n = lambda cond: F.sum(cond.cast("int"))
    items = events(spark, sf).groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("item_id")).agg(
        n(F.col("event_id") % 3 == 0).alias("greedy_rounds"), n(F.col("event_id") % 9 == 0).alias("greedy_errors"),
        F.avg(F.col("event_id") % 4).alias("mean_rounds"), n(F.col("event_id") % 5 == 0).alias("errors"),
        F.count(F.lit(1)).alias("samples"),
    )
    return VO.tool_use(items).withColumns({c: F.round(c, 6) for c in ("mean_rounds", "programs")})


_PAIR = """
pair AS (SELECT count_if(a.{k} AND NOT b.{k})::BIGINT AS wins, count_if(b.{k} AND NOT a.{k})::BIGINT AS losses, count_if(a.{k} = b.{k})::BIGINT AS ties
   FROM stats a JOIN stats b USING (item_id) WHERE a.model = 'odd' AND b.model = 'even'),
mc AS (SELECT wins, losses, ties, CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) + (wins + losses) * ln(0.5)))
   FROM range(0, least(wins, losses) + 1) t(i))) END AS p FROM pair)
"""


@register(
    "paired_comparison",
    B.ctes(SAMPLES, _PAIR.replace("{k}", "modal_correct")) + "SELECT 'odd' AS model, wins, losses, ties, round(p, 6) AS p FROM mc",
)
def paired_comparison(spark, sf):
    return VO.paired(stats(spark, sf), "even", "modal_correct").withColumn("p", F.round("p", 6))


@register(
    "parse_rate_spread",
    B.ctes(SAMPLES)
    + """, r AS (SELECT model, sum(unparseable) / sum(n_samples) AS rate FROM stats GROUP BY model)
       SELECT model, round(rate, 6) AS rate, round((SELECT max(rate) - min(rate) FROM r), 6) AS spread, (SELECT max(rate) - min(rate) FROM r) > 0.05 AS blocks_verdict FROM r""",
)
def parse_rate_spread(spark, sf):
    return VO.parse_spread(stats(spark, sf)).withColumns({c: F.round(c, 6) for c in ("rate", "spread")})


@register(
    "ranking_verdict",
    B.ctes(SAMPLES, _PAIR.replace("{k}", "greedy_correct"))
    + """, g AS (SELECT model, avg(greedy_correct::INTEGER) AS acc FROM stats GROUP BY model),
       b AS (SELECT model AS best, acc AS best_accuracy FROM g ORDER BY round(acc, 9) DESC, model = 'even' DESC LIMIT 1),
       sp AS (SELECT max(rate) - min(rate) AS spread FROM (SELECT model, sum(unparseable) / sum(n_samples) AS rate FROM stats GROUP BY model))
       SELECT best, round(best_accuracy, 6) AS best_accuracy, round(CASE WHEN best = 'odd' THEN p END, 6) AS p, round(spread, 6) AS spread,
         CASE WHEN best = 'even' THEN 'keep incumbent' WHEN p < 0.05 AND spread <= 0.05 THEN 'switch' WHEN spread > 0.05 THEN 'not decidable' ELSE 'not supported' END AS verdict FROM b, mc, sp""",
)
def ranking_verdict(spark, sf):
    return VO.ranking_verdict(stats(spark, sf), "even").withColumns(
        {c: F.round(c, 6) for c in ("best_accuracy", "p", "spread")}
    )


@register(
    "bakeoff_summary",
    B.ctes(SAMPLES)
    + """SELECT model, round(avg(greedy_correct::INTEGER), 6) AS greedy_accuracy, CASE WHEN model = 'even' THEN 88.2::DOUBLE END AS gsm8k FROM stats GROUP BY model""",
)
def bakeoff_summary(spark, sf):
    """The even half stands in for the incumbent's published row."""
    runs = stats(spark, sf).groupBy("model").agg(F.round(F.avg(F.col("greedy_correct").cast("int")), 6).alias("greedy_accuracy"))
    published = spark.createDataFrame(VO.PUBLISHED, "tag string, name string, gsm8k double, math double, ctx int")
    tagged = published.withColumn("tag", F.when(F.col("name") == "DeepSeekMath-7B-RL", "even").otherwise(F.col("tag")))
    return VO.bakeoff_summary(runs, tagged).select("model", "greedy_accuracy", "gsm8k")


@register(
    "answer_key_check",
    """SELECT 'k' || event_id AS item_id, CASE event_id % 6 WHEN 0 THEN 'absent from file' WHEN 1 THEN 'unverified' WHEN 2 THEN 'answer differs'
         WHEN 3 THEN 'alias does not parse: x+1' ELSE 'alias differs: 3/0.5' END AS problem FROM events WHERE event_id % 6 <> 5 AND NOT (event_id % 6 = 4 AND value = 6)""",
)
def answer_key_check(spark, sf):
    e = events(spark, sf).select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("item_id"), (F.col("event_id") % 6).alias("r"), "value")
    computed = e.where("r <> 1").select("item_id", F.col("value").alias("want"))
    shown = F.col("value").cast("string")
    items = e.where("r <> 0").select(
        "item_id",
        F.when(F.col("r") == 2, (F.col("value") + 1).cast("string")).otherwise(shown).alias("answer"),
        F.when(F.col("r") == 3, F.array(F.lit("x+1"))).when(F.col("r") == 4, F.array(F.lit("3/0.5"))).otherwise(F.array(shown)).alias("aliases"),
    )
    return VO.check_answer_key(items, computed)


# ---- usage log --------------------------------------------------------------------------------

SALT = "test-salt"


def log(spark, sf):
    """One query event per row of ``events``; nested fields follow from its numbers."""
    e, v = F.col("event_id"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int")
    source = lambda i: F.struct(
        F.concat(F.lit("s"), F.lit(i).cast("string")).alias("source"), F.concat_ws("::", F.lit(f"s{i}"), e % 50).alias("chunk_id"),
        (((e * (i + 3)) % 100) / 100.0).alias("score"), F.lit("").alias("preview"),
    )
    one_pass = lambda i: F.struct(
        (v * i).alias("at_ms"), v.alias("ms"), (e % 900 + i).alias("prompt_tokens"), F.when((e + i) % 5 != 0, e % 200).alias("output_tokens"),
        F.lit(None).cast("double").alias("prefill_ms"), F.when((e + i) % 7 != 0, F.round(v * 20, 1)).alias("decode_ms"),
        F.lit(None).cast("double").alias("load_ms"), F.lit("stop").alias("done_reason"), F.lit(i).alias("tool_calls"),
    )
    passes = F.slice(F.array(one_pass(0), one_pass(1)), F.lit(1), (e % 3).cast("int")).cast(TL.PASSES_TYPE)
    none = lambda t: F.lit(None).cast(t)
    tool = lambda n, name: F.struct(
        F.lit(n).alias("n"), F.lit(name).alias("tool"), ((e + n) % 4 != 0).alias("ok"), F.when(k % 2 == 0, v * n).alias("at_ms"), (v + n).alias("ms"),
        *[none("string").alias(c) for c in ("code", "output", "reason", "query")],
        *[none("int").alias(c) for c in ("hits", "kept")], none("double").alias("top_score"),
        *[none("int").alias(c) for c in ("n_docs", "n_chunks")],
    )
    tools = F.when(k > 66, F.array(tool(1, "run_python"), tool(2, "search_documents"))).when(
        k > 33, F.array(tool(1, "run_python"))
    ).otherwise(F.array().cast(TL.TOOL_LOG_TYPE))
    n_tools = F.when(k > 66, 2).when(k > 33, 1).otherwise(0)
    rows = events(spark, sf).select(
        e.alias("pos"), F.concat(F.lit("e"), e.cast("string")).alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        TL.user_hash(F.col("user_id").cast("string"), SALT).alias("user_hash"), F.concat(F.lit("q"), (e % 100).cast("string")).alias("question"),
        F.when(e % 5 == 0, F.concat(F.lit("q"), (e % 100).cast("string"), F.lit(" more"))).alias("retrieval_query"),
        F.when(F.col("event_type").isin("view", "purchase"), "grounded").otherwise("general").alias("mode"),
        F.element_at(F.array(F.lit("hf.co/org/alpha-GGUF:Q4"), F.lit("beta:7b"), F.lit("hf.co/lab/gamma-GGUF")), (F.col("user_id") % 3 + 1).cast("int")).alias("model"),
        F.when(e % 3 == 0, "tools").when(e % 3 == 1, "tir").alias("protocol"),
        F.array(source(0), source(1), source(2)).alias("sources"),
        F.map_filter(F.create_map(
            F.lit("bm25_ms"), v / 10, F.lit("dense_ms"), F.when(e % 4 != 0, v / 5), F.lit("rrf_ms"), F.lit(0.0), F.lit("rerank_ms"), v * 2,
            F.lit("ttft_ms"), F.when(e % 7 != 0, v * 3), F.lit("generate_ms"), v * 4,
        ), lambda _k, x: x.isNotNull()).alias("timings"),
        (e % 11 == 0).alias("truncated"), (e % 4).cast("int").alias("continuations"), n_tools.alias("tool_calls"),
        F.when(k > 33, ((e + 1) % 4 == 0).cast("int")).otherwise(0).alias("tool_errors"),
        F.when(k > 66, F.create_map(F.lit("run_python"), F.lit(1), F.lit("search_documents"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>")).alias("tool_counts"),
        F.when(k > 66, F.array(F.concat(F.lit("w"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("search_queries"),
        (e % 2).cast("int").alias("memories_recalled"), tools.alias("tool_log"), passes.alias("passes"),
        F.when(F.col("event_type") == "error", "boom").alias("error"),
    )
    return rows.withColumn("tokens", TL.token_totals(F.col("passes")))


LOG = """
lg0 AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events),
lg1 AS (SELECT event_id AS pos, 'e' || event_id AS event_id, ts AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, value AS v, k, 'q' || (event_id % 100) AS question,
   CASE WHEN event_id % 5 = 0 THEN 'q' || (event_id % 100) || ' more' END AS retrieval_query, CASE WHEN event_type IN ('view', 'purchase') THEN 'grounded' ELSE 'general' END AS mode,
   ['hf.co/org/alpha-GGUF:Q4', 'beta:7b', 'hf.co/lab/gamma-GGUF'][user_id % 3 + 1] AS model, CASE event_id % 3 WHEN 0 THEN 'tools' WHEN 1 THEN 'tir' END AS protocol,
   list_transform([0, 1, 2], lambda i: {'chunk_id': 's' || i || '::' || (event_id % 50), 'score': ((event_id * (i + 3)) % 100) / 100.0::DOUBLE}) AS sources,
   CASE WHEN event_id % 4 <> 0 THEN value / 5 END AS dense_ms, CASE WHEN event_id % 7 <> 0 THEN value * 3 END AS ttft_ms, event_id % 11 = 0 AS truncated, event_id % 4 AS continuations,
   CASE WHEN k > 66 THEN 2 WHEN k > 33 THEN 1 ELSE 0 END AS tool_calls, CASE WHEN k > 33 THEN ((event_id + 1) % 4 = 0)::INTEGER ELSE 0 END AS tool_errors,
   event_id % 2 AS memories_recalled, CASE WHEN event_type = 'error' THEN 'boom' END AS error,
   list_transform(range(0, event_id % 3), lambda i: {'at_ms': value * i, 'ms': value, 'p': event_id % 900 + i, 'o': CASE WHEN (event_id + i) % 5 <> 0 THEN event_id % 200 END,
     'd': CASE WHEN (event_id + i) % 7 <> 0 THEN round(value * 20, 1) END}) AS passes,
   list_transform(range(1, CASE WHEN k > 66 THEN 3 WHEN k > 33 THEN 2 ELSE 1 END), lambda n: {'tool': CASE n WHEN 1 THEN 'run_python' ELSE 'search_documents' END, 'ok': (event_id + n) % 4 <> 0,
     'at_ms': CASE WHEN k % 2 = 0 THEN value * n END, 'ms': value + n}) AS tool_log, user_id FROM lg0),
lg2 AS (SELECT *, list_sum(list_transform(passes, lambda p: p.p))::BIGINT AS tok_in, list_sum(list_transform(passes, lambda p: p.o))::BIGINT AS tok_out, list_sum(list_transform(passes, lambda p: p.d)) AS dec FROM lg1),
log AS (SELECT *, CASE WHEN tok_out <> 0 AND dec <> 0 THEN round(dec / tok_out, 2) END AS mtpt, CASE WHEN tok_out <> 0 AND dec <> 0 THEN round(1000 / (dec / tok_out), 1) END AS tok_s,
   CASE WHEN len(passes) > 0 THEN passes[-1].at_ms + passes[-1].ms ELSE v / 10 + coalesce(dense_ms, 0) + 0 + v * 2 + v * 4 END AS total_ms FROM lg2),
fb AS (SELECT 'e' || (event_id - event_id % 3) AS event_id, CASE WHEN value > 50 THEN 'up' ELSE 'down' END AS rating, event_id AS pos FROM events WHERE event_type = 'click'),
rate AS (SELECT event_id, arg_max(rating, pos) AS rating FROM fb GROUP BY event_id),
rated AS (SELECT log.*, rate.rating FROM log LEFT JOIN rate USING (event_id))
"""


def feedback(spark, sf):
    e = F.col("event_id")
    return events(spark, sf).where("event_type = 'click'").select(
        F.concat(F.lit("e"), (e - e % 3).cast("string")).alias("event_id"),
        F.when(F.col("value") > 50, "up").otherwise("down").alias("rating"), e.alias("pos"),
    )


def rated(spark, sf):
    return TL.with_ratings(log(spark, sf), feedback(spark, sf))


@register("user_pseudonyms", "SELECT DISTINCT user_id, substr(sha256('test-salt:' || user_id), 1, 16) AS user_hash FROM events")
def user_pseudonyms(spark, sf):
    return events(spark, sf).select("user_id", TL.user_hash(F.col("user_id").cast("string"), SALT).alias("user_hash")).distinct()


@register("latest_ratings", B.ctes(LOG) + "SELECT event_id, rating FROM rate")
def latest_ratings(spark, sf):
    return TL.latest_ratings(feedback(spark, sf))


@register(
    "facet_values",
    B.ctes(LOG)
    + """SELECT DISTINCT 'model' AS facet, model AS value FROM log UNION ALL SELECT DISTINCT 'protocol', coalesce(protocol, 'none') FROM log UNION ALL SELECT DISTINCT 'mode', mode FROM log""",
)
def facet_values(spark, sf):
    return TL.facet_values(log(spark, sf))


@register("facet_filter", B.ctes(LOG) + "SELECT event_id FROM log WHERE protocol IS NULL AND mode = 'grounded' AND model = 'beta:7b'")
def facet_filter(spark, sf):
    return TL.facet_filter(log(spark, sf), "beta:7b", "none", "grounded").select("event_id")


_PCT = "floor(100.0::DOUBLE * count_if({c}) / count(*) + 0.5)::INTEGER AS {n}"


@register(
    "kpis",
    B.ctes(LOG)
    + "SELECT model, count(*) AS queries, "
    + ", ".join(_PCT.format(c=c, n=n) for c, n in (("error IS NOT NULL", "error_pct"), ("tool_calls > 0", "tool_pct"), ("mode = 'grounded'", "grounded_pct"), ("truncated", "truncated_pct")))
    + """, round(avg(tok_in), 6) AS mean_prompt, round(avg(tok_out), 6) AS mean_output, count_if(rating = 'up')::BIGINT AS up, count_if(rating = 'down')::BIGINT AS down,
       round(quantile_cont(ttft_ms, 0.5), 6) AS ttft_p50, round(quantile_cont(ttft_ms, 0.95), 6) AS ttft_p95, round(quantile_cont(mtpt, 0.5), 6) AS mtpt_p50,
       round(quantile_cont(tok_s, 0.5), 6) AS tok_s_p50 FROM rated GROUP BY model""",
)
def kpis(spark, sf):
    k = TL.kpis(rated(spark, sf))
    return k.withColumns({c: F.round(c, 6) for c in ("mean_prompt", "mean_output", "ttft_p50", "ttft_p95", "mtpt_p50", "tok_s_p50")})


@register(
    "metric_series",
    B.ctes(LOG) + "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, round(ttft_ms, 6) AS value FROM log WHERE ttft_ms IS NOT NULL",
)
def metric_series(spark, sf):
    return TL.metric_series(log(spark, sf), F.col("timings")["ttft_ms"]).select("event_id", "idx", r6("value"))


@register(
    "tool_panel",
    B.ctes(LOG)
    + """, c AS (SELECT unnest(tool_log) AS t FROM log)
       SELECT t.tool AS tool, count(*) AS calls, floor(100.0::DOUBLE * count_if(NOT t.ok) / count(*) + 0.5)::INTEGER AS error_pct, round(quantile_cont(t.ms, 0.5), 6) AS p50_ms,
         round(quantile_cont(t.ms, 0.95), 6) AS p95_ms FROM c GROUP BY t.tool""",
)
def tool_panel(spark, sf):
    return TL.tool_panel(log(spark, sf)).withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms")})


_TOOLS = """CASE WHEN k > 66 THEN 'python×1 search×1' WHEN k > 33 THEN 'python×1' ELSE '' END || CASE WHEN tool_errors > 0 THEN ' (' || tool_errors || '✗)' ELSE '' END"""


@register(
    "request_table",
    B.ctes(LOG)
    + f"""SELECT event_id, ts, question, regexp_replace(regexp_replace(model, '^hf\\.co/[^/]+/', ''), '-GGUF', '') AS model, coalesce(protocol, 'none') AS protocol, mode,
          round(ttft_ms, 6) AS ttft_ms, round(total_ms, 6) AS total_ms, tok_in AS tokens_in, tok_out AS tokens_out, mtpt AS mtpt_ms, {_TOOLS} AS tools, rating
          FROM rated ORDER BY pos DESC LIMIT 200""",
)
def request_table(spark, sf):
    return TL.request_table(log(spark, sf), feedback(spark, sf)).withColumns({c: F.round(c, 6) for c in ("ttft_ms", "total_ms")})


@register("total_latency", B.ctes(LOG) + "SELECT event_id, round(total_ms, 6) AS total_ms FROM log")
def total_latency(spark, sf):
    return log(spark, sf).select("event_id", F.round(TL.total_ms(), 6).alias("total_ms"))


@register("tool_summaries", B.ctes(LOG) + f"SELECT event_id, {_TOOLS} AS tools FROM log")
def tool_summaries(spark, sf):
    return log(spark, sf).select("event_id", TL.tool_summary().alias("tools"))


_SPANS = """
stg AS (SELECT event_id, v, total_ms, unnest(['bm25', 'dense', 'rrf', 'rerank']) AS label, unnest([v / 10, dense_ms, 0, v * 2]) AS dur, unnest([1, 2, 3, 4]) AS i FROM log),
sp0 AS (SELECT event_id, label, 'retrieval' AS kind, coalesce(sum(dur) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, dur FROM stg WHERE coalesce(dur, 0) <> 0),
ps AS (SELECT event_id, unnest(passes) AS p, unnest(range(1, len(passes) + 1)) AS i FROM log),
tlg AS (SELECT event_id, unnest(tool_log) AS t FROM log),
sp AS (SELECT * FROM sp0 UNION ALL SELECT event_id, 'gen #' || i, 'generation', p.at_ms, p.ms FROM ps
   UNION ALL SELECT event_id, t.tool || CASE WHEN t.ok THEN '' ELSE ' ✗' END, CASE WHEN t.tool = 'run_python' THEN 'python' ELSE 'search' END, t.at_ms, t.ms FROM tlg WHERE t.at_ms IS NOT NULL),
en AS (SELECT event_id, greatest(max(start + dur), max(total_ms), 1) AS end_ms FROM sp JOIN (SELECT event_id, total_ms FROM log) USING (event_id) GROUP BY event_id)
"""


@register(
    "trace_spans",
    B.ctes(LOG, _SPANS) + "SELECT event_id, label, kind, round(start, 6) AS start, round(dur, 6) AS dur, round(end_ms, 6) AS end_ms FROM sp JOIN en USING (event_id)",
)
def trace_spans(spark, sf):
    return TL.trace_spans(log(spark, sf)).select("event_id", "label", "kind", r6("start"), r6("dur"), r6("end_ms"))


@register(
    "span_shares",
    B.ctes(LOG, _SPANS) + "SELECT event_id, label, round(start / end_ms, 6) AS \"left\", round(dur / end_ms, 6) AS width FROM sp JOIN en USING (event_id)",
)
def span_shares(spark, sf):
    return TL.span_shares(TL.trace_spans(log(spark, sf))).select("event_id", "label", r6("left"), r6("width"))


@register(
    "pass_pace",
    B.ctes(LOG, _SPANS) + "SELECT event_id, i - 1 AS pass_no, round(CASE WHEN p.d <> 0 AND p.o <> 0 THEN p.d / p.o END, 6) AS ms_per_token FROM ps",
)
def pass_pace(spark, sf):
    return TL.pass_pace(log(spark, sf)).select("event_id", "pass_no", r6("ms_per_token"))


@register(
    "pass_records",
    """SELECT event_id, round(value, 1) AS at_ms, event_id % 100 AS prompt_tokens, CASE WHEN event_id % 3 <> 0 THEN round(event_id * 1234567 / 1e6, 1) END AS decode_ms, NULL::DOUBLE AS load_ms FROM events""",
)
def pass_records(spark, sf):
    e = F.col("event_id")
    meta = events(spark, sf).select(
        "event_id", F.lit(0).alias("seq"), (F.col("value") / 1000).alias("at_s"), F.lit(0.5).alias("wall_s"), (e % 100).alias("prompt_eval_count"),
        F.lit(None).cast("long").alias("eval_count"), F.lit(None).cast("long").alias("prompt_eval_duration"),
        F.when(e % 3 != 0, e * 1234567).alias("eval_duration"), F.lit(None).cast("long").alias("load_duration"),
        F.lit("stop").alias("done_reason"), F.lit(0).alias("n_calls"),
    )
    return TL.pass_record(meta).select("event_id", "pass.at_ms", "pass.prompt_tokens", "pass.decode_ms", "pass.load_ms")


@register("token_totals", B.ctes(LOG) + "SELECT event_id, tok_in AS prompt, tok_out AS output, round(dec, 6) AS decode_ms, mtpt AS mtpt_ms, tok_s FROM log")
def token_totals(spark, sf):
    return log(spark, sf).select("event_id", "tokens.prompt", "tokens.output", F.round("tokens.decode_ms", 6).alias("decode_ms"), "tokens.mtpt_ms", "tokens.tok_s")


@register(
    "stage_times",
    """WITH s AS (SELECT user_id AS event_id, unnest(['bm25_ms', 'rrf_ms']) AS stage, unnest([value / 7, value / 3]) AS sec FROM events)
       SELECT event_id, stage, round(sum(sec * 1000), 2) AS ms FROM s GROUP BY ALL""",
)
def stage_times(spark, sf):
    runs = events(spark, sf).select(
        F.col("user_id").alias("event_id"), F.create_map(F.lit("bm25"), F.col("value") / 7, F.lit("rrf"), F.col("value") / 3).alias("seconds")
    )
    return TL.stage_times(runs)


@register(
    "below_floor_sources",
    B.ctes(LOG) + """, s AS (SELECT event_id, unnest(sources) AS s, unnest([0, 1, 2]) AS n FROM log)
       SELECT event_id, n, s.chunk_id AS chunk_id, s.score AS score, s.score < 0.15 AS below_floor FROM s""",
)
def below_floor_sources(spark, sf):
    return TL.source_rows(log(spark, sf))


@register(
    "query_rewrites_mined",
    B.ctes(LOG)
    + """SELECT event_id, question, 'rewrite' AS kind, retrieval_query AS searched FROM log WHERE retrieval_query IS NOT NULL
         UNION ALL SELECT event_id, question, 'model search', 'w' || k FROM log WHERE k > 66""",
)
def query_rewrites_mined(spark, sf):
    return TL.rewrites(log(spark, sf))


@register(
    "operating_rollup",
    B.ctes(LOG)
    + """SELECT model, protocol, count(*) AS n, round(avg(truncated::INTEGER), 6) AS truncated_rate, round(avg(continuations), 6) AS mean_continuations,
         round(sum(tool_errors) / nullif(sum(tool_calls), 0), 6) AS tool_error_rate, round(avg((memories_recalled > 0)::INTEGER), 6) AS memory_share
         FROM (SELECT * REPLACE (coalesce(protocol, 'none') AS protocol) FROM log) GROUP BY ROLLUP (model, protocol)""",
)
def operating_rollup(spark, sf):
    r = TL.operating_rollup(log(spark, sf))
    return r.withColumns({c: F.round(c, 6) for c in ("truncated_rate", "mean_continuations", "tool_error_rate", "memory_share")})


@register(
    "model_names",
    B.ctes(LOG)
    + """SELECT DISTINCT model, regexp_replace(regexp_replace(model, '^hf\\.co/[^/]+/', ''), '-GGUF', '') AS short, regexp_replace(list_last(string_split(model, '/')), '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM log""",
)
def model_names(spark, sf):
    return log(spark, sf).select("model").distinct().select(
        "model", TL.short_model(F.col("model")).alias("short"), TL.model_slug(F.col("model")).alias("slug")
    )


@register(
    "floor_reapplied",
    B.ctes(LOG)
    + """, f AS (SELECT event_id, mode AS logged_mode, unnest([0.15::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS floor, sources FROM log)
       SELECT event_id, logged_mode, floor, len(list_filter(sources, lambda s: s.score >= floor)) AS n_kept,
         CASE WHEN len(list_filter(sources, lambda s: s.score >= floor)) > 0 THEN 'grounded' ELSE 'general' END AS mode FROM f""",
)
def floor_reapplied(spark, sf):
    return CA.reapply_floor(log(spark, sf), CA.CUTOFFS)


@register(
    "contrastive_pairs",
    B.ctes(LOG)
    + """, s AS (SELECT event_id, question, unnest(sources) AS s FROM rated WHERE rating = 'up') SELECT event_id, question, s.chunk_id AS chunk_id, s.score AS score FROM s""",
)
def contrastive_pairs(spark, sf):
    return G.contrastive_pairs(log(spark, sf), TL.latest_ratings(feedback(spark, sf)))

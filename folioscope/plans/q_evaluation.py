"""Registered queries: gold sets, retrieval metrics and floor calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.models import hashed_tf_embedder, normalizing, overlap_scorer
from folioscope.operators import calibration as CA
from folioscope.operators import chunking as K
from folioscope.operators import conversation as V
from folioscope.operators import goldset as G
from folioscope.operators import lexical as L
from folioscope.operators import metrics as M
from folioscope.operators.ordering import number_by_key
from folioscope.plans import bindings as B
from folioscope.plans import q_context as X
from folioscope.plans import q_documents as D
from folioscope.plans import q_retrieval as R
from folioscope.plans.registry import register, table
from folioscope.plans.retrieve import CONFIGS, retrieve, with_chunk
from folioscope.plans.sweep import sweep
from folioscope.session import scratch_path

WS = B.WS


def r6(name):
    return F.round(name, 6).alias(name)


# ---- gold sets --------------------------------------------------------------------------------

WORD_DF = f"""
words AS (SELECT doc_id, unnest({B.sql_content_words('text')}) AS word FROM documents),
wdf AS (SELECT word, count(*) AS df FROM words GROUP BY word),
ndocs AS (SELECT count(*) AS n_docs FROM documents)
"""


@register("corpus_word_df", B.ctes(WORD_DF) + "SELECT word, df FROM wdf")
def corpus_word_df(spark, sf):
    return G.corpus_words(D.docs(spark, sf))[0]


@register(
    "distinctive_words",
    B.ctes(WORD_DF) + "SELECT word, df <= greatest(1, floor((SELECT n_docs FROM ndocs) * 0.1)) AS distinctive FROM wdf",
)
def distinctive_words(spark, sf):
    df, n = G.corpus_words(D.docs(spark, sf))
    return df.select("word", G.is_distinctive(F.col("df"), n.scalar()).alias("distinctive"))


def qa_pairs(spark, sf):
    """User turns as questions on the assistant turn after them."""
    return X.answered(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"),
        F.col("reply").alias("chunk_text"),
    )


LEAK = f"""
qa AS (SELECT conv_id * 1000 + turn AS id, text AS question, reply AS chunk_text FROM answered),
qw AS (SELECT id, unnest({B.sql_content_words('question')}) AS word, {B.sql_content_words('chunk_text')} AS cw FROM qa),
ql AS (SELECT id, avg(list_contains(cw, word)::INTEGER) AS leak FROM qw LEFT JOIN wdf USING (word)
       WHERE coalesce(df, 0) <= greatest(1, floor((SELECT n_docs FROM ndocs) * 0.1)) GROUP BY id),
leaks AS (SELECT qa.*, coalesce(leak, 0.0) AS leak_score FROM qa LEFT JOIN ql USING (id))
"""


def leaks(spark, sf):
    word_df, n_docs = G.corpus_words(D.docs(spark, sf))
    return G.leak_scores(qa_pairs(spark, sf), word_df, n_docs)


@register("leak_scores", B.ctes(WORD_DF, X.ANSWERED, LEAK) + "SELECT id, round(leak_score, 6) AS leak_score FROM leaks")
def leak_scores(spark, sf):
    return leaks(spark, sf).select("id", r6("leak_score"))


@register("math_flags", f"SELECT doc_id, {B.sql_is_math('text')} AS is_math FROM documents")
def math_flags(spark, sf):
    from folioscope.functions import text as T

    return D.docs(spark, sf).select("doc_id", T.is_math(F.col("text")).alias("is_math"))


ANSWERABLE = f"""
gate0 AS (SELECT doc_id, source, text, {B.sql_strip('text')} AS t FROM documents),
gate1 AS (SELECT *, len(regexp_extract_all(t, '\\p{{L}}'))::DOUBLE / length(t) AS share FROM gate0),
gate AS (SELECT doc_id, source, text, length(t) >= 200 AND share >= 0.45
   AND len(list_filter(regexp_split_to_array(t, '[.!?]\\s'), lambda s: len({B.sql_ws_tokens('s')}) >= 6)) >= 2
   AND NOT regexp_matches(lower(substr(t, 1, 120)), '^\\s*(figure|fig\\.|table|exhibit|chart)\\s*\\d')
   AND NOT regexp_matches(lower(substr(t, 1, 120)), '^\\s*(references|bibliography|index|contents|appendix)\\b')
   AND NOT (len(regexp_extract_all(t, '\\b(?:19|20)\\d{{2}}\\b')) >= 4 AND share < 0.7) AS ok FROM gate1)
"""


@register("answerable_gate", B.ctes(ANSWERABLE) + "SELECT doc_id, coalesce(ok, false) AS answerable FROM gate")
def answerable_gate(spark, sf):
    return D.docs(spark, sf).select(
        "doc_id", F.coalesce(G.is_answerable(F.col("text")), F.lit(False)).alias("answerable")
    )


def _sql_clean(raw: str) -> str:
    line = B.sql_strip(f"string_split({B.sql_strip(raw)}, chr(10))[1]")
    bare = B.sql_strip(f"regexp_replace({line}, '(?i)^(question|q)\\s*[:.\\-]\\s*', '')")
    return B.sql_strip(f"regexp_replace({bare}, '^\"+|\"+$', '', 'g')")


@register(
    "clean_questions",
    B.ctes(X.ANSWERED)
    + f"""SELECT conv_id, turn, {_sql_clean("text")} AS own, {_sql_clean("chr(10) || ' Question: \"' || replace(text, chr(10), '\"' || chr(10)) || '\"'")} AS question
          FROM answered""",
)
def clean_questions(spark, sf):
    """Every turn as it is, and dressed up as a reply with a prefix and quotes."""
    raw = F.concat(F.lit('\n Question: "'), F.replace(F.col("text"), F.lit("\n"), F.lit('"\n')), F.lit('"'))
    return X.answered(spark, sf).select("conv_id", "turn", G.clean_question(F.col("text")).alias("own"), G.clean_question(raw).alias("question"))


@register(
    "reject_reasons",
    B.ctes(WORD_DF, X.ANSWERED, LEAK)
    + f"""SELECT id, CASE WHEN id % 5 = 0 OR length(question || '?') < 15 THEN 'not a question' WHEN id % 3 = 0 THEN 'refers to the chunk itself'
          WHEN regexp_matches(question, '{G.REFERENTIAL}') THEN 'refers to the chunk itself'
          WHEN leak_score >= 0.6 THEN 'leaks chunk wording (' || round(leak_score * 100)::INTEGER || '% of distinctive words)' END AS reason FROM leaks""",
)
def reject_reasons(spark, sf):
    asked = (
        F.when(F.col("id") % 5 == 0, F.translate("question", "?", "."))
        .when(F.col("id") % 3 == 0, F.concat(F.lit("As shown in the Figure, "), F.col("question"), F.lit("?")))
        .otherwise(F.concat("question", F.lit("?")))
    )
    joined = qa_pairs(spark, sf).join(leaks(spark, sf), "id")
    return joined.select("id", G.reject_reason(asked, F.col("leak_score")).alias("reason"))


@register(
    "gold_sample",
    B.ctes(
        ANSWERABLE,
        f"""us AS (SELECT doc_id, {B.sql_is_math("text")} OR doc_id % 9 = 0 AS is_math, md5('3:' || doc_id) AS h FROM gate WHERE ok)""",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY is_math ORDER BY h, doc_id) AS rn FROM us)",
        "mq AS (SELECT least(count(*), 42) AS q FROM us WHERE is_math)",
        """tier AS (SELECT *, CASE WHEN is_math AND rn <= (SELECT q FROM mq) THEN 0 WHEN NOT is_math AND rn <= 60 - (SELECT q FROM mq) THEN 1
              WHEN is_math THEN 2 END AS tier FROM rk)""",
    )
    + "SELECT doc_id, is_math FROM tier WHERE tier IS NOT NULL QUALIFY row_number() OVER (ORDER BY tier, rn) <= 60",
)
def gold_sample(spark, sf):
    """Every ninth document gets an equation, so both strata are filled."""
    text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" $$x$$"))).otherwise(F.col("text"))
    marked = D.docs(spark, sf).where(G.is_answerable(F.col("text"))).select("doc_id", text.alias("text"))
    return G.sample_chunks(marked, 60, seed=3, key="doc_id").select("doc_id", "is_math")


GOLD = """
gold AS (SELECT id AS pos, question AS q, 'g' || id AS gold_chunk_id, 'conv' AS source, id % 4 = 0 AS is_math,
       CASE WHEN id % 10 <> 0 THEN round(leak_score, 3) END AS leak_score, chunk_text FROM leaks)
"""


def gold_rows(spark, sf):
    return qa_pairs(spark, sf).join(leaks(spark, sf), "id").select(
        F.col("id").alias("pos"), F.col("question").alias("q"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("gold_chunk_id"),
        F.lit("conv").alias("source"), (F.col("id") % 4 == 0).alias("is_math"),
        F.when(F.col("id") % 10 != 0, F.round("leak_score", 3)).alias("leak_score"), "chunk_text",
    )


@register(
    "gold_health",
    B.ctes(WORD_DF, X.ANSWERED, LEAK, GOLD)
    + """SELECT count(*) AS n, count_if(is_math)::BIGINT AS n_math, round(avg(leak_score), 6) AS mean_leak, count(leak_score) AS n_scored,
         count_if(leak_score >= 0.6)::BIGINT AS n_high, avg(leak_score) >= 0.4 OR count_if(leak_score >= 0.6) > count(*) * 0.15 AS leaky FROM gold""",
)
def gold_health(spark, sf):
    return G.gold_health(gold_rows(spark, sf)).withColumn("mean_leak", F.round("mean_leak", 6))


@register(
    "gold_review",
    B.ctes(WORD_DF, X.ANSWERED, LEAK, GOLD)
    + """SELECT gold_chunk_id, leak_score, q, replace(substr(chunk_text, 1, 300), chr(10), ' ') AS snippet FROM gold""",
)
def gold_review(spark, sf):
    return G.review_rows(gold_rows(spark, sf))


def followups(spark, sf):
    """The next user turn of a conversation follows up on the one before."""
    return qa_pairs(spark, sf).select(
        F.concat(F.lit("g"), F.col("id").cast("string")).alias("gold_chunk_id"), F.col("question").alias("q1"),
        F.concat(F.lit("why is that? "), F.substring("question", 1, 20)).alias("q2"),
    )


@register(
    "followup_pairs",
    B.ctes(X.ANSWERED)
    + """SELECT 'g' || (conv_id * 1000 + turn) AS gold_chunk_id, md5(text) AS q1, md5('why is that? ' || substr(text, 1, 20)) AS q2, md5(reply) AS chunk
         FROM answered""",
)
def followup_pairs(spark, sf):
    gold = qa_pairs(spark, sf).select(
        F.concat(F.lit("g"), F.col("id").cast("string")).alias("gold_chunk_id"), "chunk_text",
        F.lit("conv").alias("source"), F.col("id").alias("pos"),
    )
    pairs = G.followup_pairs(followups(spark, sf), gold)
    return pairs.select("gold_chunk_id", F.md5("q1").alias("q1"), F.md5("q2").alias("q2"), F.md5("chunk_text").alias("chunk"))


# ---- retrieval metrics ------------------------------------------------------------------------

EXAM_CONFIGS = tuple(CONFIGS)


def exam(spark, sf, configs=EXAM_CONFIGS):
    """Every benchmark passage is its own question and gold text, scored under every configuration."""
    got = R.all_configs(spark, sf, configs)
    asked = B.questions(spark, sf)
    gold = asked.select("qid", F.col("text").alias("gold_text"))
    chunks = B.chunks(spark, sf)
    # both tables hold a subset of the same (question, chunk) pairs: overlap is computed once per pair
    pairs = got.ranked.select("user", "qid", "ord").union(got.candidates.select("user", "qid", "ord")).distinct()
    overlap = M.with_containment(with_chunk(pairs, chunks, ["text"]), gold)
    everyone = asked.select("user", "qid").withColumn("config", F.explode(F.array(*[F.lit(c.name) for c in configs])))
    keys = ["user", "qid", "ord"]
    return M.exam_rows(everyone, got.ranked.join(overlap, keys), got.candidates.join(overlap, keys), ["config", "user", "qid"]), got


EXAM = (
    R.sql_all_configs().removeprefix("WITH ").rstrip(),
    f"""ov AS (SELECT p.qid, p.ord, {B.sql_containment('q.text', 'd.text')} AS o
        FROM (SELECT qid, ord FROM ranked UNION SELECT qid, ord FROM pool) p JOIN benchmark q ON q.item_id = p.qid JOIN documents d ON d.doc_id = p.ord)""",
    f"""exam AS (SELECT c.config, q.item_id AS qid,
         (SELECT min(rank) FROM ranked r JOIN ov USING (qid, ord) WHERE r.config = c.config AND r.qid = q.item_id AND o >= 0.7) AS gold_rank,
         (SELECT min(rank) FROM ranked r JOIN ov USING (qid, ord) WHERE r.config = c.config AND r.qid = q.item_id AND o >= 0.5) AS gold_rank_soft,
         coalesce((SELECT bool_or(o >= 0.7) FROM pool p JOIN ov USING (qid, ord) WHERE p.config = c.config AND p.qid = q.item_id), false) AS in_pool,
         (SELECT count(*) FROM pool p WHERE p.config = c.config AND p.qid = q.item_id) AS pool_size
         FROM (SELECT DISTINCT config FROM ranked) c CROSS JOIN benchmark q)""",
    """summ AS (SELECT config, count(*) AS n, round(avg(pool_size), 1) AS pool_size, avg((gold_rank IS NOT NULL AND gold_rank <= 1)::INTEGER) AS recall_1,
         avg((gold_rank IS NOT NULL AND gold_rank <= 5)::INTEGER) AS recall_5, avg((gold_rank_soft IS NOT NULL AND gold_rank_soft <= 5)::INTEGER) AS recall_5_soft,
         avg(in_pool::INTEGER) AS recall_pool, avg(coalesce(1.0 / gold_rank, 0)) AS mrr,
         avg(CASE WHEN gold_rank <= 5 THEN 1 / log2(gold_rank + 1) ELSE 0 END) AS ndcg_5 FROM exam GROUP BY config)""",
)


@register(
    "overlap_ranks",
    B.ctes(*EXAM) + "SELECT config, qid, gold_rank, gold_rank_soft, in_pool, pool_size FROM exam",
)
def overlap_ranks(spark, sf):
    return exam(spark, sf)[0].drop("user")


_METRICS = ["recall_1", "recall_5", "recall_5_soft", "recall_pool", "mrr", "ndcg_5"]


@register(
    "retrieval_metrics",
    B.ctes(*EXAM) + "SELECT config, n, pool_size, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM summ",
)
def retrieval_metrics(spark, sf):
    return M.summarize_exam(exam(spark, sf)[0]).select("config", "n", "pool_size", *[r6(m) for m in _METRICS])


@register(
    "config_verdicts",
    B.ctes(*EXAM)
    + """, d AS (SELECT 'rerank vs hybrid' AS comparison, a.recall_5 - b.recall_5 AS d5, a.mrr - b.mrr AS dm FROM summ a, summ b WHERE a.config = 'hybrid+rerank' AND b.config = 'hybrid'
       UNION ALL SELECT 'hybrid vs dense', a.recall_5 - b.recall_5, a.mrr - b.mrr FROM summ a, summ b WHERE a.config = 'hybrid+rerank' AND b.config = 'dense+rerank')
       SELECT comparison, round(d5, 6) AS delta_recall_5, round(dm, 6) AS delta_mrr, CASE WHEN comparison = 'rerank vs hybrid'
         THEN CASE WHEN d5 <= 0 AND dm <= 0.01 THEN 'not paying' ELSE 'paying' END
         ELSE CASE WHEN d5 < 0 THEN 'hurting' WHEN d5 = 0 THEN 'adds nothing' ELSE 'helping' END END AS verdict FROM d""",
)
def config_verdicts(spark, sf):
    return M.config_verdicts(M.summarize_exam(exam(spark, sf)[0])).select(
        "comparison", r6("delta_recall_5"), r6("delta_mrr"), "verdict"
    )


@register(
    "retrieval_failures",
    B.ctes(*EXAM)
    + """SELECT e.config, e.qid, e.gold_rank, e.in_pool, (SELECT string_agg(r.ord || ':' || replace(substr(d.text, 1, 120), chr(10), ' '), '|' ORDER BY r.rank)
           FROM ranked r JOIN documents d ON d.doc_id = r.ord WHERE r.config = e.config AND r.qid = e.qid AND r.rank <= 5) AS instead
         FROM exam e WHERE gold_rank IS NULL OR gold_rank > 5""",
)
def retrieval_failures(spark, sf):
    rows, got = exam(spark, sf)
    final = with_chunk(got.final, B.chunks(spark, sf), ["text"]).withColumn("chunk_id", F.col("ord").cast("string"))
    failed = M.failures(rows, final, ["config", "user", "qid"])
    shown = F.array_join(F.transform("retrieved_instead", lambda r: F.concat_ws(":", r["chunk_id"], r["preview"])), "|")
    return failed.select("config", "qid", "gold_rank", "in_pool", shown.alias("instead"))


@register(
    "neighbour_sets",
    B.ctes(B.CHUNKS)
    + """SELECT chunk_id, CASE WHEN ord % 11 = 0 THEN 'loose' || ord
           ELSE CASE WHEN n > 0 THEN source || '::' || n || '|' || source || '::' || (n - 1) || '|' ELSE source || '::0|' END || source || '::' || (n + 1) END AS around FROM chunks""",
)
def neighbour_sets(spark, sf):
    gold_id = F.when(F.col("ord") % 11 == 0, F.concat(F.lit("loose"), F.col("ord").cast("string"))).otherwise(F.col("chunk_id"))
    return B.chunks_with_ids(spark, sf).select("chunk_id", F.array_join(M.neighbour_ids(gold_id), "|").alias("around"))


_NEAR = [
    *R.SHIPPED, B.CHUNKS,
    """gid AS (SELECT b.qid, c.source, c.n FROM bm25 b JOIN chunks c USING (ord) WHERE b.rank = 2)""",
    """tg AS (SELECT qid, source || '::' || unnest([n, n - 1, n + 1]) AS chunk_id FROM gid)""",
    "sr AS (SELECT s.qid, s.rank, c.chunk_id FROM s_ranked s JOIN chunks c USING (ord))",
]


@register(
    "id_ranks",
    B.ctes(*_NEAR)
    + """SELECT g.qid, (SELECT min(rank) FROM sr WHERE sr.qid = g.qid AND sr.chunk_id = g.source || '::' || g.n) AS gold_rank,
           (SELECT min(rank) FROM sr WHERE sr.qid = g.qid AND sr.chunk_id IN (SELECT chunk_id FROM tg WHERE tg.qid = g.qid)) AS gold_rank_soft FROM gid g""",
)
def id_ranks(spark, sf):
    """The second lexical hit of a question serves as its gold id."""
    chunks = B.chunks_with_ids(spark, sf)
    index = L.build_index(B.chunks(spark, sf))  # both searches read it
    ranked = with_chunk(R.shipped(spark, sf, index).ranked, chunks, ["chunk_id"]).select("qid", "rank", "chunk_id")
    gold = with_chunk(R.bm25_top(spark, sf, index=index).where("rank = 2"), chunks, ["chunk_id"]).select("qid", "chunk_id")
    around = gold.select("qid", F.explode(M.neighbour_ids(F.col("chunk_id"))).alias("chunk_id"))
    return (
        gold.select("qid")
        .join(M.rank_of_ids(ranked, gold, ["qid"]), "qid", "left")
        .join(M.rank_of_ids(ranked, around, ["qid"], "gold_rank_soft"), "qid", "left")
    )


@register(
    "stage_latency",
    """WITH s AS (SELECT event_type AS config, unnest(['bm25', 'dense']) AS stage, unnest([value / 1000, value / 250]) AS sec FROM events),
       m AS (SELECT config, stage, round(avg(sec) * 1000, 2) AS ms FROM s GROUP BY ALL)
       SELECT * FROM m UNION ALL SELECT config, 'retrieval_total', round(sum(ms), 2) FROM m GROUP BY config""",
)
def stage_latency(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("config"),
        F.create_map(F.lit("bm25"), F.col("value") / 1000, F.lit("dense"), F.col("value") / 250).alias("seconds"),
    )
    return M.stage_latency(runs, ["config"])


@register(
    "judge_scores",
    """WITH r AS (SELECT event_type AS config, TRY_CAST(nullif(regexp_extract(CASE WHEN event_id % 6 = 0 THEN 'no grade' ELSE 'grade: ' || props END, '(\\d)', 1), '') AS INTEGER) AS d FROM events)
       SELECT config, round(avg(CASE WHEN d IS NOT NULL THEN least(5, greatest(1, d)) END), 2) AS answer_score, count(d) AS n_judged FROM r GROUP BY config""",
)
def judge_scores(spark, sf):
    reply = F.when(F.col("event_id") % 6 == 0, "no grade").otherwise(F.concat(F.lit("grade: "), F.col("props")))
    return M.judge_summary(
        table(spark, sf, "events").select(F.col("event_type").alias("config"), reply.alias("reply")), ["config"]
    )


# ---- follow-up arms ---------------------------------------------------------------------------

def arm_questions(spark, sf):
    """Benchmark passages as first turns; the follow-up keeps their first four words."""
    q1 = F.col("text")
    q2 = F.concat(F.lit("why is that "), F.array_join(F.slice(F.split(F.col("text"), " "), 1, 4), " "))
    asked = B.questions(spark, sf).withColumns({"q1": q1, "q2": q2})
    rewritten, fired = V.borrowed_query(F.col("q2"), F.col("q1"), V.is_follow_up(F.col("q2"), F.lit(True)))
    arms = F.array(
        F.struct(F.lit("turn1").alias("arm"), F.col("q1").alias("q"), F.lit(False).alias("fired")),
        F.struct(F.lit("raw").alias("arm"), F.col("q2").alias("q"), F.lit(False).alias("fired")),
        F.struct(F.lit("rewritten").alias("arm"), rewritten.alias("q"), fired.alias("fired")),
    )
    return asked.select("user", F.col("qid").alias("item"), F.col("text").alias("gold_text"), F.posexplode(arms).alias("a", "s")).select(
        "user", "item", "gold_text", (F.col("item") * 8 + F.col("a")).alias("qid"), "s.arm", F.col("s.q").alias("text"), "s.fired"
    )


def score_arms(spark, sf, arms):
    """Exam rows of arm questions against the documents, under the configuration that answers users."""
    chunks = B.chunks(spark, sf)
    vectors = B.hashed_vectors(chunks).select("user", "ord", "embedding")
    asked = B.hashed_vectors(arms).select("user", "qid", "embedding")
    got = retrieve(arms.select("user", "qid", "text"), chunks, index=L.build_index(chunks), vectors=vectors, query_vectors=asked)
    gold = arms.select("qid", "gold_text")
    hit = lambda df: M.with_containment(with_chunk(df, chunks, ["text"]), gold)
    rows = M.exam_rows(arms.select("user", "qid", "arm", "fired"), hit(got.ranked), hit(got.candidates), ["user", "qid"])
    return M.summarize_exam(rows, ["arm"]).join(
        arms.groupBy("arm").agg(F.sum(F.col("fired").cast("int")).alias("fired")), "arm"
    )


def sql_arm_exam(arms_cte: str) -> list[str]:
    return [
        arms_cte, "asked AS (SELECT qid AS item_id, text FROM arms)", *[part.replace("benchmark", "asked") for part in R.SHIPPED],
        f"""ax AS (SELECT a.arm, a.qid, a.fired, min(CASE WHEN o >= 0.7 THEN rank END) AS r, min(CASE WHEN o >= 0.5 THEN rank END) AS rs FROM arms a LEFT JOIN (
            SELECT b.qid, b.rank, {B.sql_containment('a.gold_text', 'd.text')} AS o FROM s_ranked b JOIN arms a USING (qid) JOIN documents d ON d.doc_id = b.ord) h USING (qid)
            GROUP BY ALL)""",
        """asum AS (SELECT arm, count(*) AS n, count_if(fired)::BIGINT AS fired, avg(coalesce((r <= 1)::INTEGER, 0)) AS recall_1, avg(coalesce((r <= 5)::INTEGER, 0)) AS recall_5,
            avg((r IS NOT NULL)::INTEGER) AS recall_pool, avg(coalesce(1.0 / r, 0)) AS mrr, avg(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END) AS ndcg_5 FROM ax GROUP BY arm)""",
    ]


_ARM_METRICS = ["recall_1", "recall_5", "recall_pool", "mrr", "ndcg_5"]
_ARM_SELECT = "SELECT arm, n, fired, " + ", ".join(f"round({m}, 6) AS {m}" for m in _ARM_METRICS) + " FROM asum"
_ARMS = f"""
base AS (SELECT item_id, text AS q1, 'why is that ' || array_to_string(string_split(text, ' ')[1:4], ' ') AS q2 FROM benchmark),
arms AS (SELECT item_id * 8 AS qid, 'turn1' AS arm, q1 AS text, q1 AS gold_text, false AS fired FROM base
   UNION ALL SELECT item_id * 8 + 1, 'raw', q2, q1, false FROM base
   UNION ALL SELECT item_id * 8 + 2, 'rewritten', q2 || ' ' || {B.sql_strip(f"substr({B.sql_collapse('q1')}, 1, 200)")}, q1, true FROM base)
"""


@register("followup_arms", B.ctes(*sql_arm_exam(_ARMS)) + _ARM_SELECT)
def followup_arms(spark, sf):
    return score_arms(spark, sf, arm_questions(spark, sf)).select("arm", "n", "fired", *[r6(m) for m in _ARM_METRICS])


_FP = f"""
shorter AS (SELECT item_id AS pos, text, CASE WHEN item_id % 2 = 0 THEN array_to_string(string_split(text, ' ')[1:6], ' ') ELSE text END AS q FROM benchmark),
prior AS (SELECT *, coalesce(lead(q) OVER (ORDER BY pos), first_value(q) OVER (ORDER BY pos)) AS p, {B.sql_question_words('q')} AS ws FROM shorter),
arms AS (SELECT pos * 8 AS qid, 'clean' AS arm, q AS text, text AS gold_text, false AS fired FROM prior
   UNION ALL SELECT pos * 8 + 1, 'unrelated prior', CASE WHEN len(ws) <= 6 OR list_has_any(ws, {X._ANA}) THEN q || ' ' || {B.sql_strip(f"substr({B.sql_collapse('p')}, 1, 200)")} ELSE q END, text,
      len(ws) <= 6 OR list_has_any(ws, {X._ANA}) FROM prior)
"""


def false_positive_arms(spark, sf):
    short = F.array_join(F.slice(F.split(F.col("text"), " "), 1, 6), " ")
    asked = B.questions(spark, sf).withColumn("q", F.when(F.col("qid") % 2 == 0, short).otherwise(F.col("text")))
    gold = M.unrelated_prior(number_by_key(asked, ["user"], "qid", "pos"))
    query, fired = V.borrowed_query(F.col("q"), F.col("prior"), V.is_follow_up(F.col("q"), F.lit(True)))
    arms = F.array(
        F.struct(F.lit("clean").alias("arm"), F.col("q").alias("q"), F.lit(False).alias("fired")),
        F.struct(F.lit("unrelated prior").alias("arm"), query.alias("q"), fired.alias("fired")),
    )
    return gold.select("user", F.col("qid").alias("item"), F.col("text").alias("gold_text"), F.posexplode(arms).alias("a", "s")).select(
        "user", "item", "gold_text", (F.col("item") * 8 + F.col("a")).alias("qid"), "s.arm", F.col("s.q").alias("text"), "s.fired"
    )


@register(
    "false_positive_arm",
    B.ctes(*sql_arm_exam(_FP))
    + """SELECT round(b.recall_5 - a.recall_5, 4) AS recall_5_delta, round(b.recall_1 - a.recall_1, 4) AS recall_1_delta,
         round(b.recall_5 - a.recall_5, 4) < -0.05 AS too_eager FROM asum a, asum b WHERE a.arm = 'clean' AND b.arm = 'unrelated prior'""",
)
def false_positive_arm(spark, sf):
    return M.arm_deltas(score_arms(spark, sf, false_positive_arms(spark, sf)), "clean", "unrelated prior")


def swept_embedders():
    """Two widths of the default embedder, and the wider one over normalised markup."""
    wide = hashed_tf_embedder(256)
    return {"small": hashed_tf_embedder(64), "wide": wide, "wide_normalized": normalizing(wide)}


@register("chunker_grid")
def chunker_grid(spark, sf):
    """Chunkers × embedders × settings over whole documents: metrics, chunk counts, build seconds and index size of 18 cells."""
    asked = B.questions(spark, sf).select("user", "qid", "text", F.col("text").alias("gold_text"))
    return sweep(D.doc_rows(spark, sf), asked, swept_embedders())


# ---- scorer bench -----------------------------------------------------------------------------

SCORERS = {"overlap": (8.0, 0.35), "strict": (20.0, 0.6)}


def scorer_runs(spark, sf):
    """The shared pool rescored by each scorer; pools are built once and reused."""
    pool = R.shipped(spark, sf).candidates
    both = with_chunk(pool, B.chunks(spark, sf), ["text"]).join(
        B.questions(spark, sf).select("user", "qid", F.col("text").alias("qtext")), ["user", "qid"]
    )
    scored = F.array(
        *[F.struct(F.lit(n).alias("scorer"), overlap_scorer(*p)(F.col("qtext"), F.col("text")).alias("s")) for n, p in SCORERS.items()],
        F.struct(F.lit("length").alias("scorer"), F.round(1 / (1 + F.length("text") / 1000), 9).alias("s")),
    )
    rows = both.select("qid", F.col("ord").alias("chunk_id"), F.col("rank").alias("prior"), F.explode(scored).alias("x")).select(
        "qid", "chunk_id", "prior", "x.scorer", F.col("x.s").alias("score")
    )
    return M.rank_in_group(rows, ["scorer", "qid"], F.col("score").desc(), F.col("prior"))


_BENCH = [
    *R.SHIPPED,
    f"""sc AS (SELECT p.qid, p.ord, p.rank AS prior, unnest(['overlap', 'strict', 'length']) AS scorer, unnest([{B.sql_scorer('q.text', 'd.text')},
        {B.sql_scorer('q.text', 'd.text').replace('-8.0', '-20.0').replace('0.35', '0.6')}, round(1 / (1 + length(d.text) / 1000), 9)]) AS score
        FROM s_pool p JOIN benchmark q ON q.item_id = p.qid JOIN documents d ON d.doc_id = p.ord)""",
    "sr AS (SELECT *, row_number() OVER (PARTITION BY scorer, qid ORDER BY score DESC, prior) AS rank FROM sc)",
]


@register(
    "scorer_agreement",
    B.ctes(*_BENCH)
    + """SELECT scorer, round(avg(s), 6) AS agreement FROM (SELECT a.scorer, a.qid, count(b.ord) / 5 AS s FROM sr a LEFT JOIN sr b ON b.scorer = 'overlap' AND b.qid = a.qid
         AND b.ord = a.ord AND b.rank <= 5 WHERE a.rank <= 5 GROUP BY ALL) GROUP BY scorer""",
)
def scorer_agreement(spark, sf):
    return M.top5_agreement(scorer_runs(spark, sf), "overlap").select("scorer", r6("agreement"))


@register(
    "scorer_score_range",
    B.ctes(*_BENCH)
    + """SELECT scorer, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max, round(quantile_cont(score, 0.5), 6) AS score_median FROM sr GROUP BY scorer""",
)
def scorer_score_range(spark, sf):
    return M.score_range(scorer_runs(spark, sf), ["scorer"]).select(
        "scorer", r6("score_min"), r6("score_max"), r6("score_median")
    )


@register(
    "bench_gold_hits",
    B.ctes(*R.SHIPPED)
    + f"""SELECT p.qid, count(DISTINCT p.ord) AS n_hits FROM s_pool p JOIN benchmark q ON q.item_id = p.qid JOIN documents d ON d.doc_id = p.ord
          WHERE len(list_intersect(list_distinct({B.sql_ws_tokens('q.text')}), {B.sql_ws_tokens('d.text')}))::DOUBLE / len(list_distinct({B.sql_ws_tokens('q.text')})) >= 0.7
          GROUP BY p.qid""",
)
def bench_gold_hits(spark, sf):
    pool = with_chunk(R.shipped(spark, sf).candidates, B.chunks(spark, sf), ["text"])
    gold = B.questions(spark, sf).select("qid", F.col("text").alias("gold_text"), F.lit("").alias("gold_chunk_id"))
    hits = M.bench_hits(pool.select("qid", F.col("ord").cast("string").alias("chunk_id"), "text"), gold)
    return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))


@register(
    "latency_profile",
    """WITH m AS (SELECT event_type AS scorer, user_id AS qid, median(value) AS ms FROM events GROUP BY ALL),
       p AS (SELECT scorer, quantile_cont(ms, 0.5) AS p50_ms, list_sort(list(ms))[greatest(0, floor(count(*) * 0.95) - 1)::INTEGER + 1] AS p95_ms FROM m GROUP BY scorer)
       SELECT scorer, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round((SELECT p50_ms FROM p WHERE scorer = 'click') / p50_ms, 6) AS speed_up FROM p""",
)
def latency_profile(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("scorer"), F.col("user_id").alias("qid"), F.col("value").alias("ms")
    )
    return M.latency_profile(runs, "click").select("scorer", r6("p50_ms"), r6("p95_ms"), r6("speed_up"))


# ---- calibration ------------------------------------------------------------------------------


def judged(spark, sf):
    """Labelled documents as judged pairs: the source asks, grade from the labels, score from the text."""
    docs = D.docs(spark, sf).select("doc_id", "source", F.length("text").alias("len"))
    score = F.round((F.col("len") % 997 + 1) / 1000 * F.when(F.col("grade") > 0, 1.0).otherwise(0.7), 6)
    return (
        table(spark, sf, "labels").join(docs, "doc_id")
        .withColumn("grade", F.col("quality") * (F.col("doc_id") % 3 + 1).cast("int"))
        .select(F.col("source").alias("qid"), F.col("doc_id").alias("did"), "grade", score.alias("score"))
    )


JUDGED = """
judged AS (SELECT source AS qid, doc_id AS did, quality * (doc_id % 3 + 1)::INTEGER AS grade,
   round((length(text) % 997 + 1)::DOUBLE / 1000 * CASE WHEN quality > 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END, 6) AS score
   FROM labels JOIN documents USING (doc_id))
"""


def _pairs_to_score(spark, sf, scored):
    docs = D.docs(spark, sf)
    queries = docs.where("source <> 'src3'").select(F.col("source").alias("qid")).distinct().withColumn("qtext", F.col("qid"))
    return CA.unscored_pairs(
        judged(spark, sf).select("qid", "did", "grade"), scored, queries, docs.select(F.col("doc_id").alias("did"), "text")
    )


@register(
    "unscored_pairs",
    B.ctes(JUDGED)
    + f"""SELECT j.qid, j.did, j.grade, round({B.sql_scorer('j.qid', 'd.text')}, 6) AS score FROM judged j
         JOIN (SELECT DISTINCT source FROM documents WHERE source <> 'src3') q ON q.source = j.qid JOIN documents d ON d.doc_id = j.did
         WHERE j.did % 4 <> 0""",
)
def unscored_pairs(spark, sf):
    j = judged(spark, sf)
    todo = _pairs_to_score(spark, sf, j.where("did % 4 = 0"))
    return CA.score_pairs(todo, overlap_scorer()).select("qid", "did", "grade", F.round("score", 6).alias("score"))


@register(
    "resumed_scores",
    B.ctes(JUDGED)
    + f"""SELECT j.qid, j.did, j.grade, round({B.sql_scorer('j.qid', 'd.text')}, 6) AS score FROM judged j
         JOIN (SELECT DISTINCT source FROM documents WHERE source <> 'src3') q ON q.source = j.qid JOIN documents d ON d.doc_id = j.did""",
)
def resumed_scores(spark, sf):
    """All judged pairs, scored in two calls: the first ends after three of eight slices, the second takes up the rest in four."""
    path, none = scratch_path(spark, "scores"), judged(spark, sf).where("false")
    todo = _pairs_to_score(spark, sf, none)
    CA.score_resumably(todo, overlap_scorer(), path, slices=8, at_most=3)
    got = CA.score_resumably(todo, overlap_scorer(), path, slices=4)
    return got.select("qid", "did", "grade", F.round("score", 6).alias("score"))


_NEAREST = ", ".join(
    f"list_sort(list(score))[least(count(*) - 1, floor({q}::DOUBLE * count(*)))::INTEGER + 1] AS {n}" for n, q in CA.GRADE_QUANTILES.items()
)


@register("grade_quantiles", B.ctes(JUDGED) + f"SELECT grade, count(*) AS n, {_NEAREST} FROM judged GROUP BY grade")
def grade_quantiles(spark, sf):
    return CA.grade_quantiles(judged(spark, sf))


@register(
    "pairwise_auc",
    B.ctes(JUDGED)
    + """SELECT count(DISTINCT p.did) AS n_pos, count(DISTINCT n.did) AS n_neg, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc
         FROM judged p, judged n WHERE p.grade >= 1 AND n.grade = 0""",
)
def pairwise_auc(spark, sf):
    return CA.pairwise_auc(judged(spark, sf)).select("n_pos", "n_neg", r6("auc"))


_ABST = """
irr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5('0:' || qid || ':' || did), did) AS rn FROM judged WHERE grade = 0),
negs AS (SELECT '5' AS pool, qid, max(score) AS neg_max FROM irr WHERE rn <= 5 GROUP BY qid UNION ALL SELECT '20', qid, max(score) FROM irr WHERE rn <= 20 GROUP BY qid
   UNION ALL SELECT 'all', qid, max(score) FROM irr GROUP BY qid),
abst AS (SELECT pool, qid, neg_max, pos_max FROM negs JOIN (SELECT qid, max(score) AS pos_max FROM judged WHERE grade >= 1 GROUP BY qid) USING (qid))
"""


@register("abstention_inputs", B.ctes(JUDGED, _ABST) + "SELECT pool, qid, neg_max, pos_max FROM abst")
def abstention_inputs(spark, sf):
    return CA.abstention_inputs(judged(spark, sf))


_FLOORS = "[" + ", ".join(f"{f}::DOUBLE" for f in CA.FLOORS) + "]"
_SWEEP = f"""
sweep AS (SELECT pool, floor, count(*) AS n, avg((neg_max < floor)::INTEGER) AS correct_abstain, avg((pos_max < floor)::INTEGER) AS false_abstain
   FROM abst, (SELECT unnest({_FLOORS}) AS floor) GROUP BY ALL)
"""


@register(
    "floor_sweep",
    B.ctes(JUDGED, _ABST, _SWEEP)
    + """SELECT pool, floor, n, round(correct_abstain, 6) AS correct_abstain, round(false_abstain, 6) AS false_abstain, round(correct_abstain - false_abstain, 6) AS youden_j FROM sweep""",
)
def floor_sweep(spark, sf):
    return CA.floor_sweep(CA.abstention_inputs(judged(spark, sf))).select(
        "pool", "floor", "n", r6("correct_abstain"), r6("false_abstain"), r6("youden_j")
    )


@register(
    "best_floors",
    B.ctes(JUDGED, _ABST, _SWEEP)
    + """SELECT pool, (SELECT floor FROM sweep b WHERE b.pool = a.pool ORDER BY round(correct_abstain - false_abstain, 9) DESC, floor LIMIT 1) AS best_floor,
         round(max(correct_abstain - false_abstain), 6) AS best_j,
         (SELECT floor FROM sweep b WHERE b.pool = a.pool AND false_abstain <= 0.1 ORDER BY round(correct_abstain, 9) DESC, floor LIMIT 1) AS budget_floor,
         round(max(CASE WHEN false_abstain <= 0.1 THEN correct_abstain END), 6) AS budget_abstain FROM sweep a GROUP BY pool""",
)
def best_floors(spark, sf):
    best = CA.best_floors(CA.floor_sweep(CA.abstention_inputs(judged(spark, sf))))
    return best.select("pool", "best_floor", r6("best_j"), "budget_floor", r6("budget_abstain"))


@register(
    "softmax_top_share",
    B.ctes(JUDGED)
    + """, t AS (SELECT qid, score, ln(greatest(score, 1e-9) / greatest(1 - score, 1e-9)) AS lg FROM judged QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) <= 5),
       m AS (SELECT qid, max(score) AS ms, max(lg) AS ml FROM t GROUP BY qid HAVING count(*) >= 5),
       s AS (SELECT qid, 1 / sum(exp(score - ms)) AS raw, 1 / sum(exp(lg - ml)) AS logit FROM t JOIN m USING (qid) GROUP BY qid)
       SELECT 'raw' AS scale, round(list_sort(list(raw))[(count(*) // 2)::INTEGER + 1], 6) AS median_share FROM s
       UNION ALL SELECT 'logit', round(list_sort(list(logit))[(count(*) // 2)::INTEGER + 1], 6) FROM s""",
)
def softmax_top_share(spark, sf):
    return CA.top1_softmax_share(judged(spark, sf)).select("scale", r6("median_share"))


def topics(spark, sf):
    """Best final score per question: benchmark passages are on topic, pages' titles are not."""
    on = R.shipped(spark, sf).final.groupBy("qid").agg(F.max("score").alias("score")).withColumn("topic", F.lit("on"))
    off = judged(spark, sf).where("grade = 0").groupBy(F.col("did").alias("qid")).agg(
        (F.max("score") * 0.6).alias("score")
    ).withColumn("topic", F.lit("off"))
    return on.unionByName(off)


_TOPICS = [
    *R.SHIPPED, JUDGED,
    """best AS (SELECT 'on' AS topic, qid, max(score) AS score FROM s_ranked WHERE rank <= 5 GROUP BY qid
        UNION ALL SELECT 'off', did, max(score) * 0.6 FROM judged WHERE grade = 0 GROUP BY did)""",
]


@register(
    "topic_bracket",
    B.ctes(*_TOPICS)
    + """, b AS (SELECT topic, min(score) AS lo, max(score) AS hi, list_sort(list(score))[(count(*) // 4)::INTEGER + 1] AS p25, quantile_cont(score, 0.5) AS median FROM best GROUP BY topic)
       SELECT topic, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p25, 6) AS p25, round(median, 6) AS median,
         round(sqrt((SELECT hi FROM b WHERE topic = 'off') * (SELECT lo FROM b WHERE topic = 'on')), 6) AS midpoint FROM b""",
)
def topic_bracket(spark, sf):
    t = CA.topic_bracket(topics(spark, sf))
    return t.select("topic", r6("lo"), r6("hi"), r6("p25"), r6("median"), r6("midpoint"))


@register(
    "corpus_floor_sweep",
    B.ctes(*_TOPICS)
    + f"""SELECT floor, count(*) AS n, round(avg((score < floor)::INTEGER) FILTER (topic = 'off'), 6) AS correct_abstain,
          round(avg((score < floor)::INTEGER) FILTER (topic = 'on'), 6) AS false_abstain FROM best, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in CA.CORPUS_FLOORS)}]) AS floor) GROUP BY floor""",
)
def corpus_floor_sweep(spark, sf):
    return CA.corpus_floor_sweep(topics(spark, sf)).select("floor", "n", r6("correct_abstain"), r6("false_abstain"))


@register(
    "cutoff_vs_nucleus",
    B.ctes(*R.SHIPPED)
    + """, f AS (SELECT qid, rank, score, ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))) AS lg FROM s_ranked WHERE rank <= 5),
       p AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY qid)) AS e FROM f),
       c AS (SELECT *, sum(e) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY qid) AS cum FROM p),
       k AS (SELECT qid, unnest(['cutoff 0.15', 'cutoff 0.5', 'cutoff 0.8', 'nucleus 0.8', 'nucleus 0.9', 'nucleus 0.95']) AS mechanism,
         unnest([count_if(score >= 0.15), count_if(score >= 0.5), count_if(score >= 0.8), coalesce(min(CASE WHEN round(cum, 9) >= 0.8 THEN rank END), count(*)),
           coalesce(min(CASE WHEN round(cum, 9) >= 0.9 THEN rank END), count(*)), coalesce(min(CASE WHEN round(cum, 9) >= 0.95 THEN rank END), count(*))]::BIGINT[]) AS kept FROM c GROUP BY qid)
       SELECT mechanism, round(avg(kept), 6) AS mean_kept, round(avg((kept = 5)::INTEGER), 6) AS keeps_all, round(avg((kept = 1)::INTEGER), 6) AS keeps_one FROM k GROUP BY mechanism""",
)
def cutoff_vs_nucleus(spark, sf):
    got = CA.cutoff_vs_nucleus(R.shipped(spark, sf).final.select("qid", "rank", "score"))
    return got.select("mechanism", r6("mean_kept"), r6("keeps_all"), r6("keeps_one"))


@register(
    "worst_off_topic",
    B.ctes(*_TOPICS) + "SELECT qid, round(score, 6) AS score FROM best WHERE topic = 'off' ORDER BY best.score DESC, qid LIMIT 4",
)
def worst_off_topic(spark, sf):
    return CA.worst_off_topic(topics(spark, sf)).select("qid", r6("score"))

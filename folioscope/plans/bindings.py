"""How the library's tables are derived from the given test tables, in Spark and in SQL.

Each Spark binding has a SQL fragment of the same meaning next to it; the fragments are CTE
bodies the registered queries' SQL is put together from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.models import hashed_tf_embedder
from folioscope.operators.chunking import assign_chunk_ids
from folioscope.operators.dense import embed
from folioscope.plans.registry import table

USER = "shared"
DIM = 64
WS = T.WS


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


# ---- SQL expression helpers -------------------------------------------------------------------


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def sql_casefold(x: str) -> str:
    return f"translate(replace(lower({x}), 'ß', 'ss'), 'ςµ', 'σμ')"


def sql_ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda t: t <> '')"


def sql_alnum_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def sql_content_words(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{3,}}')), "
        f"lambda w: NOT list_contains([{stop}], w))"
    )


def sql_question_words(x: str) -> str:
    return f"regexp_extract_all({sql_casefold(x)}, '[a-z0-9'']+')"


def sql_containment(gold: str, text: str) -> str:
    g, t = sql_alnum_set(gold), sql_alnum_set(text)
    return f"(CASE WHEN len({g}) = 0 THEN 0.0 ELSE len(list_intersect({g}, {t}))::DOUBLE / len({g}) END)"


def sql_is_math(x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{s}')" for s in T.MATH_SIGNALS) + ")"


def owner(key: str) -> Column:
    """The one user of the test tables, as a per-row value: a literal would fold join keys away."""
    return F.when(F.col(key).isNotNull(), F.lit(USER)).alias("user")


# ---- chunks and questions ---------------------------------------------------------------------


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as one user's chunk table."""
    return table(spark, sf, "documents").select(
        owner("doc_id"), F.col("doc_id").alias("ord"), "source", "lang", "text"
    )


def chunks_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`chunks`, with ``n`` and ``chunk_id`` counted per source in document order."""
    return assign_chunk_ids(chunks(spark, sf), "ord")


CHUNKS = """
chunks AS (
  SELECT 'shared' AS "user", doc_id AS ord, source, lang, text,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n,
         source || '::' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS chunk_id
  FROM documents)
"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        owner("item_id"), F.col("item_id").alias("qid"), "text"
    )


QUESTIONS = "questions AS (SELECT 'shared' AS \"user\", item_id AS qid, text FROM benchmark)"

# BM25 tables and per-question ranking, cut at depth 25 (the deepest list a configuration asks for).
BM25 = f"""
b_dl AS MATERIALIZED (SELECT doc_id AS ord, {sql_ws_tokens('text')} AS toks, len({sql_ws_tokens('text')}) AS dl FROM documents),
b_tf AS MATERIALIZED (SELECT ord, term, dl, count(*) AS tf FROM (SELECT ord, dl, unnest(toks) AS term FROM b_dl) GROUP BY ALL),
b_stat AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM b_dl),
b_raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n_docs FROM b_stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
          FROM b_tf GROUP BY term),
b_mean AS (SELECT avg(raw) AS mean_idf FROM b_raw),
b_terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT mean_idf FROM b_mean) ELSE raw END AS idf FROM b_raw),
b_ask AS (SELECT item_id AS qid, term, count(*) AS qtf
          FROM (SELECT item_id, unnest({sql_ws_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
b_hit AS (SELECT qid, ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM b_stat)))), 9) AS score
          FROM b_ask JOIN b_terms USING (term) JOIN b_tf USING (term) GROUP BY qid, ord)
"""
BM25_RANKED = """
b_all AS (SELECT q.item_id AS qid, d.doc_id AS ord, coalesce(h.score, 0.0) AS score
          FROM benchmark q CROSS JOIN documents d LEFT JOIN b_hit h ON h.qid = q.item_id AND h.ord = d.doc_id),
bm25 AS (SELECT qid, ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank
         FROM b_all QUALIFY rank <= 25)
"""


def hashed_vectors(df: DataFrame) -> DataFrame:
    return embed(df, hashed_tf_embedder(DIM))


def sql_vectors(name: str, tab: str, key: str) -> str:
    return f"""
{name}_n AS (SELECT {key} AS id, ('0x' || substr(md5(tok), 1, 8))::UBIGINT % {DIM} AS axis, count(*) AS c
        FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM {tab}) GROUP BY ALL),
{name} AS (SELECT id, axis, (c / sqrt(sum(c * c) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM {name}_n)
"""


DENSE_RANKED = (
    sql_vectors("v_doc", "documents", "doc_id").strip()
    + ",\n"
    + sql_vectors("v_ask", "benchmark", "item_id").strip()
    + """,
v_dot AS (SELECT a.id AS qid, d.id AS ord, round(sum(a.x * d.x), 9) AS score
          FROM v_ask a JOIN v_doc d USING (axis) GROUP BY ALL),
v_all AS (SELECT q.item_id AS qid, d.doc_id AS ord, coalesce(v.score, 0.0) AS score
          FROM benchmark q CROSS JOIN documents d LEFT JOIN v_dot v ON v.qid = q.item_id AND v.ord = d.doc_id),
dense AS (SELECT qid, ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank
          FROM v_all QUALIFY rank <= 25)
"""
)


def sql_rrf(name: str, lists: list[tuple[str, float]], depth: int) -> str:
    """CTEs fusing ranked lists (bm25, dense) at one depth into ``name(qid, ord, key, score, rank)``."""
    union = " UNION ALL ".join(
        f"SELECT qid, ord, rank, {i} AS list_no, {w}::DOUBLE AS w FROM {t} WHERE rank <= {depth}"
        for i, (t, w) in enumerate(lists)
    )
    return f"""
{name}_in AS (SELECT u.*, substr(d.text, 1, 120) AS key, u.list_no * 1000 + u.rank AS seen
        FROM ({union}) u JOIN documents d ON d.doc_id = u.ord),
{name}_sum AS (SELECT qid, key, sum(w * (1.0::DOUBLE / (60 + rank)) ORDER BY seen) AS score,
         arg_max(ord, seen) AS ord, min(seen) AS first_seen FROM {name}_in GROUP BY qid, key),
{name} AS (SELECT qid, ord, key, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first_seen) AS rank
        FROM {name}_sum)
"""


def sql_scorer(query: str, text: str) -> str:
    q, t = sql_alnum_set(query), sql_alnum_set(text)
    share = f"(CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {t}))::DOUBLE / len({q}) ELSE 0.0 END)"
    return f"round(1 / (1 + exp(-8.0::DOUBLE * ({share} - 0.35::DOUBLE))), 9)"

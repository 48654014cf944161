"""Registered queries that write given tables out through a sink, read them back and return what is there; and a model's scorer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folioscope.functions.models import scorer_from_model
from folioscope.plans import bindings as B
from folioscope.plans import q_context as X
from folioscope.plans import q_evaluation as E
from folioscope.plans import q_retrieval as Q
from folioscope.plans.registry import register, table
from folioscope.plans.retrieve import rerank_scores
from folioscope.session import scratch_path
from folioscope.sources import readers as R
from folioscope.sources import sinks


@register("exam_read_back", "SELECT item_id, md5(text) AS digest FROM benchmark")
def exam_read_back(spark, sf):
    """Benchmark items as JSON lines with blank lines among them."""
    path = scratch_path(spark, "exam")
    table(spark, sf, "benchmark").select(F.concat(F.to_json(F.struct("item_id", "text")), F.lit("\n"))).write.text(path)
    return R.read_exam(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("digest"))


@register(
    "figures_replaced",
    """SELECT 'p' || page_id AS doc_name, 'p' || page_id || '::img' || n AS image_id, n, CASE WHEN page_id % 2 = 0 THEN 'new ' ELSE '' END || url AS caption
       FROM pages, (SELECT unnest([0, 1, 2]) AS n) WHERE page_id % 2 = 1 OR n = 0""",
)
def figures_replaced(spark, sf):
    """Three figures a page; every other page is written again with one, and keeps no stale row."""
    path = scratch_path(spark, "figures")
    doc = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    shown = table(spark, sf, "pages").select("page_id", "url", doc.alias("doc_name"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    figures = shown.withColumn("image_id", F.concat_ws("::img", "doc_name", "n"))
    keep = ["doc_name", "image_id", "n"]
    sinks.replace_figures(figures.select(*keep, F.col("url").alias("caption")), path)
    again = figures.where("page_id % 2 = 0 and n = 0").select(*keep, F.concat(F.lit("new "), "url").alias("caption"))
    sinks.replace_figures(again, path)
    return spark.read.parquet(path).select(*keep, "caption")


@register("report_read_back", "SELECT event_type AS config, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def report_read_back(spark, sf):
    """A metrics table with a folder per configuration; a second report replaces the first."""
    path = scratch_path(spark, "report")
    metrics = table(spark, sf, "events").groupBy(F.col("event_type").alias("config")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    sinks.write_report(metrics.withColumn("n", F.lit(0).cast("long")), path)
    sinks.write_report(metrics, path)
    return spark.read.schema("n long, mean double, config string").json(path).select("config", "n", F.round("mean", 6).alias("mean"))


@register(
    "review_read_back",
    B.ctes(E.WORD_DF, X.ANSWERED, E.LEAK, E.GOLD)
    + """SELECT gold_chunk_id, round(leak_score, 6) AS leak_score, md5(q) AS q, md5(replace(substr(chunk_text, 1, 300), chr(10), ' ')) AS snippet FROM gold""",
)
def review_read_back(spark, sf):
    path = scratch_path(spark, "review")
    sinks.write_review(E.gold_rows(spark, sf), path)
    rows = spark.read.schema("gold_chunk_id string, leak_score double, q string, snippet string").json(path)
    return rows.select("gold_chunk_id", F.round("leak_score", 6).alias("leak_score"), F.md5("q").alias("q"), F.md5("snippet").alias("snippet"))


def length_scorer():
    """A joint model behind the scorer hook: how close the lengths of question and text are."""

    def load():
        return lambda pairs: np.array([1 / (1 + abs(len(q) - len(t)) / 100) for q, t in pairs])

    return scorer_from_model(load)


@register(
    "model_scored_pairs",
    B.ctes(*Q.SHIPPED)
    + """SELECT p.qid, p.ord, round(1 / (1 + abs(length(q.text) - length(d.text)) / 100), 6) AS score
         FROM s_pool p JOIN benchmark q ON q.item_id = p.qid JOIN documents d ON d.doc_id = p.ord""",
)
def model_scored_pairs(spark, sf):
    """The pool of the shipped configuration under a model's scores."""
    pool = Q.shipped(spark, sf).candidates.select("user", "qid", "ord")
    scored = rerank_scores(pool, B.questions(spark, sf), B.chunks(spark, sf), length_scorer())
    return scored.select("qid", "ord", F.round("score", 6).alias("score"))

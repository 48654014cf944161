"""Registered queries: lexical, dense, fused and reranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F


from folioscope.operators import dense as D
from folioscope.operators import fusion as FU
from folioscope.operators import lexical as L
from folioscope.plans import bindings as B
from folioscope.plans.registry import register, table
from folioscope.plans.retrieve import CONFIGS, RetrievalConfig, retrieve, retrieve_all, with_chunk


@register("bm25_terms", B.ctes(B.BM25) + "SELECT term, df, round(idf, 6) AS idf FROM b_terms")
def bm25_terms(spark, sf):
    index = L.build_index(B.chunks(spark, sf))
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register(
    "bm25_corpus_stats",
    B.ctes(B.BM25) + """SELECT n_docs, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf FROM b_stat, b_mean""",
)
def bm25_corpus_stats(spark, sf):
    stats = L.build_index(B.chunks(spark, sf)).stats
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@register(
    "bm25_score_summary",
    B.ctes(B.BM25)
    + """SELECT qid, count(*) AS n_matched, round(max(score), 6) AS best, round(avg(score), 6) AS mean
         FROM b_hit GROUP BY qid""",
)
def bm25_score_summary(spark, sf):
    scores = L.bm25_scores(L.build_index(B.chunks(spark, sf)), B.questions(spark, sf))
    return scores.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_matched"), F.round(F.max("score"), 6).alias("best"),
        F.round(F.avg("score"), 6).alias("mean"),
    )


def bm25_top(spark, sf, k=10, index=None):
    return L.bm25_top_k(index or L.build_index(B.chunks(spark, sf)), B.questions(spark, sf), k)


@register(
    "bm25_top_k",
    B.ctes(B.BM25, B.BM25_RANKED) + "SELECT qid, rank, ord, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
)
def bm25_top_k(spark, sf):
    return bm25_top(spark, sf).select("qid", "rank", "ord", F.round("score", 6).alias("score"))


def _pruned(spark, sf):
    asked, by_block = B.questions(spark, sf), L.blocked(L.build_index(B.chunks(spark, sf)))
    return by_block, asked, L.bm25_top_k_blocks(by_block, asked, 10)


@register(
    "bm25_top_k_blocks",
    B.ctes(B.BM25, B.BM25_RANKED) + "SELECT qid, rank, ord, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
)
def bm25_top_k_blocks(spark, sf):
    """The same rows from posting blocks, ranges under the tenth score left out."""
    return _pruned(spark, sf)[2].top.select("qid", "rank", "ord", F.round("score", 6).alias("score"))


@register("bm25_block_reads")
def bm25_block_reads(spark, sf):
    """How much of the asked terms' postings that search scores."""
    by_block, asked, pruned = _pruned(spark, sf)
    return L.postings_read(by_block, pruned, asked)


@register(
    "dense_centroid_top_k",
    """WITH axes AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS axis, vec_id FROM embeddings),
    cen AS (SELECT label, axis, avg(x) AS m FROM axes GROUP BY ALL),
    dot AS (SELECT c.label AS qid, a.vec_id AS ord, round(sum(c.m * a.x), 9) AS score
            FROM cen c JOIN axes a USING (axis) GROUP BY ALL)
    SELECT qid, ord, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM dot) WHERE rank <= 10""",
)
def dense_centroid_top_k(spark, sf):
    vectors, asked = _centroids(spark, sf)
    return D.dense_top_k(vectors, asked, 10).select("qid", "ord", F.round("score", 6).alias("score"), "rank")


def _centroids(spark, sf):
    stored = table(spark, sf, "embeddings")
    vectors = stored.select(B.owner("vec_id"), F.col("vec_id").alias("ord"), "embedding")
    asked = D.label_centroids(stored).select(
        B.owner("label"), F.col("label").cast("long").alias("qid"), "embedding"
    )
    return vectors, asked


def dense_inputs(spark, sf):
    vectors = B.hashed_vectors(B.chunks(spark, sf)).select("user", "ord", "embedding")
    return vectors, B.hashed_vectors(B.questions(spark, sf)).select("user", "qid", "embedding")


@register("approx_dense_recall")
def approx_dense_recall(spark, sf):
    """Every benchmark question against every document: recall of the inverted file's best ten, and the share of pairs it scored."""
    vectors, asked = dense_inputs(spark, sf)
    index = D.build_cells(vectors)
    recall = D.recall_against_exact(D.dense_top_k_approx(index, asked, 10), D.dense_top_k(vectors, asked, 10))
    return recall.withColumn("share_scored", D.scored_share(index, asked).scalar())


@register(
    "embedded_top_k",
    B.ctes(B.DENSE_RANKED) + "SELECT qid, rank, ord, round(score, 6) AS score FROM dense WHERE rank <= 10",
)
def embedded_top_k(spark, sf):
    return D.dense_top_k(*dense_inputs(spark, sf), 10).select("qid", "rank", "ord", F.round("score", 6).alias("score"))


@register(
    "embedding_axes",
    B.ctes(B.sql_vectors("v", "documents", "doc_id"))
    + "SELECT axis::BIGINT AS axis, count(*) AS n, round(sum(x), 6) AS total FROM v WHERE x > 0 GROUP BY 1",
)
def embedding_axes(spark, sf):
    vectors = B.hashed_vectors(B.chunks(spark, sf))
    return (
        vectors.select(F.posexplode("embedding").alias("axis", "x")).where("x > 0")
        .groupBy(F.col("axis").cast("long").alias("axis"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 6).alias("total"))
    )


def both_lists(spark, sf):
    chunks = B.chunks(spark, sf).withColumn("key", FU.content_key(F.col("text")))
    bm25 = bm25_top(spark, sf)
    dense = D.dense_top_k(*dense_inputs(spark, sf), 10)
    return [with_chunk(h, chunks, ["key"]) for h in (bm25, dense)]


def _fused(spark, sf, weights=None):
    return FU.reciprocal_rank_fusion(FU.stack_lists(both_lists(spark, sf), weights), ["qid"])


_FUSED = "SELECT qid, rank, ord, round(score, 6) AS score FROM rrf"


@register(
    "rank_fusion",
    B.ctes(B.BM25, B.BM25_RANKED, B.DENSE_RANKED, B.sql_rrf("rrf", [("bm25", 1.0), ("dense", 1.0)], 10)) + _FUSED,
)
def rank_fusion(spark, sf):
    return _fused(spark, sf).select("qid", "rank", "ord", F.round("score", 6).alias("score"))


@register(
    "rank_fusion_weighted",
    B.ctes(B.BM25, B.BM25_RANKED, B.DENSE_RANKED, B.sql_rrf("rrf", [("bm25", 0.3), ("dense", 1.0)], 10)) + _FUSED,
)
def rank_fusion_weighted(spark, sf):
    return _fused(spark, sf, [0.3, 1.0]).select("qid", "rank", "ord", F.round("score", 6).alias("score"))


@register(
    "candidate_pool",
    B.ctes(B.BM25, B.BM25_RANKED, B.DENSE_RANKED, B.sql_rrf("rrf", [("bm25", 1.0), ("dense", 1.0)], 10))
    + "SELECT qid, count(*) AS pool, max(rank) AS deepest FROM rrf WHERE rank <= 15 GROUP BY qid",
)
def candidate_pool(spark, sf):
    return FU.candidate_pool(_fused(spark, sf), 15).groupBy("qid").agg(
        F.count(F.lit(1)).alias("pool"), F.max("rank").alias("deepest")
    )


def sql_ranked(config: RetrievalConfig, name: str) -> list[str]:
    """CTEs for one configuration: ``<name>_rrf``, ``<name>_pool`` and ``<name>_ranked``."""
    lists = [t for t, on in (("bm25", config.use_bm25), ("dense", config.use_dense)) if on]
    weights = config.rrf_weights or (1.0,) * len(lists)
    parts = [
        B.sql_rrf(f"{name}_rrf", list(zip(lists, weights)), config.top_k),
        f"{name}_pool AS (SELECT * FROM {name}_rrf WHERE rank <= {config.rerank_top_c})",
    ]
    if config.use_rerank:
        parts.append(
            f"""{name}_sc AS (SELECT p.qid, p.ord, p.rank AS prior, {B.sql_scorer('q.text', 'd.text')} AS score
                FROM {name}_pool p JOIN benchmark q ON q.item_id = p.qid JOIN documents d ON d.doc_id = p.ord)"""
        )
        parts.append(
            f"""{name}_ranked AS (SELECT qid, ord, score,
                row_number() OVER (PARTITION BY qid ORDER BY score DESC, prior) AS rank FROM {name}_sc)"""
        )
    else:
        parts.append(f"{name}_ranked AS (SELECT qid, ord, score, rank FROM {name}_rrf)")
    return parts


BASE = [B.BM25, B.BM25_RANKED, B.DENSE_RANKED]


def sql_all_configs() -> str:
    """CTEs of every configuration plus ``ranked`` and ``pool`` tables with a config column."""
    parts = list(BASE)
    for i, c in enumerate(CONFIGS):
        parts += sql_ranked(c, f"c{i}")
    for t in ("ranked", "pool"):
        union = " UNION ALL ".join(
            f"SELECT '{c.name}' AS config, qid, ord, score, rank FROM c{i}_{t}" for i, c in enumerate(CONFIGS)
        )
        parts.append(f"{t} AS ({union})")
    return B.ctes(*parts)


def all_configs(spark, sf, configs=tuple(CONFIGS)):
    vectors, asked = dense_inputs(spark, sf)
    chunks = B.chunks(spark, sf)
    return retrieve_all(
        B.questions(spark, sf), chunks, configs, L.build_index(chunks), vectors, asked
    )


def shipped(spark, sf, index=None):
    vectors, asked = dense_inputs(spark, sf)
    chunks = B.chunks(spark, sf)
    return retrieve(
        B.questions(spark, sf), chunks, CONFIGS[3],
        index=index or L.build_index(chunks), vectors=vectors, query_vectors=asked,
    )


SHIPPED = BASE + sql_ranked(CONFIGS[3], "s")


@register(
    "rerank_top_n",
    B.ctes(*SHIPPED) + "SELECT qid, rank, ord, round(score, 6) AS score FROM s_ranked WHERE rank <= 5",
)
def rerank_top_n(spark, sf):
    return shipped(spark, sf).final.select("qid", "rank", "ord", F.round("score", 6).alias("score"))


@register(
    "retrieval_config_sweep",
    sql_all_configs() + "SELECT config, qid, rank, ord, round(score, 6) AS score FROM ranked WHERE rank <= 5",
)
def retrieval_config_sweep(spark, sf):
    final = all_configs(spark, sf).final
    return final.select("config", "qid", "rank", "ord", F.round("score", 6).alias("score"))

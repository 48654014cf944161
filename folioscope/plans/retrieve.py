"""Hybrid retrieval for whole tables of questions and any number of configurations at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.models import Scorer, overlap_scorer
from folioscope.operators.dense import dense_top_k
from folioscope.operators.fusion import (
    RERANK_POOL,
    RRF_K,
    TOP_K,
    TOP_N,
    content_key,
    reciprocal_rank_fusion,
)
from folioscope.operators.lexical import LexicalIndex, bm25_top_k
from folioscope.session import cut_lineage




@dataclass(frozen=True)
class RetrievalConfig:
    name: str
    use_bm25: bool = True
    use_dense: bool = True
    use_rerank: bool = True
    top_k: int = TOP_K
    rerank_top_c: int = RERANK_POOL
    rrf_weights: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        if not (self.use_bm25 or self.use_dense):
            raise ValueError("at least one of BM25 and dense retrieval must be on")
        lists = self.use_bm25 + self.use_dense
        if self.rrf_weights is not None and len(self.rrf_weights) != lists:
            raise ValueError(f"{len(self.rrf_weights)} weights for {lists} ranked lists")

    @property
    def pool_cap(self) -> int:
        """Largest pool this configuration can produce; a larger ``rerank_top_c`` changes nothing."""
        return min(self.rerank_top_c, self.top_k * (self.use_bm25 + self.use_dense))


# The named configurations an evaluation compares.
CONFIGS = [
    RetrievalConfig("bm25", use_dense=False, use_rerank=False),
    RetrievalConfig("dense", use_bm25=False, use_rerank=False),
    RetrievalConfig("hybrid", use_rerank=False),
    RetrievalConfig("hybrid+rerank"),
    RetrievalConfig("dense+rerank", use_bm25=False),
    RetrievalConfig("hybrid_bm25_lite", rrf_weights=(0.3, 1.0)),
    RetrievalConfig("rerank_pool10", top_k=5, rerank_top_c=10),
    RetrievalConfig("rerank_pool50", top_k=25, rerank_top_c=50),
]


@dataclass(frozen=True)
class Retrieved:
    """Every stage of every (config, question): long tables with a 1-based ``rank``."""

    final: DataFrame
    ranked: DataFrame
    candidates: DataFrame


def with_chunk(hits: DataFrame, chunks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Attach chunk columns to ranked rows. No side is hinted: Spark ships the hits if it finds them small."""
    return chunks.select("user", "ord", *cols).join(hits, ["user", "ord"])


def retrieve_all(
    queries: DataFrame,
    chunks: DataFrame,
    configs: Sequence[RetrievalConfig] = tuple(CONFIGS),
    index: LexicalIndex | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    scorer: Scorer | None = None,
    top_n: int = TOP_N,
) -> Retrieved:
    """Run all ``configs`` over ``queries(user, qid, text)`` and ``chunks(user, ord, text)`` in one plan.

    Each retriever runs once with the largest list any config asks for; a config is a column, and
    a shorter list is a rank filter. Each (question, chunk) pair is rescored once and shared.
    """
    depth = max(c.top_k for c in configs)
    lists = []
    if any(c.use_bm25 for c in configs):
        lists.append(bm25_top_k(index, queries, depth).withColumn("retriever", F.lit("bm25")))
    if any(c.use_dense for c in configs):
        lists.append(dense_top_k(vectors, query_vectors, depth).withColumn("retriever", F.lit("dense")))
    return retrieve_from(lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1]), queries, chunks, configs, scorer, top_n)


def retrieve_from(
    hits: DataFrame, queries: DataFrame, chunks: DataFrame, configs: Sequence[RetrievalConfig], scorer: Scorer | None = None, top_n: int = TOP_N
) -> Retrieved:
    """Fuse, pool and rescore the lists ``hits(user, qid, rank, ord, score, retriever)``, made to the largest depth of ``configs``."""
    # a bounded list per question, read by every config, the pools and the rescoring: kept as a table
    hits = cut_lineage(hits)
    keyed = with_chunk(hits, chunks.withColumn("key", content_key(F.col("text"))), ["key"])

    options = []
    for c in configs:
        weights = list(c.rrf_weights or ())
        for name in ("bm25", "dense"):
            if (c.use_bm25 if name == "bm25" else c.use_dense):
                no = 1 if (name == "dense" and c.use_bm25) else 0
                options.append((c.name, name, no, float(weights[no]) if weights else 1.0, c.top_k))
    spark = queries.sparkSession
    option_table = spark.createDataFrame(
        options, "config string, retriever string, list_no int, weight double, depth int"
    )
    # one row per (config, retriever): a fixed handful
    stacked = keyed.join(F.broadcast(option_table), "retriever").where(F.col("rank") <= F.col("depth"))
    by = ["config", "user", "qid"]
    fused = reciprocal_rank_fusion(stacked, by, "key", "ord", RRF_K)

    settings = spark.createDataFrame(
        [(c.name, c.use_rerank, c.rerank_top_c) for c in configs], "config string, use_rerank boolean, top_c int"
    )
    fused = cut_lineage(fused.join(F.broadcast(settings), "config"))
    candidates = fused.where(F.col("rank") <= F.col("top_c"))
    plain = fused.where(~F.col("use_rerank")).select(*by, "rank", "ord", "score")
    pairs = candidates.where("use_rerank").select(*by, "rank", "ord")
    distinct_pairs = pairs.select("user", "qid", "ord").distinct()
    scored = cut_lineage(rerank_scores(distinct_pairs, queries, chunks, scorer))
    rescored = pairs.join(scored, ["user", "qid", "ord"])
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("rank").asc())
    reranked = rescored.withColumn("rank", F.row_number().over(w)).select(*by, "rank", "ord", "score")
    ranked = plain.unionByName(reranked)
    return Retrieved(
        final=ranked.where(F.col("rank") <= top_n),
        ranked=ranked,
        candidates=candidates.select(*by, "rank", "ord", "score"),
    )


def rerank_scores(
    pairs: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Scorer | None = None
) -> DataFrame:
    """``(user, qid, ord)`` pairs → ``score``; each distinct pair is scored exactly once."""
    # chunk texts meet bare keys; the question's text, which repeats for each of its pairs, is joined last
    found = with_chunk(pairs.select("user", "qid", "ord"), chunks, ["text"])
    both = found.join(queries.select("user", "qid", F.col("text").alias("qtext")), ["user", "qid"])
    return both.select("user", "qid", "ord", (scorer or overlap_scorer())(F.col("qtext"), F.col("text")).alias("score"))


def retrieve(
    queries: DataFrame, chunks: DataFrame, config: RetrievalConfig = CONFIGS[3], **kw
) -> Retrieved:
    """One configuration; see :func:`retrieve_all`."""
    return retrieve_all(queries, chunks, [config], **kw)

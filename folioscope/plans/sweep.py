"""Chunkers × embedders × configurations over one collection: every cell is a row of one result."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.models import Embedder, Scorer
from folioscope.operators import chunking as K
from folioscope.operators import lexical as L
from folioscope.operators import metrics as M
from folioscope.operators.dense import dense_top_k, embed, embed_all
from folioscope.plans.retrieve import CONFIGS, RetrievalConfig, retrieve_from, with_chunk
from folioscope.session import cut_lineage, scratch_path

# The settings that a sweep compares, by default.
SWEPT = (CONFIGS[1], CONFIGS[3])
_SEP = "\x1f"


def _tagged(user: Column, *names: str) -> Column:
    """A user of one cell's tables: index, vectors and searches keep users apart, so cells stay apart in shared tables."""
    return F.concat(*[F.lit(n + _SEP) for n in names], user)


def _stored_kb(spark, path: str) -> float:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return round(folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength() / 1024, 1)


def _all_of(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _encoded(chunks: DataFrame, embedders: Mapping[str, Embedder]) -> list[tuple[DataFrame, float]]:
    """Per embedder its stored vectors, ``user`` tagged with its name, and the seconds that took."""
    out = []
    if all(getattr(e, "encoder", None) for e in embedders.values()):
        begun = time.monotonic()
        packed, spent = embed_all(chunks, list(embedders.values()))
        packed = cut_lineage(packed)
        took, total = time.monotonic() - begun, sum(s.value for s in spent)
        for n, (name, seconds) in enumerate(zip(embedders, spent)):
            mine = packed.select(_tagged(F.col("user"), name).alias("user"), "ord", F.col(f"e{n}").alias("embedding"))
            out.append((mine, took * seconds.value / total if total else took / len(embedders)))
        return out
    for name, embedder in embedders.items():
        begun = time.monotonic()
        mine = chunks.withColumn("user", _tagged(F.col("user"), name))
        out.append((cut_lineage(embed(mine, embedder).select("user", "ord", "embedding")), time.monotonic() - begun))
    return out


def sweep(
    documents: DataFrame, questions: DataFrame, embedders: Mapping[str, Embedder], chunkers: Sequence[str] | None = None,
    configs: Sequence[RetrievalConfig] = SWEPT, scorer: Scorer | None = None,
) -> DataFrame:
    """Metrics of every ``chunker, embed, config`` with ``n_chunks``, ``n_postings``, ``index_kb`` and ``build_s``.

    ``documents(user, source, doc_pos, text)`` are cut and indexed once per chunker (all registered ones by default) and encoded once
    per chunker and embedder; ``questions(user, qid, text, gold_text)`` have a ``qid`` of their own across users. Chunker
    and embedder are part of the user key of one index and one vector table, so a single search, fusion and
    rescoring serves all cells. ``build_s`` is the time to cut, index and encode; ``index_kb`` the stored lexical index.
    Embedders with an ``encoder`` share one pass over a chunker's texts, whose time is dealt to them by the seconds its tasks spent on
    each. Rows without a user take no part, and names hold no control character.
    """
    spark = documents.sparkSession
    cut, indexes, vectors, asked, built = [], [], [], [], []
    for chunker in K.CHUNKERS if chunkers is None else chunkers:
        begun = time.monotonic()
        chunks = cut_lineage(K.chunk_documents(documents, chunker).withColumn("user", _tagged(F.col("user"), chunker)).select("user", "ord", "text"))
        path = scratch_path(spark, "swept")
        index = L.store_index(chunks, path)
        counted = time.monotonic() - begun
        n_postings, n_chunks = L.sizes(index)
        cut.append(chunks)
        indexes.append(index)
        for (name, embedder), (mine, encoded) in zip(embedders.items(), _encoded(chunks, embedders)):
            vectors.append(mine)
            built.append((chunker, name, n_chunks, n_postings, _stored_kb(spark, path), round(counted + encoded, 2)))
            asked.append(embed(questions.withColumn("user", _tagged(F.col("user"), name, chunker)), embedder).select("user", "qid", "embedding"))

    depth = max(c.top_k for c in configs)
    by_chunker = questions.withColumn("chunker", F.explode(F.array(*[F.lit(c) for c in dict.fromkeys(b[0] for b in built)])))
    by_chunker = by_chunker.withColumn("user", F.concat("chunker", F.lit(_SEP), "user")).select("user", "qid", "text", "gold_text")

    def per_embedder(rows: DataFrame) -> DataFrame:
        names = F.explode(F.array(*[F.lit(n) for n in embedders]))
        return rows.withColumn("_embed", names).withColumn("user", F.concat("_embed", F.lit(_SEP), "user")).drop("_embed")

    lists = []
    if any(c.use_bm25 for c in configs):
        tables = {f.name: [getattr(i, f.name) for i in indexes] for f in fields(L.LexicalIndex)}
        index = L.LexicalIndex(**{name: None if None in parts else _all_of(parts) for name, parts in tables.items()})
        # the lexical lists do not depend on the embedder: searched once, at most ``depth`` rows a question are copied
        lists.append(per_embedder(L.bm25_top_k(index, by_chunker, depth)).withColumn("retriever", F.lit("bm25")))
    if any(c.use_dense for c in configs):
        lists.append(dense_top_k(_all_of(vectors), cut_lineage(_all_of(asked)), depth).withColumn("retriever", F.lit("dense")))
    everyone = per_embedder(by_chunker)
    hits = cut_lineage(_all_of(lists))
    # texts of what was found, once for all embedders and for the fusion, the rescoring and the metrics
    found = hits.select("user", "ord").distinct().withColumn("_cell", F.col("user")).withColumn("user", F.split("user", _SEP, 2)[1])
    cells = cut_lineage(with_chunk(found, _all_of(cut), ["text"]).select(F.col("_cell").alias("user"), "ord", "text"))
    got = retrieve_from(hits, everyone.select("user", "qid", "text"), cells, configs, scorer)

    keys = ["user", "qid", "ord"]
    pairs = got.ranked.select(*keys).union(got.candidates.select(*keys)).distinct()
    overlap = cut_lineage(M.with_containment(with_chunk(pairs, cells, ["text"]), questions.select("qid", "gold_text")))
    exam = everyone.select("user", "qid").withColumn("config", F.explode(F.array(*[F.lit(c.name) for c in configs])))
    rows = M.exam_rows(exam, got.ranked.join(overlap, keys), got.candidates.join(overlap, keys), ["config", "user", "qid"])
    named = rows.withColumns({"embed": F.split("user", _SEP, 3)[0], "chunker": F.split("user", _SEP, 3)[1]})
    sizes = spark.createDataFrame(built, "chunker string, embed string, n_chunks long, n_postings long, index_kb double, build_s double")
    # one row per chunker and embedder
    return M.summarize_exam(named, ["chunker", "embed", "config"]).join(F.broadcast(sizes), ["chunker", "embed"])

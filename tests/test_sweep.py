"""The grid of chunkers, embedders and settings: each cell equals a run of its own."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import chunking as K
from folioscope.operators import lexical as L
from folioscope.operators import metrics as M
from folioscope.operators.dense import embed
from folioscope.plans import q_evaluation as Q
from folioscope.plans.retrieve import CONFIGS, retrieve_all, with_chunk
from folioscope.plans.sweep import sweep

METRICS = ["n", "pool_size", "recall_1", "recall_5", "recall_5_soft", "recall_pool", "mrr", "ndcg_5"]


def test_cells_equal_runs_of_their_own(spark):
    line = "the slope of \\frac{a}{b} at point p%d is found by rule %d of chapter c%d. "
    texts = [(u, f"{u}{n}.mmd", n, "".join(line % (n, k % 5, n * k % 7) for k in range(40)) + f"\n\n$$x_{n}$$\n\n" + "closing words. " * n) for u in ("u", "v") for n in range(6)]
    documents = spark.createDataFrame(texts, "user string, source string, doc_pos long, text string")
    asked = spark.createDataFrame(
        [("u", 1, "slope at point p3", "is found by rule 3 of chapter c2"), ("u", 2, "chapter c5 rule", "closing words"), ("v", 3, "closing words", "closing words. closing")],
        "user string, qid long, text string, gold_text string",
    )
    embedders = dict(list(Q.swept_embedders().items())[::2])
    configs = [CONFIGS[1], CONFIGS[3]]
    got = {(r.chunker, r.embed, r.config): r for r in sweep(documents, asked, embedders, ["baseline", "eqaware"]).collect()}
    assert len(got) == 8
    for chunker in ("baseline", "eqaware"):
        chunks = K.chunk_documents(documents, chunker).persist()
        index = L.build_index(chunks)
        for name, embedder in embedders.items():
            lone = retrieve_all(asked, chunks, configs, index, embed(chunks, embedder).select("user", "ord", "embedding"), embed(asked, embedder).select("user", "qid", "embedding"))
            gold = asked.select("qid", "gold_text")
            hit = lambda df: M.with_containment(with_chunk(df, chunks, ["text"]), gold)
            everyone = asked.select("user", "qid").withColumn("config", F.explode(F.array(*[F.lit(c.name) for c in configs])))
            rows = M.exam_rows(everyone, hit(lone.ranked), hit(lone.candidates), ["config", "user", "qid"])
            for want in M.summarize_exam(rows).collect():
                cell = got[chunker, name, want.config]
                assert [cell[m] for m in METRICS] == pytest.approx([want[m] for m in METRICS])
                assert cell.n_chunks == chunks.count() and cell.n_postings == index.postings.count()
                assert cell.build_s > 0 and cell.index_kb > 0

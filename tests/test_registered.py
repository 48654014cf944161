"""Registered queries: same keys as their SQL, and a spread of them compared with DuckDB."""

import pytest
from oracle_check import compare, connect

from folioscope.operators import lexical as L
from folioscope.plans import catalog

QUICK = [
    "chunk_ids", "chunk_upsert", "tokenizers", "sentences", "page_markers", "bm25_terms", "bm25_top_k", "dense_centroid_top_k",
    "rank_fusion_weighted", "context_block", "fact_recall", "recall_pairs", "live_rating_state", "resumed_scores", "query_rewrite", "clean_history", "tool_call_audit", "leak_scores",
    "gold_sample", "pairwise_auc", "item_vote_stats", "paired_comparison", "kpis", "trace_spans", "operating_rollup", "live_last_rating", "live_latency_rollup", "exam_read_back", "figures_replaced", "report_read_back", "review_read_back",
]


def test_every_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert not [n for n in catalog.QUERIES if n.startswith("op") and n[2:3].isdigit()]


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, sf, name):
    verdict, _, diff = compare(spark, connect(sf), sf, catalog.QUERIES[name], catalog.SQL[name])
    assert verdict == "match", diff


@pytest.mark.parametrize("name", ["merged_sources", "id_ranks"])
def test_two_searches_read_one_index(spark, monkeypatch, name):
    built = []
    monkeypatch.setattr(L, "build_index", lambda *a, _f=L.build_index, **kw: built.append(1) or _f(*a, **kw))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(built) == 1

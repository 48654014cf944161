"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from folioscope.operators import lexical
from folioscope.plans import bindings, catalog
from folioscope.session import local_session

HEADLINES = [
    "bm25_top_k", "embedded_top_k", "rank_fusion", "rerank_top_n", "retrieval_metrics", "chunks_baseline",
    "chunks_eqaware", "chunk_ids", "corpus_word_df", "leak_scores", "answerable_gate", "query_rewrite",
    "pairwise_auc", "item_vote_stats", "vote_accuracy", "kpis", "tool_panel", "trace_spans", "metric_series",
    "live_kpi_windows",
]


def stored_search(spark, sf: str) -> dict[str, float]:
    """Building an index and searching it, timed apart; the index is a stored table when the search begins."""
    start = time.perf_counter()
    index = lexical.blocked(lexical.build_index(bindings.chunks(spark, sf)))
    built = time.perf_counter()
    questions = bindings.questions(spark, sf)
    found = lexical.bm25_top_k_blocks(index, questions, 10).top.count()
    done = time.perf_counter()
    return {"bm25_build_sec": round(built - start, 3), "bm25_search_sec": round(done - built, 3), "bm25_questions_per_sec": round(found / 10 / (done - built), 1)}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["index_summary"](spark, sf).collect()  # start-up is not part of any query
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    search = stored_search(spark, sf) if "BENCH_QUERIES" not in os.environ else {}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rsplit("sf", 1)[-1],
        **({"stored_index": search} if search else {}),
    }))


if __name__ == "__main__":
    main()

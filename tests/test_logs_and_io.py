"""Usage log, readers, sinks and streams."""

import json
import random
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators.chunking import chunk_documents
from folioscope.functions.models import hashed_tf_embedder
from folioscope.operators import telemetry as TL
from folioscope.sources import readers as R
from folioscope.sources import sinks as S
from folioscope.streaming import live


def passes(spark, rows):
    schema = ("event_id string, seq int, at_s double, wall_s double, prompt_eval_count long, eval_count long, prompt_eval_duration long, "
              "eval_duration long, load_duration long, done_reason string, n_calls int")
    rec = TL.pass_record(spark.createDataFrame(rows, schema))
    grouped = rec.groupBy("event_id").agg(F.collect_list("pass").alias("passes"))
    return grouped.select(TL.token_totals(F.col("passes").cast(TL.PASSES_TYPE)).alias("t")).first().t


def test_token_totals(spark):
    t = passes(spark, [("e", 0, 0.5, 2.5, 900, 100, None, 2_000_000_000, None, "stop", 1), ("e", 1, 3.0, 3.1, 40, 100, None, 3_000_000_000, None, "stop", 0)])
    assert (t.prompt, t.output, t.mtpt_ms, t.tok_s, t.prefill_ms) == (940, 200, 25.0, 40.0, None)
    empty = passes(spark, [("e", 0, 0.0, 1.0, None, None, None, None, None, None, 0)])
    assert empty.output is None and empty.mtpt_ms is None


def event(**kw):
    base = {"kind": "query", "event_id": "e", "ts": "2024-01-01T00:00:00+00:00", "mode": "general", "model": "m"}
    return {**base, **kw}


def typed(spark, records):
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "pos long, value string")
    return R.parse_jsonl(lines, TL.EVENT_SCHEMA)


def test_missing_fields_are_null_not_zero(spark):
    q = typed(spark, [
        event(event_id="a", timings={"ttft_ms": 100.0}, tokens={"prompt": 10}, truncated=True), event(event_id="b"),
        event(event_id="c", timings={"ttft_ms": 300.0}, error="x", tool_log=[{"n": 1, "tool": "run_python", "ok": False, "ms": 4.0}]),
    ])
    fb = spark.createDataFrame([("a", "up", 1), ("a", "down", 2), ("c", "up", 3)], "event_id string, rating string, pos long")
    k = TL.kpis(TL.with_ratings(q, fb)).first()
    assert (k.queries, k.error_pct, k.tool_pct, k.truncated_pct, k.up, k.down) == (3, 33, 33, 33, 1, 1)
    assert (k.ttft_p50, k.ttft_p95, k.mean_prompt, k.mtpt_p50) == (200.0, 290.0, 10.0, None)


def test_totals_summaries_and_spans(spark):
    q = typed(spark, [
        event(event_id="a", timings={"bm25_ms": 1.0, "dense_ms": 2.0, "rrf_ms": 0.0, "generate_ms": 10.0}, tool_calls=2, tool_errors=1),
        event(event_id="b", passes=[{"at_ms": 5.0, "ms": 7.0}], tool_counts={"search_documents": 2, "run_python": 1}, timings={"bm25_ms": 3.0},
              tool_log=[{"n": 1, "tool": "run_python", "ok": False, "ms": 90.0, "at_ms": 1.0}, {"n": 2, "tool": "list_documents", "ok": True, "ms": 1.0}]),
        event(event_id="c"),
    ])
    rows = {r.event_id: r for r in q.select("event_id", TL.total_ms().alias("t"), TL.tool_summary().alias("s")).collect()}
    assert (rows["a"].t, rows["b"].t, rows["c"].t) == (13.0, 12.0, None)
    assert (rows["a"].s, rows["b"].s, rows["c"].s) == ("python×2 (1✗)", "python×1 search×2", "")
    spans = TL.span_shares(TL.trace_spans(q)).orderBy("event_id", "span_no").collect()
    assert [(s.event_id, s.label, s.start) for s in spans] == [
        ("a", "bm25", 0.0), ("a", "dense", 1.0), ("b", "bm25", 0.0), ("b", "gen #1", 5.0), ("b", "run_python ✗", 1.0)
    ]
    assert spans[-1].end_ms == 91.0 and spans[1].left == 1 / 13


def test_model_names(spark):
    df = spark.createDataFrame([("hf.co/bartowski/Qwen2.5-Math-7B-Instruct-GGUF:Q4_K_M",)], "m string")
    r = df.select(TL.short_model(F.col("m")).alias("a"), TL.model_slug(F.col("m")).alias("b")).first()
    assert r.a == "Qwen2.5-Math-7B-Instruct:Q4_K_M" and r.b == "Qwen2.5-Math-7B-Instruct-GGUF_Q4_K_M"


def test_log_tail_counts_raw_lines(spark):
    lines = spark.createDataFrame([(0, '{"n": 1}'), (1, "not json"), (2, '{"n": 2}'), (3, '{"n": 3}')], "pos long, value string")
    assert [r.n for r in R.tail_events(lines, 3, "n int").collect()] == [2, 3]
    assert [r.n for r in R.tail_events(lines, 10, "n int").collect()] == [1, 2, 3]
    for n in (0, R.MAX_TAIL + 1):
        with pytest.raises(ValueError):
            R.tail_events(lines, n, "n int")


def test_tolerant_and_strict_readers(spark, tmp_path):
    assert R.read_jsonl(spark, str(tmp_path / "absent.jsonl"), R.FACT_SCHEMA).collect() == []
    p = tmp_path / "facts.jsonl"
    p.write_text('{"id": "1", "fact": "x"}\n\n  \nbroken {\n[1]\n{"id": "2", "fact": ""}\n{"id": "3"}\n')
    assert [r.id for r in R.read_jsonl(spark, str(p), R.FACT_SCHEMA, ["fact"]).collect()] == ["1"]
    g = tmp_path / "gold.jsonl"
    g.write_text('{"q": "a"}\n\n{"q": "b"}\n')
    assert R.read_exam(spark, str(g), "q string").count() == 2 and R.read_exam(spark, str(g), "q string", 1).count() == 1
    with pytest.raises(Exception):
        R.read_exam(spark, str(tmp_path / "none.jsonl"), "q string").count()


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a b.mmd").write_text("one\ntwo")
    (tmp_path / "skip.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.mmd").write_text("no")
    got = R.load_corpus(spark, str(tmp_path)).collect()
    assert [(r.source, r.text, r.user) for r in got] == [("a b.mmd", "one\ntwo", "shared")]


def test_append_and_feedback(spark, tmp_path):
    path = str(tmp_path / "log")
    q = spark.createDataFrame([("e1", "hi")], "event_id string, question string")
    S.append_events(q, path)
    S.append_feedback(spark.createDataFrame([("e1", "up", None)], "event_id string, rating string, note string"), path)
    rows = {r.kind: r for r in R.read_jsonl(spark, path, TL.EVENT_SCHEMA).collect()}
    assert rows["query"].question == "hi" and rows["feedback"].rating == "up" and rows["feedback"].note == ""
    assert rows["query"].ts.endswith("+00:00")


def test_user_index_upsert_leaves_other_users(spark, tmp_path):
    path, schema = str(tmp_path / "ix"), "user string, ord long, chunk_id string, source string, text string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    S.write_user_index(spark, make([("a", 0, "s::0", "s", "x y"), ("b", 0, "t::0", "t", "z")]), path, hashed_tf_embedder(8))
    S.write_user_index(spark, make([("a", 0, "s::0", "s", "new"), ("a", 1, "s::1", "s", "more")]), path, hashed_tf_embedder(8))
    index = S.read_user_index(spark, path)
    got = {(r.user, r.chunk_id): r.text for r in index.chunks.collect()}
    assert got == {("a", "s::0"): "new", ("a", "s::1"): "more", ("b", "t::0"): "z"}
    assert index.vectors.count() == 3
    assert {r.term for r in index.lexical.postings.collect()} == {"new", "more", "z"}


def test_uploads_and_merges_equal_one_rebuild(spark, tmp_path):
    """Uploads that partly replace each other, merges of some and of all segments, and removal: always the index of the live chunks."""
    draw, schema = random.Random(6), "user string, ord long, chunk_id string, source string, text string"
    path, live_rows, places = str(tmp_path / "ix"), {}, {}
    for step in range(4):
        batch = []
        for i in range(12):
            user = draw.choice(["ann", "007", "ann"])
            words = [f"w{draw.randint(0, 9)}" for _ in range(draw.randint(0, 8))]
            batch.append((user, i, f"s::{draw.randint(0, 9)}", "s", " ".join(words)))
        S.write_user_index(spark, spark.createDataFrame(batch, schema).repartition(2), path, hashed_tf_embedder(8))
        for user, _, cid, _, text in batch:
            places.setdefault((user, cid), len([1 for u, _ in places if u == user]))
            live_rows[user, cid] = text
        if step == 2:
            S.merge_segments(spark, path, newest=2)
            assert S.remove_superseded(spark, path) == [1, 2] and S.remove_superseded(spark, path) == []
        if step == 3:
            check_index(spark, path, live_rows, places)
            S.merge_segments(spark, path)
            assert len(S.remove_superseded(spark, path)) == 3 and not (tmp_path / "ix/blocks/version=0").exists()
            check_index(spark, path, live_rows, places)


def check_index(spark, path, live_rows, places):
    from folioscope.operators import lexical as L

    index = S.read_user_index(spark, path)
    got = {(r.user, r.chunk_id): (r.ord, r.text) for r in index.chunks.collect()}
    assert got == {k: (places[k], t) for k, t in live_rows.items()}
    assert {(r.user, r.ord) for r in index.vectors.collect()} == {(u, places[u, c]) for u, c in live_rows}
    whole = L.build_index(index.chunks)
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for name, columns in (("postings", ["user", "ord", "term", "tf", "impact"]), ("docs", ["user", "ord", "dl"]), ("terms", ["user", "term", "df", "idf"]), ("stats", ["user", "n_docs", "avgdl", "mean_idf"])):
        assert rounded(getattr(index.lexical, name).select(*columns)) == rounded(getattr(whole, name).select(*columns)), name
    queries = spark.createDataFrame([("ann", 1, "w1 w2 w2"), ("007", 1, "w3"), ("ann", 2, "none")], "user string, qid long, text string")
    columns = ["user", "qid", "rank", "ord", "score"]
    assert rounded(L.bm25_top_k_blocks(index.blocks, queries, 3).top.select(*columns)) == rounded(L.bm25_top_k(whole, queries, 3).select(*columns))


def test_unfinished_and_repeated_uploads_change_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "ix"), "user string, ord long, chunk_id string, source string, text string"
    make = lambda text: spark.createDataFrame([("007", 0, "s::0", "s", text)], schema)
    S.write_user_index(spark, make("first"), path, hashed_tf_embedder(8), version=3)
    # tables of a version that was never named, as a crash leaves them
    make("half").write.partitionBy("user").parquet(f"{path}/chunks/version=4")
    seen = lambda: [(r.user, r.text) for r in S.read_user_index(spark, path).chunks.collect()]
    assert seen() == [("007", "first")]
    S.write_user_index(spark, make("again"), path, hashed_tf_embedder(8), version=3)
    assert seen() == [("007", "first")]
    S.write_user_index(spark, make("second"), path, hashed_tf_embedder(8), version=4)
    assert seen() == [("007", "second")] and S.read_user_index(spark, path).lexical.stats.count() == 1


def test_upsert_stream_survives_a_restart(spark, tmp_path):
    src, path, state = tmp_path / "in", str(tmp_path / "ix"), str(tmp_path / "state")
    schema = "user string, ord long, chunk_id string, source string, text string"
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))

    def run():
        stream = spark.readStream.schema(schema).json(str(src))
        merge = lambda batch, n: S.write_user_index(batch.sparkSession, batch, path, hashed_tf_embedder(8), n)
        live.upsert_chunks(stream, state, merge).trigger(availableNow=True).start().awaitTermination()

    make([("a", 0, "s::0", "s", "one"), ("b", 0, "s::0", "s", "two")])
    run()
    run()
    make([("a", 0, "s::0", "s", "three"), ("a", 1, "s::1", "s", "four")])
    run()
    got = {(r.user, r.chunk_id): r.text for r in S.read_user_index(spark, path).chunks.collect()}
    assert got == {("a", "s::0"): "three", ("a", "s::1"): "four", ("b", "s::0"): "two"}


def test_ratings_settle_between_batches(spark, tmp_path):
    src, out = tmp_path / "log", str(tmp_path / "rated")
    src.mkdir()
    row = lambda e, r, ts: json.dumps({"kind": "feedback", "event_id": e, "rating": r, "ts": ts}) + "\n"
    (src / "1.jsonl").write_text(row("a", "up", "2024-01-01T03") + row("b", "up", "2024-01-01T01"))
    (src / "2.jsonl").write_text(row("a", "down", "2024-01-01T02") + row("b", "down", "2024-01-01T02"))
    live.keep_updates(live.read_log(spark, str(src), 1), out, str(tmp_path / "c"), live.live_ratings).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.rating for r in live.latest(spark, out, ["event_id"], ["ts", "epoch"]).collect()}
    assert got == {"a": "up", "b": "down"}


def test_kpi_windows_in_update_mode(spark, tmp_path):
    src, out = tmp_path / "log", str(tmp_path / "kpis")
    src.mkdir()
    stamps = ["2024-01-01T01:00:00", "2024-01-01T01:30:00", "2024-01-02T05:00:00", "2024-01-01T01:45:00"]
    for n, ts in enumerate(stamps):  # the last comes long after its window was closed
        (src / f"{n}.jsonl").write_text(json.dumps(event(event_id=str(n), kind="query", ts=ts)) + "\n")
        kpis = live.live_kpis(live.read_log(spark, str(src), 1), "1 hour", "10 minutes")
        live.keep_updates(kpis, out, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {str(r.window.start): r.queries for r in live.latest(spark, out, ["window"]).collect()}
    assert got == {"2024-01-01 01:00:00": 2, "2024-01-02 05:00:00": 1}


def test_ten_uploads_keep_a_dense_order(spark, tmp_path):
    """Documents with one position hash stay apart, and repeated uploads neither overflow nor mix."""
    path = str(tmp_path / "ix")
    schema = "user string, source string, doc_pos long, text string"
    top = (1 << 62) + 5
    for k in range(10):
        docs = spark.createDataFrame([("a", f"/x/d{k}.mmd", top, f"one{k}"), ("a", f"/y/e{k}.mmd", top, f"two{k}"), ("a", "/x/same.mmd", 7, f"new{k}")], schema)
        chunks = chunk_documents(docs, "baseline")
        assert sorted(r.ord for r in chunks.collect()) == [0, 1, 2]
        S.write_user_index(spark, chunks.select("user", "ord", "chunk_id", "source", "text"), path, hashed_tf_embedder(8))
    got = S.read_user_index(spark, path).chunks.collect()
    assert sorted(r.ord for r in got) == sorted({r.ord for r in got}) and len(got) == 21 and max(r.ord for r in got) < 40
    assert {r.text for r in got if r.source == "same.mmd"} == {"new9"}
    assert {r.text for r in got} >= {f"one{k}" for k in range(10)} | {f"two{k}" for k in range(10)}


def test_figure_replacement_is_per_document(spark, tmp_path):
    path, schema = str(tmp_path / "figs"), "image_id string, doc_name string, caption string"
    S.replace_figures(spark.createDataFrame([("a::img0", "a", "x"), ("a::img1", "a", "y"), ("b::img0", "b", "z")], schema), path)
    S.replace_figures(spark.createDataFrame([("a::img0", "a", "only")], schema), path)
    assert {r.image_id: r.caption for r in spark.read.parquet(path).collect()} == {"a::img0": "only", "b::img0": "z"}


def test_figure_folders_do_not_grow_with_the_documents(spark, tmp_path):
    path = str(tmp_path / "figs")
    docs = spark.range(1500).select(F.concat(F.lit("p"), "id").alias("doc_name"), F.concat(F.lit("p"), "id", F.lit("::img0")).alias("image_id"), F.lit("old").alias("caption"))
    S.replace_figures(docs, path)
    S.replace_figures(docs.where("doc_name in ('p3', 'p700')").withColumn("caption", F.lit("new")), path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 1500 and {r.doc_name for r in rows if r.caption == "new"} == {"p3", "p700"}
    assert len(os.listdir(path)) < 300


def test_figures_of_a_nameless_document_are_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "figs"), "image_id string, doc_name string, caption string"
    for caption in ("x", "y"):
        S.replace_figures(spark.createDataFrame([("i", None, caption), ("j", "", caption), ("k", "7", caption)], schema), path)
    assert sorted((r.image_id, r.doc_name, r.caption) for r in spark.read.parquet(path).collect()) == [("i", None, "y"), ("j", "", "y"), ("k", "7", "y")]


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("bm25", 0.5), ("dense", 0.7)], "config string, mrr double")
    S.write_report(m, str(tmp_path / "m"))
    assert sorted(d for d in os.listdir(tmp_path / "m") if d.startswith("config=")) == ["config=bm25", "config=dense"]
    g = spark.createDataFrame([("a", 0.1, "q", "t\nu"), ("b", 0.9, "q", "t")], "gold_chunk_id string, leak_score double, q string, chunk_text string")
    S.write_review(g.repartition(1), str(tmp_path / "r"))
    assert {r.snippet for r in spark.read.json(str(tmp_path / "r")).collect()} == {"t u", "t"}


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "log", str(tmp_path / "typed")
    src.mkdir()
    (src / "1.jsonl").write_text(json.dumps(event(event_id="a", truncated=True)) + "\nnot json\n")
    (src / "2.jsonl").write_text(json.dumps(event(event_id="b")) + "\n" + json.dumps({"kind": "feedback", "event_id": "a", "rating": "up", "ts": "2024-01-01T01"}) + "\n")
    go = lambda w: w.trigger(availableNow=True).start().awaitTermination()
    go(live.ingest(live.read_log(spark, str(src), 1), out, str(tmp_path / "c1")))
    batch = R.read_jsonl(spark, str(src), TL.EVENT_SCHEMA)
    key = lambda df: sorted((r.kind, r.event_id, r.truncated) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(batch)
    # a second run finds nothing new
    go(live.ingest(live.read_log(spark, str(src), 1), out, str(tmp_path / "c1")))
    assert spark.read.parquet(out).count() == 3



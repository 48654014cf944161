"""Lexical, dense and fused retrieval against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions.markup import normalize_markup
from folioscope.functions.models import (
    embedder_from_model,
    hashed_tf_embedder,
    normalizing,
    overlap_scorer,
    scorer_from_model,
)
from folioscope.operators import dense as D
from folioscope.operators import fusion as FU
from folioscope.operators import lexical as L
from folioscope.plans.retrieve import CONFIGS, RetrievalConfig, retrieve, retrieve_all
from folioscope.session import cut_lineage


def okapi(texts, query):
    docs = [t.split() for t in texts]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (0.25 * mean if v < 0 else v) for t, v in idf.items()}
    out = []
    for d in docs:
        s = 0.0
        for t in query.split():
            tf = d.count(t)
            s += idf.get(t, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        out.append(round(s, 9) + 0.0)
    return out


def corpus(seed, n=40, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(vocabulary)], k=rng.randrange(1, 25))) for _ in range(n)]


def chunk_table(spark, by_user):
    rows = [(u, i, t) for u, texts in by_user.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "user string, ord long, text string")


QUERIES = ["w0 w3 w3 w29", "w7 unknown", "nothing here", "w0"]


def test_block_search_never_joins_by_user_alone(spark, capsys):
    chunks = chunk_table(spark, {"a": corpus(3), "b": corpus(4)})
    queries = spark.createDataFrame([("a", 1, "w0 w3"), ("b", 2, "w5")], "user string, qid long, text string")
    by_block = L.blocked(L.build_index(chunks), 8)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pruned = L.bm25_top_k_blocks(by_block, queries, 3)
        weighted = cut_lineage(L.weighted_query_terms(by_block.lexical, queries).join(by_block.lexical.stats.select("user", "avgdl"), "user"))
        capsys.readouterr()
        L._range_bounds(by_block, weighted, L.K1, L.B).explain()
        L._range_scores(by_block, weighted, pruned.read, L.K1, L.B).explain()
        assert not re.search(r"Join \[user#\d+\], \[user#\d+\]", capsys.readouterr().out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert pruned.top.count() == 6


def test_block_search_deals_work_by_chunks(spark, monkeypatch):
    by_block = L.blocked(L.build_index(chunk_table(spark, {"a": corpus(3, 60)})), 8)
    monkeypatch.setattr(L, "TASK_CHUNKS", 2)
    assert L._tasks(by_block.lexical.stats) == 30


def test_best_of_many_questions_holds_few_products(monkeypatch):
    rng = np.random.default_rng(5)
    stored, asked = np.round(rng.standard_normal((300, 4)), 1), np.round(rng.standard_normal((50, 4)), 1)
    monkeypatch.setattr(D, "_ROWS", 64)
    monkeypatch.setattr(D, "_PRODUCTS", 640)
    best = D._Best(np.arange(50) * 3, asked, 7)
    held = []
    monkeypatch.setattr(D.np, "partition", lambda a, *x, _f=np.partition, **kw: held.append(a.size) or _f(a, *x, **kw))
    best.offer(np.arange(300)[::-1].copy(), stored[::-1])
    want = np.round(asked @ stored.T, 9)
    for q in range(50):
        mine = [(int(o), float(s)) for w, o, s in zip(best.who, best.ords, best.scores) if w == q]
        assert mine == [(int(o), float(want[q, o])) for o in np.lexsort((np.arange(300), -want[q]))[:7]]
    assert max(held) <= 640


def test_cells_are_found_in_bounded_batches(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("u", i, [float(x) for x in np.round(rng.standard_normal(4), 1)]) for i in range(40)]
    sdf = spark.createDataFrame(rows, "user string, ord long, embedding array<float>")
    centroids = np.array([r[2] for r in rows[:10]])
    whole = [sorted((r.ord, tuple(r.cells)) for r in D._nearest_cells(sdf, centroids, n).collect()) for n in (1, 3)]
    monkeypatch.setattr(D, "_PRODUCTS", 70)
    assert whole == [sorted((r.ord, tuple(r.cells)) for r in D._nearest_cells(sdf, centroids, n).collect()) for n in (1, 3)]
    assert all(one[1][0] == three[1][0] for one, three in zip(*whole))


def test_embedding_hands_over_few_texts(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        D.embed(spark.createDataFrame([("a",)], "text string"), hashed_tf_embedder())
        assert 0 < int(spark.conf.get(name)) <= D.TEXT_BATCH
    finally:
        spark.conf.set(name, before)


def check_bm25(spark, by_user, k=6):
    asked = [(u, i, q) for u in by_user for i, q in enumerate(QUERIES)]
    queries = spark.createDataFrame(asked, "user string, qid long, text string")
    got = {}
    for r in L.bm25_top_k(L.build_index(chunk_table(spark, by_user)), queries, k).collect():
        got.setdefault((r.user, r.qid), []).append((r.rank, r.ord, r.score))
    for u, i, q in asked:
        scores = okapi(by_user[u], q)
        want = sorted(range(len(scores)), key=lambda j: (-scores[j], j))[:k]
        rows = sorted(got[u, i])
        assert [o for _, o, _ in rows] == want, (u, q)
        assert all(math.isclose(s, scores[o], abs_tol=1e-7) for _, o, s in rows)


def test_bm25_per_user(spark):
    check_bm25(spark, {"ann": corpus(1), "bob": corpus(2, n=25) + ["", "w0 w0"]})


def test_bm25_with_negative_mean_idf(spark):
    """Every word is in most chunks, so common words score below zero and unmatched chunks win."""
    check_bm25(spark, {"tiny": ["w0 w3 w7"] * 5 + ["w0 w3", "zz"], "ann": corpus(4)}, k=5)


def test_bm25_salted_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "fits_broadcast", lambda *_: False)
    check_bm25(spark, {"ann": corpus(5)})


def test_index_round_trip_replaces_one_user(spark, tmp_path):
    path = str(tmp_path / "ix")
    L.build_index(chunk_table(spark, {"ann": corpus(1), "bob": corpus(2)})).write(path)
    L.build_index(chunk_table(spark, {"ann": ["only one here"]})).write(path)
    back = L.LexicalIndex.read(spark, path)
    assert {r.user: r.n_docs for r in back.stats.collect()} == {"ann": 1, "bob": 40}


def vectors(spark, n, seed, key):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("u" if i % 3 else "v", i, [float(f) for f in np.float32(v)]) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, f"user string, {key} long, embedding array<float>")


@pytest.mark.parametrize("large", [False, True])
def test_dense_is_exact(spark, monkeypatch, large):
    if large:  # the block-by-block path, with blocks far smaller than the data
        monkeypatch.setattr(D, "BROADCAST_QUERIES", 2)
        monkeypatch.setattr(D, "QUERY_BLOCK", 4)
        monkeypatch.setattr(D, "VECTOR_SLICE", 30)
    stored, sdf = vectors(spark, 200, 1, "ord")
    asked, qdf = vectors(spark, 11, 2, "qid")
    got = {}
    for r in D.dense_top_k(sdf, qdf, 5).collect():
        got.setdefault((r.user, r.qid), []).append((r.rank, r.ord))
    for u, q, e in asked:
        score = {o: round(float(np.dot(np.float64(v), np.float64(e))), 9) for w, o, v in stored if w == u}
        want = sorted(score, key=lambda o: (-score[o], o))[:5]
        assert [o for _, o in sorted(got[u, q])] == want


def test_dense_breaks_ties_by_order(spark):
    rows = [("u", i, [1.0, 0.0]) for i in range(50)]
    sdf = spark.createDataFrame(rows, "user string, ord long, embedding array<float>")
    got = D.dense_top_k(sdf, sdf.where("ord = 0").withColumnRenamed("ord", "qid"), 4).orderBy("rank").collect()
    assert [r.ord for r in got] == [0, 1, 2, 3]


@pytest.mark.parametrize("slice_rows, query_block", [(100_000, 16_384), (7, 3)])
def test_cells_against_brute_force(spark, slice_rows, query_block):
    """Clustered vectors: few pairs are scored, nearly all neighbours found, scores and ties as in the exact search."""
    rng = np.random.default_rng(3)
    heads = rng.standard_normal((12, 16))
    made = [heads[i % 12] + 0.25 * rng.standard_normal(16) for i in range(600)]
    made = [(v / np.linalg.norm(v)).astype(np.float32).tolist() for v in made]
    rows = [("u", i, v) for i, v in enumerate(made)] + [("u", 600 + i, made[0]) for i in range(5)] + [("w", 1, made[3])]
    sdf = spark.createDataFrame(rows, "user string, ord long, embedding array<float>").repartition(4)
    qdf = sdf.where("ord % 30 = 0 OR user = 'w'").withColumnRenamed("ord", "qid")
    index = D.build_cells(sdf, slice_rows=slice_rows)
    assert index.stored.count() == len(rows) and index.sizes.agg(F.sum("n")).first()[0] == len(rows)
    assert index.stored.groupBy("user", "cell", "part").count().agg(F.max("count")).first()[0] <= max(slice_rows, 25)
    approx = D.dense_top_k_approx(index, qdf, 5, query_block=query_block)
    asked = {(r.user, r.qid): np.float64(r.embedding) for r in qdf.collect()}
    hits = total = 0
    for (u, q), e in asked.items():
        score = {o: round(float(np.float64(np.float32(v)) @ e), 9) for w, o, v in rows if w == u}
        want = sorted(score, key=lambda o: (-score[o], o))[:5]
        got = [(r.ord, r.score) for r in approx.where((F.col("user") == u) & (F.col("qid") == q)).orderBy("rank").collect()] if q < 120 else None
        if got is not None:
            assert got == sorted(((o, score[o]) for o, _ in got), key=lambda x: (-x[1], x[0]))
            hits, total = hits + len({o for o, _ in got} & set(want)), total + len(want)
    assert hits / total >= 0.9
    r = D.recall_against_exact(approx, D.dense_top_k(sdf, qdf, 5)).first()
    assert r.recall >= 0.9 and D.scored_share(index, qdf).first()[0] < 0.2


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([], "user string, ord long, embedding array<float>")
    assert D.dense_top_k_approx(D.build_cells(none), none.withColumnRenamed("ord", "qid"), 5).collect() == []


def test_approximate_recall_over_documents(spark):
    from folioscope.plans import catalog

    r = catalog.QUERIES["approx_dense_recall"](spark, "/root/testdata/sf0.01").first()
    assert r.recall >= 0.9 and r.share_scored < 0.2


def ranked(spark, names):
    return spark.createDataFrame([(0, i + 1, n, n) for i, n in enumerate(names)], "qid long, rank int, ord string, key string")


def test_rrf_worked_example(spark):
    lists = [ranked(spark, ["C", "A", "B"]), ranked(spark, ["A", "C", "E"])]
    stacked = FU.stack_lists([ranked(spark, ["A", "C", "B"]), ranked(spark, ["C", "E", "A"])])
    got = {r.key: round(r.score, 4) for r in FU.reciprocal_rank_fusion(stacked, ["qid"]).collect()}
    assert got == {"C": 0.0325, "A": 0.0323, "B": 0.0159, "E": 0.0161}
    tie = [r.key for r in FU.reciprocal_rank_fusion(FU.stack_lists(lists), ["qid"]).orderBy("rank").collect()]
    assert tie == ["C", "A", "B", "E"]


def test_rrf_duplicate_keys_add_and_the_last_document_stands(spark):
    rows = [(0, 1, "d1", "same"), (0, 2, "d2", "same"), (0, 3, "d3", "other")]
    one = spark.createDataFrame(rows, "qid long, rank int, ord string, key string")
    top = FU.reciprocal_rank_fusion(FU.stack_lists([one]), ["qid"]).orderBy("rank").collect()
    assert top[0].ord == "d2" and math.isclose(top[0].score, 1 / 61 + 1 / 62)


def test_weights_must_match_lists(spark):
    with pytest.raises(ValueError):
        FU.stack_lists([ranked(spark, ["A"])], [0.3, 1.0])
    with pytest.raises(ValueError):
        RetrievalConfig("none", use_bm25=False, use_dense=False)
    with pytest.raises(ValueError):
        RetrievalConfig("w", use_dense=False, rrf_weights=(0.3, 1.0))
    assert RetrievalConfig("cap", top_k=5, rerank_top_c=50).pool_cap == 10


def test_rerank_is_stable_and_cuts(spark):
    df = spark.createDataFrame([(0, i + 1, "q", t) for i, t in enumerate(["b", "a", "a", "c"])], "qid long, rank int, qtext string, text string")
    scorer = scorer_from_model(lambda: lambda pairs: [1.0 if t == "a" else 0.5 for _, t in pairs], batch=2)
    got = FU.rerank(df, ["qid"], scorer, top_n=3).orderBy("rank").collect()
    assert [r.text for r in got] == ["a", "a", "b"]
    assert FU.rerank(df.where("false"), ["qid"], scorer, top_n=None).collect() == []


def test_model_hooks_compose(spark):
    df = spark.createDataFrame([(r"$\alpha$  b",), ("",)], "text string")
    plain = embedder_from_model(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), normalize=False)
    rows = [r.v for r in df.select(normalizing(plain)(F.col("text")).alias("v")).collect()]
    assert rows == [[3.0, 1.0], [0.0, 1.0]]
    unit = [r.v for r in df.select(hashed_tf_embedder(16)(F.col("text")).alias("v")).collect()]
    assert math.isclose(sum(x * x for x in unit[0]), 1, rel_tol=1e-6) and sum(unit[1]) == 0
    s = spark.createDataFrame([("a b", "a b c"), ("a b", "z"), ("", "a")], "q string, t string")
    got = [r.s for r in s.select(overlap_scorer()(F.col("q"), F.col("t")).alias("s")).collect()]
    assert got[0] > 0.99 and got[1] < 0.1 and got[1] == got[2]


@pytest.mark.parametrize("width, shared", [(16, False), (1, False), (8, True)])
def test_blocks_give_the_rows_of_the_full_scan(spark, width, shared):
    """Also with words that most chunks share (negative idf), and while leaving ranges out where a few chunks stand out."""
    draw = random.Random(width)
    texts = [" ".join([f"w{min(draw.randint(0, 400), draw.randint(0, 400))}" for _ in range(draw.randint(1, 12))] + (["all", "every"] if shared else [])) for _ in range(400)]
    for i in range(0, 400, 40):
        texts[i] += " rare w1 rare w2" * (1 + i // 200)
    rows = [(u, i, t) for u in ("ann", "bob") for i, t in enumerate(texts[: 400 if u == "ann" else 30])]
    chunks = spark.createDataFrame(rows, "user string, ord long, text string").repartition(3)
    asked = [("ann", 1, "rare w1 w2"), ("ann", 2, "w3 w3 w9 all"), ("ann", 3, "nothing here"), ("bob", 1, "all every w5"), ("bob", 2, "")]
    queries = spark.createDataFrame(asked, "user string, qid long, text string")
    index = L.build_index(chunks)
    by_block = L.blocked(index, width)
    pruned = L.bm25_top_k_blocks(by_block, queries, 5, first=8 if width == 1 else 2)  # as many chunks as are asked for
    columns = ["user", "qid", "rank", "ord", "score"]
    assert sorted(map(tuple, pruned.top.select(*columns).collect())) == sorted(map(tuple, L.bm25_top_k(index, queries, 5).select(*columns).collect()))
    read = L.postings_read(by_block, pruned, queries).first()
    assert 0 < read.ranges_read <= read.ranges
    if not shared:
        assert read.ranges_read < read.ranges and read.postings_share < 1


def test_hooks_over_markup_on_any_table(spark, tmp_path):
    """The same vectors from rows held by the driver, from a file, and behind a step of their own, adaptive or not."""
    texts = [r"$\frac{a}{b}$  x", "plain  words", r"\broken{", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    rows.write.parquet(f"{tmp_path}/t")
    length = embedder_from_model(lambda: lambda texts: np.array([[len(t)] for t in texts]), normalize=False)
    said = embedder_from_model(lambda: lambda texts: np.array([[len(t)] for t in texts]), normalize=False)
    wanted = [[5.0], [11.0], [8.0], [0.0], [0.0]]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    for flag in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", flag)
        for table in (rows, spark.read.parquet(f"{tmp_path}/t"), rows.repartition(3), rows.where("i >= 0").cache()):
            got = table.select("i", normalizing(length)(F.col("text")).alias("v"))
            step = table.withColumn("t", normalize_markup(F.col("text"))).select("i", said(F.col("t")).alias("v"))
            for found in (got, step):
                assert [r.v for r in found.orderBy("i").collect()] == wanted
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_pipeline_stages(spark):
    chunks = chunk_table(spark, {"ann": corpus(6, 60)})
    queries = spark.createDataFrame([("ann", 1, "w5 w9"), ("ann", 2, "w1")], "user string, qid long, text string")
    embed = hashed_tf_embedder(16)
    kw = dict(
        index=L.build_index(chunks), vectors=D.embed(chunks, embed), query_vectors=D.embed(queries, embed),
    )
    got = retrieve_all(queries, chunks, CONFIGS, **kw)
    final = got.final.groupBy("config", "qid").count().collect()
    assert {r["count"] for r in final} == {5} and len({r.config for r in final}) == 8
    pool = {(r.config, r.qid): r["count"] for r in got.candidates.groupBy("config", "qid").count().collect()}
    full = {(r.config, r.qid): r["count"] for r in got.ranked.groupBy("config", "qid").count().collect()}
    for (config, qid), n in pool.items():
        c = next(c for c in CONFIGS if c.name == config)
        assert n <= c.pool_cap
        # with reranking the ranked list is the pool, without it the whole fused list
        assert full[config, qid] == n if c.use_rerank else full[config, qid] >= n
    one = retrieve(queries, chunks, CONFIGS[3], **kw).final
    both = got.final.where("config = 'hybrid+rerank'")
    assert sorted((r.qid, r.rank, r.ord) for r in one.collect()) == sorted((r.qid, r.rank, r.ord) for r in both.collect())

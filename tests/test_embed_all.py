"""One pass over the texts for all embedders of a sweep."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.functions import models as M
from folioscope.functions.markup import normalize_markup
from folioscope.operators import dense as D
from folioscope.operators import lexical as L
from folioscope.plans import q_evaluation as Q

TEXTS = ["a b  b\n\tc", r"$\frac{a1}{b2}$  x", r"\broken{ left  as it is", "", None, "Ünï 7 seven Seven İstanbul", "b2 x" * 60]


def test_one_pass_gives_the_vectors_of_each_embedder(spark):
    chunks = spark.createDataFrame([("u", n, t) for n, t in enumerate(TEXTS)], "user string, ord long, text string")
    plain = M.embedder_from_model(lambda: lambda texts: np.array([[len(t), 1.0, 2.0] for t in texts]))
    embedders = {**Q.swept_embedders(), "plain": plain, "plain_normalized": M.normalizing(plain)}
    got, spent = D.embed_all(chunks, list(embedders.values()))
    rows = {r.ord: r for r in got.collect()}
    assert len(rows) == len(TEXTS) and all(s.value > 0 for s in spent)
    for n, (name, embedder) in enumerate(embedders.items()):
        for r in D.embed(chunks, embedder).collect():
            assert np.frombuffer(rows[r.ord][f"e{n}"], "<f4").tolist() == r.embedding, (name, r.ord)


def test_blanks_do_not_change_a_hashed_vector(spark):
    chunks = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "i long, text string")
    embedder = M.hashed_tf_embedder(32)
    got = chunks.select("i", M.normalizing(embedder)(F.col("text")).alias("v"), embedder(normalize_markup(F.col("text"))).alias("w")).collect()
    assert len(got) == len(TEXTS) and all(r.v == r.w for r in got)


def test_hashes_outlive_a_batch_and_stay_bounded(monkeypatch):
    monkeypatch.setattr(M, "embedder_from_model", lambda load: load())
    monkeypatch.setattr(M, "_KEPT_TOKENS", 3)
    embedder, texts = M.hashed_tf_embedder(16), [" ".join(f"w{n * k % 17}" for n in range(9)) + " z" * 40 + " " + "y" * 50 for k in range(12)]
    whole = embedder(texts)
    assert (np.concatenate([embedder([t]) for t in texts]) == whole).all()
    assert len(M._hashes) <= 3 + 1 and max(map(len, M._hashes)) <= M._KEPT_BYTES


def test_bytes_are_searched_as_arrays_are(spark):
    rng = np.random.default_rng(3)
    stored = np.round(rng.standard_normal((90, 5)), 1).astype(np.float32)
    rows = [("u" if n % 3 else "v", n, [float(x) for x in v], v.tobytes()) for n, v in enumerate(stored)]
    vectors = spark.createDataFrame(rows, "user string, ord long, embedding array<float>, packed binary").repartition(3)
    asked = spark.createDataFrame([(u, n, [float(x) for x in stored[n]]) for u in "uv" for n in range(7)], "user string, qid long, embedding array<float>")
    found = lambda df: sorted(map(tuple, D.dense_top_k(df, asked, 4).collect()))
    assert found(vectors.select("user", "ord", "embedding")) == found(vectors.select("user", "ord", F.col("packed").alias("embedding")))


def test_an_index_is_stored_once(spark, tmp_path, monkeypatch):
    rows = [("a", n, f"w{n % 5} w{n % 3} w1") for n in range(20)] + [("b", 0, None), (None, 1, "x y")]
    chunks = spark.createDataFrame(rows, "user string, ord long, text string")
    monkeypatch.setattr(L, "cut_lineage", lambda df, _cut=L.cut_lineage: _cut(df) if "tfs" not in df.columns else 1 / 0)
    index = L.store_index(chunks, str(tmp_path / "new"))
    monkeypatch.undo()
    L.build_index(chunks).write(str(tmp_path / "copied"))
    copied = L.LexicalIndex.read(spark, str(tmp_path / "copied"))
    for name in ("postings", "docs", "terms", "stats", "forward"):
        ordered = lambda i: sorted(str([sorted(v) if isinstance(v, list) else v for v in r]) for r in getattr(i, name).collect())
        assert ordered(index) == ordered(copied), name
    assert L.sizes(index) == (index.postings.count(), index.docs.count()) == L.sizes(copied)

"""The trained operators: held-out accuracy, and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import _training, language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark, docs, none):
    found = queries.QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    checked = found.where("held_out")
    assert checked.where("lang = lang_pred").count() / checked.count() > 0.97
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    model = language.train(docs)
    odd = [tuple(r) for r in language.predict(docs, model).collect()]
    assert len(odd) == docs.count() and {r[1] for r in odd if r[0] in (4, 5, 7)} == {"und"}
    empty = language.train(none)
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"} and language.predict(none, empty).count() == 0


def test_ftrl_is_sparse_and_temperature_calibrates():
    draw = np.random.default_rng(1)
    model = language.Ftrl(50, 2, l1=0.5)
    for _ in range(400):
        y = int(draw.integers(2))
        index = np.array([y, *(2 + draw.choice(48, 5, replace=False))])
        model.learn(index, np.full(6, 0.4), y)
    w = model.read(slice(None))
    assert w[0, 0] > 0.5 and w[1, 1] > 0.5 and (w[2:] == 0).mean() > 0.3
    logits, labels = draw.normal(0, 1, (3000, 2)), None
    p = language.softmax(logits)
    labels = (draw.random(3000) > p[:, 0]).astype(int)
    assert abs(language.temperature(logits * 4, labels) - 4) < 0.8


def separated(found, label, threshold):
    rows = [(r[label], r["predicted"]) for r in found.where("held_out").collect()]
    return sum(a == b for a, b in rows) / len(rows)


def test_toxicity_held_out(spark, docs, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.QUERIES["op2_toxicity"](spark, SF)
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    assert separated(found.join(labels, "doc_id"), "toxic", 0.5) > 0.93
    model = toxicity.train(docs, labels.limit(0))
    got = toxicity.score(docs, model, out="p", carry=["doc_id", "score"])
    assert got.count() == docs.count() and got.where("p >= 0.5").count() == 0 and got.columns == ["doc_id", "score", "p"]
    assert toxicity.score(none, model, out="p").count() == 0
    with pytest.raises(ValueError):
        toxicity.score(docs, model)


def test_deobfuscation(spark):
    words = "you idiot here stupid loser pathetic clown scum call the other another stop running still ".split()
    clean = spark.createDataFrame([(i, " ".join(words[i % 7 :] + words)) for i in range(200)], "doc_id long, text string")
    restore = toxicity.Restorer(toxicity.language_model(toxicity.gather_counts(clean)))
    said = lambda t: "".join(map(chr, restore(t)))
    for marked, plain in [("you 1d10t", "you idiot"), ("i d i o t here", "idiot here"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("p4th3t1c", "pathetic"), ("$tupid", "stupid")]:
        assert said(marked) == plain
    for plain in ["call 555-3752", "the&&& other***", "hello!!", "a b", ""]:
        assert said(plain) == plain
    assert len(restore("x1" * 5000)) > 0


def test_deobfuscation_of_signs_alone_or_last_and_short_spellings(spark):
    words = "you shit here nazi loser ass pathetic stupid scum lol call the other another stop running still ".split()
    clean = spark.createDataFrame([(i, " ".join(words[i % 7 :] + words)) for i in range(200)], "doc_id long, text string")
    restore = toxicity.Restorer(toxicity.language_model(toxicity.gather_counts(clean)))
    said = lambda t: "".join(map(chr, restore(t)))
    forms = [
        ("you a$$", "you ass"), ("you @$$", "you ass"), ("4$$ here", "ass here"), ("shi+", "shit"), ("as$", "ass"), ("naz!", "nazi"), ("naz|", "nazi"),
        ("you a s s", "you ass"), ("a.s.s", "ass"), ("a  s  s here", "ass here"), ("s  h  i  t", "shit"), ("s h i t  a s s", "shit  ass"), ("a $ $", "ass"),
    ]
    for marked, plain in forms:
        assert said(marked) == plain, marked
    for plain in ["hello!!", "stop!", "the other!!!", "call 555-3752", "$100", "+49 (555)", "!!!", "$$$", "a b", "a  b", "the  other", ""]:
        assert said(plain) == plain, plain


def test_quality_held_out(spark, docs, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.QUERIES["op10_quality"](spark, SF)
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    assert separated(found.join(labels, "doc_id"), "quality", 0.3) > 0.9
    model = quality.train(docs, labels.limit(0))
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.where(F.col("score").isNull()).count() == 0
    assert quality.score(none, model).count() == 0


def test_factorisation_identity():
    draw = np.random.default_rng(5)
    model = quality.Model(draw.normal(size=6), draw.normal(size=(6, 3)), 0.2)
    x = draw.normal(size=4)
    index = np.array([0, 2, 3, 5])
    pairs = sum(model.factors[index[i]] @ model.factors[index[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    z = 0.2 + model.linear[index] @ x + pairs
    assert abs(model.score(index, x) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_copies_with_two_labels(spark):
    """Copies of a text count once, with the larger label, whatever the order of the rows."""
    texts = [(f"grumblewort slander number {i}", 1) for i in range(12)] + [(f"a pleasant morning walk {i}", 0) for i in range(60)]
    rows = [(2 * i + copy, text, label * copy) for i, (text, label) in enumerate(texts) for copy in (0, 1)]
    model = toxicity.train(
        spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
        spark.createDataFrame([(r[0], r[2]) for r in rows[::-1]], "doc_id long, toxic int"),
    )
    found = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    assert all((found[r[0]] >= 0.5) == r[1].startswith("grumble") for r in rows)


def test_one_row_of_a_key_is_fetched(spark):
    """A sample's bound on keys is a bound on rows: repeated rows and different texts under one key count once."""
    rows = [(d, f"text {i % 3} of {d}") for d in (1, 2) for i in range(400)] + [(3, "left out")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sample = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    got = _training.texts_of(docs, sample).collect()
    assert sorted((r["doc_id"], r["label"]) for r in got) == [(1, 0), (2, 1)]
    again = _training.texts_of(docs.repartition(2), sample).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_number_of_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(i, f"words of {lang} {i}", lang) for i, lang in enumerate(["aa"] * 9 + ["bb"] * 9 + ["cc"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert {r["lang_pred"] for r in language.predict(docs.drop("lang"), model).collect()} <= {"aa", "bb"}

"""Lexical search over rows by chunk, and the tokens and vectors that are made column by column."""

import hashlib
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from folioscope.functions import models as M
from folioscope.functions import tokens as K
from folioscope.operators import lexical as L

_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　"


def odd_texts(n=400):
    draw = random.Random(4)
    return ["".join(draw.choice("aBzé09_İKß$​" + _BLANKS) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_tokens_are_those_of_python():
    texts = [*odd_texts(), "", None]
    tokens, rows = K.split_rows(K.blank_rows(texts))
    found = [[] for _ in texts]
    for token, row in zip(tokens.to_pylist(), rows):
        found[row].append(token)
    assert found == [(text or "").split() for text in texts]


def test_hashed_vectors_count_each_token(monkeypatch):
    monkeypatch.setattr(M, "embedder_from_model", lambda load: load())
    texts = odd_texts()
    wanted = np.zeros((len(texts), 16))
    for row, text in enumerate(texts):
        for token, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
            wanted[row, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += n
    assert (M.hashed_tf_embedder(16)(texts) == wanted).all()
    assert M.hashed_tf_embedder(16)([]).shape == (0, 16)


@pytest.mark.parametrize("limits", [{}, {"_CHUNKS": 7, "_POSTS": 40}])
def test_search_by_chunk_equals_search_by_postings(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(L, name, value)
    draw = random.Random(6)
    words = ["all", "most", *(f"w{n}" for n in range(30))]
    texts = [" ".join(["all", *(["most"] if n % 5 else []), *draw.choices(words, k=draw.randint(0, 9))]) for n in range(60)]
    rows = [("ann", n, text) for n, text in enumerate([*texts, None, "", "w1 w1"])]
    rows += [("bob", n * 3, text) for n, text in enumerate(texts[:9])]
    chunks = spark.createDataFrame(pd.DataFrame(rows, columns=["user", "ord", "text"])).repartition(3)
    asked = [("ann", 1, "w1 w2 w2"), ("ann", 2, "all most"), ("ann", 3, "no such"), ("ann", 4, ""), ("bob", 1, "w3 all"), ("eve", 1, "w1")]
    asked += [("ann", n, " ".join(draw.choices(words, k=6))) for n in range(5, 30)]
    questions = spark.createDataFrame(asked, "user string, qid long, text string")
    index = L.build_index(chunks)
    columns = ["user", "qid", "rank", "ord", "score"]
    rounded = lambda df: sorted((*r[:4], round(r[4], 8)) for r in df.select(*columns).collect())
    by_chunk = rounded(L.bm25_top_k(replace(index, postings=None, docs=None), questions, 6))
    assert by_chunk == rounded(L.bm25_top_k(replace(index, forward=None), questions, 6))
    assert len(by_chunk) == 29 * 6 + 6 and min(r[4] for r in by_chunk) >= 0


def test_stored_rows_by_chunk_come_back(spark, tmp_path):
    chunks = spark.createDataFrame([("007", 0, "a b b"), ("007", 1, "c"), ("eve", 0, "a")], "user string, ord long, text string")
    path = str(tmp_path / "index")
    L.build_index(chunks).write(path)
    L.build_index(chunks.where("user = 'eve'").replace("a", "d", "text")).write(path)
    index = L.LexicalIndex.read(spark, path)
    assert index.forward is not None
    assert sorted((r.user, r.ord, r.dl, sorted(zip(r.terms, r.tfs))) for r in index.forward.collect()) == [
        ("007", 0, 3, [("a", 1), ("b", 2)]), ("007", 1, 1, [("c", 1)]), ("eve", 0, 1, [("d", 1)]),
    ]

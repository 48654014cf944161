import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark forest today"),
    (2, "  prefix the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark forest today"),
    (3, "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark forest today"),
    (4, ""),
    (5, None),
    (6, "one two"),
    (6, "one two"),
    (7, " \t\n "),
    (None, "a null key with some words of its own that stand nowhere else"),
    (None, "one two"),
    (8, "é" * 3000 + " ü\x1c²½ _x_ 日本語 🎉 \U0010ffff " + "ab" * 4000),
    (9, "word " * 5000),
    (10, "Ein Satz mit Umlauten wie über und schön, dazu noch mehr Wörter als nötig."),
]


@pytest.fixture
def docs(spark):
    """Nulls, blanks, repeated rows, ties and columns whose names clash with what the operators make."""
    rows = [(d, t, "en" if d != 10 else None, None if d == 7 else f"s{(d or 0) % 2}", None if t is None else len(t), 0.5, 3) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int")


@pytest.fixture
def none(docs):
    return docs.limit(0)


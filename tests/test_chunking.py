"""Chunkers, ids, upserts and page lookups."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.markup import GLYPHS, normalize_markup, read_markup
from folioscope.operators import chunking as K

CALCULUS = "The chain rule states that $$\\frac{d}{dx}f(g(x)) = f'(g(x))g'(x)$$.\n\n" * 20


def docs(spark, rows):
    return spark.createDataFrame(rows, "user string, source string, doc_pos long, text string")


@pytest.mark.parametrize("name", ["baseline", "eqaware", "eqaware_context"])
def test_ids_do_not_depend_on_the_folder(spark, name):
    cut = [
        [r.chunk_id for r in K.chunk_documents(docs(spark, [("u", f"{d}/calculus.mmd", 0, CALCULUS)]), name).orderBy("n").collect()]
        for d in ("/tmp/a", "/var/b")
    ]
    assert cut[0] == cut[1] and cut[0][0] == "calculus.mmd::0" and len(set(cut[0])) == len(cut[0])


def test_numbers_run_on_over_documents_of_one_source(spark):
    rows = [("u", "a/x.mmd", i, "word " * (50 + 40 * (i % 5))) for i in range(30)] + [("u", "y.mmd", 99, "one two")]
    got = K.chunk_documents(docs(spark, rows), size=100, overlap=20).orderBy("doc_pos", "n").collect()
    xs = [r.n for r in got if r.source == "x.mmd"]
    assert xs == list(range(len(xs))) and [r.n for r in got if r.source == "y.mmd"] == [0]


def test_recursive_split_prefers_coarse_separators():
    text = "aaa bbb\n\nccc ddd\n\neee"
    assert K.split_recursive(text, 12, 0) == ["aaa bbb", "ccc ddd", "eee"]
    assert K.split_recursive("a" * 25, 10, 3) == ["a" * 10, "a" * 10, "a" * 10, "a" * 4]
    assert K.split_recursive("one two three four", 9, 4) == ["one two", "three", "four"]
    # the overlap is kept only as far as the next part still fits beside it
    assert K.split_recursive("aa bb cc dd", 8, 3) == ["aa bb cc", "cc dd"]
    assert K.split_recursive("aa bb cc dd", 5, 3) == ["aa bb", "cc", "dd"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n$x.", max_size=300), st.integers(5, 60))
def test_chunks_hold_size_and_every_letter(text, size):
    chunks = K.split_recursive(text, size, size // 4)
    assert all(0 < len(c) <= size for c in chunks)
    # overlap repeats text but never loses any
    assert sum(len(c) for c in chunks) >= len("".join(text.split())) - text.count(" ") or not text.strip()
    for c in chunks:
        assert c in text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "long sentence here.", "$x+y$", "$$a\n=b$$", "\n", " "]), max_size=40))
def test_equations_are_never_cut(parts):
    text = " ".join(parts)
    for cut in (K.chunk_eqaware, K.chunk_eqaware_context):
        chunks = cut(text, 40, 10)
        for chunk in chunks:
            assert chunk.count("$") % 2 == 0
        for eq in K._EQ.findall(text):
            assert any(eq in c for c in chunks)


def test_context_bundles_neighbouring_sentences():
    text = "Intro here. We have the rule: $x=1$ which is nice. Then more follows."
    units = K._with_context(list(K._spans(text)))
    assert units[1][0] and units[1][1] == "We have the rule: $x=1$ which is nice."
    assert units[0] == (False, "Intro here.") and units[2] == (False, "Then more follows.")


def test_overlap_seed_skips_equations_and_half_words():
    assert K.overlap_seed("short", 80) == "short"
    assert K.overlap_seed("alpha beta gamma delta", 10) == "delta"
    text = "see $a + b + c + d$ then rest"
    assert K.overlap_seed(text, 15) == "then rest"


def test_pages_follow_markers(spark):
    text = "zero <!-- page:3 -->alpha beta.\n\n<!-- page:4 -->" + "gamma " * 100
    got = K.chunk_documents(docs(spark, [("u", "d.mmd", 0, text), ("u", "e.mmd", 1, "no pages")]), size=60, overlap=10).collect()
    d = [r for r in got if r.source == "d.mmd"]
    assert "page:" not in "".join(r.text for r in got)
    assert d[-1].page == 4 and [r.page for r in got if r.source == "e.mmd"] == [None]
    marks = spark.createDataFrame([(text,)], "t string").select(T.page_markers(F.col("t")).alias("m")).first().m
    clean = spark.createDataFrame([(text,)], "t string").select(T.strip_page_markers(F.col("t")).alias("c")).first().c
    assert [(m.offset, m.page) for m in marks] == [(5, 3), (clean.index("gamma"), 4)]


def test_page_break_rewrite_and_file_page(spark):
    df = spark.createDataFrame([("x{3}-----y", "_page_12_fig.png", "cover.png")], "t string, f string, g string")
    r = df.select(T.page_breaks_to_markers(F.col("t")).alias("t"), T.page_of_file(F.col("f")).alias("f"), T.page_of_file(F.col("g")).alias("g")).first()
    assert r.t == "x<!-- page:3 -->y" and r.f == 12 and r.g is None


def test_upsert_replaces_in_place_and_keeps_stale_tail(spark):
    schema = "user string, chunk_id string, ord long, text string"
    old = spark.createDataFrame([("u", f"a::{i}", i, f"old{i}") for i in range(4)], schema)
    new = spark.createDataFrame([("u", "a::0", 0, "new0"), ("u", "a::1", 1, "new1"), ("u", "b::0", 2, "b")], schema)
    got = K.merge_chunks(old, new).orderBy("ord").collect()
    assert [(r.chunk_id, r.text) for r in got] == [
        ("a::0", "new0"), ("a::1", "new1"), ("a::2", "old2"), ("a::3", "old3"), ("b::0", "b")
    ]
    assert K.merge_chunks(old, old).count() == 4


def test_segments_are_lossless(spark):
    text = "a $x$ b $$y\nz$$ c $lone"
    segs = spark.createDataFrame([(text,)], "t string").select(T.equation_segments(F.col("t")).alias("s")).first().s
    assert "".join(s.span for s in segs) == text
    assert [s.span for s in segs if s.kind == "eq"] == ["$x$", "$$y\nz$$"]


def test_markup_reads_as_text(spark):
    df = spark.createDataFrame([(r"so $\frac{a}{b} \leq \alpha$  and" + "\n more",)], "t string")
    assert df.select(normalize_markup(F.col("t")).alias("t")).first().t == "so a/b ≤ α and more"


def test_registered_chunker_is_usable(spark):
    K.register_chunker("lines", lambda text, size, overlap: text.split("\n"))
    got = K.chunk_documents(docs(spark, [("u", "d.mmd", 0, "a\nb")]), "lines").orderBy("n").collect()
    assert [r.text for r in got] == ["a", "b"]
    del K.CHUNKERS["lines"]


def test_figures_link_to_the_nearest_earlier_page(spark):
    chunks = spark.createDataFrame(
        [("d", 0, "d::0", 2), ("d", 1, "d::1", 2), ("d", 2, "d::2", 5), ("e", 0, "e::0", None)],
        "source string, n long, chunk_id string, page int",
    )
    figs = spark.createDataFrame(
        [("d", 1, "f1"), ("d", 2, "f2"), ("d", 4, "f3"), ("d", 9, "f4"), ("d", None, "f5"), ("e", 3, "f6")],
        "doc_name string, page int, image_id string",
    )
    got = {r.image_id: r.nearby_chunk_id for r in K.nearest_page_chunk(figs, chunks).collect()}
    assert got == {"f1": "d::0", "f2": "d::1", "f3": "d::1", "f4": "d::2", "f5": None, "f6": None}


def test_order_key_is_unique_and_follows_documents(spark):
    rows = [("u", f"s{i % 3}.mmd", i, "alpha beta " * (10 + i)) for i in range(9)]
    got = K.chunk_documents(docs(spark, rows), size=40, overlap=5).collect()
    assert len({r.ord for r in got}) == len(got)
    ordered = sorted(got, key=lambda r: r.ord)
    assert [r.doc_pos for r in ordered] == sorted(r.doc_pos for r in got)
    for s in ("s0.mmd", "s1.mmd"):
        assert [r.n for r in ordered if r.source == s] == list(range(sum(r.source == s for r in got)))


def brute_markup(s):
    """A reader of the same subset by recursive descent; what it can't read to the end comes back as it is."""
    if "\\" not in s and "$" not in s:
        return " ".join(s.split())

    def group(i):
        while s[i].isspace():
            i += 1
        if s[i] != "{":
            raise ValueError
        return read(i + 1, True)

    def read(i, inside=False):
        out = []
        while i < len(s) or inside:
            if s[i] == "}":
                if not inside:
                    raise ValueError
                break
            c = s[i]
            i += 1
            if c == "{":
                inner, i = read(i, True)
                out.append(inner)
            elif c == "\\" and s[i].isalpha():
                j = i
                while j < len(s) and s[j].isascii() and s[j].isalpha():
                    j += 1
                name, i = s[i:j], j
                if name in ("frac", "dfrac", "tfrac"):
                    a, i = group(i)
                    b, i = group(i)
                    out.append(f"{a}/{b}")
                elif name == "sqrt":
                    a, i = group(i)
                    out.append(f"√({a})")
                elif name in ("text", "mathbb", "mathbf", "mathrm", "mathcal"):
                    a, i = group(i)
                    out.append(a)
                elif name in ("begin", "end"):
                    _, i = group(i)
                    out.append(" ")
                elif name not in ("left", "right", "displaystyle"):
                    out.append(GLYPHS.get(name, "\\" + name))
            elif c == "\\":
                out.append(s[i] if s[i] in "%$&#_{}" else " ")
                i += 1
            elif c != "$":
                out.append(" " if c == "~" else c)
        return "".join(out), i + 1

    try:
        return " ".join(read(0)[0].split())
    except (IndexError, ValueError):
        return s


NESTED = [
    r"so $\frac{1}{1+\frac{1}{1+\frac{1}{1+\frac{a}{b}}}}$ holds",
    r"roots \sqrt{1+\sqrt{2+\sqrt{3+\sqrt{\alpha}}}} end",
    r"\frac{x^{2_{i}}}{\sqrt{y^{a^{b}}}} \leq \text{if \mathbf{x \frac{{a}{b}{c}{d}}{e_{1}} y}}",
    r"sets \frac{\{a, b\}}{\left| S_{\mathcal{A}} \right|} cost \$5 \\ {next~line} 10\%, f{rac}{s}",
    r"\begin{align} \frac {\hat{x}} {\dfrac{a}{\sqrt{b}}} \\{z} \end{align} \in{A} \int_{0}^{\infty}",
    "plain {text} with  blanks",
    "only $5 here",
    "",
]


BROKEN = [r"\frac{a}", r"a } b \alpha", r"\sqrt  x", "ends \\", r"{ \beta", r"\frac{a} x {b}", r"\begin{align", "$ }  {"]


def test_random_markup_equals_the_recursive_reader():
    draw, parts = random.Random(7), ["{", "}", "{", "}", "\\frac", "\\sqrt ", "\\text", "\\begin", "\\alpha", "\\foo", "\\{", "\\\\", "\\é", "$", "~", " ", "\n", "x", "é1"]
    read = kept = 0
    for _ in range(20_000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) + draw.choice(["", "$"])
        got = read_markup(t)
        if "\\" in t or "$" in t:
            assert (t if got is None else " ".join(got.split())) == brute_markup(t), t
            read, kept = read + (got is not None), kept + (got is None)
    assert read > 1000 and kept > 1000


def test_very_long_markup_takes_linear_time():
    deep = "\\frac{" * 200_000 + "x" + "}{y}" * 200_000
    assert read_markup(deep) == "x" + "/y" * 200_000


def test_nested_markup_is_read_to_any_depth(spark, tmp_path):
    deep = "x"
    for i in range(40):
        deep = [rf"\frac{{{deep}}}{{2}}", rf"\sqrt{{{deep}}}", rf"y_{{{deep}}}"][i % 3]
    texts = [*NESTED, *BROKEN, deep, r"\frac{a}{b} and \sqrt{c} " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", normalize_markup(F.col("text")).alias("t")).collect()}
    assert got.pop(len(texts)) is None
    assert got == {i: brute_markup(t) for i, t in enumerate(texts)}

    from hashlib import md5

    from folioscope.plans import catalog

    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.digest for r in catalog.QUERIES["markup_normalized_all"](spark, str(tmp_path)).collect()}
    assert found == {i: md5(brute_markup(t).encode()).hexdigest() for i, t in enumerate(texts)} | {len(texts): None}

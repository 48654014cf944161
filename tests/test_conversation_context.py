"""Context assembly, facts, figures and conversation operators on small hand-made tables."""

from pyspark.sql import functions as F

from folioscope.functions.models import overlap_scorer
from folioscope.operators import context as C
from folioscope.operators import conversation as V

FACTS = "user string, seq long, id string, fact string, pinned boolean"


def facts(spark):
    return spark.createDataFrame(
        [("kid", 0, "f0", "in year 10", True), ("kid", 1, "f1", "drops minus signs when distributing", False)], FACTS
    )


def asked(spark, text="why the sign error?"):
    return spark.createDataFrame([("kid", 1, text)], "user string, qid long, text string")


def test_near_duplicate_facts_are_rejected(spark):
    new = spark.createDataFrame(
        [("kid", 5, "a", "  In Year 10 ", False), ("kid", 6, "b", "  ", False), ("kid", 7, "c", "likes  Graphs", False),
         ("kid", 8, "d", "likes graphs", False)], FACTS
    )
    assert [r.fact for r in C.add_facts(facts(spark), new).collect()] == ["likes  Graphs"]


def test_recall_budget(spark):
    assert [r.fact for r in C.recall_facts(asked(spark), facts(spark), None, 400).collect()] == ["in year 10"]
    assert C.recall_facts(asked(spark), facts(spark), None, 1).collect() == []
    assert C.recall_facts(asked(spark), facts(spark), None, 0).collect() == []
    both = C.recall_facts(asked(spark, "minus signs"), facts(spark), overlap_scorer(), 400).orderBy("rank").collect()
    assert [r.fact for r in both] == ["in year 10", "drops minus signs when distributing"]


def test_forget_and_pin(spark):
    ids = spark.createDataFrame([("kid", "f0"), ("kid", "deadbeef")], "user string, id string")
    kept, report = C.forget_facts(facts(spark), ids)
    assert [r.id for r in kept.collect()] == ["f1"]
    assert {r.id: r.matched for r in report.collect()} == {"f0": True, "deadbeef": False}
    pinned = C.set_pinned(facts(spark), spark.createDataFrame([("kid", "f1", True)], "user string, id string, pinned boolean"))
    assert all(r.pinned for r in pinned.collect())


def test_equal_captions_resolve_to_the_last_record(spark):
    figs = spark.createDataFrame(
        [("d::img0", "d", 1, "a red triangle", None, 0), ("d::img1", "d", 2, "a red triangle", None, 1),
         ("d::img2", "d", 3, "unrelated", None, 2), ("x::img0", "x", 1, "a red triangle", None, 3)],
        "image_id string, doc_name string, page int, caption string, nearby_chunk_id string, seq long",
    )
    owned = spark.createDataFrame([("kid", "d")], "user string, source string")
    got = C.recall_figures(asked(spark, "red triangle"), figs, owned, overlap_scorer()).orderBy("rank").collect()
    assert [r.image_id for r in got] == ["d::img1", "d::img1"]


def test_merge_sources_keeps_repeats_of_the_new_list(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "qid long, rank int, chunk_id string")
    new = spark.createDataFrame([(1, 1, "b"), (1, 2, "c"), (1, 3, "c"), (2, 1, "a")], "qid long, rank int, chunk_id string")
    got = C.merge_sources(old, new).orderBy("qid", "rank").collect()
    assert [(r.qid, r.rank, r.chunk_id) for r in got] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "c"), (2, 1, "a")]


def test_context_block_and_footer(spark):
    modes = spark.createDataFrame([(1, "grounded"), (2, "general")], "qid long, mode string")
    kept = spark.createDataFrame([(1, 2, "lib/b.mmd", "B"), (1, 1, "a.mmd", "A")], "qid long, rank int, source string, text string")
    figs = spark.createDataFrame([(1, 1, "a.mmd", None, "cap")], "qid long, rank int, doc_name string, page int, caption string")
    got = {r.qid: r.context for r in C.build_context(modes, kept, figs).collect()}
    assert got[1] == "Context from your documents:\n\n\n\n[Source: a.mmd]\nA\n\n[Source: b.mmd]\nB\n\n[Figure: a.mmd]\ncap\n\n"
    assert got[2] == ""
    foot = {r.qid: r.footer for r in C.sources_footer(modes, kept).collect()}
    assert foot == {1: "\n\n_Sources: a.mmd, lib/b.mmd_", 2: ""}


def test_search_reply_budget(spark):
    q = spark.createDataFrame([(1, 1), (2, 0)], "qid long, n_total int")
    p = spark.createDataFrame([(1, 1, "s", "word " * 400)], "qid long, rank int, source string, text string")
    got = {r.qid: r.reply for r in C.search_result_text(q, p).collect()}
    assert got[1].startswith("1 passage found:\n\n[Source: s]\nword") and got[1].endswith("word …") and len(got[1]) < 1250
    assert got[2] == C.NO_RESULTS


def turns(spark, n):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_history_window_moves_in_blocks(spark):
    for n, start in ((5, 0), (15, 0), (16, 8), (23, 8), (24, 16)):
        got = sorted(r.turn for r in V.history_window(turns(spark, n)).collect())
        assert got == list(range(start, n))


def test_history_text_without_turns(spark):
    convs = spark.createDataFrame([(1,), (2,)], "conv_id long")
    got = {r.conv_id: r.history for r in V.history_text(convs, turns(spark, 2)).collect()}
    assert got == {1: "Student: t0\nTutor: t1", 2: "None yet."}


def test_rewrite_borrows_the_last_question(spark):
    rows = [(1, 0, "user", "What is the derivative of the sine function at zero?"), (1, 1, "assistant", "cos"),
            (1, 2, "user", "why?"), (1, 3, "assistant", "because"),
            (1, 4, "user", "Please show me how one can integrate by parts here now")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.follow_up, r.query) for r in V.rewrite_queries(df).collect()}
    assert got[0] == (False, rows[0][3])
    assert got[2] == (True, "why? What is the derivative of the sine function at zero?")
    assert got[4] == (False, rows[4][3])


def test_image_references(spark):
    schema = "conv_id long, turn long, role string, type string, text string"
    history = spark.createDataFrame(
        [(1, 0, "user", "image", "a red triangle"), (1, 1, "user", "image", "a blue circle")], schema
    )
    ask = ["the photo", "the picture before that", "show the red triangle picture", "what is a limit"]
    msgs = spark.createDataFrame([(1, 10 + i, t, t) for i, t in enumerate(ask)], "conv_id long, turn long, text string, query string")
    got = {r.turn: (r.image_caption, r.query) for r in V.resolve_images(msgs, history, overlap_scorer()).collect()}
    assert got[10] == ("a blue circle", "the photo a blue circle")
    assert got[11][0] == "a red triangle" and got[12][0] == "a red triangle"
    assert got[13] == (None, "what is a limit")


def test_clean_history(spark):
    rows = [(1, 0, "user", "a", False), (1, 1, "assistant", "ok", False), (1, 2, "user", "b", False),
            (1, 3, "assistant", " ", False), (1, 4, "user", "c", False), (1, 5, "user", "d", False),
            (1, 6, "assistant", "x", True), (1, 7, "user", "e", False)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, failed boolean")
    assert sorted(r.turn for r in V.clean_history(df).collect()) == [0, 1]


def test_question_echo(spark):
    q = "What is the derivative of sin?"
    cases = [
        (q, q, ""), (q, "what  IS the derivative of sin? : \nIt is cos.", "It is cos."), (q, "It is cos. " + q, "It is cos. " + q),
        (q, "What is the deri", "What is the deri"), ("hi", "hi there", "hi there"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, q string, a string")
    got = {r.i: r.o for r in df.select("i", V.strip_question_echo(F.col("q"), F.col("a")).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_code_fences(spark):
    cases = [
        ("a\n```python\nx\n```\nb", "a\nb", None), ("```Py \nx```tail", "tail", None), ("```text\nx\n```\n", "```text\nx\n```\n", None),
        ("so\n```python\nprint(1)\n```  \n", "so\n  \n", "print(1)"), ("cut ```python\nprint(", "cut ", None), ("```python\n\n```", "", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: (r.h, r.p) for r in df.select("i", V.hide_python_blocks(F.col("t")).alias("h"), V.pending_program(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [(c[1], c[2]) for c in cases]


def test_tool_audit(spark):
    cases = [("search_documents", '{"query": "x"}', None, '{"query":"x"}'), ("run_python", '{"code": 5}', None, '{"code":"5"}'),
             ("list_documents", None, None, "{}"), ("fly", "{}", "There is no tool", None), ("run_python", "{bad", "not valid JSON", None),
             ("run_python", "[1]", "must be an object", None), ("run_python", None, 'needs a "code"', None),
             ("search_documents", '{"query": " "}', "was empty", None), ("search_documents", '{"query": null}', 'needs a "query"', None)]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, tool string, args string")
    for r in V.audit_tool_calls(df).collect():
        _, _, why, clean = cases[r.i]
        assert r.clean_args == clean, cases[r.i]
        assert (r.reason is None) if why is None else why in r.reason


def test_user_names(spark):
    df = spark.createDataFrame([(" Ann-1 ",), ("a b",), ("x-",), ("",)], "u string")
    assert [r.n for r in df.select(C.normalize_user(F.col("u")).alias("n")).collect()] == ["ann-1", None, None, None]


def test_salted_pairing_gives_the_same(spark, monkeypatch):
    from folioscope import session

    rows = [("hot" if i % 3 else "u", i, f"f{i}", f"fact number {i} on signs", i % 10 == 0) for i in range(90)]
    many = spark.createDataFrame(rows, FACTS)
    qs = spark.createDataFrame([("hot", 1, "number 7"), ("hot", 2, "signs"), ("u", 3, "fact 9")], "user string, qid long, text string")
    plan = lambda: sorted(map(tuple, C.recall_facts(qs, many, overlap_scorer(), 60).collect()))
    small = plan()
    monkeypatch.setattr(session, "fits_broadcast", lambda *_: False)
    assert plan() == small and len(small) > 10


def test_broadcast_bound_counts_bytes(spark):
    from folioscope.session import fits_broadcast

    df = spark.createDataFrame([("x" * 100,)] * 10, "t string")
    assert fits_broadcast(df, 10, 1000) and not fits_broadcast(df, 9) and not fits_broadcast(df, 10, 999)


def test_rewrite_in_long_null_and_repeated_conversations(spark):
    said = [(None, 0, "user", "How do I factor this polynomial into primes over the integers"), (None, 3, "user", "why?"), (2, None, "user", "why?")]
    said += [(3, 5, "user", "aa bb cc dd ee ff gg"), (3, 5, "user", "zz bb cc dd ee ff gg"), (3, 6, "assistant", None), (3, 9, "user", None), (3, 10, "user", "and then?")]
    said += [(4, n, "user" if n in (0, 5000) else "assistant", "first question" if n == 0 else "why?") for n in range(5001)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.text): r.query for r in V.rewrite_queries(df).collect()}
    assert len(got) == sum(r[2] == "user" for r in said)
    assert got[(None, 3, "why?")] == "why? " + said[0][3]
    assert got[(2, None, "why?")] == "why?"
    assert got[(3, 10, "and then?")] == "and then? zz bb cc dd ee ff gg"
    assert got[(4, 5000, "why?")] == "why? first question"
    kept = V.history_window(df).groupBy("conv_id").count().collect()
    assert {r.conv_id: r["count"] for r in kept} == {None: 2, 2: 1, 3: 5, 4: 9}

"""Registered queries: citations, context blocks, figures, facts and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.models import overlap_scorer
from folioscope.operators import context as C
from folioscope.operators import lexical as L
from folioscope.operators import conversation as V
from folioscope.operators.recall import candidate_pairs
from folioscope.plans import bindings as B
from folioscope.plans import q_documents as D
from folioscope.plans import q_retrieval as R
from folioscope.plans.registry import register, table
from folioscope.plans.retrieve import with_chunk

FLOOR = C.RELEVANCE_FLOOR
# tokens of a question a text must hold to reach the floor
_NEED = (
    "len(list_filter(range(0, n + 1), lambda c: round(1 / (1 + exp(-8.0::DOUBLE * (c::DOUBLE / n - 0.35::DOUBLE))), 9) < "
    f"{FLOOR}))"
)


def final_chunks(spark, sf, index=None):
    """Final five of every question with ids and whole text."""
    final = R.shipped(spark, sf, index).final.drop("config")
    return with_chunk(final, B.chunks_with_ids(spark, sf), ["source", "chunk_id", "text"])


FINAL = [
    *R.SHIPPED, B.CHUNKS,
    """fin AS (SELECT s.qid, s.rank, s.ord, s.score, c.source, c.chunk_id, c.text
        FROM s_ranked s JOIN chunks c ON c.ord = s.ord WHERE s.rank <= 5)""",
    f"kept AS (SELECT * FROM fin WHERE score >= {FLOOR})",
    """modes AS (SELECT q.item_id AS qid, CASE WHEN count(k.qid) > 0 THEN 'grounded' ELSE 'general' END AS mode,
        count(k.qid) AS n_kept FROM benchmark q LEFT JOIN kept k ON k.qid = q.item_id GROUP BY q.item_id)""",
]


@register(
    "citation_rows",
    B.ctes(*FINAL) + "SELECT qid, rank, source, chunk_id, round(score, 6) AS score, substr(text, 1, 200) AS preview FROM fin",
)
def citation_rows(spark, sf):
    return C.to_sources(final_chunks(spark, sf)).select(
        "qid", "rank", "source", "chunk_id", F.round("score", 6).alias("score"), "preview"
    )


@register(
    "context_floor",
    B.ctes(*FINAL) + "SELECT qid, rank, chunk_id, round(score, 6) AS score FROM kept",
)
def context_floor(spark, sf):
    return C.select_context(final_chunks(spark, sf)).select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


def modes_and_kept(spark, sf):
    kept = C.select_context(final_chunks(spark, sf))
    modes = C.answer_mode(B.questions(spark, sf), kept, B.chunks(spark, sf).select("user"))
    return modes, kept


@register("answer_mode", B.ctes(*FINAL) + "SELECT qid, mode, n_kept FROM modes")
def answer_mode(spark, sf):
    return modes_and_kept(spark, sf)[0].select("qid", "mode", "n_kept")


@register(
    "context_block",
    B.ctes(*FINAL)
    + """SELECT m.qid, m.mode, CASE WHEN m.mode = 'grounded' THEN md5('Context from your documents:' || chr(10) || chr(10) || chr(10) || chr(10)
          || (SELECT string_agg('[Source: ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) FROM kept k WHERE k.qid = m.qid)
          || chr(10) || chr(10)) ELSE md5('') END AS digest FROM modes m""",
)
def context_block(spark, sf):
    modes, kept = modes_and_kept(spark, sf)
    return C.build_context(modes.select("qid", "mode"), kept).select("qid", "mode", F.md5("context").alias("digest"))


@register(
    "plain_context",
    B.ctes(*FINAL)
    + """SELECT qid, md5(string_agg('[Source: ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest
         FROM fin GROUP BY qid""",
)
def plain_context(spark, sf):
    return C.plain_context(final_chunks(spark, sf)).select("qid", F.md5("context").alias("digest"))


@register(
    "sources_footer",
    B.ctes(*FINAL)
    + """, firsts AS (SELECT qid, source, min(rank) AS pos FROM kept GROUP BY ALL)
       SELECT m.qid, coalesce((SELECT chr(10) || chr(10) || '_Sources: ' || string_agg(source, ', ' ORDER BY pos) || '_' FROM firsts f
          WHERE f.qid = m.qid), '') AS footer FROM modes m""",
)
def sources_footer(spark, sf):
    modes, kept = modes_and_kept(spark, sf)
    return C.sources_footer(modes, kept).select("qid", "footer")


@register(
    "merged_sources",
    B.ctes(*FINAL)
    + """, late AS (SELECT b.qid, b.rank, c.chunk_id FROM bm25 b JOIN chunks c USING (ord) WHERE b.rank <= 5),
       fresh AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM late l
          WHERE NOT EXISTS (SELECT 1 FROM fin f WHERE f.qid = l.qid AND f.chunk_id = l.chunk_id))
       SELECT qid, rank, chunk_id FROM fin UNION ALL
       SELECT qid, k + (SELECT max(rank) FROM fin f WHERE f.qid = fresh.qid), chunk_id FROM fresh""",
)
def merged_sources(spark, sf):
    index = L.build_index(B.chunks(spark, sf))  # both searches read it
    existing = final_chunks(spark, sf, index).select("qid", "rank", "chunk_id")
    late = with_chunk(R.bm25_top(spark, sf, 5, index), B.chunks_with_ids(spark, sf), ["chunk_id"])
    return C.merge_sources(existing, late.select("qid", "rank", "chunk_id"))


@register(
    "search_reply",
    B.ctes(*FINAL)
    + f""", n AS (SELECT qid, count(*) AS n FROM kept GROUP BY qid),
       body AS (SELECT k.qid, k.rank, k.source, {B.sql_strip('k.text')} AS b, (1200 // n.n)::INTEGER AS budget FROM kept k JOIN n USING (qid)),
       cut AS (SELECT qid, rank, source, CASE WHEN length(b) > budget THEN regexp_replace(substr(b, 1, budget), '(?s)^(.*) [^ ]*$', '\\1') || ' …' ELSE b END AS t FROM body)
       SELECT q.item_id AS qid, md5(coalesce((SELECT count(*) || ' passage' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END || ' found:' || chr(10) || chr(10)
          || string_agg('[Source: ' || source || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY rank) FROM cut c WHERE c.qid = q.item_id HAVING count(*) > 0),
          '{C.NO_RESULTS.replace("'", "''")}')) AS digest FROM benchmark q""",
)
def search_reply(spark, sf):
    modes, kept = modes_and_kept(spark, sf)
    asked = modes.select("qid", F.col("n_kept").alias("n_total"))
    return C.search_result_text(asked, kept).select("qid", F.md5("reply").alias("digest"))


_OWNED = "owned AS (SELECT DISTINCT source FROM documents)"


def _owned(spark, sf):
    return B.chunks(spark, sf).select("user", "source").distinct()


_FIGS = [
    B.CHUNKS, D.PAGED, D.FIGURES, D.NEARBY, _OWNED,
    """cap AS (SELECT caption, arg_max(image_id, seq) AS image_id, count(*) AS copies, min(seq) AS first_seq
        FROM nearby JOIN owned ON owned.source = nearby.doc_name GROUP BY caption)""",
    """cop AS (SELECT *, unnest(range(1, least(copies, 3) + 1)) AS copy FROM cap)""",
    f"""fsc AS (SELECT q.item_id AS qid, c.*, {B.sql_scorer('q.text', 'c.caption')} AS score FROM benchmark q CROSS JOIN cop c)""",
    f"""frec AS (SELECT qid, image_id, caption, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_seq, copy) AS rank
        FROM fsc WHERE score >= {FLOOR} QUALIFY rank <= 3)""",
]


def recalled(spark, sf):
    figs = D.linked_figures(spark, sf)
    return C.recall_figures(B.questions(spark, sf), figs, _owned(spark, sf), overlap_scorer()), figs


@register("figure_recall", B.ctes(*_FIGS) + "SELECT qid, rank, image_id, round(score, 6) AS score FROM frec")
def figure_recall(spark, sf):
    return recalled(spark, sf)[0].select("qid", "rank", "image_id", F.round("score", 6).alias("score"))


@register(
    "figures_with_neighbours",
    B.ctes(*FINAL, *_FIGS[1:])
    + """, joined AS (SELECT qid, image_id, rank AS pos FROM frec UNION ALL
         SELECT k.qid, f.image_id, 1000000 * (1 + k.rank) + f.seq FROM kept k JOIN nearby f ON f.nearby_chunk_id = k.chunk_id),
       once AS (SELECT qid, image_id, min(pos) AS pos FROM joined GROUP BY ALL)
       SELECT qid, image_id, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank FROM once""",
)
def figures_with_neighbours(spark, sf):
    found, figs = recalled(spark, sf)
    _, kept = modes_and_kept(spark, sf)
    return C.figures_near(found, kept, figs).select("qid", "image_id", "rank")


def facts(spark, sf):
    """System turns and short user turns as stored facts; system turns are pinned."""
    c = table(spark, sf, "conversations")
    return c.where("role <> 'assistant'").select(
        B.owner("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("fact"),
        (F.col("role") == "system").alias("pinned"),
    )


FACTS = """
facts AS (SELECT conv_id * 1000 + turn AS seq, conv_id || '-' || turn AS id, text AS fact, role = 'system' AS pinned
       FROM conversations WHERE role <> 'assistant')
"""


@register(
    "fact_recall",
    B.ctes(
        FACTS,
        f"fs AS (SELECT q.item_id AS qid, f.seq, f.fact, {B.sql_scorer('q.text', 'f.fact')} AS score FROM benchmark q CROSS JOIN facts f WHERE NOT f.pinned)",
        f"fb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS pos FROM fs WHERE score >= {FLOOR} QUALIFY pos <= 5)",
        """fo AS (SELECT q.item_id AS qid, 0 AS part, f.seq AS pos, f.fact FROM benchmark q CROSS JOIN facts f WHERE f.pinned
            UNION ALL SELECT qid, 1, pos, fact FROM fb)""",
        """fu AS (SELECT *, row_number() OVER w AS rank, sum(length(fact) + 3) OVER w - 1 AS used FROM fo
            WINDOW w AS (PARTITION BY qid ORDER BY part, pos ROWS UNBOUNDED PRECEDING))""",
    )
    + "SELECT qid, rank, md5(fact) AS digest FROM fu WHERE used <= 4 * 1500",
)
def fact_recall(spark, sf):
    got = C.recall_facts(B.questions(spark, sf), facts(spark, sf), overlap_scorer(), 1500)
    return got.select("qid", "rank", F.md5("fact").alias("digest"))


@register(
    "recall_pairs",
    B.ctes(
        *_FIGS[:-2], FACTS,
        """it AS MATERIALIZED (SELECT 'facts' AS kind, seq::VARCHAR AS item, fact AS body FROM facts WHERE NOT pinned UNION ALL SELECT 'figures', caption, caption FROM cap)""",
        f"iw AS MATERIALIZED (SELECT kind, item, unnest({B.sql_alnum_set('body')}) AS w FROM it)",
        "dfs AS (SELECT kind, w, count(*) AS df FROM iw GROUP BY ALL)",
        f"""qn AS (SELECT item_id AS qid, {B.sql_alnum_set('text')} AS ws, len(ws) AS n FROM benchmark),
        qw AS (SELECT qid, unnest(ws) AS w, NEED AS need FROM qn WHERE n > 0)""".replace("NEED", _NEED),
        """pre AS (SELECT kind, qid, w FROM qw JOIN dfs USING (w)
            QUALIFY row_number() OVER (PARTITION BY kind, qid ORDER BY df, w) <= count(*) OVER (PARTITION BY kind, qid) - need + 1)""",
        "met AS (SELECT DISTINCT kind, qid, item FROM pre JOIN iw USING (kind, w))",
        f"reach AS (SELECT kind, count(*) AS n_kept FROM it CROSS JOIN benchmark q WHERE {B.sql_scorer('q.text', 'it.body')} >= {FLOOR} GROUP BY kind)",
    )
    + """SELECT i.kind, (SELECT count(*) FROM benchmark) * i.n AS n_all, coalesce(m.n, 0) AS n_met, coalesce(r.n_kept, 0) AS n_kept
         FROM (SELECT kind, count(*) AS n FROM it GROUP BY kind) i LEFT JOIN (SELECT kind, count(*) AS n FROM met GROUP BY kind) m USING (kind)
         LEFT JOIN reach r USING (kind)""",
)
def recall_pairs(spark, sf):
    """Pairs there are, pairs that met and pairs that reached the floor, for facts and for figure captions."""
    asked, scorer = B.questions(spark, sf), overlap_scorer()
    captions = D.linked_figures(spark, sf).join(_owned(spark, sf).withColumnRenamed("source", "doc_name"), "doc_name")
    kinds = {
        "facts": (facts(spark, sf).where("not pinned"), "fact", "seq"),
        "figures": (captions.select("user", "caption").distinct(), "caption", "caption"),
    }
    out = None
    for kind, (items, text, key) in kinds.items():
        met = candidate_pairs(asked, items, text, scorer, FLOOR, key)
        kept = F.col("score") >= FLOOR
        pairs = met.agg(F.count(F.lit(1)).alias("n_met"), F.sum(kept.cast("long")).alias("n_kept"))
        sizes = items.groupBy("user").agg(F.count(F.lit(1)).alias("items")).join(
            asked.groupBy("user").agg(F.count(F.lit(1)).alias("asked")), "user"
        ).agg(F.sum(F.col("items") * F.col("asked")).alias("n_all"))
        # two tables of one row each
        row = sizes.withColumn("kind", F.lit(kind)).join(pairs.withColumn("kind", F.lit(kind)), "kind")
        row = row.select("kind", "n_all", "n_met", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
        out = row if out is None else out.unionByName(row)
    return out


_NEW_FACTS = f"""
newf AS (SELECT conv_id * 1000 + turn AS seq, {B.sql_strip("CASE WHEN turn % 2 = 0 THEN '  ' || translate(text, 'aeinrst', 'AEINRST') ELSE text END")} AS fact
         FROM conversations WHERE role <> 'system'),
keyed AS (SELECT *, {B.sql_casefold(B.sql_collapse('fact'))} AS key FROM newf WHERE fact <> ''),
stored AS (SELECT DISTINCT {B.sql_casefold(B.sql_collapse('text'))} AS key FROM conversations WHERE role <> 'assistant' AND conv_id % 2 = 0)
"""


@register(
    "fact_add",
    B.ctes(_NEW_FACTS)
    + """SELECT min(seq) AS seq, md5(arg_min(fact, seq)) AS digest FROM keyed
         WHERE key NOT IN (SELECT key FROM stored) GROUP BY key""",
)
def fact_add(spark, sf):
    stored = facts(spark, sf).where(F.floor(F.col("seq") / 1000) % 2 == 0)
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), F.translate("text", "aeinrst", "AEINRST"))).otherwise(F.col("text"))
    new = table(spark, sf, "conversations").where("role <> 'system'").select(
        B.owner("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), text.alias("fact")
    )
    return C.add_facts(stored, new).select("seq", F.md5("fact").alias("digest"))


@register(
    "fact_forget",
    B.ctes(FACTS) + "SELECT id, pinned FROM facts WHERE (seq % 1000) <> 1",
)
def fact_forget(spark, sf):
    f = facts(spark, sf)
    kept, _ = C.forget_facts(f, f.where(F.col("seq") % 1000 == 1).select("user", "id"))
    return kept.select("id", "pinned")


@register(
    "fact_pin",
    B.ctes(FACTS) + "SELECT id, CASE WHEN seq % 1000 = 2 THEN true ELSE pinned END AS pinned FROM facts",
)
def fact_pin(spark, sf):
    f = facts(spark, sf)
    ids = f.where(F.col("seq") % 1000 == 2).select("user", "id", F.lit(True).alias("pinned"))
    return C.set_pinned(f, ids).select("id", "pinned")


# ---- conversations ----------------------------------------------------------------------------


def turns(spark, sf):
    """Conversations regrouped three to one, so that some outgrow the history window."""
    return table(spark, sf, "conversations").where("role <> 'system'").select(
        F.floor(F.col("conv_id") / 4).alias("conv_id"), (F.col("conv_id") % 4 * 100 + F.col("turn")).alias("turn"),
        "role", "text",
    )


TURNS = """
turns AS (SELECT conv_id // 4 AS conv_id, conv_id % 4 * 100 + turn AS turn, role, text FROM conversations WHERE role <> 'system')
"""
_WINDOW = """
win AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
shown AS (SELECT * FROM win WHERE pos >= greatest(0, floor((n - 8) / 8.0) * 8))
"""


@register("history_window", B.ctes(TURNS, _WINDOW) + "SELECT conv_id, turn, role FROM shown")
def history_window(spark, sf):
    return V.history_window(turns(spark, sf)).select("conv_id", "turn", "role")


_HISTORY = """SELECT c.conv_id, md5(coalesce((SELECT string_agg(CASE role WHEN 'user' THEN 'Student: ' ELSE 'Tutor: ' END || text, chr(10) ORDER BY turn)
       FROM shown s WHERE s.conv_id = c.conv_id), 'None yet.')) AS digest FROM (SELECT DISTINCT conv_id // 4 AS conv_id FROM conversations) c"""


@register("history_text", B.ctes(TURNS, _WINDOW) + _HISTORY)
def history_text(spark, sf):
    return V.history_text(_convs(spark, sf), V.history_window(turns(spark, sf))).select("conv_id", F.md5("history").alias("digest"))


def _convs(spark, sf):
    return table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 4).alias("conv_id")).distinct()


@register(
    "history_text_terminal",
    B.ctes(TURNS, "shown AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12)") + _HISTORY,
)
def history_text_terminal(spark, sf):
    return V.history_text(_convs(spark, sf), V.last_turns(turns(spark, sf))).select("conv_id", F.md5("history").alias("digest"))


_ANA = "[" + ", ".join(f"'{w}'" for w in T.ANAPHORS) + "]"
_REWRITE = f"""
seen AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS prior, count(*) OVER w AS n_before
         FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, {B.sql_question_words('text')} AS ws, {B.sql_strip(f"substr({B.sql_collapse("coalesce(prior, '')")}, 1, 200)")} AS borrowed
         FROM seen WHERE role = 'user'),
follow AS (SELECT *, n_before > 0 AND len(ws) > 0 AND (len(ws) <= 6 OR list_has_any(ws, {_ANA})) AS follow_up FROM flagged),
rew AS (SELECT conv_id, turn, text, follow_up, follow_up AND borrowed <> '' AS fired,
         CASE WHEN follow_up AND borrowed <> '' THEN text || ' ' || borrowed ELSE text END AS query FROM follow)
"""


@register(
    "query_rewrite",
    B.ctes(TURNS, _REWRITE) + "SELECT conv_id, turn, follow_up, fired, md5(query) AS digest FROM rew",
)
def query_rewrite(spark, sf):
    return V.rewrite_queries(turns(spark, sf)).select(
        "conv_id", "turn", "follow_up", "fired", F.md5("query").alias("digest")
    )


def image_turns(spark, sf):
    """Every third turn of a conversation is a picture; user turns ask for one in various ways."""
    kind = F.when(F.col("turn") % 3 == 1, "image").otherwise("text")
    return turns(spark, sf).withColumn("type", kind)


def image_messages(spark, sf):
    ask = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("the photo "), F.col("text")))
        .when(F.col("turn") % 4 == 1, F.lit("what about the picture before that"))
        .when(F.col("turn") % 4 == 2, F.lit("that image"))
        .otherwise(F.col("text"))
    )
    return turns(spark, sf).where("role = 'user'").select("conv_id", "turn", ask.alias("text")).withColumn(
        "query", F.col("text")
    )


_IMG = [
    TURNS,
    """msg AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'the photo ' || text WHEN 1 THEN 'what about the picture before that'
         WHEN 2 THEN 'that image' ELSE text END AS text FROM turns WHERE role = 'user')""",
    f"mw AS (SELECT *, {B.sql_question_words('text')} AS ws FROM msg)",
    """ask AS (SELECT *, list_has_any(ws, ['photo','picture','image','pic','snapshot']) AS img,
        CASE WHEN list_has_any(ws, ['before','previous','earlier','last']) THEN 1 ELSE 0 END AS off,
        len(list_filter(ws, lambda w: NOT list_contains(list_concat(['photo','picture','image','pic','snapshot','before','previous','earlier','last'], """
    + _ANA + """), w))) > 0 AS described FROM mw)""",
    f"""cand AS (SELECT a.conv_id, a.turn, a.off, a.described, t.turn AS pos, t.text AS cap, {B.sql_scorer('a.text', 't.text')} AS score,
        row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY t.turn DESC) - 1 AS back, count(*) OVER (PARTITION BY a.conv_id, a.turn) AS n
        FROM ask a JOIN turns t ON t.conv_id = a.conv_id AND t.turn < a.turn AND t.turn % 3 = 1 WHERE a.img)""",
    f"""pick AS (SELECT conv_id, turn, CASE WHEN max(n) > 1 AND bool_or(described) AND max(score) >= {FLOOR}
        THEN arg_max(cap, score * 1000000 - pos / 10000) ELSE max(CASE WHEN back = off THEN cap END) END AS cap FROM cand GROUP BY ALL)""",
]


@register(
    "image_references",
    B.ctes(*_IMG)
    + """SELECT m.conv_id, m.turn, md5(p.cap) AS caption, md5(CASE WHEN p.cap IS NOT NULL AND NOT contains(m.text, p.cap)
         THEN substr(m.text || ' ' || p.cap, 1, 1000) ELSE m.text END) AS query FROM msg m LEFT JOIN pick p USING (conv_id, turn)""",
)
def image_references(spark, sf):
    got = V.resolve_images(image_messages(spark, sf), image_turns(spark, sf), overlap_scorer())
    return got.select("conv_id", "turn", F.md5("image_caption").alias("caption"), F.md5("query").alias("query"))


@register(
    "clean_history",
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 7 = 5 THEN '  ' ELSE text END AS text, role = 'assistant' AND (conv_id + turn) % 5 = 0 AS failed
          FROM conversations WHERE role <> 'system'),
       n AS (SELECT *, NOT failed AND trim(text) <> '' AS ok, lead(role) OVER w AS nr, lead(NOT failed AND trim(text) <> '') OVER w AS nok
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       SELECT conv_id, turn, role FROM n WHERE (role = 'assistant' AND ok) OR (role = 'user' AND nr = 'assistant' AND nok)""",
)
def clean_history(spark, sf):
    t = table(spark, sf, "conversations").where("role <> 'system'").withColumns(
        {
            "failed": (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0),
            "text": F.when(F.col("turn") % 7 == 5, "  ").otherwise(F.col("text")),
        }
    )
    return V.clean_history(t).select("conv_id", "turn", "role")


def answered(spark, sf):
    """User turns with the assistant turn that follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("reply", F.lead("text").over(w))
    return t.where("role = 'user' AND reply IS NOT NULL").select("conv_id", "turn", "text", "reply")


ANSWERED = """
answered AS (SELECT * FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)
             WHERE role = 'user' AND reply IS NOT NULL)
"""


@register(
    "question_echo",
    B.ctes(ANSWERED)
    + f"""SELECT conv_id, turn, md5(CASE WHEN (conv_id + turn) % 2 = 0 AND length({B.sql_strip('text')}) >= 20
          THEN ltrim(reply, ' .:' || chr(10)) WHEN (conv_id + turn) % 2 = 0 THEN upper(text) || ' :' || chr(10) || reply ELSE reply END) AS digest FROM answered""",
)
def question_echo(spark, sf):
    """Half of the replies open with a copy of the question in capitals."""
    copy = F.concat(F.upper("text"), F.lit(" :\n"), F.col("reply"))
    said = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, copy).otherwise(F.col("reply"))
    return answered(spark, sf).select("conv_id", "turn", F.md5(V.strip_question_echo(F.col("text"), said)).alias("digest"))


def _program(c):
    return F.concat(F.lit("```python\nprint("), F.length(c).cast("string"), F.lit(")\n```\n"))


@register(
    "hidden_code",
    B.ctes(ANSWERED)
    + """SELECT conv_id, turn, md5(text || chr(10) || reply || chr(10) || '```text' || chr(10) || 'table' || chr(10) || '```' || chr(10)) AS digest FROM answered""",
)
def hidden_code(spark, sf):
    said = F.concat(F.col("text"), F.lit("\n"), _program(F.col("text")), F.col("reply"),
                    F.lit("\n```text\ntable\n```\n``` Py \nunfinished("), F.col("text"))
    return answered(spark, sf).select("conv_id", "turn", F.md5(V.hide_python_blocks(said)).alias("digest"))


@register(
    "pending_programs",
    B.ctes(ANSWERED)
    + """SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'print(' || length(text) || ')' END AS program FROM answered""",
)
def pending_programs(spark, sf):
    """Transcripts ending in a program, in prose after one, or in an unfinished one."""
    closed = F.concat(F.col("reply"), F.lit("\n"), _program(F.col("reply")), _program(F.col("text")))
    said = F.when(F.col("turn") % 4 == 1, F.concat(closed, F.lit("  \n"))).when(
        F.col("turn") % 4 == 2, F.concat(closed, F.lit("so it is 4"))
    ).otherwise(F.concat(F.col("reply"), F.lit("```python\nprint("), F.col("text")))
    return answered(spark, sf).select("conv_id", "turn", V.pending_program(said).alias("program"))


@register(
    "tool_call_audit",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'unknown' WHEN 2 THEN 'json' WHEN 3 THEN 'object' WHEN 4 THEN 'needs'
         WHEN 5 THEN 'empty' ELSE 'ok' END AS outcome, CASE event_id % 7 WHEN 0 THEN '{"query":"' || event_type || '"}' WHEN 6 THEN '{}' END AS clean_args
       FROM events""",
)
def tool_call_audit(spark, sf):
    r = F.col("event_id") % 7
    tool = F.when(r == 1, F.col("event_type")).when(r.isin(4, 5), "run_python").when(r == 6, "list_documents").otherwise("search_documents")
    args = (
        F.when(r == 0, F.to_json(F.struct(F.col("event_type").alias("query"))))
        .when(r == 2, F.concat(F.lit('{"query": '), F.col("event_type")))
        .when(r == 3, F.lit('["a"]'))
        .when(r == 4, F.col("props"))
        .when(r == 5, F.lit('{"code": "  "}'))
    )
    audited = V.audit_tool_calls(table(spark, sf, "events").select("event_id", tool.alias("tool"), args.alias("args")))
    reason = F.col("reason")
    outcome = (
        F.when(reason.isNull(), "ok").when(reason.startswith("There is no tool"), "unknown")
        .when(reason.contains("not valid JSON"), "json").when(reason.contains("must be an object"), "object")
        .when(reason.contains("it needs a"), "needs").when(reason.contains("was empty"), "empty")
    )
    return audited.select("event_id", outcome.alias("outcome"), "clean_args")

"""Registered queries: chunks, text shapes, ids, as-of lookups and source scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.markup import normalize_markup
from folioscope.operators import chunking as K
from folioscope.operators import context as C
from folioscope.operators import ordering as O
from folioscope.plans import bindings as B
from folioscope.plans.registry import register, table
from folioscope.sources import readers as R

WS = B.WS


def docs(spark, sf):
    return table(spark, sf, "documents")


def with_math(c):
    """Prose with every first comma turned into an inline and every first full stop into a display equation."""
    return F.regexp_replace(F.regexp_replace(c, r", ", r" \$x_1 + y\$ "), r"\.\n", ".\n\\$\\$\\\\frac{a}{b}\n= c\\$\\$\n")


def doc_rows(spark, sf, math=False):
    text = with_math(F.col("text")) if math else F.col("text")
    paged = F.concat(F.lit("<!-- page:1 -->"), F.regexp_replace(text, r"\n", "\n<!-- page:2 -->\n"))
    return docs(spark, sf).select(
        B.owner("doc_id"), F.concat(F.lit("lib/"), F.col("source"), F.lit(".mmd")).alias("source"),
        F.col("doc_id").alias("doc_pos"), (paged if math else text).alias("text"),
    )


def _chunk_rows(chunks):
    return chunks.select("source", "ord", "n", "chunk_id", "page", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@register("chunks_baseline")
def chunks_baseline(spark, sf):
    return _chunk_rows(K.chunk_documents(doc_rows(spark, sf), "baseline"))


@register("chunks_eqaware")
def chunks_eqaware(spark, sf):
    return _chunk_rows(K.chunk_documents(doc_rows(spark, sf, True), "eqaware"))


@register("chunks_eqaware_context")
def chunks_eqaware_context(spark, sf):
    return _chunk_rows(K.chunk_documents(doc_rows(spark, sf, True), "eqaware_context"))


@register(
    "chunk_ids",
    B.ctes(B.CHUNKS) + "SELECT ord, n, chunk_id FROM chunks",
)
def chunk_ids(spark, sf):
    return B.chunks_with_ids(spark, sf).select("ord", "n", "chunk_id")


@register(
    "chunk_id_fallback",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'legacy::' || substr(text, 1, 120) ELSE source || '#' || doc_id END AS id
       FROM documents""",
)
def chunk_id_fallback(spark, sf):
    stored = F.when(F.col("doc_id") % 3 != 0, F.concat_ws("#", "source", "doc_id"))
    return docs(spark, sf).select("doc_id", T.chunk_id_of(stored, F.col("text")).alias("id"))


@register(
    "sentences",
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|\\S[^.!?\\n]*$'),
          lambda x: {B.sql_strip('x')}), lambda x: x <> '') AS ss FROM documents)
        SELECT doc_id, len(ss) AS n, coalesce(list_max(list_transform(ss, lambda x: length(x))), 0)::INTEGER AS longest,
               ss[1] AS first, ss[-1] AS last FROM s""",
)
def sentences(spark, sf):
    ss = T.sentences(F.col("text"))
    return docs(spark, sf).select("doc_id", ss.alias("ss")).select(
        "doc_id", F.size("ss").alias("n"),
        F.coalesce(F.array_max(F.transform("ss", F.length)), F.lit(0)).alias("longest"),
        F.try_element_at("ss", F.lit(1)).alias("first"), F.try_element_at("ss", F.lit(-1)).alias("last"),
    )


_MATH_SQL = r"""m AS (SELECT doc_id, regexp_replace(regexp_replace(text, ', ', ' $x_1 + y$ ', 'g'), '\.\n',
       '.' || chr(10) || '$$\\frac{a}{b}' || chr(10) || '= c$$' || chr(10), 'g') AS text FROM documents)"""


@register(
    "equation_segments",
    B.ctes(_MATH_SQL)
    + r"""SELECT doc_id, len(regexp_extract_all(text, '(?s)\$\$.*?\$\$|\$[^$\n]+?\$')) AS n_equations,
          length(regexp_replace(text, '(?s)\$\$.*?\$\$|\$[^$\n]+?\$', '', 'g')) AS prose_chars,
          length(text) AS all_chars FROM m""",
)
def equation_segments(spark, sf):
    segs = docs(spark, sf).select(
        "doc_id", T.equation_segments(with_math(F.col("text"))).alias("s")
    )
    chars = lambda kind: F.aggregate(
        F.filter("s", lambda x: x["kind"].isin(*kind)), F.lit(0), lambda a, x: a + F.length(x["span"])
    )
    return segs.select(
        "doc_id", F.size(F.filter("s", lambda x: x["kind"] == "eq")).alias("n_equations"),
        chars(["prose"]).alias("prose_chars"), chars(["prose", "eq"]).alias("all_chars"),
    )


@register(
    "page_markers",
    r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        e AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM p)
        SELECT doc_id, i AS page, list_sum(list_transform(parts[1:i], lambda x: length(x)))::INTEGER AS "offset" FROM e""",
)
def page_markers(spark, sf):
    """Line breaks of a document stand in for page breaks: line i ends page i."""
    lines = F.split(F.col("text"), "\n")
    marked = F.array_join(
        F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("{"), i.cast("string"), F.lit("}-----"), x))), ""
    )
    text = T.page_breaks_to_markers(marked)
    return docs(spark, sf).select("doc_id", F.explode(T.page_markers(text)).alias("m")).select(
        "doc_id", "m.page", "m.offset"
    )


@register(
    "pages_at_offsets",
    r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        e AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM p),
        m AS (SELECT doc_id, max(i) AS page, list_sum(list_transform(parts[1:i], lambda x: length(x))) AS off
              FROM e GROUP BY doc_id, list_sum(list_transform(parts[1:i], lambda x: length(x)))),
        l AS (SELECT doc_id AS doc, unnest(range(0, length(text), 400)) AS "offset" FROM documents)
        SELECT l.doc, l."offset"::INTEGER AS "offset", m.page FROM l ASOF LEFT JOIN m ON l.doc = m.doc_id AND l."offset" >= m.off""",
)
def pages_at_offsets(spark, sf):
    marks = page_markers(spark, sf).select(F.col("doc_id").alias("doc"), "offset", "page", F.col("page").alias("seq"))
    grid = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(400))
    located = docs(spark, sf).where(F.length("text") > 0).select(
        F.col("doc_id").alias("doc"), F.explode(grid).alias("offset")
    )
    return K.pages_at_offsets(located, marks)


@register(
    "page_from_name",
    r"""SELECT page_id, TRY_CAST(nullif(regexp_extract('fig_page_' || regexp_extract(url, '(\d+)[^0-9]*$', 1) || '_x.png', 'page_(\d+)', 1), '') AS INTEGER) AS page FROM pages""",
)
def page_from_name(spark, sf):
    name = F.concat(F.lit("fig_page_"), F.regexp_extract("url", r"(\d+)[^0-9]*$", 1), F.lit("_x.png"))
    return table(spark, sf, "pages").select("page_id", T.page_of_file(name).alias("page"))


_UPSERT_SQL = """
old AS (SELECT source || '::' || (doc_id % 50) AS chunk_id, doc_id AS ord, text FROM documents WHERE lang = 'en'),
new AS (SELECT source || '::' || (doc_id % 50) AS chunk_id, doc_id AS ord, text FROM documents WHERE lang <> 'en'),
every AS (SELECT * FROM old UNION ALL
          SELECT chunk_id, row_number() OVER (ORDER BY ord) + (SELECT max(ord) FROM old), text FROM new)
"""


@register(
    "chunk_upsert",
    B.ctes(_UPSERT_SQL)
    + "SELECT chunk_id, min(ord) AS ord, md5(arg_max(text, ord)) AS digest FROM every GROUP BY chunk_id",
)
def chunk_upsert(spark, sf):
    rows = docs(spark, sf).select(
        B.owner("doc_id"), F.concat_ws("::", "source", F.col("doc_id") % 50).alias("chunk_id"),
        F.col("doc_id").alias("ord"), "text", "lang",
    )
    old, new = rows.where("lang = 'en'").drop("lang"), rows.where("lang <> 'en'").drop("lang")
    return K.merge_chunks(old, new).select("chunk_id", "ord", F.md5("text").alias("digest"))


@register(
    "chunk_dedupe",
    """SELECT source || '::' || (doc_id % 20) AS chunk_id, min(doc_id) AS ord, md5(arg_max(text, doc_id)) AS digest
       FROM documents GROUP BY 1""",
)
def chunk_dedupe(spark, sf):
    rows = docs(spark, sf).select(
        B.owner("doc_id"), F.concat_ws("::", "source", F.col("doc_id") % 20).alias("chunk_id"),
        F.col("doc_id").alias("ord"), "text",
    )
    return K.latest_by_id(rows).select("chunk_id", "ord", F.md5("text").alias("digest"))


MARKUP_SIGNS = "\\${}~"


@register(
    "markup_normalized",
    f"""SELECT doc_id, md5(trim(regexp_replace(replace({B.sql_collapse("translate(text, '" + MARKUP_SIGNS + "', '     ')")}, ', ', ' √(x)/2 ≤ α '), '[{WS}]+', ' ', 'g'))) AS digest
        FROM documents""",
)
def markup_normalized(spark, sf):
    """Known markup in every document: signs of its own become blanks, commas become a formula."""
    plain = F.translate("text", MARKUP_SIGNS, " " * len(MARKUP_SIGNS))
    raw = F.replace(T.collapse_ws(plain), F.lit(", "), F.lit(r" $\frac{\sqrt{x}}{2}$ \leq \alpha "))
    return docs(spark, sf).select("doc_id", F.md5(normalize_markup(raw)).alias("digest"))


@register("markup_normalized_all")
def markup_normalized_all(spark, sf):
    """Every document as it is; SQL has no loop for nested groups."""
    return docs(spark, sf).select("doc_id", F.md5(normalize_markup(F.col("text"))).alias("digest"))


@register(
    "tokenizers",
    f"""SELECT doc_id, len({B.sql_ws_tokens('text')}) AS ws, len({B.sql_alnum_set('text')}) AS alnum,
          len({B.sql_content_words('text')}) AS content, len({B.sql_question_words('text')}) AS question,
          md5({B.sql_casefold(B.sql_collapse('text'))}) AS near_dup
        FROM documents""",
)
def tokenizers(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", F.size(T.ws_tokens(t)).alias("ws"), F.size(T.alnum_set(t)).alias("alnum"),
        F.size(T.content_words(t)).alias("content"), F.size(T.question_words(t)).alias("question"),
        F.md5(T.near_dup_key(t)).alias("near_dup"),
    )


def figures(spark, sf):
    """Pages as figures of the document source their number maps to, on the page of their number."""
    return table(spark, sf, "pages").select(
        F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("doc_name"),
        F.when(F.col("page_id") % 7 != 0, (F.col("page_id") * 37 % 300).cast("int")).alias("page"),
        F.concat_ws("::img", F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")), F.col("page_id")).alias("image_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"),
        F.col("page_id").alias("seq"),
    )


FIGURES = """
figures AS (SELECT 'src' || (page_id % 20) AS doc_name, CASE WHEN page_id % 7 <> 0 THEN (page_id * 37 % 300)::INTEGER END AS page,
       'src' || (page_id % 20) || '::img' || page_id AS image_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS caption,
       page_id AS seq FROM pages)
"""


def paged_chunks(spark, sf):
    """A document counts as a chunk on page n // 2; every fifth one has no page."""
    c = B.chunks_with_ids(spark, sf)
    return c.withColumn("page", F.when(F.col("ord") % 5 != 0, F.floor(F.col("n") / 2 + 3).cast("int")))


PAGED = """paged AS (SELECT *, CASE WHEN ord % 5 <> 0 THEN floor(n / 2.0 + 3)::INTEGER END AS page FROM chunks)"""
NEARBY = """
nearby AS (SELECT f.*, CASE WHEN f.page IS NULL THEN NULL ELSE coalesce(
    (SELECT arg_max(c.chunk_id, c.page * 1000000 + c.n) FROM paged c WHERE c.source = f.doc_name AND c.page <= f.page),
    (SELECT arg_min(c.chunk_id, c.page * 1000000 + c.n) FROM paged c WHERE c.source = f.doc_name AND c.page IS NOT NULL)) END
    AS nearby_chunk_id FROM figures f)
"""


def linked_figures(spark, sf):
    return K.nearest_page_chunk(figures(spark, sf), paged_chunks(spark, sf))


@register(
    "figure_nearest_chunk",
    B.ctes(B.CHUNKS, PAGED, FIGURES, NEARBY) + "SELECT image_id, page, nearby_chunk_id FROM nearby",
)
def figure_nearest_chunk(spark, sf):
    return linked_figures(spark, sf).select("image_id", "page", "nearby_chunk_id")


@register(
    "asof_last_view",
    """WITH v AS (SELECT user_id, floor(epoch(ts))::BIGINT AS at, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL),
       p AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS at FROM events WHERE event_type = 'purchase')
       SELECT p.event_id, p.user_id, p.at, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.at >= v.at""",
)
def asof_last_view(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.unix_timestamp("ts"))
    views = e.where("event_type = 'view'").groupBy("user_id", "at").agg(F.max("event_id").alias("view_id"))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    return O.asof_backward(buys, views, ["user_id"], "at", "view_id", width=86_400)


@register(
    "user_names",
    """WITH u AS (SELECT c_custkey, lower(trim('  ' || replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE ' ' END) || ' ')) AS name FROM customer)
       SELECT c_custkey, CASE WHEN regexp_full_match(name, '[a-z0-9_-]*[a-z0-9]') THEN name END AS name FROM u""",
)
def user_names(spark, sf):
    sep = F.when(F.col("c_custkey") % 2 == 0, "-").otherwise(" ")
    raw = F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), sep), F.lit(" "))
    return table(spark, sf, "customer").select("c_custkey", C.normalize_user(raw).alias("name"))


@register(
    "index_summary",
    """SELECT lang AS "user", count(*) AS n_chunks, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
       FROM documents GROUP BY lang""",
)
def index_summary(spark, sf):
    c = docs(spark, sf).select(F.col("lang").alias("user"), "source")
    return C.index_summary(c).withColumn("sources", F.array_join("sources", ","))


@register(
    "user_isolated_summary",
    """SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source""",
)
def user_isolated_summary(spark, sf):
    c = docs(spark, sf).select(F.col("lang").alias("user"), "source")
    return C.of_user(c, " EN ").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def log_lines(spark, sf):
    """Events as JSON lines; error rows are cut mid-line and signup rows are blank."""
    whole = F.to_json(F.struct(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.lit("query").alias("kind"),
        F.col("event_type").alias("mode"),
    ))
    line = F.when(F.col("event_type") == "error", F.substring(whole, 1, 25)).when(
        F.col("event_type") == "signup", "  "
    ).otherwise(whole)
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), line.alias("value"))


@register(
    "tolerant_jsonl",
    """SELECT 'e' || event_id AS event_id, 'query' AS kind, event_type AS mode FROM events
       WHERE event_type NOT IN ('error', 'signup')""",
)
def tolerant_jsonl(spark, sf):
    return R.parse_jsonl(log_lines(spark, sf), "event_id string, kind string, mode string", ["event_id"]).drop("pos")


@register(
    "log_tail",
    """SELECT pos, 'e' || pos AS event_id FROM (SELECT event_id AS pos, event_type FROM events ORDER BY event_id DESC LIMIT 500)
       WHERE event_type NOT IN ('error', 'signup')""",
)
def log_tail(spark, sf):
    return R.tail_events(log_lines(spark, sf), 500, "event_id string, kind string").select("pos", "event_id")


@register(
    "raw_figures",
    """SELECT 'p' || page_id AS doc_name, 0 AS n, 1 AS page, md5(url) AS digest FROM pages
       UNION ALL SELECT 'p' || page_id, 2, NULL, md5(html) FROM pages""",
)
def raw_figures(spark, sf):
    """Three entries per page; the middle one is not base64."""
    entry = lambda page, b64: F.struct(page.cast("int").alias("page"), b64.alias("bytes_b64"))
    files = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_name"),
        F.to_json(F.array(
            entry(F.lit(1), F.base64(F.encode("url", "UTF-8"))),
            entry(F.lit(1), F.lit("*** not base64 ***")),
            entry(F.lit(None), F.base64(F.encode("html", "UTF-8"))),
        )).alias("json"),
    )
    return R.raw_figures(files).select("doc_name", "n", "page", F.md5("bytes").alias("digest"))

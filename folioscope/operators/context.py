"""From ranked chunks to what an answer may cite: isolation, floors, context blocks, footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.ordering import top_k
from folioscope.operators.recall import floor_pairs
from folioscope.session import join_items

RELEVANCE_FLOOR = 0.15
PREVIEW_CHARS = 200
RESULT_BUDGET = 1200

NO_RESULTS = (
    "No chunk of this user's documents fits the question. Rephrase it, or answer without sources and say so."
)


# ---- users ------------------------------------------------------------------------------------


def normalize_user(c: Column) -> Column:
    """Lower-cased, stripped user name; null where the name is not usable as a partition."""
    name = F.lower(T.strip(c))
    return F.when(name.rlike(r"\A[a-z0-9_-]*[a-z0-9]\z"), name)


def of_user(df: DataFrame, user: str) -> DataFrame:
    """Rows of one user; on a table partitioned by user this prunes to one folder."""
    return df.where(F.col("user") == normalize_user(F.lit(user)))


def index_summary(chunks: DataFrame) -> DataFrame:
    """Chunk count and sorted source names per user; sources are made distinct before they are listed."""
    per_source = chunks.groupBy("user", T.basename(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_source.groupBy("user").agg(
        F.sum("n").alias("n_chunks"), F.array_sort(F.collect_list("source")).alias("sources")
    )


# ---- sources ----------------------------------------------------------------------------------


def to_sources(results: DataFrame, preview: int = PREVIEW_CHARS) -> DataFrame:
    """Ranked results with text → the citation columns ``source, chunk_id, score, preview``."""
    return results.withColumns(
        {
            "source": T.basename(F.coalesce("source", F.lit("unknown"))),
            "chunk_id": T.chunk_id_of(F.col("chunk_id"), F.col("text")),
            "score": F.col("score").cast("double"),
            "preview": F.substring("text", 1, preview),
        }
    ).drop("text")


def console_preview(text: Column) -> Column:
    return T.one_line(text, 150)


def merge_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new(qid, rank, chunk_id, ..)`` rows whose id the question has not cited yet.

    No re-sorting; a repeat within ``new`` itself stays.
    """
    ends = existing.groupBy("qid").agg(F.max("rank").alias("_end"))
    fresh = new.join(existing.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"], "left_anti")
    w = W.partitionBy("qid").orderBy("rank")
    appended = (
        fresh.join(ends, "qid", "left")
        .withColumn("rank", F.row_number().over(w) + F.coalesce("_end", F.lit(0)))
        .drop("_end")
    )
    return existing.unionByName(appended)


def select_context(results: DataFrame, floor: float = RELEVANCE_FLOOR) -> DataFrame:
    """Results whose own score clears the floor."""
    return results.where(F.col("score") >= floor)


def answer_mode(questions: DataFrame, kept: DataFrame, indexed_users: DataFrame) -> DataFrame:
    """``grounded`` where the user has an index and at least one kept chunk, else ``general``."""
    counts = kept.groupBy("user", "qid").agg(F.count(F.lit(1)).alias("n_kept"))
    owners = indexed_users.select("user").distinct().withColumn("_indexed", F.lit(True))
    grounded = (F.coalesce("n_kept", F.lit(0)) > 0) & F.coalesce("_indexed", F.lit(False))
    return (
        questions.join(counts, ["user", "qid"], "left")
        .join(owners, "user", "left")
        .select("user", "qid", F.when(grounded, "grounded").otherwise("general").alias("mode"),
                F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
    )


def ordered(values: Column, *order: str) -> Column:
    """``values`` of a small group as an array in the order of the given columns."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, values.alias("_v"))))
    return F.transform(pairs, lambda p: p["_v"])


def plain_context(results: DataFrame) -> DataFrame:
    """``[Source: x]`` blocks of each question joined by blank lines."""
    block = F.concat(F.lit("[Source: "), T.basename(F.col("source")), F.lit("]\n"), F.col("text"))
    return results.groupBy("qid").agg(F.array_join(ordered(block, "rank"), "\n\n").alias("context"))


def build_context(modes: DataFrame, kept: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Context block per question: kept chunks in rank order, then figures; empty in general mode.

    ``modes(qid, mode)``, ``kept(qid, rank, source, text)``, ``figures(qid, rank, doc_name, page, caption)``.
    """
    blocks = kept.select(
        "qid", F.lit(0).alias("part"), "rank",
        F.concat(F.lit("[Source: "), T.basename(F.col("source")), F.lit("]\n"), F.col("text")).alias("block"),
    )
    if figures is not None:
        where = F.concat(
            F.coalesce("doc_name", F.lit("unknown")),
            F.coalesce(F.concat(F.lit(", page "), F.col("page").cast("string")), F.lit("")),
        )
        blocks = blocks.unionByName(
            figures.select(
                "qid", F.lit(1).alias("part"), "rank",
                F.concat(F.lit("[Figure: "), where, F.lit("]\n"), F.coalesce("caption", F.lit(""))).alias("block"),
            )
        )
    parts = blocks.groupBy("qid").agg(ordered(F.col("block"), "part", "rank").alias("_parts"))
    head = F.array(F.lit("Context from your documents:"), F.lit(""))
    body = F.array_join(F.concat(head, F.coalesce("_parts", F.array().cast("array<string>"))), "\n\n")
    return modes.join(parts, "qid", "left").select(
        *modes.columns,
        F.when(F.col("mode") == "grounded", F.concat(body, F.lit("\n\n"))).otherwise("").alias("context"),
    )


def sources_footer(modes: DataFrame, sources: DataFrame) -> DataFrame:
    """``_Sources: a, b_`` line in rank order; empty in general mode or without sources."""
    names = sources.groupBy("qid").agg(F.array_distinct(ordered(F.col("source"), "rank")).alias("_names"))
    return modes.join(names, "qid", "left").select(
        *modes.columns,
        F.when(
            (F.col("mode") == "grounded") & F.col("_names").isNotNull(),
            F.concat(F.lit("\n\n_Sources: "), F.array_join("_names", ", "), F.lit("_")),
        ).otherwise("").alias("footer"),
    )


def search_result_text(questions: DataFrame, passages: DataFrame, n_total: str = "n_total") -> DataFrame:
    """Budgeted passage list per question: the budget is split evenly, longer bodies end at a word."""
    share = F.floor(F.lit(RESULT_BUDGET) / F.count(F.lit(1)).over(W.partitionBy("qid"))).cast("int")
    cut = (
        passages.withColumn("_budget", share)
        .withColumn("_body", T.strip(F.col("text")))
        .withColumn("_head", F.expr("substring(_body, 1, _budget)"))
        .withColumn(
            "_body",
            F.when(
                F.length("_body") > F.col("_budget"),
                # everything after the last space goes; a body without one stays whole
                F.concat(F.regexp_replace("_head", r"(?s)\A(.*) [^ ]*\z", "$1"), F.lit(" …")),
            ).otherwise(F.col("_body")),
        )
    )
    block = F.concat(F.lit("[Source: "), F.col("source"), F.lit("]\n"), F.col("_body"))
    listed = cut.groupBy("qid").agg(ordered(block, "rank").alias("_blocks"))
    n = F.col(n_total)
    head = F.concat(n.cast("string"), F.lit(" passage"), F.when(n != 1, "s").otherwise(""), F.lit(" found:"))
    return questions.join(listed, "qid", "left").select(
        "qid",
        F.when(
            F.col("_blocks").isNotNull(), F.concat(head, F.lit("\n\n"), F.array_join("_blocks", "\n\n"))
        ).otherwise(NO_RESULTS).alias("reply"),
    )


# ---- figures and facts ------------------------------------------------------------------------

MAX_FIGURES = 3
MAX_FACTS = 5
CHARS_PER_TOKEN = 4


def recall_figures(
    questions: DataFrame, figures: DataFrame, owned: DataFrame, scorer, floor: float = RELEVANCE_FLOOR,
    limit: int = MAX_FIGURES,
) -> DataFrame:
    """Best figures per question among the user's documents, by caption.

    ``questions(user, qid, text)``, ``figures(image_id, doc_name, page, caption, seq, ..)``,
    ``owned(user, source)``. Figures with equal captions all resolve to the last record.
    """
    mine = figures.join(owned.select("user", F.col("source").alias("doc_name")).distinct(), "doc_name")
    per_caption = mine.groupBy("user", "caption").agg(
        F.max_by(F.struct("image_id", "doc_name", "page", "nearby_chunk_id"), "seq").alias("_rec"),
        F.count(F.lit(1)).alias("_copies"), F.min("seq").alias("_first"),
    )
    pairs = floor_pairs(questions, per_caption, "caption", scorer, floor, "caption")
    # a repeated caption can fill every place, but never more than ``limit`` of them
    kept = pairs.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("_copies"), F.lit(limit)).cast("int")))
    )
    best = top_k(kept, ["user", "qid"], [F.col("score").desc(), F.col("_first"), F.col("_copy")], limit)
    return best.select("user", "qid", "rank", "_rec.*", "caption", "score")


def figures_near(recalled: DataFrame, selected: DataFrame, figures: DataFrame) -> DataFrame:
    """Recalled figures first, then those sitting next to a selected chunk; one row per image."""
    near = selected.select("user", "qid", "rank", F.col("chunk_id").alias("nearby_chunk_id")).join(
        figures.select("image_id", "doc_name", "page", "caption", "nearby_chunk_id", "seq"), "nearby_chunk_id"
    )
    both = recalled.select("user", "qid", "image_id", "doc_name", "page", "caption",
                           F.lit(0).alias("part"), "rank", F.lit(0).cast("long").alias("seq")).unionByName(
        near.select("user", "qid", "image_id", "doc_name", "page", "caption", F.lit(1).alias("part"), "rank", "seq")
    )
    order = F.struct("part", "rank", "seq")
    once = both.groupBy("user", "qid", "image_id").agg(
        F.min_by(F.struct("doc_name", "page", "caption"), order).alias("_f"), F.min(order).alias("_at")
    )
    w = W.partitionBy("user", "qid").orderBy("_at")
    return once.select("user", "qid", F.row_number().over(w).alias("rank"), "image_id", "_f.*")


def recall_facts(
    questions: DataFrame, facts: DataFrame, scorer, budget_tokens: int, floor: float = RELEVANCE_FLOOR,
    limit: int = MAX_FACTS,
) -> DataFrame:
    """Facts to recall per question: pinned in stored order, then the best others, cut to the budget.

    ``facts(user, seq, fact, pinned)``. Without a scorer only pinned facts are recalled.
    """
    cap = max(0, budget_tokens) * CHARS_PER_TOKEN
    # a pinned fact past the cap-th line can never fit: only the first ``cap`` per user are summed, and of those
    # each question gets the ones that fit and the first that does not, after which nothing may follow
    head = top_k(facts.where("pinned"), ["user"], [F.col("seq")], max(1, cap), "_n")
    before = F.sum(F.length("fact") + 3).over(W.partitionBy("user").orderBy("_n").rowsBetween(W.unboundedPreceding, -1))
    head = head.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= cap).drop("_n", "_before")
    pinned = (
        join_items(questions.select("user", "qid"), head, "user", "seq")
        .select("user", "qid", F.lit(0).alias("part"), F.col("seq").alias("at"), "fact")
    )
    ordered_facts = pinned
    if scorer is not None:
        pairs = floor_pairs(questions, facts.where(~F.col("pinned")), "fact", scorer, floor, "seq")
        best = top_k(pairs, ["user", "qid"], [F.col("score").desc(), F.col("seq")], limit, "at")
        ordered_facts = pinned.unionByName(
            best.select("user", "qid", F.lit(1).alias("part"), F.col("at").cast("long").alias("at"), "fact")
        )
    return fit_budget(ordered_facts, cap)


def fit_budget(facts: DataFrame, cap: int) -> DataFrame:
    """Longest prefix whose ``- fact`` lines, newline-joined, fit ``cap`` characters.

    A line costs at least three characters, so only the first ``cap`` rows of a question can
    matter; they are picked before the running sum.
    """
    if cap <= 0:
        return facts.select("user", "qid", F.lit(0).alias("rank"), "fact").where(F.lit(False))
    head = top_k(facts, ["user", "qid"], [F.col("part"), F.col("at")], cap)
    w = W.partitionBy("user", "qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(F.length("fact") + 3).over(w) - 1
    return head.withColumn("_used", used).where(F.col("_used") <= cap).select("user", "qid", "rank", "fact")


def add_facts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new(user, seq, fact, ..)`` that are neither blank nor a near-duplicate of a stored
    or earlier new fact of the same user."""
    trimmed = new.withColumn("fact", T.strip(F.col("fact"))).where(F.col("fact") != "")
    keyed = trimmed.withColumn("_key", T.near_dup_key(F.col("fact")))
    payload = F.struct(*[c for c in trimmed.columns if c != "user"])
    firsts = keyed.groupBy("user", "_key").agg(F.min_by(payload, "seq").alias("_row"))
    known = existing.select("user", T.near_dup_key(F.col("fact")).alias("_key")).distinct()
    return firsts.join(known, ["user", "_key"], "left_anti").select("user", "_row.*").select(*new.columns)


def forget_facts(facts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts without the given ``(user, id)`` rows, those ids with whether anything matched)."""
    kept = facts.join(ids.select("user", "id"), ["user", "id"], "left_anti")
    known = facts.select("user", "id").distinct().withColumn("_hit", F.lit(True))
    report = ids.join(known, ["user", "id"], "left").select(
        "user", "id", F.coalesce("_hit", F.lit(False)).alias("matched")
    )
    return kept, report


def set_pinned(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with ``pinned`` replaced for the given ``(user, id, pinned)`` rows."""
    wanted = ids.select("user", "id", F.col("pinned").alias("_pinned"))
    return (
        facts.join(wanted, ["user", "id"], "left")
        .withColumn("pinned", F.coalesce("_pinned", "pinned"))
        .drop("_pinned")
        .select(*facts.columns)
    )

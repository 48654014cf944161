"""Building and auditing gold question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators.ordering import top_k
from folioscope.session import fits_broadcast

LEAK_THRESHOLD = 0.6
MAX_DF_RATIO = 0.10
MATH_SHARE = 0.7

# Phrasing that only makes sense while looking at the passage.
REFERENTIAL = (
    r"(?i)\b(this|the)\s+(passage|text|document|excerpt|benchmark|table|figure|plot|graph|chart|"
    r"paper|section|chapter|example|experiment|study|image)\b"
    r"|\bas (shown|described|given|seen|illustrated)\b"
    r"|\b(shown|described|given|illustrated|mentioned|listed) (in|above|below|here)\b"
    r"|\b(the )?(top|bottom|middle|left|right) (row|column|panel|plot|graph)\b"
    r"|\baccording to (the|this)\b"
)
# Heads of captions and of reference matter, years, sentence ends.
CAPTION_HEAD = r"\A\s*(figure|fig\.|table|exhibit|chart)\s*\d"
REFERENCE_HEAD = r"\A\s*(references|bibliography|index|contents|appendix)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
SENTENCE_END = r"[.!?]\s"


def corpus_words(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document frequency per content word, one-row chunk count)."""
    words = chunks.select(F.explode_outer(T.content_words(F.col("text"))).alias("word")).where("word IS NOT NULL")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), chunks.agg(F.count(F.lit(1)).alias("n_docs"))


def is_distinctive(df: Column, n_docs: Column, ratio: float = MAX_DF_RATIO) -> Column:
    """Found in few enough chunks; a word never seen (null ``df``) counts as distinctive."""
    return F.coalesce(df, F.lit(0)) <= F.greatest(F.lit(1), F.floor(n_docs * F.lit(ratio)))


def leak_scores(pairs: DataFrame, word_df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Share of a question's distinctive words lifted from its chunk, per ``pairs(id, question, chunk_text)``.

    Only the questions' words are looked up; the corpus vocabulary is filtered by them first.
    """
    # both word lists come before the explode, so that neither is rebuilt per word
    listed = pairs.select(
        "id", T.content_words(F.col("question")).alias("_asked"), T.content_words(F.col("chunk_text")).alias("_chunk")
    )
    asked = listed.select(
        "id", "_chunk", F.explode_outer("_asked").alias("word")
    ).select("id", "word", F.array_contains("_chunk", F.col("word")).alias("lifted"))
    wanted = asked.select("word").distinct()
    vocabulary = word_df.join(F.broadcast(wanted) if fits_broadcast(pairs) else wanted, "word")
    total = n_docs.select("n_docs").scalar()
    judged = asked.join(vocabulary, "word", "left").withColumn(
        "distinctive", F.col("word").isNotNull() & is_distinctive(F.col("df"), total)
    )
    return judged.groupBy("id").agg(
        F.coalesce(F.avg(F.when(F.col("distinctive"), F.col("lifted").cast("double"))), F.lit(0.0)).alias("leak_score")
    )


def is_answerable(text: Column) -> Column:
    """Could this chunk answer a standalone question? Rejects captions, references, symbol soup."""
    t = T.strip(text)
    share = F.regexp_count(t, F.lit(r"\p{L}")) / F.length(t)
    prose = F.size(
        F.filter(F.split(t, SENTENCE_END), lambda s: F.size(T.ws_tokens(s)) >= 6)
    )
    head = F.lower(F.substring(t, 1, 120))
    return (
        (F.length(t) >= 200)
        & (share >= 0.45)
        & (prose >= 2)
        & ~head.rlike(CAPTION_HEAD)
        & ~head.rlike(REFERENCE_HEAD)
        & ~((F.regexp_count(t, F.lit(YEAR)) >= 4) & (share < 0.7))
    )


def clean_question(raw: Column) -> Column:
    """First line of a reply without a ``question:`` prefix or surrounding quotes."""
    line = T.strip(F.element_at(F.split(T.strip(raw), "\n"), 1))
    bare = T.strip(F.regexp_replace(line, r"(?i)\A(question|q)\s*[:.\-]\s*", ""))
    return T.strip(F.regexp_replace(bare, r'\A"+|"+\z', ""))


def reject_reason(question: Column, leak: Column) -> Column:
    return (
        F.when((F.length(question) < 15) | ~F.contains(question, F.lit("?")), "not a question")
        .when(question.rlike(REFERENTIAL), "refers to the chunk itself")
        .when(
            leak >= LEAK_THRESHOLD,
            F.concat(F.lit("leaks chunk wording ("), F.round(leak * 100, 0).cast("int").cast("string"),
                     F.lit("% of distinctive words)")),
        )
    )


def sample_chunks(chunks: DataFrame, n: int, seed: int = 0, key: str = "chunk_id") -> DataFrame:
    """``n`` answerable chunks, up to 70 % of them mathematical, the rest filled from either side.

    Order within a stratum is the hash of (seed, key). Each stratum gives at most ``n`` rows, so
    the quotas are settled on a handful of rows.
    """
    usable = chunks.where(is_answerable(F.col("text"))).withColumn("is_math", T.is_math(F.col("text")))
    hashed = usable.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    order = [F.col("_h"), F.col(key)]
    drawn = top_k(hashed, ["is_math"], order, n, "_rn")
    counted = drawn.withColumn("_math", F.sum(F.col("is_math").cast("int")).over(W.partitionBy()))
    quota = F.least(F.col("_math"), F.lit(int(n * MATH_SHARE)))
    # first choice: the maths quota and prose for the remainder; second: more maths
    tier = F.when(F.col("is_math") & (F.col("_rn") <= quota), 0).when(
        ~F.col("is_math") & (F.col("_rn") <= n - quota), 1
    ).when(F.col("is_math"), 2)
    chosen = counted.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    pick = F.row_number().over(W.orderBy("_tier", "_rn"))
    return (
        chosen.withColumn("_pick", pick).where(F.col("_pick") <= n)
        .drop("_h", "_rn", "_math", "_tier", "_pick")
    )


def gold_health(gold: DataFrame) -> DataFrame:
    leak = F.col("leak_score")
    n = F.count(F.lit(1))
    high = F.sum(F.when(leak >= 0.6, 1).otherwise(0))
    return gold.agg(
        n.alias("n"),
        F.coalesce(F.sum(F.coalesce(F.col("is_math"), F.lit(False)).cast("int")), F.lit(0)).alias("n_math"),
        F.avg(leak).alias("mean_leak"),
        F.count(leak).alias("n_scored"),
        F.coalesce(high, F.lit(0)).alias("n_high"),
        F.coalesce((F.avg(leak) >= 0.4) | (high > n * 0.15), F.lit(False)).alias("leaky"),
    )


def review_rows(gold: DataFrame) -> DataFrame:
    """Rows for human review, worst leak first, with a one-line snippet."""
    return gold.orderBy(F.col("leak_score").desc(), F.col("gold_chunk_id")).select(
        "gold_chunk_id", "leak_score", "q", T.one_line(F.col("chunk_text"), 300).alias("snippet")
    )


def unmatched_followups(followups: DataFrame, gold: DataFrame) -> DataFrame:
    return followups.join(gold.select("gold_chunk_id").distinct(), "gold_chunk_id", "left_anti")


def followup_pairs(followups: DataFrame, gold: DataFrame, strict: bool = True) -> DataFrame:
    """Follow-ups joined to their gold rows; an unmatched one is an error, a repeated gold id counts last.

    ``gold`` carries an integer ``pos``.
    """
    if strict:
        lost = unmatched_followups(followups, gold).select("gold_chunk_id").head(1)
        if lost:
            raise KeyError(f"{lost[0][0]} has follow-ups but no gold row")
    latest = gold.groupBy("gold_chunk_id").agg(
        F.max_by("chunk_text", "pos").alias("chunk_text"), F.max_by("source", "pos").alias("source")
    )
    return followups.join(latest, "gold_chunk_id")


def contrastive_pairs(events: DataFrame, ratings: DataFrame) -> DataFrame:
    """Thumbs-up questions × the chunks retrieved for them."""
    liked = ratings.where(F.col("rating") == "up").select("event_id")
    return events.join(liked, "event_id").select(
        "event_id", "question", F.explode("sources").alias("s")
    ).select("event_id", "question", F.col("s.chunk_id").alias("chunk_id"), F.col("s.score").alias("score"))

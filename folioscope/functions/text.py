"""Text expressions. Everything here is a native Spark column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split() and str.strip() see it (regex class body).
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# One run of whitespace; printable ASCII is ruled out first, which halves the matching time.
WS_RUN = rf"(?:(?![!-\x7E])[{WS}])+"

# Question words that say nothing about leakage.
STOPWORDS = """
what how why does do is are was were the a an of in to for and or with that this it on as by
its their our we you can could would should when which who whom where if then than there here
been be being have has had at from into about over under between among not no yes any some
""".split()

# Words that point at something outside their own sentence.
ANAPHORS = ["it", "its", "that", "this", "those", "these", "they", "them", "their", "there", "again", "instead"]

# Vocabulary of references to a picture sent earlier.
IMAGE_WORDS = ["photo", "picture", "image", "pic", "snapshot"]
BACK_WORDS = ["before", "previous", "earlier", "last"]

# Substrings that mark a passage as mathematical.
MATH_SIGNALS = [
    "$$", "\\frac", "\\int", "\\sum", "\\sqrt", "\\begin{", "\\lim",
    "\\partial", "\\nabla", "\\alpha", "\\beta", "\\theta", "\\mathbb",
]

# Equation spans, display form tried before inline form.
EQUATION = r"(?s)\$\$.*?\$\$|\$[^$\n]+?\$"
# Page sentinel inside extracted text, and the extractor's own page-break line.
PAGE_MARKER = r"<!--\s*page:(\d+)\s*-->"
PAGE_BREAK = r"\{(\d+)\}-+"
# A clause up to its end mark, or an unterminated rest.
SENTENCE = r"[^.!?\n]*[.!?\n]|\S[^.!?\n]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside lambdas, which evaluate their captures per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS_RUN}|{WS_RUN}\z", "")


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS_RUN, " "))


def casefold(c: Column) -> Column:
    """Lower case plus the foldings ``lower`` leaves out for Latin and Greek text."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ςµ", "σμ")


def ws_tokens(c: Column) -> Column:
    """Whitespace tokens, case kept: the lexical index tokeniser."""
    return F.filter(F.split(c, WS_RUN), lambda t: t != "")


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def alnum_set(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens: the overlap tokeniser."""
    return F.array_distinct(alnum_tokens(c))


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more without stopwords: the leak tokeniser."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def question_words(c: Column) -> Column:
    """Case-folded words with apostrophes: the follow-up tokeniser."""
    return F.regexp_extract_all(casefold(c), F.lit("[a-z0-9']+"), F.lit(0))


def near_dup_key(c: Column) -> Column:
    """Whitespace- and case-insensitive identity of a short text."""
    return casefold(collapse_ws(c))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def sentences(c: Column) -> Column:
    pieces = F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), strip)
    return F.filter(pieces, lambda s: s != "")


def equations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EQUATION), F.lit(0))


def equation_segments(c: Column) -> Column:
    """Ordered ``array<struct<kind, span>>`` whose spans concatenate back to the input."""

    def interleave(x: Column) -> Column:
        pairs = F.transform(
            x["prose"],
            lambda p, i: F.array(
                F.struct(F.lit("prose").alias("kind"), p.alias("span")),
                F.struct(F.lit("eq").alias("kind"), F.get(x["eq"], i).alias("span")),
            ),
        )
        return F.filter(F.flatten(pairs), lambda s: s["span"].isNotNull() & (s["span"] != ""))

    return let(F.struct(F.split(c, EQUATION).alias("prose"), equations(c).alias("eq")), interleave)


def page_breaks_to_markers(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_BREAK, "<!-- page:$1 -->")


def strip_page_markers(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_MARKER, "")


def page_markers(c: Column) -> Column:
    """``array<struct<offset, page>>``: where each marker stood in the marker-free text."""

    def locate(x: Column) -> Column:
        return F.transform(
            x["pages"],
            lambda p, i: F.struct(
                F.aggregate(F.slice(x["prose"], 1, i + 1), F.lit(0), lambda a, n: a + n).alias("offset"),
                p.cast("int").alias("page"),
            ),
        )

    prose = F.transform(F.split(c, PAGE_MARKER), F.length).alias("prose")
    pages = F.regexp_extract_all(c, F.lit(PAGE_MARKER), F.lit(1)).alias("pages")
    return let(F.struct(prose, pages), locate)


def page_of_file(c: Column) -> Column:
    """First ``page_<n>`` in a file name as an int, else null."""
    return F.when(c.rlike(r"page_\d+"), F.regexp_extract(c, r"page_(\d+)", 1).try_cast("int"))


def chunk_id_of(chunk_id: Column, text: Column) -> Column:
    """Stored id, else the content-prefix id older indexes fall back to."""
    return F.coalesce(
        F.when(chunk_id != "", chunk_id), F.concat(F.lit("legacy::"), F.substring(text, 1, 120))
    )


def is_math(c: Column) -> Column:
    hit = F.lit(False)
    for signal in MATH_SIGNALS:
        hit = hit | F.contains(c, F.lit(signal))
    return hit


def one_line(c: Column, n: int) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" "))


def array_join_or(parts: Column, sep: str, empty: str) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, sep)).otherwise(F.lit(empty))

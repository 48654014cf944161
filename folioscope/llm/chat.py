"""Chat formatting into budgeted windows.

One budget holds a window's system turn, its repeated history and its own turns. What is left of it beside the allowances for the
first two is for own turns: prefix sums over the token counts of a conversation's turns choose turn-aligned spans
of it. A turn starts in the span numbered by the tokens before it, and a turn of more than half a span's tokens stands alone.
Every window repeats the system turn and as many of the turns before it as fit the history allowance; both are
under the mask, as is everything else but each assistant text in the one window that owns its turn.

Whole turns come first. A turn that stands alone and leaves less than the allowances has as much history as still fits, and no system
turn if that doesn't fit either; only such a turn longer than the budget exceeds it. A system turn longer than its allowance is
an ordinary turn: whole in its own window, not repeated.

A conversation is worked on in segments of a bounded number of tokens, so one that holds most of the
rows is spread over tasks; a segment gets copies of the system turn and of the turns its first windows
may repeat.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts a backslash is doubled and a backslash
stands inside each ``<|``, so no control string is left in them; in roles a line feed is written ``\\n``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe
from folioscope.llm._tables import shuffle_width
from folioscope.operators.ordering import running_sum

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY, SYSTEM = 1024, 256, 256
SEGMENT = 64  # half spans in a segment
MARKS = 4  # tokens of a turn's marks and role

WINDOWS = (
    "key long, segment long, window long, formatted string, n_tokens long, history_turns int, own_turns int, "
    "has_system boolean, loss array<struct<begin: int, stop: int>>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], role)


def word_tokens(text: Column) -> Column:
    """A model-free token count: runs of word characters and single other signs, and those of the turn's marks."""
    return (F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + MARKS).cast("long")


def bpe_tokens(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> Callable[[Column], Column]:
    """A token count for :func:`windows`: the ids that byte-level BPE gives the escaped text, and those of the turn's marks."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, encoder = bpe.splitter(pattern), bpe.Encoder(shared.value)
        for texts in batches:
            sizes = [sum(len(encoder[piece]) for piece in split(escape(t or ""))) // 4 for t in texts]
            yield pd.Series(sizes, index=texts.index, dtype="int64") + MARKS

    return count


def windows(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, tokens: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """One row per window: ``key, segment, window`` (its order), ``formatted``, ``loss`` (code point ranges under
    the loss), and counts. Turns are ordered by ``turn`` (null first), ties by role and text.

    Null texts and roles are empty; a null key is a conversation of its own. The system turn is the first turn if
    its role is ``system`` and it has at most ``system`` tokens. Nothing is dropped: windows hold every turn once as their own.
    """
    half = (budget - history - system) // 2
    if half < 1:
        raise ValueError("the allowances for history and system turn leave nothing of the budget")
    rows = turns.select(
        F.col(key).cast("long").alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).withColumn("_null", F.col("key").isNull())
    rows = rows.withColumn("n", F.greatest(F.lit(1), tokens(F.col("text")))).withColumn("tie", F.monotonically_increasing_id())
    order = ["turn", "role", "text", "tie"]
    rows = rows.withColumn("_k", F.coalesce("key", F.lit(0)))
    packed = rows.withColumn("both", F.col("n") * F.lit(1 << 31) + F.when(F.col("n") > half, 1).otherwise(0))
    summed = running_sum(packed, ["_null", "_k"], order, "both", "sums")
    # two prefix sums in one: tokens before the turn, and how many turns before it stand alone
    placed = (
        summed.withColumn("before", F.expr(f"sums div {1 << 31}"))
        .withColumn("alone", (F.col("n") > half).cast("long"))
        .withColumn("window", F.struct(F.expr(f"before div {half}").alias("a"), (2 * (F.col("sums") % (1 << 31)) + F.col("alone")).alias("b")))
        .withColumn("segment", F.expr(f"before div {SEGMENT * half}"))
    )
    # a turn may be history in a later segment that starts within the allowance
    reach = F.expr(f"(before + {history}) div {SEGMENT * half}")
    leads = (F.col("before") == 0) & (F.col("role") == "system") & (F.col("n") <= system)
    last = placed.groupBy("_null", "_k").agg(F.max("segment").alias("_last")).where("_last > 0")
    heads = placed.where(leads).join(last, ["_null", "_k"]).withColumn("segment", F.explode(F.sequence(F.lit(1).cast("long"), "_last")))
    nearby = placed.where(~leads & (reach > F.col("segment"))).withColumn("segment", F.explode(F.sequence(F.col("segment") + 1, reach)))
    columns = ["key", "_null", "_k", "segment", "window", "before", "n", "role", "text", "turn", "tie"]
    dealt = (
        placed.select(*columns, F.lit(2).alias("part"))
        .unionByName(nearby.select(*columns, F.lit(1).alias("part")))
        .unionByName(heads.select(*columns, F.lit(0).alias("part")))
        .withColumn("system", F.col("part").isin(0) | (F.col("part").isin(2) & leads))
    )
    dealt = dealt.repartition(shuffle_width(turns), "_null", "_k", "segment").sortWithinPartitions(
        "_null", "_k", "segment", "part", "before", "tie"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = own = head = None
        recent: list[tuple[int, int, str]] = []  # tokens before, tokens, formatted
        number = 0

        def closed() -> tuple:
            return (
                at[0], at[2], number, "".join(own["parts"]), own["tokens"], own["history"], own["turns"], own["head"], own["loss"],
            )

        for frame in frames:
            out = []
            for key, null, segment, wa, wb, before, n, role, text, part, is_system in frame.itertuples(index=False):
                key = None if null else int(key)
                if at != (key, null, segment):
                    if own:
                        out.append(closed())
                    at, own, head, recent, number = (key, null, segment), None, None, [], -1
                shown = f"{START}{escape_role(role)}\n{escape(text)}{END}"
                if part == 0:
                    head = (n, shown)
                    continue
                if part == 1:
                    recent.append((before, n, shown))
                    continue
                if own is None or own["window"] != (wa, wb):
                    if own:
                        out.append(closed())
                    number += 1
                    recent = [r for r in recent if r[0] >= before - history]
                    lead, shared = head, recent
                    if n > half:  # it stands alone, and may leave less than the allowances
                        if lead and lead[0] + n > budget:
                            lead = None
                        room = budget - n - (lead[0] if lead else 0)
                        shared = [r for r in recent if r[0] >= before - room]
                    parts = ([lead[1]] if lead else []) + [r[2] for r in shared]
                    own = {
                        "window": (wa, wb), "parts": parts, "size": sum(map(len, parts)), "history": len(shared), "turns": 0,
                        "head": lead is not None, "tokens": (lead[0] if lead else 0) + sum(r[1] for r in shared), "loss": [],
                    }
                if role == "assistant":
                    begin = own["size"] + len(START) + len(role) + 1
                    own["loss"].append((begin, begin + len(shown) - len(START) - len(role) - 1 - len(END)))
                own["parts"].append(shown)
                own["size"] += len(shown)
                own["tokens"] += n
                own["turns"] += 1
                if is_system:
                    head = (n, shown)
                else:
                    recent.append((before, n, shown))
            if out:
                yield pd.DataFrame(out, columns=["key", "segment", "window", "formatted", "n_tokens", "history_turns", "own_turns", "has_system", "loss"]).astype({"key": "Int64"})
        if own:
            yield pd.DataFrame([closed()], columns=["key", "segment", "window", "formatted", "n_tokens", "history_turns", "own_turns", "has_system", "loss"]).astype({"key": "Int64"})

    cols = ["_k", "_null", "segment", F.col("window.a").alias("wa"), F.col("window.b").alias("wb"), "before", "n", "role", "text", "part", "system"]
    return dealt.select(*cols).mapInPandas(run, WINDOWS).withColumnRenamed("key", key)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string; an error if anything but whole turns is in it."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside the turns")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside the turns")
    return turns


def read_back(made: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of whole conversations, read from the formatted windows alone.

    ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``. A digest needs its conversation in
    order, so windows of one conversation pass through one task, one at a time.
    """
    from hashlib import sha256

    rows = made.withColumnRenamed(key, "key").withColumn("_null", F.col("key").isNull()).withColumn("_k", F.coalesce("key", F.lit(0)))
    rows = rows.repartition(shuffle_width(made), "_null", "_k").sortWithinPartitions("_null", "_k", "segment", "window")
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = state = None

        def closed() -> tuple:
            return (at[0], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"])

        for frame in frames:
            out = []
            for key, null, formatted, history, has_system, own_turns, loss in frame.itertuples(index=False):
                now = (None if null else int(key), null)
                if now != at:
                    if state:
                        out.append(closed())
                    at = now
                    state = {"turns": 0, "all": sha256(), "chars": 0, "loss": sha256(), "size": 0, "windows": 0}
                turns = read_turns(formatted)
                if len(turns) != history + has_system + own_turns:
                    raise ValueError("a window does not hold the turns it says")
                for role, text in turns[history + has_system :]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["begin"] : span["stop"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["size"] += len(formatted)
                state["windows"] += 1
            if out:
                yield pd.DataFrame(out, columns=names).astype({"key": "Int64"})
        if state:
            yield pd.DataFrame([closed()], columns=names).astype({"key": "Int64"})

    picked = rows.select("_k", "_null", "formatted", "history_turns", "has_system", "own_turns", "loss")
    schema = "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return picked.mapInPandas(run, schema).withColumnRenamed("key", key)

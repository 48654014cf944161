"""Usage-log analytics over query events and feedback events.

Older rows lack newer fields; a missing field is null and never counts as zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import let
from folioscope.operators.context import RELEVANCE_FLOOR
from folioscope.operators.ordering import number_rows, quantiles
from folioscope.session import cut_lineage

STAGES = ["bm25_ms", "dense_ms", "rrf_ms", "rerank_ms"]
FACETS = ["model", "protocol", "mode"]

_SOURCE = "source string, chunk_id string, score double, preview string"
SOURCES_TYPE = f"array<struct<{_SOURCE.replace(' string', ':string').replace(' double', ':double')}>>"
PASSES_TYPE = (
    "array<struct<at_ms:double,ms:double,prompt_tokens:bigint,output_tokens:bigint,prefill_ms:double,"
    "decode_ms:double,load_ms:double,done_reason:string,tool_calls:int>>"
)
TOOL_LOG_TYPE = (
    "array<struct<n:int,tool:string,ok:boolean,at_ms:double,ms:double,code:string,output:string,"
    "reason:string,query:string,hits:int,kept:int,top_score:double,n_docs:int,n_chunks:int>>"
)
TOKENS_TYPE = (
    "struct<prompt:bigint,output:bigint,prefill_ms:double,decode_ms:double,mtpt_ms:double,tok_s:double>"
)
EVENT_SCHEMA = (
    "kind string, event_id string, ts string, user_hash string, question string, retrieval_query string, "
    f"mode string, model string, protocol string, sources {SOURCES_TYPE}, late_sources {SOURCES_TYPE}, "
    "timings map<string,double>, n_completion_chars int, truncated boolean, continuations int, "
    "tool_calls int, tool_errors int, tool_counts map<string,int>, search_queries array<string>, "
    f"memories_recalled int, tool_log {TOOL_LOG_TYPE}, passes {PASSES_TYPE}, tokens {TOKENS_TYPE}, "
    "error string, rating string, note string"
)


def user_hash(user: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), user), 256), 1, 16)


def latest_ratings(feedback: DataFrame, order: str = "pos") -> DataFrame:
    """Last rating per event in log order."""
    return feedback.groupBy("event_id").agg(F.max_by("rating", order).alias("rating"))


def with_ratings(queries: DataFrame, feedback: DataFrame, order: str = "pos") -> DataFrame:
    return queries.drop("rating").join(latest_ratings(feedback, order), "event_id", "left")


def protocol_of(c: Column) -> Column:
    return F.coalesce(c, F.lit("none"))


def facet_filter(queries: DataFrame, model: str = "", protocol: str = "", mode: str = "") -> DataFrame:
    for name, value in (("model", model), ("mode", mode)):
        if value:
            queries = queries.where(F.col(name) == value)
    return queries.where(protocol_of(F.col("protocol")) == protocol) if protocol else queries


def facet_values(queries: DataFrame) -> DataFrame:
    """Sorted distinct values of each facet, read in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("facet"), (protocol_of(F.col(f)) if f == "protocol" else F.col(f)).alias("value"))
            for f in FACETS
        ]
    )
    return queries.select(F.explode(pairs).alias("p")).select("p.*").distinct().orderBy("facet", "value")


def share(cond: Column) -> Column:
    """Rounded percentage of rows, half away from zero."""
    hits = F.sum(F.coalesce(cond, F.lit(False)).cast("int"))
    return F.round(hits * 100 / F.count(F.lit(1)), 0).cast("int")


def used_tool() -> Column:
    return (F.coalesce("tool_calls", F.lit(0)) > 0) | (F.coalesce(F.size("tool_log"), F.lit(0)) > 0)


def kpi_counts(rated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The KPIs that are plain aggregates; works on batches and on streams."""
    return rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        share(F.coalesce(F.col("error"), F.lit("")) != "").alias("error_pct"),
        share(used_tool()).alias("tool_pct"),
        share(F.col("mode") == "grounded").alias("grounded_pct"),
        share(F.col("truncated")).alias("truncated_pct"),
        F.avg("tokens.prompt").alias("mean_prompt"),
        F.avg("tokens.output").alias("mean_output"),
        F.sum((F.coalesce(F.col("rating"), F.lit("")) == "up").cast("int")).alias("up"),
        F.sum((F.coalesce(F.col("rating"), F.lit("")) == "down").cast("int")).alias("down"),
    )


def kpis(rated: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Full KPI row per group: counts and shares plus exact, interpolated latency quantiles."""
    metrics = {"ttft": F.col("timings")["ttft_ms"], "mtpt": F.col("tokens.mtpt_ms"), "tok_s": F.col("tokens.tok_s")}
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])
    long = rated.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")
    # all metrics go through one sort
    spread = quantiles(long, [*by, "metric"], "value", {"p50": 0.5, "p95": 0.95})
    at = lambda metric, q: F.max(F.when(F.col("metric") == metric, F.col(q))).alias(f"{metric}_{q}")
    wide = spread.groupBy(*by).agg(at("ttft", "p50"), at("ttft", "p95"), at("mtpt", "p50"), at("tok_s", "p50"))
    return kpi_counts(rated, by).join(wide, list(by), "left")


def metric_series(queries: DataFrame, metric: Column) -> DataFrame:
    """Non-null values of a metric in time order, spaced by index."""
    points = queries.select("event_id", "ts", metric.alias("value")).where(F.col("value").isNotNull())
    numbered = number_rows(points.withColumn("_all", F.lit(0)), ["_all"], ["ts", "event_id"], "idx")
    return numbered.drop("_all")


def tool_panel(queries: DataFrame) -> DataFrame:
    calls = queries.select(F.explode("tool_log").alias("t")).select("t.tool", "t.ok", "t.ms")
    counts = calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), share(~F.coalesce("ok", F.lit(False))).alias("error_pct")
    )
    return counts.join(quantiles(calls, ["tool"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "tool", "left")


def total_ms() -> Column:
    """End of the last pass, else the stage and generation times there are, else null."""
    last = F.try_element_at(F.col("passes"), F.lit(-1))
    parts = F.filter(
        F.array(*[F.col("timings")[s] for s in [*STAGES, "generate_ms"]]), lambda x: x.isNotNull()
    )
    return F.when(F.coalesce(F.size("passes"), F.lit(0)) > 0, last["at_ms"] + last["ms"]).when(
        F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    )


def tool_summary() -> Column:
    """``name×count`` pairs with an error suffix; old rows fall back to their plain call count."""
    entries = F.array_sort(F.map_entries(F.col("tool_counts")))
    named = F.transform(
        entries,
        lambda e: F.concat(
            F.replace(F.replace(e["key"], F.lit("_documents"), F.lit("")), F.lit("run_"), F.lit("")),
            F.lit("×"), e["value"].cast("string"),
        ),
    )
    plain = F.when(F.col("tool_calls") > 0, F.concat(F.lit("python×"), F.col("tool_calls").cast("string")))
    body = F.when(F.coalesce(F.size("tool_counts"), F.lit(0)) > 0, F.array_join(named, " ")).otherwise(
        F.coalesce(plain, F.lit(""))
    )
    suffix = F.when(F.col("tool_errors") > 0, F.concat(F.lit(" ("), F.col("tool_errors").cast("string"), F.lit("✗)")))
    return F.concat(body, F.coalesce(suffix, F.lit("")))


def short_model(c: Column) -> Column:
    """Model tag without registry prefix and the first file-format suffix."""
    bare = F.regexp_replace(c, r"\Ahf\.co/[^/]+/", "")
    return F.regexp_replace(bare, r"(?s)\A(.*?)-GGUF", "$1")


def model_slug(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"[^A-Za-z0-9._-]+", "_")


def request_table(queries: DataFrame, feedback: DataFrame, n: int = 200) -> DataFrame:
    """Newest ``n`` requests with their derived columns; ratings are looked up for those rows only."""
    newest = cut_lineage(queries.drop("rating").orderBy(F.col("pos").desc()).limit(n))
    theirs = feedback.join(F.broadcast(newest.select("event_id")), "event_id", "left_semi")
    return newest.join(F.broadcast(latest_ratings(theirs)), "event_id", "left").select(
        "event_id", "ts", "question", short_model(F.col("model")).alias("model"),
        protocol_of(F.col("protocol")).alias("protocol"), "mode", F.col("timings")["ttft_ms"].alias("ttft_ms"),
        total_ms().alias("total_ms"), F.col("tokens.prompt").alias("tokens_in"),
        F.col("tokens.output").alias("tokens_out"), F.col("tokens.mtpt_ms").alias("mtpt_ms"),
        tool_summary().alias("tools"), "rating",
    )


def trace_spans(queries: DataFrame) -> DataFrame:
    """Spans of each request: retrieval stages end to end, passes, and tool calls with a start time.

    All spans of a row are built inside the row; nothing is shuffled.
    """
    stage = F.filter(
        F.array(*[F.struct(F.lit(s[:-3]).alias("label"), F.col("timings")[s].alias("dur")) for s in STAGES]),
        lambda s: F.coalesce(s["dur"], F.lit(0.0)) != 0,
    )
    span = "array<struct<label:string,kind:string,start:double,dur:double>>"
    retrieval = let(
        stage,
        lambda all_: F.transform(
            all_,
            lambda s, i: F.struct(
                s["label"].alias("label"), F.lit("retrieval").alias("kind"),
                F.aggregate(F.slice(all_, F.lit(1), i), F.lit(0.0), lambda a, x: a + x["dur"]).alias("start"),
                s["dur"].alias("dur"),
            ),
        ),
    )
    passes = F.transform(
        F.coalesce("passes", F.array().cast(PASSES_TYPE)),
        lambda p, i: F.struct(F.concat(F.lit("gen #"), (i + 1).cast("string")).alias("label"),
                              F.lit("generation").alias("kind"), p["at_ms"].alias("start"), p["ms"].alias("dur")),
    )
    tools = F.transform(
        F.filter(F.coalesce("tool_log", F.array().cast(TOOL_LOG_TYPE)), lambda t: t["at_ms"].isNotNull()),
        lambda t: F.struct(
            F.concat(t["tool"], F.when(F.coalesce(t["ok"], F.lit(False)), "").otherwise(" ✗")).alias("label"),
            F.when(t["tool"] == "run_python", "python").otherwise("search").alias("kind"),
            t["at_ms"].alias("start"), t["ms"].alias("dur"),
        ),
    )
    spans = F.concat(retrieval.cast(span), passes.cast(span), tools.cast(span))
    ends = F.transform(spans, lambda s: s["start"] + s["dur"])
    end = F.greatest(F.coalesce(total_ms(), F.lit(0.0)), F.coalesce(F.array_max(ends), F.lit(0.0)), F.lit(1.0))
    return queries.select("event_id", end.alias("end_ms"), F.posexplode(spans).alias("span_no", "s")).select(
        "event_id", "end_ms", "span_no", "s.*"
    )


def span_shares(spans: DataFrame) -> DataFrame:
    return spans.withColumns(
        {"left": F.col("start") / F.col("end_ms"), "width": F.col("dur") / F.col("end_ms")}
    )


def pass_pace(queries: DataFrame) -> DataFrame:
    """Milliseconds per output token of every pass; null where either number is missing or zero."""
    return queries.select("event_id", F.posexplode("passes").alias("pass_no", "p")).select(
        "event_id", "pass_no",
        F.when((F.col("p.decode_ms") != 0) & (F.col("p.output_tokens") != 0),
               F.col("p.decode_ms") / F.col("p.output_tokens")).alias("ms_per_token"),
    )


def pass_record(meta: DataFrame) -> DataFrame:
    """Raw generation metadata in nanoseconds and seconds → one pass record; missing stays null."""
    ms = lambda c: F.round(F.col(c) / 1e6, 1)
    return meta.select(
        "event_id", "seq",
        F.struct(
            F.round(F.col("at_s") * 1000, 1).alias("at_ms"), F.round(F.col("wall_s") * 1000, 1).alias("ms"),
            F.col("prompt_eval_count").alias("prompt_tokens"), F.col("eval_count").alias("output_tokens"),
            ms("prompt_eval_duration").alias("prefill_ms"), ms("eval_duration").alias("decode_ms"),
            ms("load_duration").alias("load_ms"), F.col("done_reason"), F.col("n_calls").alias("tool_calls"),
        ).alias("pass"),
    )


def scaled_round(c: Column, digits: int) -> Column:
    """Round on the scaled binary value, as the log writer does; ``round`` works on the decimal text."""
    return F.round(c * 10**digits, 0) / 10**digits


def token_totals(passes: Column) -> Column:
    """Sums over passes ignoring nulls, and the decode pace; nothing measured gives null, not zero."""

    def total(field: str, zero: Column) -> Column:
        values = F.filter(F.transform(passes, lambda p: p[field]), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.aggregate(values, zero, lambda a, v: a + v))

    long0, double0 = F.lit(0).cast("long"), F.lit(0.0)
    out, decode = total("output_tokens", long0), total("decode_ms", double0)
    rate = F.when((out != 0) & (decode != 0), decode / out)
    return F.struct(
        total("prompt_tokens", long0).alias("prompt"), out.alias("output"),
        total("prefill_ms", double0).alias("prefill_ms"), decode.alias("decode_ms"),
        scaled_round(rate, 2).alias("mtpt_ms"), scaled_round(1000 / rate, 1).alias("tok_s"),
    )


def stage_times(retrievals: DataFrame) -> DataFrame:
    """``retrievals(event_id, seconds map)``, one row per search → summed milliseconds per event and stage."""
    return (
        retrievals.select("event_id", F.explode("seconds").alias("stage", "s"))
        .groupBy("event_id", "stage")
        .agg(F.round(F.sum(F.col("s") * 1000), 2).alias("ms"))
        .withColumn("stage", F.concat("stage", F.lit("_ms")))
    )


def source_rows(queries: DataFrame, floor: float = RELEVANCE_FLOOR) -> DataFrame:
    """Logged sources one per row, with the flag for those under the floor."""
    return queries.select("event_id", F.posexplode("sources").alias("n", "s")).select(
        "event_id", "n", "s.chunk_id", "s.score",
        (F.coalesce("s.score", F.lit(0.0)) < floor).alias("below_floor"),
    )


def rewrites(queries: DataFrame) -> DataFrame:
    """Questions searched under other words: rewritten queries and the model's own searches."""
    rewritten = queries.where(F.col("retrieval_query").isNotNull()).select(
        "event_id", "question", F.lit("rewrite").alias("kind"), F.col("retrieval_query").alias("searched")
    )
    own = queries.select("event_id", "question", F.lit("model search").alias("kind"),
                         F.explode("search_queries").alias("searched"))
    return rewritten.unionByName(own)


def operating_rollup(queries: DataFrame) -> DataFrame:
    """Truncation, continuations, tool errors and memory use by model and protocol, with subtotals."""
    q = queries.withColumn("protocol", protocol_of(F.col("protocol")))
    return q.rollup("model", "protocol").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("truncated").cast("double")).alias("truncated_rate"),
        F.avg("continuations").alias("mean_continuations"),
        (F.sum("tool_errors") / F.nullif(F.sum("tool_calls"), F.lit(0))).alias("tool_error_rate"),
        F.avg((F.col("memories_recalled") > 0).cast("double")).alias("memory_share"),
    )

"""Registered queries that run a stream over the given tables to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.models import hashed_tf_embedder
from folioscope.operators import ordering as O
from folioscope.operators import sketches as SK
from folioscope.plans import bindings as B
from folioscope.plans import q_usage as U
from folioscope.plans.registry import register, table
from folioscope.session import scratch_path
from folioscope.sources import sinks
from folioscope.streaming import live


def log_folder(spark, sf):
    """Query and feedback events appended as JSON lines to one folder, cut-off lines among them."""
    path = scratch_path(spark, "log")
    events = U.log(spark, sf).drop("pos")
    sinks.append_events(events, path)
    sinks.append_feedback(U.feedback(spark, sf).select("event_id", "rating", F.lit("").alias("note")), path)
    broken = table(spark, sf, "events").where("event_type = 'error'").select(
        F.concat(F.lit('{"kind": "query", "event_id": "'), F.col("event_id").cast("string")).alias("value")
    )
    broken.write.mode("append").text(path)
    return path


def run_to_end(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@register(
    "live_log_ingest",
    B.ctes(U.LOG)
    + """SELECT 'query' AS kind, event_id, question, mode, model, truncated, tool_calls, ts, NULL AS rating FROM log
         UNION ALL SELECT 'feedback', event_id, NULL, NULL, NULL, NULL, NULL, NULL, rating FROM fb""",
)
def live_log_ingest(spark, sf):
    """The typed rows; feedback is stamped when it is appended, so its time is left out."""
    out = scratch_path(spark, "typed")
    run_to_end(live.ingest(live.read_log(spark, log_folder(spark, sf)), out, scratch_path(spark, "state")))
    return spark.read.parquet(out).select(
        "kind", "event_id", "question", "mode", "model", "truncated", "tool_calls", F.when(F.col("kind") == "query", F.col("ts")).alias("ts"), "rating"
    )


def _pct(condition: str) -> str:
    return f"floor(100.0::DOUBLE * count_if({condition}) / count(*) + 0.5)::INTEGER"


def _nth(share: float) -> str:
    return f"round(list_sort(list(ttft_ms) FILTER (ttft_ms IS NOT NULL))[greatest(1, ceil({share} * count(ttft_ms)))::BIGINT], 6)"


@register(
    "live_kpi_windows",
    B.ctes(U.LOG)
    + f"""SELECT time_bucket(INTERVAL 1 DAY, stamp) AS start, count(*) AS queries, {_pct('error IS NOT NULL')} AS error_pct, {_pct('tool_calls > 0')} AS tool_pct,
         {_pct("mode = 'grounded'")} AS grounded_pct, {_pct('truncated')} AS truncated_pct, {_nth(0.5)} AS ttft_p50, {_nth(0.95)} AS ttft_p95,
         round(avg(tok_in), 6) AS mean_prompt, round(avg(tok_out), 6) AS mean_output FROM log GROUP BY 1""",
)
def live_kpi_windows(spark, sf):
    out = scratch_path(spark, "kpis")
    kpis = live.live_kpis(live.read_log(spark, log_folder(spark, sf)), "1 day", "2 days")
    run_to_end(live.keep_updates(kpis, out, scratch_path(spark, "state")))
    ttft = F.col("ttft_p50_p95")
    return live.latest(spark, out, ["window"]).select(
        F.col("window.start").alias("start"), "queries", "error_pct", "tool_pct", "grounded_pct", "truncated_pct",
        F.round(ttft[0], 6).alias("ttft_p50"), F.round(ttft[1], 6).alias("ttft_p95"),
        F.round("mean_prompt", 6).alias("mean_prompt"), F.round("mean_output", 6).alias("mean_output"),
    )


_R = "ln(1.01::DOUBLE / 0.99)"
_SPANS = f"""
vals AS (SELECT stamp, ttft_ms AS v, 1099511627776 + ceil(ln(ttft_ms) / {_R})::BIGINT AS cell FROM log WHERE ttft_ms > 0),
spans AS (SELECT 'hour' AS span, time_bucket(INTERVAL 1 HOUR, stamp) AS start, v, cell FROM vals UNION ALL SELECT 'day', time_bucket(INTERVAL 1 DAY, stamp), v, cell FROM vals
   UNION ALL SELECT 'all', TIMESTAMP '1970-01-01', v, cell FROM vals),
numbered AS (SELECT *, row_number() OVER (PARTITION BY span, start ORDER BY v) AS r, count(*) OVER (PARTITION BY span, start) AS n FROM spans),
cells AS (SELECT span, start, cell, n, min(r) AS first_r, max(r) AS last_r, min(v) AS low, max(v) AS high FROM numbered GROUP BY ALL),
asked AS (SELECT *, greatest(1, ceil(q * n))::BIGINT AS wanted FROM cells, (SELECT unnest([0.5, 0.95]::DOUBLE[]) AS q))
"""


@register(
    "live_latency_rollup",
    B.ctes(U.LOG, _SPANS)
    + f"""SELECT span, start, q, n, round(least(high, greatest(low, exp((cell - 1099511627776) * {_R}) * 2 / (1 + exp({_R})))), 6) AS value, round(low, 6) AS low, round(high, 6) AS high,
         greatest(last_r - wanted, wanted - first_r) AS rank_error FROM asked WHERE wanted BETWEEN first_r AND last_r""",
)
def live_latency_rollup(spark, sf):
    """Hourly sketches of a stream, rolled up to days and to everything without its events; the SQL reads the events."""
    out = scratch_path(spark, "latency")
    hourly = live.live_latency(live.read_log(spark, log_folder(spark, sf)), "1 hour", "2 days")
    run_to_end(live.keep_updates(hourly, out, scratch_path(spark, "state")))
    stored = live.latest(spark, out, ["window", "cell"])
    begin = F.col("window.start")
    spans = {"hour": begin, "day": F.date_trunc("day", begin), "all": F.timestamp_seconds(F.lit(0))}
    long = stored.select(F.explode(F.array(*[F.struct(F.lit(s).alias("span"), at.alias("start")) for s, at in spans.items()])).alias("s"), "cell", "n", "low", "high")
    merged = SK.merge(long.select("s.*", "cell", "n", "low", "high"), ["span", "start"])
    return SK.quantiles(merged, ["span", "start"], [0.5, 0.95]).select(
        "span", "start", "q", "n", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")], "rank_error"
    )


@register(
    "live_last_rating",
    """SELECT 'e' || (event_id - event_id % 3) AS event_id, arg_max(CASE WHEN value > 50 THEN 'up' ELSE 'down' END, event_id) AS rating FROM events WHERE event_type = 'click' GROUP BY 1""",
)
def live_last_rating(spark, sf):
    path, out = scratch_path(spark, "ratings"), scratch_path(spark, "rated")
    stamped = U.feedback(spark, sf).select(
        F.lit("feedback").alias("kind"), "event_id", "rating", F.lpad(F.col("pos").cast("string"), 12, "0").alias("ts")
    )
    stamped.write.json(path)
    run_to_end(live.keep_updates(live.read_log(spark, path, 4), out, scratch_path(spark, "state"), live.live_ratings))
    return live.latest(spark, out, ["event_id"], ["ts", "epoch"]).select("event_id", "rating")


@register(
    "live_rating_state",
    """SELECT 'e' || (event_id - event_id % 3) AS event_id, arg_max(CASE WHEN value > 50 THEN 'up' ELSE 'down' END, event_id) AS rating FROM events WHERE event_type = 'click' GROUP BY 1""",
)
def live_rating_state(spark, sf):
    """Ratings kept as state per event: every third one arrives last to first, the stream stops twice, and its epochs are folded on the way."""
    path, out, state = scratch_path(spark, "ratings"), scratch_path(spark, "rated"), scratch_path(spark, "state")
    stamped = U.feedback(spark, sf).select(
        F.lit("feedback").alias("kind"), "event_id", "rating", "pos",
        F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("pos")), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("ts"),
    )
    for part in (2, 0, 1):
        stamped.where(F.col("pos") % 3 == part).drop("pos").write.mode("append").json(path)
        changes = live.rating_changes(live.read_log(spark, path), "60 days")
        run_to_end(live.keep_updates(changes, out, state))
        if part != 1:
            live.fold_epochs(spark, out, ["event_id"], ["at", "epoch"])
    return live.latest(spark, out, ["event_id"], ["at", "epoch"]).select("event_id", "rating")


@register(
    "live_chunk_upsert",
    """SELECT source || '::' || (doc_id % 30) AS chunk_id, md5(arg_max(text, (doc_id % 2) * 1000000000000 + doc_id)) AS digest
       FROM documents GROUP BY 1""",
)
def live_chunk_upsert(spark, sf):
    """Even documents arrive, then odd ones; the stream is stopped in between, and each of its batches is an upload to the stored index."""
    arrivals, index, state = scratch_path(spark, "arrivals"), scratch_path(spark, "index"), scratch_path(spark, "state")
    rows = table(spark, sf, "documents").select(
        B.owner("doc_id"), F.concat_ws("::", "source", F.col("doc_id") % 30).alias("chunk_id"), F.col("doc_id").alias("ord"), "source", "text"
    )
    embedder = hashed_tf_embedder(B.DIM)

    def merge(batch, version):
        sinks.write_user_index(batch.sparkSession, batch, index, embedder, version)

    for part in (0, 1):
        rows.where(F.col("ord") % 2 == part).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(rows.schema).parquet(arrivals)
        run_to_end(live.upsert_chunks(stream, state, merge))
    return sinks.read_user_index(spark, index).chunks.select("chunk_id", F.md5("text").alias("digest"))


UPLOADS = 10


@register(
    "user_index_upserts",
    f"""WITH a AS (SELECT coalesce(lang, 'none') AS "user", source || '::' || (doc_id % 7) AS chunk_id, (doc_id % {UPLOADS}) * 1000000000000 + doc_id AS seen, text FROM documents),
        b AS (SELECT "user", chunk_id, min(seen) AS first_seen, arg_max(text, seen) AS text FROM a GROUP BY ALL),
        c AS (SELECT *, {B.sql_ws_tokens('text')} AS toks, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM b)
        SELECT "user", chunk_id, row_number() OVER (PARTITION BY "user" ORDER BY first_seen) - 1 AS place, md5(text) AS digest,
          len(list_distinct(toks)) AS n_terms, len(toks) AS n_tokens,
          len(list_distinct(list_transform(words, lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT % {B.DIM}))) AS n_axes FROM c""",
)
def user_index_upserts(spark, sf):
    """Documents as chunks of their language's user, in ten uploads that partly replace what is there; the tables read back."""
    path = scratch_path(spark, "index")
    rows = table(spark, sf, "documents").select(
        F.coalesce("lang", F.lit("none")).alias("user"), F.concat_ws("::", "source", F.col("doc_id") % 7).alias("chunk_id"),
        F.col("doc_id").alias("ord"), "source", "text",
    )
    for k in range(UPLOADS):
        sinks.write_user_index(spark, rows.where(F.col("ord") % UPLOADS == k), path, hashed_tf_embedder(B.DIM))
    index = sinks.read_user_index(spark, path)
    terms = index.lexical.postings.groupBy("user", "ord").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))
    axes = index.vectors.select("user", "ord", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_axes"))
    places = O.number_rows(index.chunks.select("user", "ord"), ["user"], ["ord"], "place")
    found = index.chunks.join(places, ["user", "ord"]).join(axes, ["user", "ord"], "left").join(terms, ["user", "ord"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("user", "chunk_id", "place", F.md5("text").alias("digest"), zero("n_terms"), zero("n_tokens"), "n_axes")

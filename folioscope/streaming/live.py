"""Live log ingest, live KPIs, live ratings and live chunk upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from folioscope.operators import sketches as SK
from folioscope.operators.telemetry import EVENT_SCHEMA, share, used_tool
from folioscope.session import finished_parts
from folioscope.sources.readers import parse_jsonl


def read_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New lines of a JSON-lines folder as typed events; malformed lines drop out."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_jsonl(reader.load(path), EVENT_SCHEMA)


def ingest(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream of events to a typed table, exactly once per line."""
    return (
        events.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )


def live_kpis(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """KPIs per tumbling event-time window; rows later than the watermark are ignored.

    Quantiles are approximate here: exact ones need the whole window's values in state.
    """
    queries = events.where("kind = 'query'").withColumn("at", F.to_timestamp("ts"))
    return (
        queries.withWatermark("at", late)
        .groupBy(F.window("at", window))
        .agg(
            F.count(F.lit(1)).alias("queries"),
            share(F.coalesce(F.col("error"), F.lit("")) != "").alias("error_pct"),
            share(used_tool()).alias("tool_pct"),
            share(F.col("mode") == "grounded").alias("grounded_pct"),
            share(F.col("truncated")).alias("truncated_pct"),
            F.percentile_approx(F.col("timings")["ttft_ms"], [0.5, 0.95], 10_000).alias("ttft_p50_p95"),
            F.avg("tokens.prompt").alias("mean_prompt"),
            F.avg("tokens.output").alias("mean_output"),
        )
    )


def live_latency(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", accuracy: float = SK.ACCURACY) -> DataFrame:
    """A latency sketch per tumbling window: ``window, cell, n, low, high``.

    Its state is one small row per (window, cell). Sketch rows of any windows merge (:func:`folioscope.operators.sketches.merge`), so
    hours, days or any range have their quantiles without the events.
    """
    queries = events.where("kind = 'query'").select(F.to_timestamp("ts").alias("at"), F.col("timings")["ttft_ms"].alias("ttft"))
    return SK.sketch(queries.withWatermark("at", late), [F.window("at", window)], "ttft", accuracy)


def live_ratings(events: DataFrame) -> DataFrame:
    """Latest rating per event with its time, of a table or of one micro-batch."""
    return (
        events.where("kind = 'feedback'")
        .groupBy("event_id")
        .agg(F.max_by("rating", "ts").alias("rating"), F.max("ts").alias("ts"))
    )


BUCKETS = 4_096  # rows that the state of ratings is dealt to


def _packed(events: np.ndarray, us: np.ndarray, ratings: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(events, pa.string()), pa.array(us, pa.int64()), pa.array(ratings, pa.string())], names=["event", "us", "rating"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(bytes(state)).read_next_batch()
    return tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))


def rating_changes(
    events: DataFrame, late: str = "10 minutes", keep: timedelta = timedelta(days=7), buckets: int = BUCKETS
) -> DataFrame:
    """A stream of ``event_id, rating, at``: one row whenever the current rating of an event becomes another or newer one.

    The state of an event is its newest rating by ``ts``, whatever the order of arrival; of equal times the later batch counts, within
    a batch the greater rating. A timer frees it once the watermark has passed that time by ``keep``. What comes after
    that and is older is behind the watermark and dropped, so a freed event cannot fall back to an older rating. Rows without an
    event, a rating or a readable time are ignored.

    Events are dealt to ``buckets`` by a hash, and a bucket's events are settled by column in one call, as a call an event
    costs far more than its rows. A stream that is started again needs the number of buckets it began with.
    """
    linger = int(keep.total_seconds() * 1000)

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        if state.exists:
            ids, us, ratings = _unpacked(state.get[0])
            live = us // 1000 + linger >= watermark
            ids, us, ratings = ids[live], us[live], ratings[live]
        else:
            ids, us, ratings = np.empty(0, object), np.empty(0, np.int64), np.empty(0, object)
        changed = None
        if not state.hasTimedOut:
            rows = pd.concat([rows[["event_id", "us", "rating"]] for rows in batches])
            rows = rows.sort_values(["us", "rating"]).drop_duplicates("event_id", keep="last")
            found = pd.Index(ids, dtype=object).get_indexer(rows["event_id"])
            new = (found < 0).copy()
            later = new.copy()
            at = found[~new]
            new_us, new_ratings = rows["us"].to_numpy(np.int64), rows["rating"].to_numpy(object)
            same = (new_us[~new] == us[at]) & (new_ratings[~new] == ratings[at])
            later[~new] = (new_us[~new] >= us[at]) & ~same
            changed = rows[later]
            us, ratings = us.copy(), ratings.copy()
            known = later & ~new
            us[found[known]], ratings[found[known]] = new_us[known], new_ratings[known]
            ids = np.concatenate([ids, rows["event_id"].to_numpy(object)[new]])
            us, ratings = np.concatenate([us, new_us[new]]), np.concatenate([ratings, new_ratings[new]])
        if len(ids):
            state.update((_packed(ids, us, ratings),))
            state.setTimeoutTimestamp(max(int(us.min()) // 1000 + linger, watermark + 1))
        elif state.exists:
            state.remove()
        if changed is not None and len(changed):
            yield changed[["event_id", "rating", "us"]]

    rated = (
        events.where("kind = 'feedback'")
        .select("event_id", "rating", F.expr("try_to_timestamp(ts)").alias("at"))
        .where("event_id is not null and rating is not null and at is not null")
        .withWatermark("at", late)
        .withColumns({"us": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int")})
    )
    changes = rated.groupBy("bucket").applyInPandasWithState(
        settle, "event_id string, rating string, us long", "newest binary", "update", "EventTimeTimeout"
    )
    return changes.select("event_id", "rating", F.timestamp_micros("us").alias("at"))


def keep_updates(
    updates: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None
) -> DataStreamWriter:
    """Store what a micro-batch changed (``each`` of it, if given) under the batch's number; a replayed batch replaces itself.

    Aggregations run in update mode, so the watermark frees their state. Ratings need no state: each batch is reduced by
    itself, and :func:`latest` settles between batches.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return updates.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)


def _complete(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the finished epochs and of the finished folds below ``path``."""
    return finished_parts(spark, path, "epoch"), finished_parts(spark, path, "upto")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest fold and of the epochs after it, with their ``epoch``."""
    epochs, folds = _complete(spark, path)
    upto = folds[-1] if folds else -1
    parts = [spark.read.parquet(f"{path}/upto={upto}")] if folds else []
    after = [f"{path}/epoch={n}" for n in epochs if n > upto]
    if after or not parts:
        parts.append(spark.read.option("basePath", path).parquet(*(after or [path])).withColumn("epoch", F.col("epoch").cast("long")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def latest(spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str] = ("epoch",)) -> DataFrame:
    """The current row of every key of such a table: the one that is last by ``by``."""
    rows = _stored(spark, path)
    payload = [c for c in rows.columns if c not in (*keys, "epoch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*by)).alias("_row"))
    return last.select(*keys, "_row.*")


def fold_epochs(spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str] = ("epoch",)) -> int | None:
    """Write the current row of every key as one table that stands for all epochs so far; its number, or None if nothing is new.

    Readers take it once it is finished, so a fold that stops halfway changes nothing and is overwritten by the next try.
    The stream may go on meanwhile; ``by`` must be the one that :func:`latest` is called with.
    """
    epochs, folds = _complete(spark, path)
    if not epochs or (folds and folds[-1] >= epochs[-1]):
        return None
    rows = _stored(spark, path).where(F.col("epoch") <= epochs[-1])
    payload = F.struct(*[c for c in rows.columns if c not in keys])
    last = rows.groupBy(*keys).agg(F.max_by(payload, F.struct(*by)).alias("_row"))
    last.select(*keys, "_row.*").write.mode("overwrite").parquet(f"{path}/upto={epochs[-1]}")
    return epochs[-1]


def remove_folded(spark: SparkSession, path: str) -> int:
    """Delete the epochs and folds that the newest fold stands for; call it when no reader uses them. Returns how many."""
    epochs, folds = _complete(spark, path)
    old = [f"epoch={n}" for n in epochs if folds and n <= folds[-1]] + [f"upto={n}" for n in folds[:-1]]
    for name in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)


def upsert_chunks(chunks: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Merge each micro-batch of new chunks with ``merge(batch, number)``, e.g. a user index write of that version."""

    def apply(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            merge(batch, epoch)

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)

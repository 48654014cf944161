"""Writes. Appends never touch stored rows; replacements touch only the partitions that hold what they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.goldset import review_rows
from folioscope.session import cut_lineage
from folioscope.sources.segments import UserIndex, merge_segments, read_user_index, remove_superseded, write_user_index

__all__ = [
    "UserIndex", "append_events", "append_feedback", "merge_segments", "read_user_index", "remove_superseded", "replace_figures",
    "write_report", "write_review", "write_user_index",
]


FIGURE_BUCKETS = 128


def utc_stamp():
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def append_events(events: DataFrame, path: str) -> None:
    """One JSON object per line, stamped in UTC where the row has no stamp yet."""
    stamp = F.coalesce("ts", utc_stamp()) if "ts" in events.columns else utc_stamp()
    events.withColumns({"kind": F.lit("query"), "ts": stamp}).write.mode("append").json(path)


def append_feedback(feedback: DataFrame, path: str) -> None:
    """``feedback(event_id, rating, note)`` as records of their own; query rows stay as they are."""
    feedback.select(
        F.lit("feedback").alias("kind"), "event_id", utc_stamp().alias("ts"), "rating",
        F.coalesce("note", F.lit("")).alias("note"),
    ).write.mode("append").json(path)


def _has_parts(spark: SparkSession, path: str, by: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}=*")
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def replace_figures(figures: DataFrame, path: str) -> None:
    """Replace all figure rows of every document in ``figures``; other documents stay.

    Documents are stored by a hash of their name, ``bucket``, in at most ``FIGURE_BUCKETS`` folders however many there are. A bucket
    that ``figures`` carries is written again with its other documents, the rest is not touched.
    """
    spark = figures.sparkSession
    bucket = F.pmod(F.xxhash64("doc_name"), F.lit(FIGURE_BUCKETS)).cast("int")
    rows = cut_lineage(figures.withColumn("bucket", bucket))
    if _has_parts(spark, path, "bucket"):
        carried = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most FIGURE_BUCKETS numbers
        stored = spark.read.parquet(path).where(F.col("bucket").isin(carried))
        names = rows.select(F.col("doc_name").alias("_name")).distinct()
        kept = stored.join(names, F.col("doc_name").eqNullSafe(F.col("_name")), "left_anti")
        rows = cut_lineage(rows.unionByName(kept, allowMissingColumns=True))
    writer = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """A metrics, failure, sweep or calibration table as JSON lines, one folder per config where there is one."""
    writer = metrics.write.mode("overwrite")
    if "config" in metrics.columns:
        writer = writer.partitionBy("config")
    writer.json(path)


def write_review(gold: DataFrame, path: str) -> None:
    """Review table, worst leak first; files keep that order."""
    review_rows(gold).write.mode("overwrite").json(path)

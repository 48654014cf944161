"""Scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from folioscope.functions import text as T

MAX_TAIL = 5000
_BAD = "_malformed"

FACT_SCHEMA = "id string, ts string, user string, fact string, pinned boolean, source string"
FIGURE_SCHEMA = "image_id string, doc_name string, page int, caption string, nearby_chunk_id string"
GOLD_SCHEMA = (
    "q string, gold_chunk_id string, source string, is_math boolean, leak_score double, model string, "
    "prompt_version int, chunk_text string"
)
FOLLOWUP_SCHEMA = "gold_chunk_id string, q1 string, q2 string"
ITEM_SCHEMA = "id string, topic string, question string, answer string, aliases array<string>"


def _schema(schema: str | TY.StructType) -> TY.StructType:
    return TY.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def load_corpus(spark: SparkSession, paths: str | Sequence[str], user: str = "shared") -> DataFrame:
    """``*.mmd`` files of the given folders (not their subfolders) or files, one row per file.

    Files of any other kind are skipped. ``doc_pos`` is a hash of the path: stable between runs and without
    global numbering. It orders documents and does not identify them.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = (
        spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.mmd")
        .load(paths).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    )
    return files.select(
        F.when(F.col("path").isNotNull(), F.lit(user)).alias("user"),
        T.basename(F.url_decode(F.col("path"))).alias("source"),
        F.pmod(F.xxhash64("path"), F.lit((1 << 63) - 1)).alias("doc_pos"),
        "text",
    )


def parse_jsonl(lines: DataFrame, schema: str | TY.StructType, required: Sequence[str] = ()) -> DataFrame:
    """``lines(value, ..)`` → typed rows; blank and malformed lines and rows lacking a required field drop out."""
    full = TY.StructType([*_schema(schema).fields, TY.StructField(_BAD, TY.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    extra = [c for c in lines.columns if c != "value"]
    # a JSON scalar or array is valid JSON but no record
    parsed = lines.where(F.trim("value").startswith("{")).select(
        *extra, F.from_json("value", full, options).alias("r")
    )
    rows = parsed.where(F.col(f"r.{_BAD}").isNull()).select(*extra, "r.*").drop(_BAD)
    for name in required:
        rows = rows.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return rows


def read_jsonl(
    spark: SparkSession, path: str, schema: str | TY.StructType, required: Sequence[str] = ()
) -> DataFrame:
    """Tolerant JSON-lines scan; a missing path is an empty table."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _schema(schema))
    return parse_jsonl(lines, schema, required)


def tail_events(lines: DataFrame, n: int, schema: str | TY.StructType, pos: str = "pos") -> DataFrame:
    """The last ``n`` raw lines (1..``MAX_TAIL``) in log order, malformed ones dropped afterwards."""
    if not 1 <= n <= MAX_TAIL:
        raise ValueError(f"n must be between 1 and {MAX_TAIL}")
    newest = lines.orderBy(F.col(pos).desc()).limit(n)
    return parse_jsonl(newest, schema).orderBy(pos)


def read_exam(spark: SparkSession, path: str, schema: str, first: int | None = None) -> DataFrame:
    """Benchmark set in JSON lines; blank lines are skipped, a missing file or a bad line is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if first is None else rows.limit(first)


def raw_figures(files: DataFrame) -> DataFrame:
    """``files(doc_name, json)``, a JSON array of ``{page, bytes_b64}`` → one row per decodable image.

    ``n`` is the position in the array, undecodable entries counted.
    """
    entries = F.from_json("json", "array<struct<page:int,bytes_b64:string>>")
    return (
        files.select("doc_name", F.posexplode(entries).alias("n", "image"))
        .select("doc_name", "n", "image.page", F.try_to_binary("image.bytes_b64", F.lit("base64")).alias("bytes"))
        .where("bytes IS NOT NULL")
        .withColumn("image_id", F.concat_ws("::img", "doc_name", "n"))
    )

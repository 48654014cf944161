"""Session set-up and the one place that decides where lineage cuts are stored."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "folioscope") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a folder of its own; a cluster without one is a configuration error, since
    a machine-local folder would not survive the loss of that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back from there.

    Unlike an RDD checkpoint this computes the plan once and keeps column pruning. ``codec`` is for tables as large as the texts.
    """
    path = scratch_path(df.sparkSession, "cut")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that are run inside go when each ends, not when the driver happens to collect its garbage.

    For writes: a table that is written is planned anew, so nothing later reads those files.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, for tables one job writes and reads back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def finished_parts(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the tables ``path/name=<number>`` that are written to their end, as their success mark says."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in files.listStatus(folder) if files.exists(folder) else []:
        named = re.fullmatch(rf"{name}=(\d+)", entry.getPath().getName())
        if named and files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(named[1]))
    return sorted(found)


def bound_batches(spark: SparkSession, rows: int) -> None:
    """Hand Python at most ``rows`` rows at a time from now on, for columns of whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python at most ``rows`` rows at a time in the jobs that are run inside, for rows that each stand for many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    bound_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows holding at most ``max_bytes`` of values.

    The check reads no more than ``max_rows + 1`` rows, and only their sizes leave the tasks. Strings and binaries count
    with their bytes, everything nested with the bytes of its text form, other columns with eight.
    """

    def width(f) -> Column:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            return F.octet_length(F.col(f"`{f.name}`"))
        if kind in ("array", "struct", "map"):
            return F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        return F.lit(8)

    size = reduce(lambda a, c: a + c, [F.coalesce(width(f), F.lit(0)).cast("long") for f in df.schema], F.lit(0).cast("long"))
    head = df.select(size.alias("_bytes")).limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes")).first()
    return head["n"] <= max_rows and head["bytes"] <= max_bytes


def join_items(questions: DataFrame, items: DataFrame, by: str, item_key: str, salts: int = 32) -> DataFrame:
    """Pair every question with the items of its ``by`` value, for scorers that must see each pair.

    Questions within the broadcast bound are shipped to the items, which then never move. Beyond it
    both sides are salted by item, so a ``by`` value with a third of all items is spread over tasks.
    Pairs only exist while they stream into the top-k that follows.
    """
    return meet(items, questions, [by], item_key, salts)


def meet(many: DataFrame, few: DataFrame, on: Sequence[str], salt_by: str, salts: int = 32) -> DataFrame:
    """Inner join of two tables with hot keys. ``few`` is shipped if it is within the broadcast bound; beyond it the
    rows of ``many`` are salted by ``salt_by`` and those of ``few`` are repeated for each salt."""
    if fits_broadcast(few):
        return many.join(F.broadcast(few), list(on))
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    fanned = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(fanned, [*on, "_salt"]).drop("_salt")


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle partition count, for repartitions adaptive execution must not narrow."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

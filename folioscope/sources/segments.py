"""A stored user index of immutable segments.

An upload writes one segment: its own chunks, their vectors, forward rows and posting blocks, what it changes in the
counts of its users, and tombstones for the chunks it replaces. A chunk keeps its position when it is replaced, so a
tombstone is a position, and a row is live if no later segment has buried it. Counts are sums over segments. A merge
writes the newest segments anew as one; what it replaces can then be removed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.models import Embedder
from folioscope.operators.chunking import latest_by_id
from folioscope.operators.dense import embed
from folioscope.operators.lexical import BlockIndex, LexicalIndex, blocks_of, impact, term_weights
from folioscope.operators.ordering import number_rows
from folioscope.session import cut_lineage

TABLES = ("keys", "chunks", "vectors", "forward", "blocks", "gone", "terms", "stats")
COMMITS = "version long, batch long, merged array<long>"


@dataclass(frozen=True)
class UserIndex:
    chunks: DataFrame  # user, ord, chunk_id, source, text, ..
    lexical: LexicalIndex
    vectors: DataFrame  # user, ord, chunk_id, embedding
    blocks: BlockIndex


def _commits(spark: SparkSession, path: str) -> list:
    """All commits, one small row each."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def active_versions(spark: SparkSession, path: str) -> list[int]:
    """The segments that make up the index, oldest first."""
    return _active(_commits(spark, path))


def _active(found: list) -> list[int]:
    merged = {v for c in found for v in c["merged"]}
    return sorted(c["version"] for c in found if c["version"] not in merged)


def _commit(spark: SparkSession, path: str, version: int, batch: int | None, merged: list[int]) -> None:
    spark.createDataFrame([(version, batch, merged)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _segments(spark: SparkSession, path: str, name: str, versions: list[int]) -> DataFrame:
    """A table of the given segments, with the ``version`` each row is from, as the folders name it."""
    found = spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/version={v}" for v in versions])
    return found.withColumn("version", F.col("version").cast("long"))


def _gone(spark: SparkSession, path: str, versions: list[int]) -> DataFrame:
    return _segments(spark, path, "gone", versions).groupBy("user", "ord").agg(F.max("version").alias("gone"))


def _live(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["user", "ord"], "left").where("gone IS NULL OR gone <= version").drop("gone", "version")


def _write(path: str, version: int, tables: dict[str, DataFrame]) -> None:
    """The tables side by side: most are small, and each is a job that leaves cores free."""
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda t: t[1].write.mode("overwrite").parquet(f"{path}/{t[0]}/version={version}"), tables.items()))


def _stored(spark: SparkSession, path: str, version: int, name: str, df: DataFrame) -> DataFrame:
    """A table of a segment that is written, and read back for those made from it."""
    _write(path, version, {name: df})
    return spark.read.schema(df.schema).parquet(f"{path}/{name}/version={version}")


def _counts(forward: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """What forward rows add to (or take from) the counts of terms and of users."""
    one = F.lit(sign).cast("long")
    terms = forward.select("user", F.explode("terms").alias("t")).select("user", F.col("t.term").alias("term"), one.alias("df"))
    stats = forward.select("user", one.alias("docs"), (F.col("dl") * sign).cast("long").alias("tokens"))
    return terms, stats


def write_user_index(spark: SparkSession, new_chunks: DataFrame, path: str, embedder: Embedder, version: int | None = None) -> None:
    """Upsert chunks by id as one new segment.

    ``new_chunks(user, ord, chunk_id, source, text)``; of equal ids the last by ``ord`` counts. A new id is placed behind its
    user's chunks, a known one stays in its place. Stored text, vectors and postings are neither read nor rewritten: only
    ids, tombstones and the forward rows of what is replaced are read. All tables are written first, then one
    file that names the segment, so readers see a whole upload or nothing of it. One writer at a time. ``version`` is the
    caller's number of the upload: one that is not above all before it changes nothing, so batches can be replayed.
    """
    commits = _commits(spark, path)
    batches = [c["batch"] for c in commits if c["batch"] is not None]
    if version is not None and batches and version <= max(batches):
        return
    if version is None:
        version = max(batches, default=-1) + 1
    name = max((c["version"] for c in commits), default=-1) + 1
    active = _active(commits)
    fresh = latest_by_id(new_chunks).withColumnRenamed("ord", "_arrived")
    if active:
        known = _segments(spark, path, "keys", active).drop("version").withColumnRenamed("ord", "_known")
        fresh = cut_lineage(fresh.join(known, ["user", "chunk_id"], "left"))
        ends = _segments(spark, path, "stats", active).groupBy("user").agg(F.sum("docs").alias("_end"))
    else:
        fresh = cut_lineage(fresh.withColumn("_known", F.lit(None).cast("long")))
        ends = spark.createDataFrame([], "user string, _end long")
    added = fresh.where("_known IS NULL").select("user", F.col("_arrived").alias("ord"))
    places = number_rows(added, ["user"], ["ord"], "_place").join(ends, "user", "left")
    places = places.select("user", F.col("ord").alias("_arrived"), (F.col("_place") + F.coalesce("_end", F.lit(0))).alias("_new"))
    placed = fresh.join(places, ["user", "_arrived"], "left").withColumn("ord", F.coalesce("_known", "_new"))
    payload = [c for c in new_chunks.columns if c not in ("user", "ord", "chunk_id")]
    chunks = _stored(spark, path, name, "chunks", placed.select("user", "ord", "chunk_id", *payload, F.col("_known").isNotNull().alias("again")))

    tokens = chunks.select("user", "ord", T.ws_tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    counted = tokens.select("user", "ord", "dl", F.explode_outer("tokens").alias("term")).groupBy("user", "ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    said = F.filter(F.collect_list(F.struct("term", "tf")), lambda t: t["term"].isNotNull())
    forward = _stored(spark, path, name, "forward", counted.groupBy("user", "ord", "dl").agg(F.sort_array(said).alias("terms")))
    gone = chunks.where("again").select("user", "ord")
    deltas = [_counts(forward, 1)]
    if active:
        before = _segments(spark, path, "forward", active).join(gone, ["user", "ord"], "left_semi")
        deltas.append(_counts(_live(before, _gone(spark, path, active)), -1))
    terms, stats = (reduce(DataFrame.unionByName, parts) for parts in zip(*deltas))
    _write(path, name, {
        "keys": chunks.where("NOT again").select("user", "chunk_id", "ord"),
        "vectors": embed(chunks, embedder).select("user", "ord", "chunk_id", "embedding"),
        "blocks": _blocks(forward),
        "gone": gone,
        "terms": terms.groupBy("user", "term").agg(F.sum("df").alias("df")).where("df <> 0"),
        "stats": stats.groupBy("user").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")),
    })
    _commit(spark, path, name, version, [])


def _blocks(forward: DataFrame) -> DataFrame:
    counted = forward.select("user", "ord", "dl", F.explode("terms").alias("t")).select("user", "ord", "t.term", "t.tf", "dl")
    return blocks_of(counted).sortWithinPartitions("user", "term", "range")


def merge_segments(spark: SparkSession, path: str, newest: int | None = None) -> None:
    """Write the ``newest`` segments (all, if not given) anew as one; readers change over when it is committed.

    Uploads and merges take turns. Dead rows are left behind; tombstones stay if there are older segments.
    """
    active = active_versions(spark, path)
    chosen = active if newest is None else active[-newest:]
    if len(chosen) < 2:
        return
    gone = cut_lineage(_gone(spark, path, chosen))
    live = {n: _live(_segments(spark, path, n, chosen), gone) for n in ("chunks", "vectors", "forward")}
    version = max(c["version"] for c in _commits(spark, path)) + 1
    _write(path, version, {
        "keys": _segments(spark, path, "keys", chosen).drop("version"),
        **live,
        "blocks": _blocks(live["forward"]),
        "gone": gone.select("user", "ord").where(F.lit(len(chosen) < len(active))),
        "terms": _segments(spark, path, "terms", chosen).groupBy("user", "term").agg(F.sum("df").alias("df")).where("df <> 0"),
        "stats": _segments(spark, path, "stats", chosen).groupBy("user").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")),
    })
    _commit(spark, path, version, None, chosen)


def remove_superseded(spark: SparkSession, path: str) -> list[int]:
    """Delete the segments that a committed merge has replaced, and return their numbers. For when no reader of them is left."""
    merged = sorted({v for c in _commits(spark, path) for v in c["merged"]})
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    removed = []
    for v in merged:
        found = False
        for name in TABLES:
            folder = hadoop(f"{path}/{name}/version={v}")
            found |= folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if found:
            removed.append(v)
    return removed


def read_user_index(spark: SparkSession, path: str) -> UserIndex:
    """The live rows of all segments, and the statistics their counts add up to."""
    active = active_versions(spark, path)
    gone = cut_lineage(_gone(spark, path, active))
    forward = _live(_segments(spark, path, "forward", active), gone)
    totals = _segments(spark, path, "stats", active).groupBy("user").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    corpus = cut_lineage(totals.where("n_docs > 0").select("user", "n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl")))
    freq = _segments(spark, path, "terms", active).groupBy("user", "term").agg(F.sum("df").alias("df")).where("df > 0")
    terms, means = term_weights(freq, corpus)
    said = forward.select("user", "ord", "dl", F.explode("terms").alias("t")).join(corpus.select("user", "avgdl"), "user")
    postings = said.select("user", "ord", "t.term", "t.tf", impact(F.col("t.tf"), F.col("dl"), F.col("avgdl")).alias("impact"))
    lexical = LexicalIndex(postings, forward.select("user", "ord", "dl"), terms, corpus.join(means, "user", "left"))
    return UserIndex(
        _live(_segments(spark, path, "chunks", active), gone).drop("again"), lexical, _live(_segments(spark, path, "vectors", active), gone),
        BlockIndex(_segments(spark, path, "blocks", active), gone, lexical),
    )

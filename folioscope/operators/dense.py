"""Vector search for tables of query vectors.

Exact: query vectors are held as matrices next to the stored vectors; each Arrow batch of stored vectors
is multiplied against them in one call and every task keeps only its best ``k`` per question, so
no (question, vector) pair is ever a row. A query table within a checked size is broadcast;
a larger one is met block by block in a co-grouped join, stored slices against query blocks.

Approximate: an inverted file. Centroids are trained on a bounded sample, every vector is stored under its
nearest one, and a question only meets the vectors of the few cells nearest to it, in an equality join on the cell.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.models import Embedder
from folioscope.operators.ordering import top_k
from folioscope.session import bound_batches, cut_lineage, fits_broadcast

BROADCAST_QUERIES = 8_192
QUERY_BLOCK = 16_384
VECTOR_SLICE = 131_072
SCORE_DIGITS = 9
CELL_SAMPLE = 16_384  # vectors that the centroids of cells are trained on
MOST_CELLS = 4_096
PROBED = 0.075  # share of the cells that a question meets
_ROWS = 8_192  # stored vectors multiplied at a time
_PRODUCTS = 1 << 21  # products held at a time, whatever the number of questions or cells
TEXT_BATCH = 500  # texts that an embedder is handed at a time
OUT = "user string, qid long, ord long, score double"
OUT_ARROW = pa.schema([("user", pa.string()), ("qid", pa.int64()), ("ord", pa.int64()), ("score", pa.float64())])


def embed(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """Add unit vectors; the same embedder must serve stored texts and questions.

    Sets ``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``TEXT_BATCH`` if it is larger: a batch is whole texts.
    """
    bound_batches(df.sparkSession, TEXT_BATCH)
    return df.withColumn(out, embedder(F.col(text)))


def _pack(batches: Iterator[pa.RecordBatch], encoders: list, spent: list[Accumulator]) -> Iterator[pa.RecordBatch]:
    """Each of ``encoders`` is a model's number, what loads it and the column of texts it reads, from 2."""
    models = {model: load() for model, load, _ in encoders}
    for batch in batches:
        texts: dict[int, list[str]] = {}
        made: dict[int, tuple[int, np.ndarray]] = {}
        columns = []
        for (model, _, at), seconds in zip(encoders, spent):
            begun = time.perf_counter()
            if at not in texts:  # models of one column get the same list
                texts[at] = [text or "" for text in batch.column(at).to_pylist()]
            if model in made:
                # a text that is the same in the other column it has read has the same vector
                other, vectors = made[model]
                new = [n for n, (a, b) in enumerate(zip(texts[at], texts[other])) if a != b]
                vectors = vectors.copy()
                if new:
                    vectors[new] = models[model]([texts[at][n] for n in new])
            else:
                vectors = np.ascontiguousarray(models[model](texts[at]), dtype="<f4")
                made[model] = at, vectors
            width = vectors.itemsize * (vectors.shape[1] if len(vectors) else 0)
            ends = pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            columns.append(pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(vectors)]))
            seconds.add(time.perf_counter() - begun)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["user", "ord", *[f"e{n}" for n in range(len(columns))]])


def embed_all(df: DataFrame, embedders: Sequence[Embedder]) -> tuple[DataFrame, list[Accumulator]]:
    """``df(user, ord, text)`` → ``user, ord, e0, e1, ..``: the vectors of every embedder as the bytes of their floats, from one
    pass over the texts, and the seconds the tasks spend on each. All embedders have an ``encoder``.

    Sets ``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``TEXT_BATCH`` if it is larger.
    """
    spark = df.sparkSession
    bound_batches(spark, TEXT_BATCH)
    columns, encoders, read, models = [F.col("user").cast("string"), F.col("ord").cast("long")], [], {}, {}
    for e in embedders:
        reads = getattr(e, "reads", None)
        if reads not in read:
            read[reads] = len(columns)
            columns.append((reads(F.col("text")) if reads else F.col("text")).alias(f"t{len(columns)}"))
        encoders.append((models.setdefault(id(e.encoder), len(models)), e.encoder, read[reads]))
    spent = [spark.sparkContext.accumulator(0.0) for _ in encoders]
    kinds = ", ".join(f"e{n} binary" for n in range(len(encoders)))
    return df.select(*columns).mapInArrow(partial(_pack, encoders=encoders, spent=spent), f"user string, ord long, {kinds}"), spent


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array of numbers, or of the bytes of floats."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
        floats = np.frombuffer(column.buffers()[2], "<f4", (ends[-1] - ends[0]) // 4, ends[0])
        return floats.astype(np.float64).reshape(len(column), -1)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Best:
    """Best ``k`` (score, ord) per question seen so far by one task."""

    def __init__(self, qids: np.ndarray, asked: np.ndarray, k: int):
        self.qids, self.asked, self.k = qids, asked, k
        self.who = self.ords = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0)
        self.floor = np.full(len(qids), -np.inf)  # the k-th best score so far

    def products(self, at: int, upto: int, block) -> np.ndarray:
        """Scores of the questions ``at`` to ``upto`` (rows) for the block's rows (columns)."""
        return self.asked[at:upto] @ block.T

    def _reaching(self, at: int, rows: np.ndarray, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question, score and ord of the products that may be among the best, of the questions from ``at``."""
        scores = np.round(self.products(at, min(len(self.qids), at + max(1, _PRODUCTS // len(rows))), block), SCORE_DIGITS)
        least = self.floor[at : at + len(scores)].copy()
        many = np.flatnonzero(np.count_nonzero(scores >= least[:, None], axis=1) > self.k)
        if len(many):
            # everything at or above the k-th score stays, so ties are settled by ord later
            least[many] = np.partition(scores[many], len(rows) - self.k, axis=1)[:, len(rows) - self.k]
        who, row = np.nonzero(scores >= least[:, None])
        return who + at, scores[who, row], rows[row]

    def offer(self, ords: np.ndarray, stored: np.ndarray) -> None:
        for at in range(0, len(ords), _ROWS):
            self.take(ords[at : at + _ROWS], stored[at : at + _ROWS])

    def take(self, rows: np.ndarray, block) -> None:
        met = [self._reaching(q, rows, block) for q in range(0, len(self.qids), max(1, _PRODUCTS // len(rows)))]
        who, score, met = (np.concatenate(c) for c in zip((self.who, self.scores, self.ords), *met))
        order = np.lexsort((met, -score, who))
        first = np.searchsorted(who[order], np.arange(len(self.qids)))
        place = np.arange(len(order)) - first[who[order]]
        order, last = order[place < self.k], order[place == self.k - 1]
        self.who, self.scores, self.ords = who[order], score[order], met[order]
        self.floor[who[last]] = score[last]

    def batches(self, user: str) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([user] * len(self.who), pa.string()), pa.array(self.qids[self.who], pa.int64()),
                pa.array(self.ords, pa.int64()), pa.array(self.scores, pa.float64()),
            ],
            schema=OUT_ARROW,
        )


def _search_broadcast(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    best: dict[str, _Best] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        users = np.asarray(batch.column("user").to_pylist(), dtype=object)
        ords = batch.column("ord").to_numpy(zero_copy_only=False)
        stored = _matrix(batch.column("embedding"))
        for user in set(users.tolist()) & shared.value.keys():
            mine = users == user
            best.setdefault(user, _Best(*shared.value[user], k)).offer(ords[mine], stored[mine])
    for user, kept in best.items():
        yield from kept.batches(user)


def _search_blocks(stored: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    if not stored.num_rows or not asked.num_rows:
        return OUT_ARROW.empty_table()
    stored, asked = stored.combine_chunks(), asked.combine_chunks()
    best = _Best(asked.column("qid").to_numpy(), _matrix(asked.column("embedding").combine_chunks()), k)
    best.offer(stored.column("ord").to_numpy(), _matrix(stored.column("embedding").combine_chunks()))
    return pa.Table.from_batches(list(best.batches(stored.column("user")[0].as_py())), OUT_ARROW)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact ``k`` nearest by dot product of unit vectors (same order as squared L2).

    ``vectors(user, ord, embedding)``, ``queries(user, qid, embedding)`` →
    ``(user, qid, ord, score, rank)``; ties go to the lower ``ord``. An embedding is an array or, as of :func:`embed_all`, bytes.
    """
    stored = vectors.select("user", F.col("ord").cast("long"), "embedding")
    asked = queries.select("user", F.col("qid").cast("long"), "embedding")
    if fits_broadcast(asked, BROADCAST_QUERIES):
        rows = asked.collect()  # at most BROADCAST_QUERIES rows
        packed = {
            u: (
                np.array([r[1] for r in rows if r[0] == u], dtype=np.int64),
                np.array([r[2] for r in rows if r[0] == u], dtype=np.float64),
            )
            for u in {r[0] for r in rows}
        }
        shared = vectors.sparkSession.sparkContext.broadcast(packed)
        found = stored.mapInArrow(partial(_search_broadcast, shared=shared, k=k), OUT)
    else:
        slices = max(1, -(-stored.count() // VECTOR_SLICE))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        left = stored.withColumns(
            {
                "slice": F.pmod(F.xxhash64("ord"), F.lit(slices)).cast("int"),
                "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
            }
        )
        right = asked.withColumns(
            {
                "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))),
                "block": F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"),
            }
        )
        keys = ["user", "slice", "block"]
        found = (
            left.groupBy(*keys)
            .cogroup(right.groupBy(*keys))
            .applyInArrow(lambda a, b: _search_blocks(a, b, k), OUT)
        )
    return top_k(found, ["user", "qid"], [F.col("score").desc(), F.col("ord").asc()], k)


@dataclass(frozen=True)
class CellIndex:
    """Vectors stored by cell. ``centroids`` has at most ``MOST_CELLS`` rows, whatever the number of vectors."""

    centroids: np.ndarray
    stored: DataFrame  # user, cell, part, ord, embedding
    sizes: DataFrame  # user, cell, n, parts


def train_centroids(vectors: DataFrame, cells: int | None = None, sample: int = CELL_SAMPLE, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means over the ``sample`` vectors with the smallest hash of user and ord.

    Without ``cells`` there are eight times the root of the number of vectors, at most ``MOST_CELLS``. Only the sample, whose
    size is the bound, comes to the driver.
    """
    many = vectors.count()
    place = F.pmod(F.xxhash64("user", "ord", F.lit(seed)), F.lit(1 << 40))
    near = vectors.select(place.alias("_place"), "user", "ord", "embedding").where(F.col("_place") <= (1 << 40) * min(1.0, (2 * sample + 200) / max(1, many)))
    rows = near.orderBy("_place", "user", "ord").limit(sample).select("embedding").toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    points = _matrix(rows.column("embedding").combine_chunks())
    cells = max(1, min(cells or int(8 * many**0.5), MOST_CELLS, len(points)))
    centroids = points[:cells].copy()
    for _ in range(rounds):
        of = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0), centroids)
    return centroids


def _nearest_cells(df: DataFrame, centroids: np.ndarray, many: int) -> DataFrame:
    """``df(user, <id>, embedding)`` with the ``cells`` (array) of its ``many`` best centroids, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    many = min(many, len(centroids))
    step = max(1, min(_ROWS, _PRODUCTS // len(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                scores = np.round(_matrix(part.column(2)) @ shared.value.T, SCORE_DIGITS)
                # of equal scores the first cell counts in both
                best = scores.argmax(axis=1)[:, None] if many == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :many]
                best = best.astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, many), pa.int32()), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], [*part.schema.names, "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, cells array<int>")


def build_cells(vectors: DataFrame, centroids: np.ndarray | None = None, slice_rows: int = VECTOR_SLICE) -> CellIndex:
    """Store every row of ``vectors(user, ord, embedding)`` under its nearest centroid; a cell with more than ``slice_rows``
    vectors of a user is split into parts by ``ord``. Rows come in again with the same centroids by another call."""
    centroids = train_centroids(vectors) if centroids is None else centroids
    placed = _nearest_cells(vectors.select("user", F.col("ord").cast("long"), "embedding"), centroids, 1)
    placed = cut_lineage(placed.select("user", "ord", "embedding", F.col("cells")[0].alias("cell")))
    sizes = placed.groupBy("user", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes.withColumn("parts", F.ceil(F.col("n") / slice_rows).cast("int")))
    stored = placed.join(sizes.select("user", "cell", "parts"), ["user", "cell"])
    stored = stored.select("user", "cell", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int").alias("part"), "ord", "embedding")
    return CellIndex(centroids, stored, sizes)


def probed_cells(index: CellIndex, queries: DataFrame, probed: float = PROBED) -> DataFrame:
    """One row for each question and cell it meets: ``user, qid, embedding, cell``; the nearest share ``probed`` of all cells."""
    many = max(1, int(np.ceil(probed * len(index.centroids))))
    asked = _nearest_cells(queries.select("user", F.col("qid").cast("long"), "embedding"), index.centroids, many)
    return asked.select("user", "qid", "embedding", F.explode("cells").alias("cell"))


def dense_top_k_approx(index: CellIndex, queries: DataFrame, k: int, probed: float = PROBED, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best of the vectors in the cells a question meets, scored exactly; columns as of :func:`dense_top_k`.

    Parts of cells meet blocks of questions, so neither a crowded cell nor a cell that most questions probe is one task.
    """
    asked = cut_lineage(probed_cells(index, queries, probed))
    busy = asked.groupBy("user", "cell").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
    plan = cut_lineage(index.sizes.join(busy, ["user", "cell"]).select("user", "cell", "parts", "blocks"))
    left = index.stored.join(plan.select("user", "cell", "blocks"), ["user", "cell"])
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = asked.join(plan, ["user", "cell"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")
    keys = ["user", "cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search_blocks(a, b, k), OUT)
    return top_k(found, ["user", "qid"], [F.col("score").desc(), F.col("ord").asc()], k)


def scored_share(index: CellIndex, queries: DataFrame, probed: float = PROBED) -> DataFrame:
    """``share_scored``: the (question, vector) pairs the approximate search multiplies, of all pairs of a user."""
    asked = probed_cells(index, queries, probed).groupBy("user", "cell").agg(F.count(F.lit(1)).alias("asked"))
    met = index.sizes.join(asked, ["user", "cell"]).agg(F.sum(F.col("n") * F.col("asked")).alias("met"))
    every = index.sizes.groupBy("user").agg(F.sum("n").alias("n")).join(queries.groupBy("user").agg(F.count(F.lit(1)).alias("q")), "user")
    every = every.agg(F.sum(F.col("n") * F.col("q")).alias("every"))
    return met.crossJoin(every).select(F.round(F.coalesce("met", F.lit(0)) / F.col("every"), 6).alias("share_scored"))  # one row each


def recall_against_exact(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours the approximate search also returned, over all questions."""
    hits = exact.join(
        approx.select("user", "qid", "ord", F.lit(1).alias("_hit")), ["user", "qid", "ord"], "left"
    )
    return hits.agg(
        F.count(F.lit(1)).alias("n_exact"), F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("recall")
    )


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label: averages per axis, pre-aggregated map-side."""
    axes = vectors.select("label", F.posexplode("embedding").alias("axis", "x"))
    means = axes.groupBy("label", "axis").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("axis", "mean"))), lambda s: s["mean"]).alias("embedding")
    )

"""Exact top-k inner products with block-at-a-time pruning.

Vectors are whole numbers; a dimension is a term. Documents are cut into blocks of neighbouring ids, and a
block keeps the largest and smallest value of each term beside its forward index (its rows). For a query the
block's bound is the sum over terms of the query's weight times the extreme that suits its sign. Blocks
are taken by falling bound and scored row by row through the forward index, until the bound falls
below the query's k-th best score so far; a bound equal to it is still scored, for ties.

Blocks come in shelves, ranges of ids of a bounded number of rows, and queries in batches of a bounded number; a cell (shelf,
batch) is one group. A shelf's bound is made like a block's. First each query is searched in the shelf of its highest
bound alone, which gives it a score that k documents reach. It then goes only to shelves whose bound reaches that
score, and starts there from it; a shelf is copied once for each batch that has such a query. The best k of all its cells are
the answer, so the first search only sets the score to start from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._tables import cut_lineage, shuffle_width
from folioscope.operators.ordering import top_k

BLOCK, SHELF, BATCH = 64, 8192, 4096
LOWEST = int(np.iinfo(np.int64).min)


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of every component, x as double.

    Null keys, null vectors and vectors with a null or non-finite component take no part.
    """
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(~odd)
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(vs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vs), width), np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: by floats while every sum is a whole number below 2^53, else by 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Upper bounds (query, block) of the products with any row between the blocks' extremes."""
    return _product(np.maximum(queries, 0), most) + _product(np.minimum(queries, 0), least)


def search_cell(
    ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None
) -> tuple[list[tuple[int, int, int]], int]:
    """Top k of one shelf for one batch, of scores that reach the query's floor: (position of the query, document, score) rows,
    and how many (query, block) pairs were scored."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    begins = np.arange(0, len(ids), BLOCK)
    bounds = _bounds(queries, np.maximum.reduceat(rows, begins), np.minimum.reduceat(rows, begins))
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # (-score, id), sorted
    floor = np.full(len(query_ids), LOWEST) if floors is None else floors.astype(np.int64)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    scored = 0
    for step in range(len(begins)):
        block_of = turn[:, step]
        active = np.flatnonzero(bounds[np.arange(len(query_ids)), block_of] >= floor)
        if not len(active):
            break
        scored += len(active)
        by_block = active[np.argsort(block_of[active], kind="stable")]
        cuts = np.flatnonzero(np.diff(block_of[by_block])) + 1
        for group in np.split(by_block, cuts):
            low = begins[block_of[group[0]]]
            part = ids[low : low + BLOCK]
            scores = _product(queries[group], rows[low : low + BLOCK])
            for q, line in zip(group, scores):
                good = np.flatnonzero((line >= floor[q]) & (part != query_ids[q]))
                if len(good):
                    merged = sorted(best[q] + [(-int(line[i]), int(part[i])) for i in good])[:k]
                    best[q] = merged
                    if len(merged) == k:
                        floor[q] = max(floor[q], -merged[-1][0])
    return [(q, d, -s) for q in range(len(query_ids)) for s, d in best[q]], scored


def top_products(documents: DataFrame, queries: DataFrame, k: int = 10, shelf: int = SHELF, batch: int = BATCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best documents but itself, ties to the smaller id.

    Both tables have ``vec_id`` and ``v`` (array<long>); shorter vectors count as filled up with zeros. Sums beyond 64
    bits wrap as Java's long does. Rows with one id are kept apart.
    """
    n = shuffle_width(documents)
    shelves, batches = max(1, -(-documents.count() // shelf)), max(1, -(-queries.count() // batch))
    # ranges of ids, so blocks are neighbours; the second key splits repeated ids
    ranged = documents.select("vec_id", "v", F.monotonically_increasing_id().alias("_tie")).repartitionByRange(shelves, "vec_id", "_tie")
    placed = cut_lineage(ranged.select("vec_id", "v", F.spark_partition_id().alias("shelf")))
    numbered = queries.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("asked"))
    asked = cut_lineage(numbered.withColumn("batch", F.pmod(F.xxhash64("q"), F.lit(batches)).cast("int")))

    def summary(docs: pd.DataFrame) -> pd.DataFrame:
        rows = _matrix(docs["v"], docs["v"].map(len).max())
        return pd.DataFrame({"shelf": docs["shelf"].iloc[:1], "most": [rows.max(axis=0)], "least": [rows.min(axis=0)]})

    extremes = cut_lineage(placed.groupBy("shelf").applyInPandas(summary, "shelf int, most array<long>, least array<long>"))

    def reached(asking: DataFrame, best: bool) -> DataFrame:
        """``q, shelf, bound``: the shelf of the highest bound, or every shelf whose bound reaches the query's floor."""
        racks = -(-shelves // shelf)
        left = extremes.withColumn("rack", F.pmod("shelf", F.lit(racks))).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        right = asking.withColumn("rack", F.explode(F.sequence(F.lit(0), F.lit(racks - 1))))

        def meet(held: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(who):
                return pd.DataFrame({"q": [], "shelf": [], "bound": []}).astype("int64")
            width = max(1, held["most"].map(len).max(), who["asked"].map(len).max())
            bounds = _bounds(_matrix(who["asked"], width), _matrix(held["most"], width), _matrix(held["least"], width))
            if best:
                at, of = np.arange(len(who)), bounds.argmax(axis=1)
            else:
                at, of = np.nonzero(bounds >= who["floor"].to_numpy()[:, None])
            return pd.DataFrame({"q": who["q"].to_numpy()[at], "shelf": held["shelf"].to_numpy()[of], "bound": bounds[at, of]})

        groups = [df.repartition(n, "rack", "batch").groupBy("rack", "batch") for df in (left, right)]
        return groups[0].cogroup(groups[1]).applyInPandas(meet, "q long, shelf int, bound long")

    def search(routed: DataFrame) -> DataFrame:
        """``q, query_id, vec_id, score``: the best k of every (query, shelf) in ``routed``."""
        routed = cut_lineage(routed)
        # an alias, so that both sides of the co-group have columns of their own
        left = placed.join(routed.select("shelf", F.col("batch").alias("batch")).distinct(), "shelf")

        def cell(docs: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
            if not len(docs) or not len(who):
                return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
            width = max(1, docs["v"].map(len).max(), who["asked"].map(len).max())
            ids, query_ids = docs["vec_id"].to_numpy(), who["query_id"].to_numpy()
            found, _ = search_cell(ids, _matrix(docs["v"], width), query_ids, _matrix(who["asked"], width), k, who["floor"].to_numpy())
            at, doc, score = (np.array(c, np.int64) for c in zip(*found)) if found else [np.empty(0, np.int64)] * 3
            return pd.DataFrame({"q": who["q"].to_numpy()[at], "query_id": query_ids[at], "vec_id": doc, "score": score})

        groups = [df.repartition(n, "shelf", "batch").groupBy("shelf", "batch") for df in (left, routed)]
        return groups[0].cogroup(groups[1]).applyInPandas(cell, "q long, query_id long, vec_id long, score long")

    home = reached(asked, best=True).groupBy("q").agg(F.max_by("shelf", F.struct("bound", "shelf")).alias("shelf"))
    first = search(asked.join(home, "q").withColumn("floor", F.lit(LOWEST)))
    floors = first.groupBy("q").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("floor")).where(F.col("_n") == k)
    started = cut_lineage(asked.join(floors.drop("_n"), "q", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST))))
    found = search(started.join(reached(started, best=False).select("q", "shelf"), "q"))
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")

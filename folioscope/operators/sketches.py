"""Quantile sketches that merge: how many values fall into each cell of a logarithmic scale.

A cell spans values whose ratio is at most ``(1 + a) / (1 - a)`` for the accuracy ``a``. A sketch is a table with one row
per (group, cell): the count and the smallest and largest value seen. Merging adds counts, so a sketch rolled up from hours to days is,
row for row, the sketch of the days' values, in whatever order and batches they came. At an accuracy of 1 % the whole range of
doubles has about 71,000 cells a sign, real latencies some hundreds; that bounds a group however many rows it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 0.01
_MIDDLE = 1 << 40  # cells of positive values lie around it, those of negative ones around its negative, zero in cell 0


def _log_ratio(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("an accuracy lies between 0 and 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def cell(value: Column, accuracy: float = ACCURACY) -> Column:
    """The cell of a value; cells are ordered like their values. Null for null, NaN and infinite values."""
    v = value.cast("double")
    place = F.ceil(F.log(F.abs(v)) / F.lit(_log_ratio(accuracy))) + F.lit(_MIDDLE)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, F.when(v == 0, F.lit(0)).when(v > 0, place).otherwise(-place)).cast("long")


def cell_value(at: Column, accuracy: float = ACCURACY) -> Column:
    """The value of a cell that no value of it is further from than ``accuracy`` times itself."""
    r = _log_ratio(accuracy)
    size = F.exp((F.abs(at) - F.lit(_MIDDLE)) * F.lit(r)) * F.lit(2 / (1 + math.exp(r)))
    return F.when(at == 0, F.lit(0.0)).otherwise(F.signum(at.cast("double")) * size)


def sketch(rows: DataFrame, by: Sequence[str | Column], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """``by``, ``cell``, ``n``, ``low``, ``high`` of batches or of a stream; null and non-finite values take no part."""
    valued = rows.withColumn("_v", F.col(value).cast("double")).withColumn("cell", cell(F.col("_v"), accuracy))
    return valued.where("cell is not null").groupBy(*by, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )


def merge(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """The sketch of coarser groups (``by``; empty for one of everything) from sketch rows, which may repeat cells."""
    return sketches.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(merged: DataFrame, by: Sequence[str], qs: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """``by``, ``q``, ``n``, ``value``, ``low``, ``high``, ``rank_error`` from a sketch with one row per (group, cell).

    The exact quantile is the value of rank ``max(1, ceil(q * n))``; it lies between ``low`` and ``high``, and ``value`` is
    within ``accuracy`` of it relative to its size. No rank that ``value`` could have is further than ``rank_error`` from the one asked for: rows
    outside the cell are counted exactly.
    """
    # a group's window sees its cells, never its rows
    keys = list(by) or [F.lit(0)]
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("cell"))
    counted = merged.withColumns({"_upto": upto, "_all": F.sum("n").over(W.partitionBy(*keys))})
    asked = counted.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("q") * F.col("_all")))
    found = asked.withColumn("_rank", rank).where("_rank <= _upto and _rank > _upto - n")
    return found.select(
        *by, "q", F.col("_all").alias("n"),
        F.least("high", F.greatest("low", cell_value(F.col("cell"), accuracy))).alias("value"), "low", "high",
        F.greatest(F.col("_upto") - F.col("_rank"), F.col("_rank") - (F.col("_upto") - F.col("n") + 1)).alias("rank_error"),
    )

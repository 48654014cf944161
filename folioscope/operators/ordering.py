"""Ordering primitives that stay distributed when one key holds most of the rows.

``top_k`` prunes inside every map task before anything is shuffled. The numbering helpers
never open a window over a whole group: rows are range-partitioned into bounded slabs, each
slab is numbered by itself, and only one small row per (group, slab) is prefix-summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with a 1-based rank.

    The ``rank <= k`` filter lets Spark place a group limit below the shuffle, so a hot group
    ships at most ``k`` rows per task.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _slabs(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by (group, order) and pin the layout, so both readers see the same slabs."""
    ranged = df.repartitionByRange(*by, *order).withColumn("_slab", F.spark_partition_id())
    return cut_lineage(ranged)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group (the row itself excluded).

    ``order`` must be unique within a group. Adds ``out``.
    """
    slabs = _slabs(df, by, order)
    totals = slabs.groupBy(*by, "_slab").agg(F.sum(value).alias("_total"))
    carried = totals.select(
        *by,
        "_slab",
        F.coalesce(
            F.sum("_total").over(W.partitionBy(*by).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_carried"),
    )
    local = W.partitionBy(*by, "_slab").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = slabs.withColumn("_within", F.coalesce(F.sum(value).over(local), F.lit(0)))
    # an equality join on (group, slab) reuses the partitioning of the window above
    return (
        within.join(carried, [*by, "_slab"])
        .withColumn(out, F.col("_within") + F.col("_carried"))
        .drop("_slab", "_within", "_carried")
    )


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """0-based position within the group; ``order`` must be unique within a group."""
    numbered = running_sum(df.withColumn("_one", F.lit(1).cast("long")), by, order, "_one", out)
    return numbered.drop("_one")


def running_sum_by_key(
    df: DataFrame, by: Sequence[str], key: str, value: str, out: str, width: int = 65_536
) -> DataFrame:
    """``running_sum`` for a unique integer ``key``: buckets are fixed key ranges.

    Nothing is materialised. A bucket holds at most ``width`` rows of one group however large
    the group is, and the carried totals are one row per (group, bucket).
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(key) / width))
    totals = bucketed.groupBy(*by, "_bucket").agg(F.sum(value).alias("_total"))
    carried = totals.select(
        *by,
        "_bucket",
        F.coalesce(
            F.sum("_total").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_carried"),
    )
    local = W.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return (
        bucketed.withColumn("_within", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(carried, [*by, "_bucket"])
        .withColumn(out, F.col("_within") + F.col("_carried"))
        .drop("_bucket", "_within", "_carried")
    )


def number_by_key(df: DataFrame, by: Sequence[str], key: str, out: str = "pos", width: int = 65_536) -> DataFrame:
    """0-based position within the group in the order of a unique integer ``key``."""
    numbered = running_sum_by_key(df.withColumn("_one", F.lit(1).cast("long")), by, key, "_one", out, width)
    return numbered.drop("_one")


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values per group with their count and the count of smaller values.

    Rows are pre-aggregated before the sort, so heavy ties cost nothing.
    Columns: ``by``, ``value``, ``n``, ``before``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, by, [value], "n", "before")


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    qs: dict[str, float],
    kind: str = "linear",
) -> DataFrame:
    """Exact quantiles per group as one column per entry of ``qs``.

    ``kind``: ``linear`` interpolates between neighbours; ``nearest`` takes
    ``sorted[min(n-1, int(q*n))]``; ``tail`` takes ``sorted[max(0, int(q*n)-1)]``;
    ``upper`` takes ``sorted[n//2]`` whatever ``q`` is.
    Groups without any value do not appear.
    """
    keyed = df if by else df.withColumn("_all", F.lit(1))
    keys = list(by) or ["_all"]
    counts = value_counts(keyed.select(*keys, value), keys, value)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_size"))
    n = F.col("_size")
    wanted = []
    for name, q in qs.items():
        if kind == "linear":
            at = (n - 1) * F.lit(float(q))
            lo, hi = F.floor(at), F.ceil(at)
        elif kind == "nearest":
            lo = hi = F.least(n - 1, F.floor(n * F.lit(float(q))))
            at = lo
        elif kind == "tail":
            lo = hi = F.greatest(F.lit(0).cast("long"), F.floor(n * F.lit(float(q))) - 1)
            at = lo
        elif kind == "upper":
            lo = hi = F.floor(n / 2)
            at = lo
        else:
            raise ValueError(f"unknown quantile kind {kind!r}")
        wanted.append(
            F.struct(
                F.lit(name).alias("q"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"),
                (at - lo).cast("double").alias("frac"),
            )
        )
    asks = F.array(*wanted)

    def inside(i: Column) -> Column:
        return (F.col("before") <= i) & (i < F.col("before") + F.col("n"))

    # every distinct value is tested against the handful of indices asked for; no join per quantile
    hit = counts.join(sizes, keys).select(
        *keys, F.col(value).cast("double").alias("_v"), "n", "before",
        F.explode(F.filter(asks, lambda a: inside(a["lo"]) | inside(a["hi"]))).alias("_ask"),
    )
    lo_v = F.max(F.when(inside(F.col("_ask.lo")), F.col("_v")))
    hi_v = F.max(F.when(inside(F.col("_ask.hi")), F.col("_v")))
    per_q = (
        hit.groupBy(*keys, "_ask.q", "_ask.frac")
        .agg(lo_v.alias("_lo"), hi_v.alias("_hi"))
        .withColumn("_value", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("frac"))
    )
    wide = per_q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == name, F.col("_value"))).alias(name) for name in qs]
    )
    return wide if by else wide.drop("_all")


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, width: int = 1024
) -> DataFrame:
    """For each left row the ``value`` of the last right row of its group with ``on`` ≤ left ``on``.

    ``on`` is an integer column and ``right`` holds one row per (group, on). Distinct left keys
    are bucketed by key range; a bucket sees at most ``width`` keys per side and the value carried
    into it from earlier buckets, so no window spans a whole group. Null when nothing precedes.
    """
    keys = left.where(F.col(on).isNotNull()).select(*by, on).distinct()
    events = keys.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    events = events.unionByName(right.select(*by, on, F.col(value).alias("_v"), F.lit(0).alias("_side")))
    events = events.withColumn("_bucket", F.floor(F.col(on) / width))
    last = events.where("_side = 0").groupBy(*by, "_bucket").agg(F.max_by("_v", on).alias("_last"))
    spine = events.select(*by, "_bucket").distinct().join(last, [*by, "_bucket"], "left")
    carried = spine.select(
        *by,
        "_bucket",
        F.last("_last", ignorenulls=True)
        .over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
        .alias("_carried"),
    )
    local = W.partitionBy(*by, "_bucket").orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    resolved = (
        events.withColumn("_here", F.last("_v", ignorenulls=True).over(local))
        .where("_side = 1")
        .join(carried, [*by, "_bucket"])
        .select(*by, on, F.coalesce("_here", "_carried").alias(value))
    )
    return left.join(resolved, [*by, on], "left")

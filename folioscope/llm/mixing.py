"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are cut into blocks. Weights are whole numbers of blocks out of ``period``, so
block ``k`` (from 1) of a source with ``q`` of ``period`` is released at slot ``floor((k-1) * period / q)`` and
due at slot ``ceil(k * period / q)``. Serving in every slot the released block with the earliest deadline puts
each block between its release and its deadline, so that after any number of slots each source is within
one block of its target. The pattern repeats after ``period`` slots: it is worked out once from the
weights alone (``period`` rows), and every block finds its slot with one small join.

A source that runs out leaves its later slots empty; the others keep their order, and no document is
dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.llm._tables import cut_lineage
from folioscope.operators.ordering import number_rows
from folioscope.session import fits_broadcast

PERIOD = 1000
BLOCK = 16


def root_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """``source`` and ``weight``: the whole part of 1000 times the square root of its document count."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("source", F.floor(F.sqrt(F.col("_n").cast("double")) * 1000).cast("long").alias("weight"))


def quotas(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """``source``, ``q`` and ``period``: whole blocks per period, at least one each, by largest remainders.

    ``weights`` has one row per source (null is a source of its own) and positive whole weights. A period
    shorter than twice the number of sources is widened to that. The table has one row per source; its
    windows see nothing else.
    """
    everything = W.partitionBy(F.lit(0))
    total = weights.where(F.col("weight") > 0).select(
        "source",
        "weight",
        F.count(F.lit(1)).over(everything).alias("_s"),
        F.sum("weight").over(everything).alias("_sum"),
    )
    scaled = total.withColumn("period", F.greatest(F.lit(period).cast("long"), 2 * F.col("_s"))).withColumn(
        "_scaled", F.col("weight") * (F.col("period") - F.col("_s"))
    )
    parts = scaled.withColumn("_whole", F.expr("_scaled div _sum")).withColumn("_rest", F.expr("_scaled % _sum"))
    order = everything.orderBy(F.col("_rest").desc(), F.col("source").asc_nulls_first())
    missing = F.col("period") - F.col("_s") - F.sum("_whole").over(everything)
    extra = (F.row_number().over(order) <= missing).cast("long")
    return parts.select("source", (1 + F.col("_whole") + extra).alias("q"), "period")


JOB = "struct<due: bigint, free: bigint, i: int, k: bigint>"


def _job(k: str, q: str, i: str) -> str:
    """Block ``k`` of source number ``i``; structs compare by deadline, then release, then source."""
    due, free = f"({k} * period + {q} - 1) div {q}", f"(({k} - 1) * period) div {q}"
    return f"struct({due} as due, {free} as free, {i} as i, {k} as k)"


def schedule(quota: DataFrame) -> DataFrame:
    """One period: ``source``, ``k`` (from 1), ``release``, ``deadline``, ``slot`` (from 0).

    Earliest deadline first; ties go to the earlier release, then to the smaller source. The state is one entry
    per source, the result ``period`` rows.
    """
    one = quota.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("source", "q"))).alias("sources"), F.max("period").alias("period")
    )
    # state: the next block of every source, and the blocks served so far
    first = _job("1L", "s.q", "n")
    following = _job("(j.k + 1)", "sources[j.i].q", "j.i")
    served = one.where("period is not null").selectExpr(
        "sources",
        f"""aggregate(
            sequence(0L, period - 1),
            struct(transform(sources, (s, n) -> {first}) as jobs, cast(array() as array<{JOB}>) as done),
            (state, t) -> transform(
                array(array_min(filter(state.jobs, j -> j.free <= t))),
                pick -> struct(
                    transform(state.jobs, j -> if(j.i = pick.i, {following}, j)) as jobs,
                    concat(state.done, array(pick)) as done
                )
            )[0],
            state -> state.done
        ) as done""",
    )
    return served.selectExpr("sources", "posexplode(done) as (slot, job)").selectExpr(
        "sources[job.i].source as source", "job.k as k", "job.free as release", "job.due as deadline", "cast(slot as bigint) as slot"
    )


def _shipped(small: DataFrame) -> DataFrame:
    """A hint to broadcast, if the table is within the checked size; else both sides are shuffled."""
    return F.broadcast(small) if fits_broadcast(small) else small


def mix(docs: DataFrame, weights: DataFrame, key: str = "doc_id", source: str = "source", period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """``key``, ``source``, ``block`` (from 1 in its source), ``place`` (from 0 in its block), ``release``,
    ``deadline`` and ``slot`` (from 0) of every row of ``docs``.

    Reading by ``slot, place`` gives the mixture. Blocks follow ``key`` (null first; equal keys in any order).
    A source without a positive weight is not in the mixture and has null ``release``, ``deadline`` and ``slot``.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("_s"), F.col(source).isNull().alias("_null"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    numbered = number_rows(rows, ["_s", "_null"], ["key", "_tie"], "_pos")
    quota = cut_lineage(quotas(weights, period))
    plan = cut_lineage(schedule(quota))  # period rows
    by_source = [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null")]
    shares = _shipped(quota.select(*by_source, "q", "period"))
    steps = _shipped(
        plan.select(
            *by_source, F.col("k").alias("_k"), F.col("release").alias("_release"), F.col("deadline").alias("_deadline"), F.col("slot").alias("_slot")
        )
    )
    placed = (
        numbered.withColumn("block", F.expr(f"_pos div {block}") + 1)
        .withColumn("place", F.col("_pos") % block)
        .join(shares, ["_s", "_null"], "left")
        .withColumn("_turn", F.expr("(block - 1) div q"))
        .withColumn("_k", F.expr("(block - 1) % q + 1"))
        .join(steps, ["_s", "_null", "_k"], "left")
    )
    shift = F.col("_turn") * F.col("period")
    return placed.select(
        F.col("key").alias(key),
        F.when(~F.col("_null"), F.col("_s")).alias("source"),
        "block",
        "place",
        (F.col("_release") + shift).alias("release"),
        (F.col("_deadline") + shift).alias("deadline"),
        (F.col("_slot") + shift).alias("slot"),
    )

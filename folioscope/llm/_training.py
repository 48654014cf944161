"""Bounded, repeatable samples of labelled rows for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.ordering import top_k
from folioscope.session import fits_broadcast


SPAN = 1 << 40


def labelled_sample(labels: DataFrame, label: str, per_class: dict | int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``key`` and ``label`` of at most so many rows of each class: those with the smallest hash of the key.

    Null keys and labels are left out; a key that carries several labels counts with the largest.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    wanted = F.lit(per_class) if isinstance(per_class, int) else F.coalesce(*[F.when(F.col(label) == c, n) for c, n in per_class.items()], F.lit(0))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(SPAN))
    # only hashes small enough to be wanted are ranked: twice the expected number, so that no class meets whole in a task
    totals = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.select(label, ((2 * wanted + 200) / F.col("_n") * SPAN).alias("_below"), wanted.alias("_wanted"))
    near = rows.withColumn("_place", place).join(F.broadcast(totals) if fits_broadcast(totals) else totals, label).where("_place < _below")
    most = per_class if isinstance(per_class, int) else max(per_class.values(), default=0)
    picked = top_k(near, [label], [F.col("_place"), F.col(key)], most, "_rank").where("_rank <= _wanted")
    return picked.select(key, label)


def texts_of(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each key of the sample, with its label: of rows that share a key, the one whose text has the
    smallest hash. So the sample's bound on keys bounds the rows. A sample within the checked size is shipped."""
    met = docs.join(F.broadcast(sample) if fits_broadcast(sample, max_rows=200_000) else sample, key)
    rest = [c for c in met.columns if c != key]
    return met.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64(text)).alias("_row")).select(key, "_row.*")

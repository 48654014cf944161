"""Mergeable quantile sketches against sorted values."""

import math
import random

from pyspark.sql import functions as F

from folioscope.operators import sketches as SK

SCHEMA = "g string, part long, v double"


def drawn():
    draw = random.Random(5)
    rows = [("a", n % 7, draw.lognormvariate(3, 2)) for n in range(3000)]
    rows += [("b", n % 3, draw.choice([-1, 1]) * draw.lognormvariate(0, 3)) for n in range(800)]
    rows += [("b", 1, 0.0)] * 50 + [("c", 0, 42.0)] * 500 + [("d", 0, x) for x in (1e300, 5e-324, -1e300, -5e-324, 1.0)]
    return rows + [("a", 1, None), ("a", 2, float("nan")), ("e", 0, float("inf")), (None, 0, 7.0), (None, 1, 7.0)]


def test_quantiles_are_within_the_stated_bounds(spark):
    rows = drawn()
    qs = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = SK.quantiles(SK.sketch(spark.createDataFrame(rows, SCHEMA), ["g"], "v"), ["g"], qs).collect()
    values = {}
    for g, _, v in rows:
        if v is not None and math.isfinite(v):
            values.setdefault(g, []).append(v)
    assert len(got) == len(qs) * len(values)
    for r in got:
        ordered = sorted(values[r.g])
        rank = max(1, math.ceil(r.q * len(ordered)))
        exact = ordered[rank - 1]
        assert r.n == len(ordered) and r.low <= exact <= r.high and r.low <= r.value <= r.high
        assert abs(r.value - exact) <= 0.010001 * abs(exact) + 1e-300
        below, upto = sum(v < r.value for v in ordered), sum(v <= r.value for v in ordered)
        assert max(0, rank - max(1, upto), below - rank) <= r.rank_error


def test_a_rollup_is_the_sketch_of_the_union(spark):
    table = spark.createDataFrame(drawn(), SCHEMA)
    parts = SK.sketch(table, ["g", "part"], "v")
    rolled = SK.merge(parts, ["g"])
    whole = SK.sketch(table, ["g"], "v")
    as_set = lambda df: {tuple(r) for r in df.select("g", "cell", "n", "low", "high").collect()}
    assert as_set(rolled) == as_set(whole) == as_set(SK.merge(rolled.unionByName(SK.sketch(table.limit(0), ["g"], "v")), ["g"]))
    everything = {r.q: r for r in SK.quantiles(SK.merge(parts, []), [], [0.5]).collect()}
    assert everything[0.5].n == whole.agg(F.sum("n")).first()[0]


def test_empty_tables_have_no_quantiles(spark):
    assert SK.quantiles(SK.sketch(spark.createDataFrame([], SCHEMA), ["g"], "v"), ["g"], [0.5]).count() == 0

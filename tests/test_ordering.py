"""Numbering, running sums, quantiles and as-of joins against brute force, with one hot group."""

import math
import random

from pyspark.sql import functions as F

from folioscope.operators import ordering as O


def hot_rows(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", i, round(rng.random() * 20, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, k long, v double")


def by_group(rows):
    out = {}
    for g, k, v in rows:
        out.setdefault(g, []).append((k, v))
    return out


def test_top_k_keeps_k_rows_per_group(spark):
    rows, df = hot_rows(spark)
    got = O.top_k(df, ["g"], [F.col("v").desc(), F.col("k")], 7).collect()
    for g, members in by_group(rows).items():
        want = [k for k, _ in sorted(members, key=lambda m: (-m[1], m[0]))[:7]]
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r.rank)] == want


def test_numbering_is_dense_in_order(spark):
    rows, df = hot_rows(spark)
    small = O.number_by_key(df, ["g"], "k", "pos", width=16).collect()
    ranged = O.number_rows(df, ["g"], ["v", "k"], "pos").collect()
    for g, members in by_group(rows).items():
        ks = sorted(k for k, _ in members)
        assert {r.k: r.pos for r in small if r.g == g} == {k: i for i, k in enumerate(ks)}
        order = [k for k, _ in sorted(members, key=lambda m: (m[1], m[0]))]
        assert {r.k: r.pos for r in ranged if r.g == g} == {k: i for i, k in enumerate(order)}


def test_running_sum_excludes_the_row_itself(spark):
    rows, df = hot_rows(spark)
    got = {(r.g, r.k): r.s for r in O.running_sum_by_key(df, ["g"], "k", "v", "s", width=10).collect()}
    for g, members in by_group(rows).items():
        total = 0.0
        for k, v in sorted(members):
            assert math.isclose(got[g, k], total, abs_tol=1e-9)
            total += v


def test_quantile_kinds(spark):
    rows, df = hot_rows(spark)
    lin = {r.g: r for r in O.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    near = {r.g: r for r in O.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.95}, kind="nearest").collect()}
    tail = {r.g: r for r in O.quantiles(df, ["g"], "v", {"a": 0.95}, kind="tail").collect()}
    upper = {r.g: r for r in O.quantiles(df, ["g"], "v", {"a": 0.0}, kind="upper").collect()}
    for g, members in by_group(rows).items():
        s = sorted(v for _, v in members)
        n = len(s)

        def linear(q):
            i = (n - 1) * q
            lo = math.floor(i)
            return s[lo] + (s[math.ceil(i)] - s[lo]) * (i - lo)

        assert math.isclose(lin[g].a, linear(0.5)) and math.isclose(lin[g].b, linear(0.95))
        assert near[g].a == s[min(n - 1, int(0.05 * n))] and near[g].b == s[min(n - 1, int(0.95 * n))]
        assert tail[g].a == s[max(0, int(0.95 * n) - 1)]
        assert upper[g].a == s[n // 2]


def test_quantiles_without_groups_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert O.quantiles(df, [], "v", {"m": 0.5}).collect()[0].m == 2.0
    assert O.quantiles(df.where("v IS NULL"), [], "v", {"m": 0.5}).collect() == []


def test_asof_takes_last_value_at_or_before(spark):
    rng = random.Random(3)
    left = [("hot" if rng.random() < 0.5 else "x", rng.randrange(5000), i) for i in range(300)]
    right = sorted({("hot" if rng.random() < 0.5 else "x", rng.randrange(5000)) for _ in range(80)})
    lf = spark.createDataFrame(left, "g string, t int, i int")
    rf = spark.createDataFrame([(g, t, f"{g}{t}") for g, t in right], "g string, t int, val string")
    got = {r.i: r.val for r in O.asof_backward(lf, rf, ["g"], "t", "val", width=64).collect()}
    for g, t, i in left:
        before = [u for h, u in right if h == g and u <= t]
        assert got[i] == (f"{g}{max(before)}" if before else None)

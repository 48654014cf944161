"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._tables import cut_lineage


def local_union(links: DataFrame) -> DataFrame:
    """Union-find over the links (``u``, ``v``) of each task: every node with its root, ``u`` > ``v``."""
    kind = dict(links.dtypes)["u"]
    plain = bytes if kind == "binary" else int

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            top = x
            while root.get(top, top) != top:
                top = root[top]
            while root.get(x, x) != top:
                root[x], x = top, root[x]
            return top

        for frame in frames:
            for a, b in zip(frame["u"], frame["v"]):
                a, b = find(plain(a)), find(plain(b))
                root[max(a, b)] = root[min(a, b)] = min(a, b)
        pairs = [(x, top) for x in root if (top := find(x)) != x]
        for low in range(0, len(pairs), 10_000):
            yield pd.DataFrame(pairs[low : low + 10_000], columns=["u", "v"])

    return links.mapInPandas(run, f"u {kind}, v {kind}")


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """``u`` and ``v``: every linked node but the smallest of its component, with that smallest node.

    Links (``a``, ``b``: whole numbers or binaries) are joined up by union-find within tasks, then by alternating large
    and small stars across them until nothing changes. Only counts come to the driver.
    """
    edges = cut_lineage(local_union(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = None
    for _ in range(most):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            return edges
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut_lineage(
            small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
    raise RuntimeError("the components did not settle")

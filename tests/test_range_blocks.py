"""Posting blocks kept as one row a range, and the search next to them."""

import random
import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.operators import lexical as L
from folioscope.session import cut_lineage

COLUMNS = ["user", "qid", "rank", "ord", "score"]


def tables(spark):
    draw = random.Random(9)
    words = [f"w{n}" for n in range(60)]
    texts = [" ".join(draw.choices(words, weights=[1 / (n + 1) for n in range(60)], k=draw.randint(0, 9))) for _ in range(150)]
    texts[70] = texts[140] = "rare w50 rare"
    rows = [(u, n * step, t) for u, step, many in (("ann", 1, 150), ("bob", 7, 40)) for n, t in enumerate(texts[:many])]
    # a chunk that comes twice, one without a text and one without a user
    rows += [("ann", 9, "w50 w51 w50"), ("ann", 9, texts[9]), ("ann", 400, None), (None, 3, "w1 w2")]
    asked = [("ann", n, " ".join(draw.choices(words, k=4))) for n in range(20)] + [("ann", 20, "rare w50"), ("ann", 21, "w50 w51"), ("bob", 1, "w9 w9 w2"), ("bob", 2, ""), ("eve", 1, "w1"), ("ann", 22, "w50 w51"), ("ann", 22, "w50 w51")]
    chunks = spark.createDataFrame(rows, "user string, ord long, text string").repartition(3)
    return chunks, spark.createDataFrame(asked, "user string, qid long, text string")


def rounded(df, *columns):
    return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("width, task", [(8, 16), (16, 1024), (128, 2)])
def test_ranges_give_the_rows_of_posting_blocks(spark, monkeypatch, width, task):
    monkeypatch.setattr(L, "TASK_CHUNKS", task)
    chunks, queries = tables(spark)
    index = L.build_index(chunks)
    by_block = L.blocked(index, width)
    by_term = replace(by_block, ranges=None)
    counted = L._posted(index.forward).select("user", "ord", "term", "tf", "dl")
    blocks = lambda df: sorted(str((r.user, r.term, r.range, r.max_tf, r.min_dl, sorted(map(tuple, r.posts)))) for r in df.collect())
    assert blocks(by_block.blocks) == blocks(L.blocks_of(counted, width))
    wanted = L.bm25_top_k_blocks(by_term, queries, 5, first=2)
    # no score of a chunk that is not among the best is a row, and no posting
    for name in ("_range_scores", "_range_bounds", "blocks_of"):
        monkeypatch.setattr(L, name, None)
    got = L.bm25_top_k_blocks(by_block, queries, 5, first=2)
    for table, columns in (("top", COLUMNS), ("read", ["user", "qid", "range"]), ("bounds", ["user", "qid", "range", "bound"])):
        assert rounded(getattr(got, table), *columns) == rounded(getattr(wanted, table), *columns), table
    counts = L.postings_read(by_block, got, queries).first()
    assert counts == L.postings_read(by_term, wanted, queries).first() and counts.ranges_read > 0


def test_a_range_is_one_row(spark):
    chunks, _ = tables(spark)
    ranges = L.blocked(L.build_index(chunks), 16).ranges
    assert ranges.groupBy("user", "range").count().where("count > 1").isEmpty()
    held = ranges.select(F.explode("ords").alias("ord"), "range").collect()
    assert len(held) == chunks.count() and all(r.range == r.ord // 16 for r in held)


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = [Path(f.getPath()) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for folder in folders for f in folder.rglob("shuffle_*")}
    before = files()
    kept = cut_lineage(spark.range(1000).repartition(5, "id"))
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before and kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

"""Rows without a text on either side of the echo; the query against its SQL on such rows."""

import duckdb
from pyspark.sql import functions as F

from folioscope.operators import conversation as V
from folioscope.plans import catalog


def test_no_answer_stays_null(spark):
    rows = [(1, None, None), (2, None, "an answer"), (3, "a question that is long enough", None), (4, None, "")]
    df = spark.createDataFrame(rows, "i int, q string, a string")
    assert {r.i: r.o for r in df.select("i", V.strip_question_echo(F.col("q"), F.col("a")).alias("o")).collect()} == {1: None, 2: "an answer", 3: None, 4: ""}


def test_query_equals_its_sql_on_rows_without_text(spark, tmp_path):
    turns = [("user", None), ("assistant", "some answer"), ("user", "Where is the long road to?"), ("assistant", ". : there"), ("user", "x"), ("assistant", None)]
    rows = [(conv, turn + conv % 2, role, text) for conv in range(4) for turn, (role, text) in enumerate(turns)]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = catalog.QUERIES["question_echo"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.SQL["question_echo"]).fetchall())
    assert any(r.digest is None for r in got)

"""Table functions in SQL beside the exploded form."""

import pytest
from corvane.functions import tables
from corvane.functions import text as T
from pyspark.sql import functions as F

ROWS = [(1, "One two\nthree four five six seven"), (2, None), (3, ""), (4, "It's a b c d e\n\nF"), (4, "a a a a a a a"), (5, "ÉTÉ one")]


@pytest.fixture
def docs(spark):
    tables.register(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.createOrReplaceTempView("some_docs")
    return df


def test_lines(spark, docs):
    got = spark.sql("SELECT d.doc_id, l.line_no, l.line FROM some_docs d, LATERAL text_lines(d.text) l")
    want = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n", [1, 6])
def test_runs(spark, docs, n):
    got = spark.sql(f"SELECT * FROM word_runs(TABLE(some_docs) PARTITION BY (doc_id), 'doc_id', 'text', {n})")
    want = docs.select(F.col("doc_id").alias("key"), F.posexplode(T.grams(T.words(F.col("text")), n)).alias("pos", "run"))
    assert got.columns == ["key", "pos", "run"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_wrong_arguments(spark, docs):
    for call in ("word_runs(TABLE(some_docs) PARTITION BY (doc_id), 'doc_id', 'nothing', 2)", "word_runs(TABLE(some_docs) PARTITION BY (doc_id), 'doc_id', 'text', 0)"):
        with pytest.raises(Exception, match="no column|one word"):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_fresh_runs(spark, docs):
    twice = docs.unionByName(docs.filter("doc_id % 2 = 0"))
    twice.createOrReplaceTempView("some_docs_twice")
    got = spark.sql("SELECT key, count(*) AS n, count_if(fresh) AS k FROM word_runs(TABLE(some_docs_twice) PARTITION BY (doc_id), 'doc_id', 'text', 2, TRUE) GROUP BY key")
    runs = twice.select(F.col("doc_id").alias("key"), F.explode(T.grams(T.words(F.col("text")), 2)).alias("run"))
    want = runs.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("run").alias("k"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

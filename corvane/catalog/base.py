"""Registration of queries, and the views of the fixture tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, author (the source), pos (place among the author's documents from 0), text, lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author"), "text", "lang", "n_chars")
    return docs.join(places(spark, sf_dir), "doc_id")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos: ids alone are ranked, so that no text moves to the few tasks that a source each has."""
    ids = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ids.select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("pos"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, unit (the source), score (length in tens, so that ties occur), label (quality)."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("source").alias("unit"), F.floor(F.col("n_chars") / 100).cast("double").alias("score"), F.col("quality").cast("int").alias("label"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, cluster (25 of them), owner (the label), vec."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 25).cast("int").alias("cluster"), F.col("label").alias("owner"), F.col("embedding").alias("vec"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, value of the events."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


#: The views above in SQL, for a WITH clause.
CORPUS = "corpus AS (SELECT doc_id, source AS author, text, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)"
SCORES = "scores AS (SELECT doc_id, source AS unit, floor(n_chars / 100)::DOUBLE AS score, quality::INTEGER AS label FROM documents JOIN labels USING (doc_id))"
ELEMENTS = "elements AS (SELECT vec_id AS item, (vec_id % 25)::INTEGER AS cluster, label AS owner, embedding AS vec FROM embeddings)"


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z'']+')"


def grams_sql(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' ')) ELSE [] END"


#: Lines of documents that can hold a run of six words, and the runs of the benchmark.
LINES = (
    "raw_lines AS (SELECT doc_id, source AS author, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents), "
    f"lines AS (SELECT *, {words_sql('line')} AS w FROM raw_lines WHERE len({words_sql('line')}) >= 6 AND NOT (upper(line) = line AND lower(line) <> line)), "
    f"line_grams AS (SELECT doc_id, author, line_no, unnest(range(len(w) - 5)) AS pos, unnest({grams_sql('w', 6)}) AS gram FROM lines), "
    f"pool AS (SELECT DISTINCT unnest({grams_sql('w', 6)}) AS gram FROM (SELECT {words_sql('text')} AS w FROM benchmark))"
)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, author, line_no, line, tokens of the lines in LINES."""
    from corvane.operators.overlap import content_lines

    return content_lines(table(spark, sf_dir, "documents").withColumnRenamed("source", "author"), ["doc_id", "author"])


def pool(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    """The distinct runs of the benchmark's texts, as hashes."""
    from corvane.operators.overlap import gram_rows

    return gram_rows(benchmark(spark, sf_dir), [], "text", n).distinct()

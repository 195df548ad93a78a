"""Table functions for SQL: lines of a text by LATERAL, and runs of words of a table's rows by a TABLE argument."""

from __future__ import annotations

import re

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corvane.functions.text import PLAIN_WORD


@udtf(returnType="line_no int, line string", useArrow=True)
class TextLines:
    """``LATERAL text_lines(text)``: the parts between line feeds, numbered from 0; null has none."""

    def eval(self, text: str):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            yield n, line


@udtf(useArrow=True)
class WordRuns:
    """``word_runs(TABLE(t) PARTITION BY (key), 'key', 'text', 6)``: key, pos and run of each run of that many plain words of a row's text.

    PARTITION BY deals the rows to tasks; any key that spreads them will do for the runs. A fifth argument of TRUE adds the column
    fresh: whether the partition has not given that run before. Partitioned by the key, fresh runs are a key's different ones,
    and need not move to be counted.
    """

    def __init__(self) -> None:
        self.given: set[str] = set()

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, n: AnalyzeArgument, fresh: AnalyzeArgument | None = None) -> AnalyzeResult:
        for a in (key, text):
            if a.value not in table.dataType.fieldNames():
                raise ValueError(f"the table has no column {a.value}")
        if n.value is None or n.value < 1:
            raise ValueError("a run has one word or more")
        mark = [StructField("fresh", BooleanType())] if fresh is not None and fresh.value else []
        return AnalyzeResult(StructType([StructField("key", table.dataType[key.value].dataType), StructField("pos", IntegerType()), StructField("run", StringType()), *mark]))

    def eval(self, row: Row, key: str, text: str, n: int, fresh: bool = False):
        words, own, given = re.findall(PLAIN_WORD, (row[text] or "").lower()), row[key], self.given
        for k in range(len(words) - n + 1):
            run = " ".join(words[k : k + n])
            if fresh:
                yield own, k, run, run not in given
                given.add(run)
            else:
                yield own, k, run


def register(spark: SparkSession) -> None:
    """Make both known to the session's SQL as text_lines and word_runs."""
    spark.udtf.register("text_lines", TextLines)
    spark.udtf.register("word_runs", WordRuns)

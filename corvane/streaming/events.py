"""Streams over files. Each micro-batch leaves partial sums in a folder of its own, so a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.stores import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder whose names match."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).parquet(folder)


def partial_sums(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], final: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the stream to its end: `partial` of each micro-batch is written, `final` reads them all."""
    spark = stream.sparkSession
    out, mark = shared_folder(spark), shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return final(spark.read.parquet(out))


def tumbling(stream: DataFrame, time: str, by: str, value: str, width: str) -> DataFrame:
    """start (seconds since 1970), by, n, total of tumbling windows."""
    window = F.window(time, width)
    keyed = lambda df: df.groupBy(F.unix_timestamp(window["start"]).alias("start"), by)
    return partial_sums(
        stream,
        lambda b: keyed(b).agg(F.count("*").alias("n"), F.sum(value).alias("total")),
        lambda p: p.groupBy("start", by).agg(F.sum("n").alias("n"), F.sum("total").alias("total")),
    )


def last_answers(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key over all that has arrived."""
    from corvane.operators.pairing import last_record

    columns = [c for c in stream.columns]
    return partial_sums(stream, lambda b: last_record(b, key, order), lambda p: last_record(p.select(*columns), key, order))


def closed_windows(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """A streaming frame: counts of windows that the watermark has closed, once each, duplicates of `event_id` dropped."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def run_to_files(stream: DataFrame) -> DataFrame:
    """All rows that an appending stream gives until its present end."""
    spark = stream.sparkSession
    out, mark = shared_folder(spark), shared_folder(spark)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

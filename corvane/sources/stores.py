"""Writers and keyed stores: batch packs, response caches, resumable outputs."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import hash_key, hash_number


_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and executors share, in spark.checkpoint.dir; it goes when the driver exits.

    Where that is unset, a master that is this very process gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corvane-")
    path = f"{base}/corvane-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            at, fs = _file_system(spark, path)
            fs.delete(at, True)
        except Exception:  # the session has ended: nothing more can be deleted through it
            return


def settled(df: DataFrame) -> DataFrame:
    """`df`, written once and read again: a round's result, after which plans start anew and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(files: DataFrame, path: str) -> None:
    """A file of its own, with the name `file`, for each row's text `value`; the driver only renames."""
    spark = files.sparkSession
    files.select("file", "value").repartition("file").write.partitionBy("file").text(f"{path}/_parts")
    at, fs = _file_system(spark, f"{path}/_parts")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in fs.listStatus(at):
        name = folder.getPath().getName()
        if name.startswith("file="):
            part = next(s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-"))
            fs.rename(part, hadoop(f"{path}/{name[5:]}"))
    fs.delete(at, True)


def trials(rows: DataFrame, by: list[str], item: str, slot: str, text: str, name: Column) -> tuple[DataFrame, DataFrame]:
    """(trial and its text, trial with its item and true_candidate): every row against its group's line-up, in the order of slots."""
    line = F.concat(F.lit("["), F.col(slot).cast("string"), F.lit("] "), F.col(text))
    groups = rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.struct(slot, line.alias("line"))))["line"], "\n").alias("candidates"))
    named = rows.withColumn("trial", name)
    value = F.concat(F.lit("TARGET:\n"), F.col(text), F.lit("\nCANDIDATES:\n"), "candidates")
    return named.join(groups, by).select("trial", value.alias("value")), named.select("trial", item, F.col(slot).alias("true_candidate"))


def request_key(model: Column, messages: Column, params: Column) -> Column:
    """The key of a response: sha256 of the request as JSON."""
    return F.sha2(F.to_json(F.array(model, messages, params)), 256)


def missing(requests: DataFrame, cache: DataFrame, key: str = "k") -> DataFrame:
    """The distinct requests that the cache lacks."""
    return requests.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def through_cache(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "k") -> tuple[DataFrame, DataFrame]:
    """(every request with its value v, the new cache rows to append): each missing key is computed once."""
    new = compute(missing(requests, cache, key)).select(key, "v")
    return requests.join(cache.select(key, "v").unionByName(new), key, "left"), new


def batches(items: DataFrame, pid: str, per_batch: int, *salt: str | int) -> DataFrame:
    """items with batch: a hash deals them to as many batches as hold about `per_batch`."""
    n = max(1, -(-items.count() // per_batch))
    return items.withColumn("batch", (hash_number(*salt, F.col(pid)) % n).cast("int"))


def write_batches(items: DataFrame, path: str) -> None:
    """One folder of JSON lines for each batch."""
    items.repartition("batch").sortWithinPartitions("batch").write.mode("overwrite").partitionBy("batch").json(path)


def batch_digests(items: DataFrame, pid: str, prompt: str) -> DataFrame:
    """batch, digest: a hash of all prompts in the order of their pids; answers hold only for an equal digest."""
    parts = items.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(F.col(pid), hash_key(F.col(prompt)).alias("h")))).alias("x"))
    return parts.select("batch", F.sha1(F.array_join(F.transform("x", lambda r: r["h"]), "|").cast("binary")).alias("digest"))


def consolidated(parts: DataFrame, by: list[str], order: str, text: str, mark: str = "@@@@@ ") -> DataFrame:
    """by, text: the parts of each group in order, each under a line with its mark."""
    piece = F.concat(F.lit(mark), F.col(order).cast("string"), F.lit("\n"), F.col(text))
    x = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("p")))).alias("x"))
    return x.select(*by, F.array_join("x.p", "\n").alias("text"))


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys a former run has not finished."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def generations(rows: DataFrame, file: str = "file") -> DataFrame:
    """rows with gen and part of files ans_<gen>_<i> (without a generation: r1)."""
    return rows.withColumns({"gen": F.coalesce(F.nullif(F.regexp_extract(file, r"^ans_([a-z]\w*)_\d+", 1), F.lit("")), F.lit("r1")), "part": F.regexp_extract(file, r"(\d+)(?:\.json)?$", 1).cast("int")})


def numbered(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

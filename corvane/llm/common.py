"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D, nothing else.
SPACES = " \t\n\x0b\x0c\r"
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a master that is this very process (tests, benchmarks) gets a temporary folder;
    a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows of an Arrow batch at most: texts, and what is made of them, are held by the batch in each Python worker.
BATCH_ROWS = 2_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, if they are larger."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def parts_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, for work that makes many rows of each."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(spark: SparkSession) -> None:
    """Between the rounds of an iteration: let go what former rounds left on the driver, and with it their shuffle files, which
    Spark deletes when the driver has collected the plans that made them."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


def lean(scan: Scan) -> Scan:
    """`scan`, giving freed memory back to the system every few batches and at its end: workers stay while the JVM works on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            for k, batch in enumerate(batches):
                yield batch
                del batch
                if k % 4 == 3:
                    release()

        yield from scan(counted())
        release()

    return run


def written(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    It cuts the lineage, fixes whatever is not deterministic, computes its input once, and
    outlives any executor. The files go when the driver exits.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: nothing more can be deleted through it
            return


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column's of `df` (nor another's, whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


#: Keys with more than this part of a table's rows get their partner by a broadcast: there are at most 1 / HOT_PART such keys.
HOT_PART = 0.002


def join_split(rows: DataFrame, side: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined to `side` (one row per key, not null; `n`: how many rows have the key; dropped), whose hot keys are broadcast.

    So no task gets more than a small part of `rows`, whatever their keys; `how` is inner or left.
    """
    most = max(1_000, int(total * HOT_PART))
    (mark,) = fresh(rows, "_hot")
    taken = [c for c in side.columns if c not in (*on, n)]
    hot = side.filter(F.col(n) > most).drop(n).withColumn(mark, F.lit(True))
    both = rows.join(F.broadcast(hot), on, "left")  # at most 1 / HOT_PART rows
    cold = both.filter(F.col(mark).isNull()).drop(mark, *taken).join(side.filter(F.col(n) <= most).drop(n), on, how)
    return both.filter(F.col(mark).isNotNull()).drop(mark).unionByName(cold)


def without_spaces(text: Column) -> Column:
    """`text` without any white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying a text; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes each; a longer row stands alone."""
    out, begin, n = [], 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        out.append((begin, min(end, n)))
        begin = out[-1][1]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Size of the table in which keys are counted to find those with very many rows.
CELLS = 1 << 16


def cells_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def cell_counts(keys: np.ndarray, total: np.ndarray) -> None:
    """Add the rows of each key to a table of CELLS counts."""
    total += np.bincount(cells_of(keys), minlength=CELLS)


def cell_batch(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["cell", "n"])


def hot_blocks(counts: DataFrame, block: int) -> np.ndarray:
    """Into how many blocks the rows of each cell's keys are to be split, from rows (cell, n): at most CELLS of them.

    A cell is hot if it holds more rows than a block and than four cells on average.
    """
    sums = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    large = n > max(block, 4 * n.sum() / CELLS)
    hot = np.ones(CELLS, np.int64)
    hot[cell[large]] = -(-n[large] // block)
    return hot


def block_pairs(keys: np.ndarray, ids: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Deal rows of keys in hot cells to pairs of blocks: (index of the row, lower block, higher block, own block).

    Rows of one key meet in exactly one pair of blocks, unless they are of the same block: those meet in
    each of its pairs, and (own, own) is the one to count them in.
    """
    blocks = hot[cells_of(keys)]
    rep = np.repeat(np.arange(len(keys)), blocks)
    other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (mixed(ids.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)[rep]
    return rep, np.minimum(own, other), np.maximum(own, other), own

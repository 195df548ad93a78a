"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target weight times the wanted total over its present size. A
document's number of copies is the inverse of the Poisson distribution with that mean at a number in
[0, 1) that a hash of seed and doc_id gives; documents are exploded by it and shuffled globally by a
hash of seed, doc_id and copy. Sizes are UTF-8 bytes plus one per document, over all documents.

Defined results: a null source is a source of its own; a null text has size one; a null doc_id hashes as
the word null with the text's hash, so that such documents are drawn one by one; rows that repeat get equal
counts and are each replicated; other columns are carried along, and a new column whose name the input has
gets an underscore before it; an empty table gives an empty result. Any mean is served: sums are kept around
it only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, join_split, lean, quoted, written

#: Above so many sources only those with very many rows get their rate by a broadcast, and the others by a shuffle.
MOST_BROADCAST = 10_000


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def _identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.xxhash64("text").cast("string")))


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def poisson_sums(rate: float) -> tuple[int, np.ndarray]:
    """(least, sums): the distribution's sums at least, least + 1, ..., up to where they reach 1.

    Weights go from the mode outward and are divided by their sum, so no rate underflows; below `least`
    and beyond the end lies less than the sums' last digit.
    """
    width, mode = 12 * math.sqrt(rate) + 20, math.floor(rate)
    least, last = max(0, math.floor(rate - width)), math.ceil(rate + width)
    down = np.cumprod(np.arange(mode, least, -1) / rate) if mode else np.zeros(0)
    weights = np.concatenate([down[::-1], [1.0], np.cumprod(rate / np.arange(mode + 1, last + 1))])
    return least, np.cumsum(weights) / weights.sum()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [poisson_sums(r) for r in batch.column("rate").to_pylist()]
        columns = [pa.array([k for k, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["_source", "n", "rate", "_least", "_cdf"])


def rates(docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float) -> DataFrame:
    """_source, n (rows), rate, _least, _cdf: each source's mean repetition rate and the Poisson distribution's sums from _least up to where they reach 1.

    `weights` maps sources to target weights (sources left out get none); without it the weights are
    the sizes to the given power, so 1 keeps the mixture and 0 makes all sources equal.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    sums = docs.groupBy(_source(F.col("source")).alias("_source")).agg(F.sum(size.cast("long")).cast("double").alias("_bytes"), F.count("*").alias("n"))
    if weights is None:
        weight = F.pow("_bytes", F.lit(float(power)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0))
    sums = sums.withColumn("_weight", weight)
    whole, weights_sum = sums.agg(F.sum("_bytes"), F.sum("_weight")).first()
    rated = sums.withColumn("rate", F.col("_weight") / F.lit(weights_sum or 1.0) * F.lit(whole or 0.0) * float(epochs) / F.col("_bytes"))
    return rated.select("_source", "n", "rate").mapInArrow(lean(_sums), "_source string, n long, rate double, _least long, _cdf array<double>")


def mixed_copies(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """Rows of `docs` repeated, with copy (from 0), rate and shuffle_key, ordered by shuffle_key over all partitions."""
    table = written(rates(docs, weights, power, epochs))
    sources, total = table.agg(F.count("*"), F.sum("n")).first()
    copy, rate, shuffle_key, source, least, cdf, copies, order = fresh(docs, "copy", "rate", "shuffle_key", "_source", "_least", "_cdf", "_copies", "_order")
    side = table.select(F.col("_source").alias(source), F.col("n").alias("_n"), F.col("rate").alias(rate), F.col("_least").alias(least), F.col("_cdf").alias(cdf))
    keyed = docs.withColumn(source, _source(F.col("source")))
    if sources <= MOST_BROADCAST:
        met = keyed.join(F.broadcast(side.drop("_n")), source)
    else:
        (n,) = fresh(keyed, "_n")
        met = join_split(keyed, side.withColumnRenamed("_n", n), [source], n, total)
    uniform = F.conv(F.substring(_hash(seed, _identity()), 1, 13), 16, 10).cast("double") / float(1 << 52)
    # the number is bound once, as the only element of an array
    below = F.transform(F.array(uniform), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))[0]
    counted = met.withColumn(copies, (F.col(least) + below).cast("int")).filter(F.col(copies) > 0)
    out = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    out = out.withColumn(shuffle_key, _hash(seed, _identity(), F.col(copy))).withColumn(order, F.monotonically_increasing_id())
    # rows that repeat share a key: the second one lets them go to several tasks
    return out.orderBy(shuffle_key, order).select(*quoted(docs.columns), copy, rate, shuffle_key)

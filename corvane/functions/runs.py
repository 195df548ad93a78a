"""Runs of words as 128 bits of hash, worked out for many texts at once in Arrow batches.

A word has two hashes of 64 bits (SipHash under two keys); a run's are sums of its words' hashes by powers of two odd numbers,
modulo 2^64. Words come as `functions.text.words` finds them: texts are lower-cased by Spark, and only a-z and apostrophes count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import PLAIN_WORD

#: Both sides of a join must use the same.
KEYS = ("corvane word one", "corvane word two")
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
GRAM = "gram struct<a:bigint,b:bigint>"
#: Characters that are worked on at once.
CHARS = 1 << 20


def _powers(factor: int, n: int) -> list[np.uint64]:
    return [np.uint64(pow(factor, k, 1 << 64)) for k in range(n)]


def _gram(a: np.ndarray, b: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def run_rows(texts: DataFrame, keys: list[str], text: Column, n: int, pos: bool = False) -> DataFrame:
    """keys, (pos, from 0), gram: every run of `n` neighbouring plain words of a text, with repeats, in order."""
    rows = texts.select(*keys, F.lower(text).alias("_low"))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(PLAIN_WORD)
        for batch in batches:
            low = batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            while at < len(low):
                found, start, size = [], at, 0
                while at < len(low) and size < CHARS:
                    found.append(word.findall(low[at]) if low[at] is not None else [])
                    size += len(low[at] or "") + 50
                    at += 1
                counts = np.array([len(w) for w in found])
                begins = np.cumsum(counts) - counts
                owner = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(owner)) - begins[owner]
                first = np.flatnonzero(place + n <= counts[owner])
                if not len(first):
                    continue
                flat = list(chain.from_iterable(found))
                codes, names = pd.factorize(np.array(flat, object))
                lanes = []
                for key, factor in zip(KEYS, FACTORS):
                    one = pd.util.hash_array(names, hash_key=key, categorize=False)[codes]
                    total = np.zeros(len(first), np.uint64)
                    for k, power in enumerate(_powers(factor, n)):
                        total += one[first + k] * power
                    lanes.append(total)
                take = pa.array(start + owner[first])
                columns = [batch.column(k).take(take) for k in range(len(keys))]
                columns += [pa.array(place[first].astype(np.int32))] if pos else []
                yield pa.RecordBatch.from_arrays([*columns, _gram(*lanes)], names=[*keys, *(["pos"] if pos else []), "gram"])

    return rows.mapInArrow(hashed, ", ".join([*kinds, *(["pos int"] if pos else []), GRAM]))


def written_rows(runs: DataFrame, keys: list[str], run: str = "gram") -> DataFrame:
    """keys, gram of runs that are written out (words joined by blanks), whatever their length."""
    rows = runs.filter(F.col(run).isNotNull()).select(*keys, F.col(run).alias("_low"))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.split(" ") for t in batch.column(batch.num_columns - 1).to_pylist()]
            if not found:
                continue
            codes, names = pd.factorize(np.array(list(chain.from_iterable(found)), object))
            counts = np.array([len(w) for w in found])
            begins = np.cumsum(counts) - counts
            place = np.arange(len(codes)) - np.repeat(begins, counts)
            lanes = [np.add.reduceat(pd.util.hash_array(names, hash_key=key, categorize=False)[codes] * np.array(_powers(factor, int(counts.max())), np.uint64)[place], begins) for key, factor in zip(KEYS, FACTORS)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], _gram(*lanes)], names=[*keys, "gram"])

    return rows.mapInArrow(hashed, ", ".join([*kinds, GRAM]))

"""Substring deduplication: Rabin-Karp hashes of 50-word windows, counted in Spark, merged into maximal intervals.

A word is removed if a window that covers it also starts in a document with a smaller doc_id.

Rolling hashes come from prefix sums over a whole batch of texts. Windows that cannot repeat are left out
of the count: each window names its minimiser, the least of its 8-word hashes; equal windows have equal
minimisers, so a window is hashed and counted only if its minimiser occurs in two documents (`gram` 0
counts every window instead; the tests hold both against brute force). Minimisers are a twentieth of all
windows, and they are what the whole corpus shuffles. Documents equal word for word to one with a smaller
doc_id are settled before that by one hash each, of 128 bits. Texts of documents that have repeated
minimisers, or lose words, are joined by doc_id and a hash of the text; all others pass straight through a
bitmap of bounded size. A document sends each of its different windows once, whatever their number.
Windows whose minimiser is found more than HOT times are counted by partial sums and a join whose hot keys
are broadcast; all others' groups have at most HOT rows, which are read in order and never held.

Defined results: null and empty texts have no words; a null doc_id counts as larger than all others;
rows that share a doc_id do not remove each other's words; other columns are ignored; an empty table
gives an empty result. Windows are told apart by 96 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_split, lean, mixed, slices, utf8, written
from corvane.llm.exact_bloom import Repeated
from corvane.llm.words import BASE, SECOND, Words, rolling

WINDOW = 50
GRAM = 8
HOT = 100_000
BYTES = 1 << 18
LAST_ID = (1 << 63) - 1


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, Words, np.ndarray]]:
    """Rows begin to end of a batch at a time: their bytes, words and word hashes."""
    data, offsets = utf8(batch.column("text"))
    for begin, end in slices(offsets, BYTES):
        own = data[offsets[begin] : offsets[end]]
        words = Words.read(own, offsets[begin : end + 1] - offsets[begin])
        yield begin, end, own, words, words.hashes(own)


def _sequences(words: Words, hashes: np.ndarray, factor: int) -> np.ndarray:
    """A hash of each row's words in order, and of their number; another factor gives another hash."""
    n = np.diff(words.first)
    position = np.arange(len(hashes)) - np.repeat(words.first[:-1], n)
    place = (position.astype(np.uint64) + np.uint64(1)) * np.uint64(factor)
    mixed_in = (hashes ^ place) * (place | np.uint64(1))
    mixed_in ^= mixed_in >> np.uint64(29)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed_in, out=sums[1:])
    return ((sums[words.first[1:]] - sums[words.first[:-1]]) * np.uint64(factor) + n.astype(np.uint64)).view(np.int64)


def _windows(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window's first word, and the place and value of its minimiser (the leftmost least; without grams its own hash)."""
    starts = np.flatnonzero(words.of[window - 1 :] == words.of[: len(hashes) - window + 1]) if len(hashes) >= window else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    grams = rolling(hashes, gram or window)
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(SECOND)  # the low bits of a sum are weaker than the high ones
    if not gram:
        return starts, starts, grams[starts]
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1)[starts] + starts
    return starts, least, grams[least]


def _texts(docs: DataFrame) -> DataFrame:
    """did, tag (a hash of the text) and text of the rows that have a text."""
    return docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.xxhash64("text").alias("tag"), "text")


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """did, tag, n (rows that share them), whole, starts: for each text that loses words, either all of it or the windows (first words; equal ones once) that go."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, words, hashes in _parts(batch):
                starts, least, value = _windows(words, hashes, window, gram)
                at, once = np.unique(least, return_index=True)
                bounds = np.searchsorted(at, words.first).astype(np.int32)
                place = (at - words.first[words.of[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("did").slice(begin, end - begin),
                        batch.column("tag").slice(begin, end - begin),
                        pa.array(_sequences(words, hashes, SECOND)),
                        pa.array(_sequences(words, hashes, BASE)),
                        pa.array(np.diff(words.first).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[once].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(place)),
                    ],
                    names=["did", "tag", "seq", "check", "words", "mins", "at"],
                )

    texts = _texts(docs)
    digests = written(texts.mapInArrow(lean(digest), "did long, tag long, seq long, check long, words int, mins array<long>, at array<int>").filter(F.col("words") >= window))
    total = digests.count()
    # texts equal to one with a smaller doc_id
    text = ["seq", "check", "words"]
    first = digests.groupBy(*text).agg(F.min("did").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = written(join_split(digests.select("did", "tag", *text), first, text, "n", total).filter("did > least").groupBy("did", "tag").agg(F.count("*").alias("n")))
    rest = join_split(digests.select("did", "tag", "mins", "at"), copies.withColumn("copy", F.lit(True)), ["did", "tag"], "n", total, "left").filter("copy IS NULL")
    own = rest.select("did", "tag", F.explode(F.arrays_zip("mins", "at")).alias("x")).select("did", "tag", F.col("x.mins").alias("m"), F.col("x.at").alias("at"))
    shared = own.groupBy("m").agg(F.min("did").alias("a"), F.max("did").alias("b"), F.count("*").alias("k")).filter("a < b").select("m", (F.col("k") > hot).alias("hot"), "k")
    many = digests.agg(F.sum(F.size("mins").cast("long"))).first()[0] or 0
    flagged = join_split(own, shared, ["m"], "k", many).groupBy("did", "tag").agg(F.collect_set(F.col("at") * 2 + F.col("hot").cast("int")).alias("flags"))
    flagged = written(flagged)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, did, tag = batch.column("flags"), batch.column("did").to_numpy(), batch.column("tag").to_numpy()
            for begin, end, _, words, hashes in _parts(batch):
                starts, least, _ = _windows(words, hashes, window, gram)
                state = np.zeros(len(hashes), np.int8)  # 1: the minimiser here repeats; 2: in many documents
                for i in range(begin, end):
                    f = flags[i].values.to_numpy().astype(np.int64)
                    state[(f >> 1) + words.first[i - begin]] = 1 + (f & 1)
                keep = state[least] > 0
                starts, kind = starts[keep], state[least[keep]]
                one, two = rolling(hashes, window), rolling(hashes, window, SECOND)
                once = np.sort(np.unique(mixed(one[starts] + words.of[starts].astype(np.uint64)), return_index=True)[1])
                starts, kind = starts[once], kind[once]  # a text's first of equal windows stands for all
                of = words.of[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[starts].view(np.int64)),
                        pa.array((two[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(did[begin:end][of]),
                        pa.array(tag[begin:end][of]),
                        pa.array((starts - words.first[of]).astype(np.int32)),
                        pa.array(kind > 1),
                    ],
                    names=["h", "c", "did", "tag", "at", "hot"],
                )

    # one of the rows that share doc_id and text goes on
    some = Repeated.every(flagged.select("did"), "did").mark(texts, "did").filter("_maybe").groupBy("did", "tag").agg(F.any_value("text").alias("text"))
    found = some.join(flagged, ["did", "tag"]).mapInArrow(lean(hashed), "h long, c int, did long, tag long, at int, hot boolean")
    met = found.filter("NOT hot").select("h", "c", "did", "tag", "at").repartition("h", "c").sortWithinPartitions("h", "c", "did").mapInArrow(lean(_later), "did long, tag long, at int")
    often = written(found.filter("hot").select("h", "c", "did", "tag", "at"))
    least = often.groupBy("h", "c").agg(F.min("did").alias("least"), F.count("*").alias("n"))
    met = met.unionByName(join_split(often, least, ["h", "c"], "n", often.count()).filter("did > least").select("did", "tag", "at"))
    gone = met.groupBy("did", "tag").agg(F.collect_list("at").alias("starts")).select("did", "tag", F.lit(False).alias("whole"), "starts")
    rows = digests.groupBy("did", "tag").agg(F.count("*").alias("n"))
    gone = gone.join(rows, ["did", "tag"]).select("did", "tag", "n", "whole", "starts")
    return gone.unionByName(copies.select("did", "tag", "n", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts")))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by window and document, those that are not of the window's first document."""
    h, c, least = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, did = (batch.column(k).to_numpy() for k in ("h", "c", "did"))
        new = np.r_[(x[0], y[0]) != (h, c), (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
        first = np.where(begin >= 0, did[begin], did[0] if least is None else least)
        h, c, least = x[-1], y[-1], first[-1]
        yield batch.select(["did", "tag", "at"]).filter(pa.array(did > first))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) of every row."""
    spans = written(removed_spans(docs, window, gram, hot))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, starts = batch.column("whole").to_pylist(), batch.column("starts")
            for begin, end, own, words, hashes in _parts(batch):
                raw = own.tobytes()
                windows = rolling(hashes, window) if any(whole[i] is False for i in range(begin, end)) else None
                kept, removed = [], []
                for i in range(begin, end):
                    b, e = words.first[i - begin], words.first[i - begin + 1]
                    x, y = words.begin[b:e], words.end[b:e]
                    if whole[i]:
                        x, y = x[:0], y[:0]
                    elif whole[i] is False:
                        own_windows = windows[b : e - window + 1]
                        first = np.flatnonzero(np.isin(own_windows, own_windows[starts[i].values.to_numpy()]))
                        steps = np.zeros(e - b + 1, np.int64)
                        steps[first] = 1
                        steps[first + window] -= 1
                        gone = np.cumsum(steps[:-1]) > 0
                        x, y = x[~gone], y[~gone]
                    removed.append(e - b - len(x))
                    kept.append(b" ".join([raw[p:q] for p, q in zip(x.tolist(), y.tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(np.diff(words.first)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), "text")
    marked = Repeated.every(spans.select("did"), "did").mark(ids, "did")
    none = [F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("array<int>").alias("starts")]
    keyed = marked.filter("_maybe").select("doc_id", "did", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("tag"), "text")
    met = join_split(keyed, spans, ["did", "tag"], "n", spans.agg(F.sum("n")).first()[0] or 0, "left").select("doc_id", "text", "whole", "starts")
    return marked.filter("NOT _maybe").select("doc_id", "text", *none).unionByName(met).mapInArrow(lean(apply), "doc_id long, n_words long, n_removed long, kept string")

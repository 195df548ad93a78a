"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints: a bit is set where over half of the text's shingle hashes (XXH64, seed 42) set it.

Links are pairs at 4 or fewer differing bits of 64. Of the two halves of 32 bits one differs in at most
2 (pigeonhole). In each half the anchors are the words of the perfect Hamming code of length 31 and a
free bit: every 32-bit word is within the covering radius 1 of an anchor. Two halves that differ in at
most 2 bits have a word midway, at most 1 from each; that word's anchor is at most radius + 1 from both.
So a fingerprint is replicated to every anchor within the covering radius plus half the threshold that
the anchor of such a midway word can be (17 at most in each half), and no link can be missed. Sending
both sides half the threshold replaces sending one side the whole of it (171 anchors in each half).

Only distinct fingerprints are replicated, 34 rows at most each. Rows with one anchor meet in one
partition, sorted; within an anchor a breadth-first search finds a spanning forest of the links, so that
a group of n fingerprints yields at most n - 1 links and never all its pairs. Anchors with very many
fingerprints are found by a table of fixed size and compared in blocks, two blocks to a task.

Defined results: null texts are empty; texts without words have fingerprint zero and link like any
other; null doc_ids are no component's name unless it has no other; repeated rows are all reported by
`near_copies`; `drop_near_copies` decides row by row and keeps one row of each group: that with the smallest
doc_id (null last), of several such one; other columns are carried, whatever their names; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import CELLS, block_pairs, cell_batch, cell_counts, hot_blocks, join_split, lean, parts_of, written
from corvane.llm.components import connected_components
from corvane.llm.exact_bloom import keep_rows, row_key

THRESHOLD = 4
#: Fingerprints per anchor from which its comparison is split into blocks.
BLOCK = 100_000
#: Fingerprints that are replicated at a time.
ROWS = 2_000


def fingerprint(text: bytes | None, n: int = 4) -> int:
    """SimHash of the `n`-word shingles of a text, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < n:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    whole = b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    begin, end = at[: len(words) - n + 1].tolist(), (at[n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, len(begin), 1 << 16):
        h = np.array([digest(whole[b:e], 42) for b, e in zip(begin[k : k + (1 << 16)], end[k : k + (1 << 16)])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, key (of the row) and fp (the fingerprint as a signed number) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in batch.column("text").cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text"))
    return ids.mapInArrow(lean(scan), "doc_id long, key string, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code of length 31 whose parity checks' columns are the numbers 1 to 31; bit 31 is free."""
    s = np.zeros(len(x), np.int64)
    for k in range(5):
        mask = sum(1 << (j - 1) for j in range(1, 32) if j >> k & 1)
        s |= (np.bitwise_count(x & np.uint64(mask)) & 1).astype(np.int64) << k
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of all anchors that a word at most one bit from half[index] has."""
    flip = np.concatenate([[0], np.uint64(1) << np.arange(31, dtype=np.uint64)]).astype(np.uint64)
    free = np.uint64(1 << 31)
    s = _syndrome(half)
    own, index = half ^ flip[s], np.arange(len(half))
    out, of = [own, own ^ free], [index, index]
    for j in range(1, 32):
        k = index[(s != 0) & (j < (s ^ j)) & (s != j)]
        out.append(half[k] ^ flip[j] ^ flip[s[k] ^ j])
        of.append(k)
    return np.concatenate(of), np.concatenate(out)


def _replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, cell): the cell holds the half's number and the anchor."""
    x = fps.view(np.uint64)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    (i, a), (j, b) = anchors(low), anchors(high)
    return np.concatenate([fps[i], fps[j]]), np.concatenate([a, b | np.uint64(1 << 32)]).view(np.int64)


def spanning(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints; each step compares one with those not reached yet."""
    left, a, b = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= threshold
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links_of(cells: np.ndarray, pairs: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (cell, pair), whose groups are whole."""
    n = len(cells)
    first = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (pairs[1:] != pairs[:-1])]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    group = np.repeat(np.arange(len(first)), size)
    small = size[group] <= 16 if n else np.zeros(0, bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, 16):
        if n <= d:
            break
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        i = i[np.bitwise_count((fps[i] ^ fps[i + d]).view(np.uint64)) <= threshold]
        a.append(fps[i])
        b.append(fps[i + d])
    for g in np.flatnonzero(size > 16):
        x, y = spanning(fps[first[g] : first[g] + size[g]], threshold)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that are linked."""
    assert threshold <= THRESHOLD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            cell_counts(_replicas(batch.column("fp").to_numpy())[1], total)
        yield cell_batch(total)

    hot = hot_blocks(fps.mapInArrow(lean(count), "cell long, n long"), block)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, ROWS):
            x, cell = _replicas(batch.column("fp").to_numpy())
            rep, low, high, _ = block_pairs(cell, x, hot)
            yield pa.RecordBatch.from_arrays([pa.array(cell[rep]), pa.array(low * (1 << 31) + high), pa.array(x[rep])], names=["cell", "pair", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3  # rows of a group that may go on in the next batch
        for batch in batches:
            kept = [np.concatenate([x, c.to_numpy()]) for x, c in zip(kept, batch.columns)]
            whole = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1])) if len(kept[0]) else []
            if len(whole):
                cut = whole[-1] + 1
                a, b = _links_of(*[x[:cut] for x in kept], threshold)
                kept = [x[cut:] for x in kept]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        a, b = _links_of(*kept, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    met = fps.mapInArrow(lean(replicate), "cell long, pair long, fp long").repartition("cell", "pair").sortWithinPartitions("cell", "pair")
    return met.mapInArrow(lean(compare), "a long, b long")


def labels(marks: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """fp, first (the row of its component with the smallest doc_id, null last: is_null, doc_id, key), n and members (rows of
    the fingerprint and of the component) for every fingerprint of `marks` (doc_id, key, fp)."""
    row = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "key")
    each = written(marks.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("n")))
    named = connected_components(linked(each.select("fp")))
    grouped = written(each.join(named, each["fp"] == named["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component")))
    best = grouped.groupBy("component").agg(F.min("least").alias("first"), F.sum("n").alias("members"), F.count("*").alias("_rows"))
    return join_split(grouped, best, ["component"], "_rows", grouped.count()).select("fp", "first", "n", "members")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    marks = written(fingerprints(docs))
    named = written(labels(marks)).select("fp", "n", F.col("first.doc_id").alias("component_id"))
    return join_split(marks, named, ["fp"], "n", marks.count()).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The first row of each group, with all its columns."""
    marks = written(fingerprints(docs))
    return keep_first(docs, marks, labels(marks))


def keep_first(docs: DataFrame, marks: DataFrame, named: DataFrame) -> DataFrame:
    """The first rows of `docs` of the components, by `marks` (key, fp) and `named` (see `labels`); only rows that may have to go are joined."""
    several = written(named.filter("members > 1")).select("fp", "first", "n")
    each = join_split(marks.select("key", "fp"), several, ["fp"], "n", marks.count())
    return keep_rows(docs, each.select("key", (F.col("key") == F.col("first.key")).alias("stays")))

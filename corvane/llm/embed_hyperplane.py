"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

A vector's key in a table is the signs of its products with random directions; vectors with equal label
and key in a table are compared, all of them, by exact cosines. Two vectors at cosine c agree in one sign
with probability p = 1 - arccos(c) / pi (0.88 at 0.93). The signs per table grow with the number of
different vectors, so that a bucket of unlike vectors keeps some `CROWD`; and the number of tables with the
signs, so that a link at the threshold itself is found with probability 1 - (1 - p ** bits) ** tables >=
RECALL, closer ones more often. A link is counted in the first table where it is found, for which each row carries its keys,
so no pair leaves a task: only sums of links and a spanning forest of each bucket do.

Equal vectors are one class with a count and a smallest vec_id before any of this. Buckets with very
many classes are split into blocks, and two blocks make a task. Vectors travel as they are stored and
become unit vectors in double precision where they are compared.

Defined results: vectors that are null, empty or zero or hold null or non-finite components, or whose
label is null, link with nothing, not even their copies; vectors of different lengths do not link;
repeated rows are copies of each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import CELLS, block_pairs, cell_batch, cell_counts, hot_blocks, join_split, lean, mixed, parts_of, utf8, written
from corvane.llm.components import connected_components

RECALL = 0.995
CROWD = 64
BLOCK = 20_000
SQUARE = 1024


def settings(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits) for `n` different vectors."""
    bits = min(24, max(8, round(math.log2(max(1, n) / CROWD))))
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits))), bits


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, cls (a digest of label and vector; null: links with nothing), the vector's bytes and the label."""
    for batch in batches:
        lists, labels = batch.column("embedding"), batch.column("label").to_pylist()
        flat, offsets = lists.values, lists.offsets.to_numpy()
        x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        bad, some = (np.concatenate([[0], np.cumsum(v)]) for v in (~np.isfinite(x), x != 0))
        ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
        cls, raw = [None] * len(labels), [None] * len(labels)
        for i in np.flatnonzero(ok).tolist():
            if labels[i] is not None:
                raw[i] = x[offsets[i] : offsets[i + 1]].tobytes()
                cls[i] = blake2b(f"{labels[i]}|".encode() + raw[i], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cls, pa.binary()), pa.array(raw, pa.binary()), batch.column("label")], names=["vec_id", "cls", "raw", "label"])


def _units(data: np.ndarray, kind: str, n: int) -> np.ndarray:
    """The bytes of n vectors of one length as rows of length 1, in double precision."""
    x = np.frombuffer(data.tobytes(), kind).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keys(raw: list[bytes], kind: str, tables: int, bits: int, seed: int) -> np.ndarray:
    """Each vector's key in every table."""
    out = np.zeros((len(raw), tables), np.uint32)
    sizes = np.array([len(u) for u in raw])
    for size in np.unique(sizes):
        i = np.flatnonzero(sizes == size)
        units = _units(np.frombuffer(b"".join(raw[k] for k in i), np.uint8), kind, len(i))
        planes = np.random.default_rng([seed, units.shape[1]]).standard_normal((units.shape[1], tables * bits))
        out[i] = (units @ planes > 0).reshape(-1, tables, bits) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))
    return out


def _buckets(batch: pa.RecordBatch, kind: str, tables: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, followed by a digest of label and length, and a number for (label, length, table, key): a row for each vector."""
    raw = batch.column("raw").to_pylist()
    keys = _keys(raw, kind, tables, bits, seed)
    digests = [blake2b(f"{x}|{len(u)}".encode(), digest_size=8).digest() for x, u in zip(batch.column("label").to_pylist(), raw)]
    where = np.frombuffer(b"".join(digests), np.uint64)
    numbers = mixed(where[:, None] ^ mixed(keys.astype(np.uint64) + (np.arange(tables, dtype=np.uint64) << np.uint64(40)))).view(np.int64)
    return np.hstack([keys, where.view(np.uint32).reshape(-1, 2)]), numbers


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union-find over arrays: every element's parent is the least element linked to it so far."""
    while True:
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        a, b = parent[i], parent[j]
        odd = a != b
        if not odd.any():
            return parent
        np.minimum.at(parent, np.maximum(a[odd], b[odd]), np.minimum(a[odd], b[odd]))


def _compare(table: int, units: np.ndarray, keys: np.ndarray, n: np.ndarray, own: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of a bucket that no earlier table finds, and the least vector that they join it to."""
    count, parent = np.zeros(len(units), np.int64), np.arange(len(units))
    for a in range(0, len(units), SQUARE):
        for b in range(a, len(units), SQUARE):
            near = units[a : a + SQUARE] @ units[b : b + SQUARE].T >= threshold
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            new = (own[i] != own[j]) if cross else np.ones(len(i), bool)
            new &= (keys[i, -2:] == keys[j, -2:]).all(axis=1) & ~(keys[i, :table] == keys[j, :table]).any(axis=1)
            i, j = i[new], j[new]
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            parent = merge(parent, i, j)
    return count, parent


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int | None = None, bits: int | None = None, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, embedding, label)."""
    label = vectors.schema["label"].dataType.simpleString()
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if narrow else "<f8"
    vector = F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding")
    marks = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector, "label").mapInArrow(lean(_marks), f"vec_id long, cls binary, raw binary, label {label}"))
    classes = marks.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("raw").alias("raw"), F.any_value("label").alias("label"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    total = classes.count()
    best_tables, best_bits = settings(total, threshold)
    tables, bits = tables or best_tables, bits or best_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            cell_counts(_buckets(batch, kind, tables, bits, seed)[1].ravel(), total)
        yield cell_batch(total)

    hot = hot_blocks(classes.select("raw", "label").mapInArrow(lean(count), "cell long, n long"), block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 500):
            keys, buckets = _buckets(batch, kind, tables, bits, seed)
            node = batch.column("node").to_numpy()
            packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * keys.shape[1] * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])
            of = np.tile(np.arange(len(node)), tables)
            number, t = buckets.T.ravel(), np.repeat(np.arange(tables, dtype=np.int32), len(node))
            rep, low, high, own = block_pairs(number, node[of], hot)
            take = pa.array(of[rep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[rep]), pa.array(low), pa.array(high), pa.array(own), pa.array(t[rep]), batch.column("node").take(take), batch.column("n").take(take), packed.take(take), batch.column("raw").take(take)],
                names=["bucket", "low", "high", "own", "t", "node", "n", "keys", "raw"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of a group that may go on in the next batch
        for batch in batches:
            both = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not both:
                continue
            rows = both[0]
            bucket, low, high = (rows.column(k).to_numpy() for k in ("bucket", "low", "high"))
            first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            yield from groups(rows, first)
            rest = rows.slice(first[-1])
        if rest is not None:
            yield from groups(rest, np.array([0, rest.num_rows]))

    def groups(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = [[], [], []]
        node, n, own, low, high, t = (rows.column(k).to_numpy() for k in ("node", "n", "own", "low", "high", "t"))
        data, at = utf8(rows.column("raw"))
        some, where = utf8(rows.column("keys"))
        keys = np.frombuffer(some[where[0] : where[-1]].tobytes(), np.uint32).reshape(len(node), -1)
        units = _units(data[at[0] : at[-1]], kind, len(node)) if len(set(np.diff(at).tolist())) == 1 else None
        for a, b in zip(first[:-1], first[1:]):
            if b - a < 2:
                continue
            x = units[a:b] if units is not None else _units(data[at[a] : at[b]], kind, b - a)
            k = keys[a:b]
            links, parent = _compare(int(t[a]), x, k, n[a:b], own[a:b], low[a] != high[a], threshold)
            some = links > 0
            for o, v in zip(out, (node[a:b][some], links[some], node[a:b][parent[some]])):
                o.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["node", "links", "root"])

    dealt = classes.select("node", "n", "raw", "label").mapInArrow(lean(deal), "bucket long, low long, high long, own long, t int, node long, n long, keys binary, raw binary")
    found = written(dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(lean(compare), "node long, links long, root long"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member")
    each = classes.select("cls", "least", "n", "node").join(sums, "node", "left").join(named, F.col("node") == F.col("member"), "left")
    each = written(each.select("cls", "least", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    best = each.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    each = join_split(each, best, ["component"], "members", total).select("cls", "n", "n_links", "component_id")
    linked = join_split(marks.filter("cls IS NOT NULL").select("vec_id", "cls"), each, ["cls"], "n", marks.count()).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(marks.filter("cls IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

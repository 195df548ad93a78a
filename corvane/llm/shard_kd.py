"""Sharding by a k-d tree: split at distributed weighted medians along the widest metadata dimension.

Every level of the tree costs a job for the extent of each node in each dimension and about three for
the medians of all its nodes at once: a histogram per node narrows the bin that holds the median until
that bin's bytes are within the tolerance. A row's place in a dimension is two numbers that together keep
its order whole: for numbers the value over 4 and the rest, for strings the exact rank among the different
values. Rows that tie in the split dimension are told apart by doc_id, then by row, so a hot source or
length is cut in the middle. Rows move once, for the slots.

Nothing but DataFrame functions runs: what the driver decides goes back as a literal that Spark unfolds.
The driver holds a row per node of the tree and, in each round, `BINS` bins for all nodes of a level
together (`FEW` for each at least), so its memory grows with the number of shards only.

Defined results: a null text has size 1 and checksum 0; null metadata sorts before all else; rows that
repeat are separate rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_split, written

#: Bins of all nodes of a level together, of one node at most, and of one at least.
BINS, MOST, FEW = 1 << 18, 4096, 8
#: The slots of a shard are numbered in so many parts, each in a task of its own.
SLOT_PARTS = 64
SLOTS_SENT = 1_000_000
LOWEST = -(1 << 61) - 1


def number_codes(c: Column) -> list[Column]:
    """The order of whole numbers as two numbers whose differences do not overflow; null before all."""
    return [F.coalesce(F.shiftright(c.cast("long"), 2), F.lit(LOWEST)), F.coalesce(c.cast("long").bitwiseAND(F.lit(3).cast("long")), F.lit(0).cast("long"))]


def ranks(docs: DataFrame, column: str) -> DataFrame:
    """value, rank (from 0) and n (rows) of the different values of a column that are not null, numbered part by part of a sorted table."""
    counts = docs.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n")).filter("value IS NOT NULL")
    parts = written(counts.orderBy("value").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))  # a row per partition
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).drop("size")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return parts.withColumn("own", rank).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("own") - 1).alias("rank"), "n")


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A DataFrame of rows that the driver knows, as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


@dataclass
class Node:
    """A subtree that is to become `leaves` shards; the search for its median is at field len(fixed) of a row's fields."""

    id: int
    leaves: int
    total: int = 0
    dim: int = 0
    low: int = 0
    high: int = 0
    before: int = 0
    few: bool = False
    fixed: list[int] = field(default_factory=list)
    cut: list[int] | None = None

    @property
    def goal(self) -> float:
        """Bytes that are to go left."""
        return self.total * (self.leaves // 2) / self.leaves


def _fields(dim: Column) -> Column:
    """What a row is ordered by in a dimension: its two codes, the two of doc_id, and its number."""
    return F.concat(F.slice("dims", 2 * dim + 1, F.lit(2)), F.col("tie"), F.array("row"))


def _near(rows: DataFrame, nodes: list[Node], bins: int) -> DataFrame:
    """The rows among which the nodes' medians lie, with _x, the field that is searched now."""
    ask = [{"_node": n.id, "_dim": n.dim, "_low": n.low, "_width": -(-(n.high - n.low + 1) // bins), "_high": n.high, "_fixed": n.fixed} for n in nodes]
    side = literal_rows(rows.sparkSession, ask, "_node: long, _dim: int, _low: long, _width: long, _high: long, _fixed: array<long>")
    both = rows.join(F.broadcast(side), F.col("node") == F.col("_node")).withColumn("_fields", _fields(F.col("_dim")))
    both = both.withColumn("_x", F.element_at("_fields", F.size("_fixed") + 1))
    return both.filter(F.col("_x").between(F.col("_low"), F.col("_high")) & (F.slice("_fields", F.lit(1), F.size("_fixed")) == F.col("_fixed")))


def _histograms(rows: DataFrame, nodes: list[Node], bins: int) -> dict[int, list[tuple[int, int, int]]]:
    """(bin, bytes, rows) of the bins of each node that are not empty."""
    found = _near(rows, nodes, bins).groupBy("node", F.expr("(_x - _low) div _width").alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in sorted(found, key=lambda r: (r["node"], r["bin"])):
        out.setdefault(r["node"], []).append((int(r["bin"]), int(r["size"]), int(r["n"])))
    return out


def _finish(rows: DataFrame, nodes: list[Node], bins: int) -> None:
    """Cut nodes whose median lies among as many rows as a node has bins, at most: those rows are read."""
    found: dict[int, list] = {}
    for r in _near(rows, nodes, bins).select("node", "_fields", "size").collect():
        found.setdefault(r["node"], []).append((list(r["_fields"]), r["size"]))
    for n in nodes:
        for key, size in sorted(found[n.id]):
            if n.before + size / 2 >= n.goal:
                break
            n.before += size
        else:
            key[-1] += 1
        n.cut = key


def _narrow(node: Node, found: list[tuple[int, int, int]], bins: int, tolerance: float, rest: list[tuple[int, int]]) -> None:
    """One round of the search; sets `cut`, the first fields on the right, when it is done. `rest`: the extents of the fields after the first."""
    width = -(-(node.high - node.low + 1) // bins)
    for b, size, n in found:
        if node.before + size >= node.goal:
            break
        node.before += size
    begin = node.low + b * width
    end = min(begin + width - 1, node.high)
    node.few = n <= bins
    if size <= tolerance:  # cut on the side that is nearer
        node.cut = node.fixed + [begin if node.goal - node.before < node.before + size - node.goal else end + 1]
    elif begin < end or node.few:
        node.low, node.high = begin, end
    else:
        node.fixed.append(begin)
        node.low, node.high = rest[len(node.fixed) - 1]


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, strings: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("n_chars", "doc_id"), tolerance: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0) and slot (gapless in the shard) of every row.

    Give the number of shards, or the bytes that a leaf should hold at most (about). `strings` and `numbers`
    name the columns that are dimensions. `tolerance` is the part of a shard's bytes by which one cut may
    miss its median.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    taken = [F.col(f"`{c}`").cast("string").alias(f"value{i}") for i, c in enumerate(strings)]
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.array(*[x for c in numbers for x in number_codes(F.col(f"`{c}`"))]).alias("numbers"),
        F.array(*number_codes(F.col("doc_id"))).alias("tie"),
        *taken,
    )
    if strings:
        rows = written(rows)
        total = rows.count()
        for i in range(len(strings)):
            side = ranks(rows, f"value{i}").select(F.col("value").alias(f"value{i}"), F.col("rank").alias(f"rank{i}"), "n")
            rows = join_split(rows, side, [f"value{i}"], "n", total, "left")
    codes = [x for i in range(len(strings)) for x in (F.coalesce(F.col(f"rank{i}"), F.lit(-1).cast("long")), F.lit(0).cast("long"))]
    rows = rows.select("doc_id", "size", "text_crc32", F.concat(F.array(*codes).cast("array<long>"), "numbers").alias("dims"), "tie")
    rows = written(rows.withColumns({"row": F.monotonically_increasing_id(), "node": F.lit(1).cast("long")}))
    dims = range(len(strings) + len(numbers))
    span = lambda c, n: [F.min(c).alias(f"low{n}"), F.max(c).alias(f"high{n}")]
    extent = [x for i in dims for x in span(F.element_at("dims", 2 * i + 1), i)]
    whole = rows.agg(F.sum("size").alias("size"), *span(F.element_at("tie", 1), "tie"), *span(F.col("row"), "row"), *extent).first()
    if whole["size"] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaves = shards or max(1, -(-int(whole["size"]) // int(target_bytes)))
    spans = [max(1, whole[f"high{i}"] - whole[f"low{i}"]) for i in dims]
    rest = [(0, 3), (whole["lowtie"], whole["hightie"]), (0, 3), (whole["lowrow"], whole["highrow"])]
    allowed = tolerance * whole["size"] / leaves
    tree, done, level = [Node(1, leaves)], [], 0
    while tree:
        done += [n.id for n in tree if n.leaves == 1]
        tree = [n for n in tree if n.leaves > 1]
        if not tree:
            break
        seen = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("size"), *extent).collect()}
        tree = [n for n in tree if n.id in seen]
        bins = max(FEW, min(MOST, BINS // max(1, len(tree))))
        for n in tree:
            r = seen[n.id]
            n.total = int(r["size"])
            n.dim = max(dims, key=lambda i: ((r[f"high{i}"] - r[f"low{i}"]) / spans[i], -i))
            n.low, n.high = r[f"low{n.dim}"], r[f"high{n.dim}"]
        while searching := [n for n in tree if n.cut is None]:
            if few := [n for n in searching if n.few]:
                _finish(rows, few, bins)
            if many := [n for n in searching if not n.few]:
                found = _histograms(rows, many, bins)
                for n in many:
                    _narrow(n, found[n.id], bins, allowed, rest)
        side = literal_rows(rows.sparkSession, [{"_node": n.id, "_dim": n.dim, "_cut": n.cut} for n in tree], "_node: long, _dim: int, _cut: array<long>")
        left = F.slice(_fields(F.col("_dim")), F.lit(1), F.size("_cut")) < F.col("_cut")
        node = F.when(F.col("_node").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        rows = rows.join(F.broadcast(side), F.col("node") == F.col("_node"), "left").withColumn("node", node).drop("_node", "_dim", "_cut")
        level += 1
        if level % 4 == 0:
            rows = written(rows)
        tree = [Node(2 * n.id + k, m) for n in tree for k, m in ((0, n.leaves // 2), (1, n.leaves - n.leaves // 2))]
    order = sorted(done, key=lambda i: bin(i)[3:])  # from left to right
    side = literal_rows(rows.sparkSession, [{"_node": n, "shard": k} for k, n in enumerate(order)], "_node: long, shard: int")
    return with_slots(rows.join(F.broadcast(side), F.col("node") == F.col("_node")).select("doc_id", "size", "text_crc32", "shard", "row"), len(order))


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Number the rows of each shard without gaps, no shard in one task: parts of shards are numbered, after the sizes of the parts before.

    The sizes are broadcast only if they are at most SLOTS_SENT rows.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SLOT_PARTS)).cast("int"))
    sizes = rows.groupBy("shard", "part").count()  # shards times SLOT_PARTS rows
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "part", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    side = F.broadcast(before) if shards * SLOT_PARTS <= SLOTS_SENT else before
    return rows.withColumn("rank", rank).join(side, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))

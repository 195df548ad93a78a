"""Exact deduplication: a counting Bloom pass finds hashes that may repeat, and only their rows shuffle.

Pass one reduces each document to its hash and counts, in two cells per hash, how many hashes fell into
each cell (numbers of a few bytes are all that moves). The cells hit twice or more become one bitmap,
which is broadcast: 16 bits per document or more, up to `2 ** MOST_BITS` bits (32 MB). In pass two a
document passes straight through unless both its cells are set; all copies of a text share their cells, so
none can slip through. With more documents than the largest bitmap can tell apart, more of the narrow rows
of hashes shuffle; the results do not change, and texts move only where a copy goes.

Defined results: a null text counts as empty; of equal texts the longest original stays, then the
smallest doc_id (null first); of rows that repeat with their doc_id one stays; extra columns are
carried by `drop_exact_copies`, whatever their names, and ignored by `exact_copies`; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from corvane.llm.common import fresh, join_split, quoted, without_spaces, written

LEAST_BITS, MOST_BITS = 20, 28


def text_sha256(text: Column) -> Column:
    return F.sha2(without_spaces(text).cast("binary"), 256)


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))


def _cells(key: Column, bits: int) -> list[Column]:
    h, mask = F.xxhash64(key), F.lit((1 << bits) - 1)
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


class Repeated:
    """The cells that two or more of some keys hit: at most 2 ** MOST_BITS / 32768 rows (bucket, bitmap of 4 KB)."""

    def __init__(self, keys: DataFrame, key: str, n: int | None = None):
        self.bits = bits_for(keys.count() if n is None else n)
        hit = keys.select(F.explode(F.array(*_cells(F.col(key), self.bits))).alias("cell")).groupBy("cell").count().filter("count > 1")
        self.bitmap = hit.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))

    @classmethod
    def every(cls, keys: DataFrame, key: str) -> Repeated:
        """All cells of some keys, whether they repeat or not."""
        return cls(keys.unionByName(keys), key)

    def mark(self, df: DataFrame, key: str, flag: str = "_maybe") -> DataFrame:
        """`df` with a column `flag`: whether both cells of the key are set. The bitmap's size is bounded, so it is broadcast."""
        for i, cell in enumerate(_cells(F.col(key), self.bits)):
            bucket, bitmap, found = fresh(df, f"_bucket{i}", f"_bitmap{i}", f"_set{i}")
            side = F.broadcast(self.bitmap.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
            at = F.bitmap_bit_position(cell)
            byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            df = df.join(side, F.bitmap_bucket_number(cell) == F.col(bucket), "left")
            df = df.withColumn(found, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))).drop(bucket, bitmap)
            flag_so_far = F.col(found) if i == 0 else F.col(flag) & F.col(found)
            df = df.withColumn(flag, flag_so_far).drop(found)
        return df


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: doc_id and a hash of the text; rows that share it are repeats of each other."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """`docs` without the rows that go, by `decided` (key: see `row_key`; stays: a boolean per row).

    Keys that are not in `decided`, or once and stay, pass through; of the rows of a key that stays one is kept.
    """
    odd = written(decided.groupBy("key").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).filter("n > 1 OR NOT stays"))
    key, maybe, stays, n, row, order = fresh(docs, "_key", "_maybe", "_stays", "_n", "_row", "_order")
    total = odd.agg(F.sum("n")).first()[0] or 0
    marked = Repeated.every(odd.select("key"), "key").mark(docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))), key, maybe)
    side = odd.select(F.col("key").alias(key), F.col("stays").alias(stays), F.col("n").alias(n))
    met = join_split(marked.filter(F.col(maybe)).drop(maybe), side, [key], n, total, "left")
    columns = quoted(docs.columns)
    alike = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    several = met.filter(F.col(stays)).select(key, F.xxhash64(*alike).alias(order), F.struct(*columns).alias(row)).groupBy(key).agg(F.min_by(row, order).alias(row)).select(f"{row}.*")
    return marked.filter(~F.col(maybe)).select(*columns).unionByName(met.filter(F.col(stays).isNull()).select(*columns)).unionByName(several)


def _digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, rest (ascending: longest originals first), key and row of every row."""
    return docs.select(
        F.col("doc_id"),
        text_sha256(F.col("text")).alias("text_sha256"),
        (-F.char_length(F.coalesce(F.col("text"), F.lit("")))).alias("rest"),
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def _shared(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The digests that repeat nothing by the bitmap, and the others with best (that stays) and group_size of their text."""
    total = digests.count()
    marked = Repeated(digests, "text_sha256", total).mark(digests, "text_sha256")
    maybe = marked.filter("_maybe").drop("_maybe")
    best = maybe.groupBy("text_sha256").agg(F.min(F.struct("rest", "doc_id", "key", "row")).alias("best"), F.count("*").alias("group_size"), F.count("*").alias("n"))
    return marked.filter("NOT _maybe"), join_split(maybe, best, ["text_sha256"], "n", total)


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    once, shared = _shared(written(_digests(docs)))
    alone = once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(shared.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; those without a possible copy never shuffle."""
    _, shared = _shared(written(_digests(docs)))
    return keep_rows(docs, shared.filter("group_size > 1").select("key", (F.col("key") == F.col("best.key")).alias("stays")))

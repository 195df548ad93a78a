"""Hash-ordered shuffles, partitions, groups and tournaments; all of them repeat exactly in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import hash_key, hash_number
from corvane.operators.prefix import hash_part, placed, with_total
from corvane.sources.stores import settled


#: Candidates of a bracket from which on it is numbered in two levels.
WIDE = 20_000


def shuffled(rows: DataFrame, by: list[str], item: str, *salt: Column | str | int, wide: bool | None = None) -> DataFrame:
    """`rows` with place (from 1): the order of salted hashes within each group.

    `wide` (by itself where there is no group): groups may be very large, so a group is numbered in two levels and its rows are
    written once; else a group is sorted by one task.
    """
    order = hash_key("shuf", *salt, *[F.col(b) for b in by], F.col(item))
    if wide if wide is not None else not by:
        keyed = settled(rows.withColumn("_key", order))
        return placed(keyed, by, "_key", "place", hash_part(F.col("_key")), [item]).drop("_key")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, item)))


def even_groups(rows: DataFrame, by: list[str], place: str = "place", size: int = 8, wide: bool = False) -> DataFrame:
    """gidx (from 0): contiguous slices of at most `size`, as even as possible, the first ones larger."""
    counted = with_total(settled(rows), by, _n=F.count("*")) if wide else rows.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    n = F.col("_n")
    groups = F.ceil(n / size)
    base, extra = F.floor(n / groups), n % groups
    i = F.col(place) - 1
    cut = extra * (base + 1)
    return counted.withColumn("gidx", F.when(i < cut, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - cut) / base)).cast("int")).drop("_n")


def round_robin(rows: DataFrame, order: list[Column], batches: int) -> DataFrame:
    """batch: rows dealt in turn in the given order.

    The order is total, so places come from a range partitioning's counts and no task numbers all rows.
    """
    return _numbered(rows, order).withColumn("batch", F.pmod(F.col("place") - 1, F.lit(batches)).cast("int"))


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """place (from 1) in a total order, without one task for all rows: sorted parts, numbered after the parts before."""
    parts = settled(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first")).orderBy("_part").collect()  # a row per task
    before, upto = [], 0
    for r in sizes:
        before.append((r["_part"], upto - r["_first"] + 1))
        upto += r["_n"]
    shift = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _shift long"))
    return parts.join(shift, "_part").withColumn("place", F.col("_in") + F.col("_shift")).drop("_part", "_in", "_shift")


def random_groups(rows: DataFrame, item: str, k: int, *salt: Column | str | int, by: list[str] | None = None) -> DataFrame:
    """cluster (from 0): groups of k in hash order; a tail below k joins the last group."""
    by = by or []
    dealt = shuffled(rows, by, item, *salt)
    counted = dealt.withColumn("_n", F.count("*").over(Window.partitionBy(*by))) if by else with_total(settled(dealt), by, _n=F.count("*"))
    return counted.withColumn("cluster", F.least(F.floor((F.col("place") - 1) / k), F.greatest(F.floor(F.col("_n") / k) - 1, F.lit(0))).cast("int")).drop("_n")


def order_batches(rows: DataFrame, batches: int, item: Column, order: str = "order") -> DataFrame:
    """batch: a hash of the pair, half the batches on for its second order, so both orders never meet."""
    return rows.withColumn("batch", F.pmod(hash_number(item) + F.col(order) * F.floor(F.lit(batches / 2)), F.lit(batches)).cast("int"))


def round_robin_groups(rows: DataFrame, by: str, item: str, m: int, *salt: Column | str | int) -> DataFrame:
    """`m` items taken from all groups in turn."""
    return shuffled(rows, [by], item, *salt).orderBy("place", by).limit(m)


def hash_sample(rows: DataFrame, by: list[str], item: str, fraction_of: Column, *salt: Column | str | int) -> DataFrame:
    """The first rows of each group in hash order, up to a number that a column gives."""
    return shuffled(rows, by, item, *salt).filter(F.col("place") <= fraction_of)


def winners(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """bid, round, gidx, winner, margin of answered groups: choice is a letter, A for slot 0, conf 50 to 100."""
    choice = F.ascii(F.col("choice")) - F.ascii(F.lit("A"))
    return groups.join(answers, ["bid", "round", "gidx"]).filter(F.col("slot") == choice).select("bid", "round", "gidx", F.col("candidate").alias("winner"), ((F.col("conf") - 50) / 50).alias("margin"))


def next_round(won: DataFrame, round_no: int, *salt: Column | str | int, size: int = 8, wide: bool = False) -> DataFrame:
    """bid, round, gidx, slot, candidate of the next round; brackets with one winner left have none."""
    left = with_total(won.select("bid", F.col("winner").alias("candidate")), ["bid"], _n=F.count("*")).filter("_n > 1").drop("_n")
    return grouped(left, round_no, *salt, size=size, wide=wide)


def grouped(candidates: DataFrame, round_no: int, *salt: Column | str | int, size: int = 8, wide: bool = False) -> DataFrame:
    """bid, round, gidx, slot, candidate; `wide`: brackets may be very large (see `shuffled`)."""
    dealt = even_groups(shuffled(candidates, ["bid"], "candidate", f"r{round_no}", *salt, wide=wide), ["bid"], size=size, wide=wide)
    slot = F.row_number().over(Window.partitionBy("bid", "gidx").orderBy("place")) - 1
    return dealt.select("bid", F.lit(round_no).alias("round"), "gidx", slot.alias("slot"), "candidate")


def candidate_scores(groups: DataFrame, won: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 4.0)) -> DataFrame:
    """bid, candidate, s0 to s5: what a candidate won until its first loss, by depth, by margin and by weighted rounds."""
    size = F.count("*").over(Window.partitionBy("bid", "round", "gidx"))
    state = groups.withColumn("size", size).join(won, ["bid", "round", "gidx"])
    win = F.col("candidate") == F.col("winner")
    state = state.select("bid", "candidate", "round", "size", "margin", win.cast("int").alias("win"))
    lost = F.sum(1 - F.col("win")).over(Window.partitionBy("bid", "candidate").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    alive = state.withColumn("_lost", F.coalesce(lost, F.lit(0))).filter("_lost = 0")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.least(F.col("round"), F.lit(len(weights))))
    margin_won, depth = F.sum(F.col("win") * F.col("margin")), F.sum("win")
    share = F.when(F.col("win") == 1, F.col("margin")).when(F.col("size") > 1, -F.col("margin") / (F.col("size") - 1)).otherwise(0.0)
    return alive.groupBy("bid", "candidate").agg(
        (margin_won + depth).alias("s0"),
        depth.cast("double").alias("s1"),
        (margin_won - F.sum((1 - F.col("win")) * F.col("margin")) + depth).alias("s2"),
        F.sum(share).alias("s3"),
        F.max(F.when((F.col("round") == 1) & (F.col("win") == 1), 1.0).otherwise(0.0)).alias("s4"),
        F.sum(F.col("win") * w).alias("s5"),
    )

"""Sums over all that comes before a row, in an order, without a task that sorts a whole group (or table).

Two levels: the order is cut into parts, sums of the parts of a group are added up in the group's one short list, and a
window runs within a part alone. The states that move between tasks are sums per (group, part), merged by aggregation;
the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that parts of an order lie between.
CUTS = 256


def hash_part(key: Column) -> Column:
    """Part of a hexadecimal hash in the order of its letters: 256 even ones."""
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("int")


def value_part(rows: DataFrame, order: str, most: int | None = None) -> Column:
    """Part of a value: how many of `most` values of the column, those with the least hashes, are not above it; nulls come first."""
    values = rows.filter(F.col(order).isNotNull()).select(order).distinct()
    cuts = sorted(r[0] for r in values.orderBy(F.xxhash64(order), order).limit(most or CUTS).collect())
    return F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))))


def joined(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the columns of `side` (a row per key), nulls equal to nulls; no keys: side has one row."""
    names = {k: f"_key_{k}" for k in keys}
    other = side.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in side.columns])
    if not keys:
        return rows.crossJoin(other)
    on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    test = on[0]
    for o in on[1:]:
        test = test & o
    return rows.join(other, test).drop(*names.values())


def prefix_sums(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column], part: Column, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """`rows` with the sums of each column over the group's rows before it in the order (0 for the first), ties by further columns.

    `part` must rise with the order; it has few hundred values.
    """
    cut = rows.withColumn("_part", -part if descending else part)
    named = {name: f"_own_{name}" for name in sums}
    cut = cut.withColumns({own: sums[name] for name, own in named.items()})
    sizes = cut.groupBy(*by, "_part").agg(*[F.sum(own).alias(own) for own in named.values()])
    entry = F.struct("_part", *named.values())
    lists = sizes.groupBy(*by).agg(F.collect_list(entry).alias("_all"))  # a group has a few hundred parts at most
    total = lambda name: F.aggregate(F.filter("_all", lambda x: x["_part"] < F.col("_one._part")), F.lit(0).cast(dict(sizes.dtypes)[named[name]]), lambda s, x: s + F.coalesce(x[named[name]], F.lit(0)))
    before = lists.select(*by, "_all", F.explode("_all").alias("_one")).select(*by, F.col("_one._part").alias("_part"), *[total(n).alias(f"_before_{n}") for n in named])
    keys = [F.desc(order) if descending else F.asc(order), *(ties or [])]
    w = Window.partitionBy(*by, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumns({f"_in_{n}": F.coalesce(F.sum(own).over(w), F.lit(0)) for n, own in named.items()})
    out = joined(inner, before, [*by, "_part"])
    out = out.withColumns({n: F.col(f"_in_{n}") + F.col(f"_before_{n}") for n in named})
    return out.drop("_part", *named.values(), *[f"_in_{n}" for n in named], *[f"_before_{n}" for n in named])


def placed(rows: DataFrame, by: list[str], order: str, place: str, part: Column | None = None, ties: list[str] | None = None) -> DataFrame:
    """`rows` with `place`, from 1, in the order of a column within a group."""
    part = value_part(rows, order) if part is None else part
    return prefix_sums(rows, by, order, {place: F.lit(1)}, part, ties=ties).withColumn(place, F.col(place) + 1)


def with_total(rows: DataFrame, by: list[str], **totals: Column) -> DataFrame:
    """`rows` with aggregates of their group, by a join instead of a window."""
    return joined(rows, rows.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]), by)

"""Verdicts that a release waits for: floors over seeds, additive-only builds, drop gates, ablations, partitions, wording."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.pairing import block_best
from corvane.operators import resampling as B
from corvane.operators import sequencing as Q
from corvane.sources.stores import settled


def char_gram_counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, gram, tf: runs of `n` characters as `functions.text.char_grams` has them, counted per key within parts of Arrow batches; sums are the caller's."""
    bare = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict = {}
            size = 0
            rows_ = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k, (own, t) in enumerate(rows_):
                found.setdefault(own, Counter()).update(t[i : i + n] for i in range(len(t) - n + 1))
                size += len(t)
                if size > 4_000_000 or k == len(rows_) - 1:
                    flat = [(own, g, c) for own, grams in found.items() for g, c in grams.items()]
                    columns = list(zip(*flat)) if flat else [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=[key, "gram", "tf"])
                    found, size = {}, 0

    return rows.select(key, bare.alias("_t")).mapInArrow(counted, f"`{key}` {rows.schema[key].dataType.simpleString()}, gram string, tf bigint")


def floor_sweep(asked: DataFrame, known: DataFrame, k: int, seeds: int, n: int = 4) -> DataFrame:
    """One row: chance (1 / k), mean, least, middle, most, above, seeds, verdict of how often the plainest stylometer finds an author.

    asked and known: author, text (any number of rows per author). In each of `seeds` random partitions into groups of k an
    author's asked text goes to the member of its group whose known text it resembles most by the cosine of runs of `n`
    characters, ties to the first name. Only members of a group are compared.
    """

    def profile(rows: DataFrame) -> DataFrame:
        counts = settled(char_gram_counts(rows, "author", n).groupBy("author", "gram").agg(F.sum("tf").alias("tf")))
        norm = counts.groupBy("author").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("norm"))
        return settled(counts.join(norm, "author").select("author", "gram", (F.col("tf") / F.col("norm")).alias("w")))

    authors = settled(asked.select("author").distinct().join(known.select("author").distinct(), "author"))
    groups = None
    for s in range(seeds):
        one = Q.random_groups(authors, "author", k, "floor", s).select("author", "cluster", F.lit(s).alias("seed"))
        groups = one if groups is None else groups.unionByName(one)
    a = profile(asked).join(groups, "author").select("seed", "cluster", "gram", F.col("author").alias("a"), F.col("w").alias("wa"))
    b = profile(known).join(groups, "author").select("seed", "cluster", "gram", F.col("author").alias("b"), F.col("w").alias("wb"))
    cosines = a.join(b, ["seed", "cluster", "gram"]).groupBy("seed", "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("cosine"))
    best = cosines.groupBy("seed", "a").agg(F.min_by("b", F.struct(-F.col("cosine"), "b")).alias("pick"))
    total = authors.agg(F.count("*").alias("n"))
    rates = best.groupBy("seed").agg(F.count_if(F.col("pick") == F.col("a")).alias("hits")).crossJoin(total).select((F.col("hits") / F.col("n")).alias("rate"))
    chance = F.lit(1.0 / k)
    out = rates.agg(chance.alias("chance"), F.avg("rate").alias("mean"), F.min("rate").alias("least"), F.expr("percentile(rate, 0.5)").alias("middle"), F.max("rate").alias("most"), F.count_if(F.col("rate") > chance).alias("above"), F.count("*").alias("seeds"))
    verdict = F.when(F.col("above") == F.col("seeds"), "above chance on all seeds").when(F.col("above") == 0, "not above chance on any seed").otherwise("unstable over seeds")
    return out.withColumn("verdict", verdict)


def additive_only(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: n_old, changed, deleted, added, sound: a rebuild may add keys but neither change nor drop one. Null values are values."""
    a, b = old.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_old")), new.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_new"))
    both = a.join(b, keys, "full_outer")
    out = both.agg(
        F.count("_old").alias("n_old"),
        F.count_if(F.col("_old") & F.col("_new") & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
        F.count_if(F.col("_old") & F.col("_new").isNull()).alias("deleted"),
        F.count_if(F.col("_old").isNull()).alias("added"),
    )
    return out.withColumn("sound", (F.col("changed") == 0) & (F.col("deleted") == 0))


def drop_gate(cells: DataFrame, by: list[str], gate: float = 0.1) -> DataFrame:
    """by, cards, dropped, content, rate, passed of cells (by, n_dropped, n_content per card): a cell above the gate is excluded by name."""
    sums = cells.groupBy(*by).agg(F.count("*").alias("cards"), F.sum("n_dropped").alias("dropped"), F.sum("n_content").alias("content"))
    rate = F.col("dropped") / F.greatest(F.lit(1), F.col("content"))
    return sums.withColumn("rate", rate).withColumn("passed", F.col("rate") <= gate)


def achieved_power(gated: DataFrame, size: str, sd: float) -> DataFrame:
    """One row: cards, sxx, half_width, mde of the trend over group sizes that the passed cells leave."""
    left = gated.filter("passed").groupBy(F.col(size).cast("double").alias("k")).agg(F.sum("cards").alias("n"))
    mean = left.agg((F.sum(F.col("k") * F.col("n")) / F.sum("n")).alias("mean"))
    out = left.crossJoin(mean).agg(F.sum("n").alias("cards"), F.sum(F.col("n") * F.pow(F.col("k") - F.col("mean"), 2)).alias("sxx"), (F.max("k") - F.min("k")).alias("span"))
    se = F.try_divide(F.lit(sd) * F.col("span"), F.sqrt("sxx"))
    return out.select("cards", "sxx", (1.96 * se).alias("half_width"), (2.8 * se).alias("mde"))


def ablation_verdict(answers: DataFrame, control: str, ablated: str, base: str, replicates: int = 2000, seed: int | str = 0) -> DataFrame:
    """One row: control_rate, control_lo, chance, control_clears, diff, lo, hi, pairs, cards, detected, passed.

    answers: arm, card, bracket, unit, hit (null: not answered), chance. The control arm must clear its chance, and the ablated
    arm must differ from the base on the same (card, bracket); unanswered items and brackets of one arm only are errors.
    """
    if answers.filter(F.col("hit").isNull()).limit(1).count():
        raise ValueError("some items have no answer: a partial reading would be a second one")
    side = lambda arm: answers.filter(F.col("arm") == arm)
    own = B.cluster_ci(side(control), [], "unit", "hit", replicates, seed).select(F.col("mean").alias("control_rate"), F.col("lo").alias("control_lo"))
    chance = side(control).agg(F.avg("chance").alias("chance"))
    mean = lambda arm, name: side(arm).groupBy("card", "bracket").agg(F.avg("hit").alias(name))
    pairs = mean(ablated, "x").join(mean(base, "y"), ["card", "bracket"], "left")
    if pairs.filter("y IS NULL").limit(1).count():
        raise ValueError("brackets differ between the arms")
    diffs = pairs.select("card", (F.col("x") - F.col("y")).alias("d"))
    ci = B.cluster_ci(diffs, [], "card", "d", replicates, seed).select(F.col("mean").alias("diff"), "lo", "hi", F.col("n_units").alias("cards"))
    out = own.crossJoin(chance).crossJoin(ci).crossJoin(diffs.agg(F.count("*").alias("pairs")))  # one row each
    out = out.withColumns({"control_clears": F.col("control_lo") > F.col("chance"), "detected": (F.col("lo") > 0) | (F.col("hi") < 0)})
    return out.withColumn("passed", F.col("control_clears") & F.col("detected"))


def partition_marginal(rows: DataFrame, partition: str, person: str, value: str, bound: float, replicates: int = 500, seed: int | str = 0) -> DataFrame:
    """One row: persons, partitions, mean, lo, hi, worst (the highest upper bound of a partition alone), clear.

    A person's value is the mean over all partitions, so an accident of one partition weighs little. A person that a partition
    lacks is an error, for then partitions would speak of different people.
    """
    each = rows.groupBy(person, partition).agg(F.avg(value).alias("m"))
    parts = rows.select(partition).distinct().count()
    holes = each.filter("m IS NOT NULL").groupBy(person).agg(F.count("*").alias("n")).filter(F.col("n") < parts).count()
    if holes:
        raise ValueError(f"{holes} persons are not in all {parts} partitions")
    whole = B.cluster_ci(each.groupBy(person).agg(F.avg("m").alias("m")), [], person, "m", replicates, seed)
    worst = B.cluster_ci(each, [partition], person, "m", replicates, seed).agg(F.max("hi").alias("worst"))
    out = whole.crossJoin(worst).select(F.col("n_units").alias("persons"), F.lit(parts).alias("partitions"), "mean", "lo", "hi", "worst")
    return out.withColumn("clear", (F.col("hi") < bound) & (F.col("worst") < bound))


def exposed_wording(elements: DataFrame, sources: DataFrame, cluster: str = "cluster", item: str = "item", owner: str = "owner", vec: str = "vec", near: float = 0.55, high: float = 0.75) -> DataFrame:
    """cluster, item, near_owners, top, exposed: elements whose wording points to one member of their cluster alone.

    An element is exposed if exactly one owner has a text at cosine `near` or more and the best is at `high` or more.
    """
    met = block_best(elements.withColumnRenamed(vec, "vec"), sources.withColumnRenamed(vec, "vec"), cluster, [item], owner)
    best = met.groupBy(cluster, item, "other").agg(F.round(F.max("best"), 6).alias("best"))
    out = best.groupBy(cluster, item).agg(F.count_if(F.col("best") >= near).alias("near_owners"), F.max("best").alias("top"))
    return out.withColumn("exposed", (F.col("near_owners") == 1) & (F.col("top") >= high))

"""Clustered resampling in which no task ever holds the units of a statistic.

Rows are summed to (statistic, unit) first. By default a replicate of U units makes U draws, the j-th by a hash of (seed,
replicate, j) over all units in their order. Units lie in blocks by their number; draws are made where they fall, go
to the blocks as places of two bytes, and only sums per (block, replicate) leave these.

The other way, for statistics of very many units, moves no draws (`tree`). Units are dealt by hash to the leaves of a binary tree of at
most some LEAF units each; a unit's number is its place in its leaf alone. A replicate of U units makes U draws: these
are split from the root down, at each node by a binomial draw with the share of units on its left, and a leaf
then draws its own units, with replacement, by hashes of (seed, replicate, node, draw). So the draws are
those of the plain bootstrap, they repeat in any engine, and the B times U of them are made and summed
where the leaf is: only sums per (leaf, replicate) move. Statistics of at most LEAF units have one leaf, and then both ways
make the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.hashing import sha1_heads, tails
from corvane.functions.numeric import hash_key, hash_number, normal_cdf
from corvane.operators.prefix import hash_part, joined, placed, value_part
from corvane.sources.stores import settled

#: Units of a leaf on average, at most, and levels below the root, at most (leaves grow beyond 2 ** LEVELS times LEAF units).
LEAF = 4096
LEVELS = 20
#: Replicates whose draws one row of work splits over the leaves.
SPLIT = 32
#: Draws that one row of work makes at most.
DRAWS = 1 << 18


def levels_of(units: int) -> int:
    """Levels of the tree below its root, so that a leaf has LEAF units or fewer on average."""
    return min(LEVELS, ((units - 1) // LEAF).bit_length()) if units > 0 else 0


def _leaves_first(units: DataFrame, by: list[str], unit: str) -> tuple[DataFrame, list[str], int]:
    parts, levels = leaves(units, by, unit, "s", "n")
    return parts, by, levels


def unit_sums(rows: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """by, unit, s, n: the sum and number of a unit's values."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))


def leaves(units: DataFrame, by: list[str], unit: str, *values: str) -> tuple[DataFrame, int]:
    """by, leaf, items (structs of unit and the values, in the unit's order); and the levels of the tree.

    A leaf's key is (by, leaf), which holds some LEAF units however many a statistic has.
    """
    most = units.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    levels = levels_of(most)
    leaf = hash_number("leaf", F.col(unit)) % (1 << levels) if levels else F.lit(0).cast("long")
    items = F.array_sort(F.collect_list(F.struct(unit, *values))).alias("items")
    return settled(units.withColumn("leaf", leaf).groupBy(*by, "leaf").agg(items)), levels


def binomial_quantile(n: int, p: float, u: float) -> int:
    """How many values k have a chance of k or fewer successes in n of at most u.

    Chances are summed about the mean: beyond 12 deviations and 40 there is less than a double can tell.
    """
    if n == 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    spread = 12 * math.sqrt(n * p * (1 - p)) + 40
    lo, hi = max(0, math.floor(n * p - spread)), min(n, math.ceil(n * p + spread))
    mode = min(hi, max(lo, math.floor((n + 1) * p)))
    log = math.lgamma(n + 1) - math.lgamma(mode + 1) - math.lgamma(n - mode + 1) + mode * math.log(p) + (n - mode) * math.log1p(-p)
    k, odds = np.arange(lo, hi + 1, dtype=float), p / (1 - p)
    up, down = k[k > mode], k[k < mode][::-1]
    chances = np.concatenate([np.cumprod((down + 1) / ((n - down) * odds))[::-1], [1.0], np.cumprod((n - up + 1) / up * odds)]) * math.exp(log)
    return lo + int(np.searchsorted(np.cumsum(chances), u, side="right"))


def split_draws(counts: np.ndarray, draws: int, uniform) -> np.ndarray:
    """Draws of each leaf: from the root (node 1; children of k: 2 k and 2 k + 1) by binomials at `uniform(node)`."""
    sizes = [counts]
    while len(sizes[0]) > 1:
        sizes.insert(0, sizes[0].reshape(-1, 2).sum(axis=1))
    here = np.array([draws])
    for level in range(len(sizes) - 1):
        below = np.zeros(2 * len(here), np.int64)
        for k in np.flatnonzero(here).tolist():
            left = binomial_quantile(int(here[k]), float(sizes[level + 1][2 * k] / sizes[level][k]), uniform(len(here) + k))
            below[2 * k : 2 * k + 2] = left, here[k] - left
        here = below
    return here


def leaf_draws(parts: DataFrame, by: list[str], levels: int, replicates: int, seed: int | str) -> DataFrame:
    """by, b, leaf, draws: how many draws each leaf gets in each replicate."""
    sizes = parts.select(*by, "leaf", F.size("items").cast("long").alias("units"))
    every = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")
    if levels == 0:
        return sizes.select(*by, every, "leaf", F.col("units").alias("draws"))
    schema = sizes.select(*by, F.lit(0).alias("b"), "leaf", F.lit(0).cast("long").alias("draws")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for k in range(batch.num_rows):
                found, begin = batch.column("leaves")[k].as_py(), batch.column("begin")[k].as_py()
                counts = np.zeros(1 << levels, np.int64)
                counts[[x["leaf"] for x in found]] = [x["units"] for x in found]
                for b in range(begin, min(begin + SPLIT, replicates)):
                    drawn = split_draws(counts, int(counts.sum()), lambda node: int(hashlib.sha1(f"{seed}|{b}|{node}".encode()).hexdigest()[:13], 16) / 2.0**52)
                    at = np.flatnonzero(drawn)
                    own = [batch.column(c).slice(k, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in by]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), b, np.int32)), pa.array(at), pa.array(drawn[at])], names=[*by, "b", "leaf", "draws"])

    # a statistic's list of leaves has at most 2 ** LEVELS entries
    lists = sizes.groupBy(*by).agg(F.collect_list(F.struct("leaf", "units")).alias("leaves"))
    work = lists.select(*by, "leaves", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(SPLIT))).alias("begin"))
    return work.repartition(*by, "begin").mapInArrow(scan, schema)


def drawn_units(parts: DataFrame, by: list[str], levels: int, replicates: int, seed: int | str) -> DataFrame:
    """by, b, leaf, item: one row per draw, the drawn unit's struct; nothing is shuffled after the draws are made."""
    keyed = [*by, "leaf"]
    per_leaf = leaf_draws(parts, by, levels, replicates, seed)
    each = per_leaf.join(parts, keyed) if levels else parts.select(*keyed, F.size("items").cast("long").alias("draws"), "items", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    each = each.filter("draws > 0").select(*keyed, "b", "items", F.explode(F.sequence(F.lit(0), F.col("draws").cast("int") - 1)).alias("j"))
    node = [F.col("leaf") + (1 << levels)] if levels else []
    u = hash_number(seed, F.col("b"), *node, F.col("j")) % F.size("items")
    return each.select(*keyed, "b", F.get("items", u.cast("int")).alias("item"))


def replicates_of(parts: DataFrame, by: list[str], levels: int, replicates: int, seed: int | str, equal_weight: bool = False) -> DataFrame:
    """by, b, value: each replicate's mean, weighted by observations or equal over units, of leaves with s and n."""
    met = drawn_units(parts, by, levels, replicates, seed)
    s, n = F.col("item.s"), F.col("item.n")
    value = F.sum(s / n) / F.count("*") if equal_weight else F.sum(s) / F.sum(n)
    return met.groupBy(*by, "b").agg(value.alias("value"))


def numbered_blocks(units: DataFrame, by: list[str], unit: str) -> DataFrame:
    """`units` with block and place: their number in the unit's order (nulls last), in blocks of LEAF."""
    last = F.when(F.col(unit).isNull(), F.lit(1 << 20)).otherwise(value_part(units, unit))
    each = placed(units, by, unit, "_u", last)
    return each.withColumns({"block": F.floor((F.col("_u") - 1) / LEAF).cast("int"), "place": ((F.col("_u") - 1) % LEAF).cast("int")}).drop("_u")


def plain_draws(units: DataFrame, by: list[str], replicates: int, seed: int | str) -> DataFrame:
    """by, block, b, places: the draws of each replicate by block, as places of two bytes each (a row per block and DRAWS draws)."""
    sizes = units.groupBy(*by).agg(F.count("*").alias("n"))
    every = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    work = every.select(*by, "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS).cast("long"))).alias("begin"))
    schema = sizes.select(*by, F.lit(0).alias("block"), F.lit(0).alias("b"), F.lit(b"").alias("places")).schema
    leaf, most = LEAF, DRAWS

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                n, b, begin = (batch.column(c)[k].as_py() for c in ("n", "b", "begin"))
                end = min(begin + most, n)
                if (begin, end) not in known:
                    known.clear()  # the numbers of one row of work
                    known[begin, end] = tails([b"%d" % j for j in range(begin, end)])
                u = (sha1_heads(f"{seed}|{b}|".encode(), known[begin, end], end - begin) >> np.uint64(32)).astype(np.int64) % n
                u.sort()
                blocks, first = np.unique(u // leaf, return_index=True)
                places = (u % leaf).astype(np.uint16)
                cut = [x.tobytes() for x in np.split(places, first[1:])]
                own = [batch.column(c).slice(k, 1).take(pa.array(np.zeros(len(blocks), np.int64))) for c in by]
                yield pa.RecordBatch.from_arrays([*own, pa.array(blocks.astype(np.int32)), pa.array(np.full(len(blocks), b, np.int32)), pa.array(cut, pa.binary())], names=[*by, "block", "b", "places"])

    return work.repartition(max(1, min(2_000, replicates * 4)), "b", "begin").mapInArrow(draw, schema)


def plain_replicates(units: DataFrame, by: list[str], unit: str, replicates: int, seed: int | str, equal_weight: bool = False) -> DataFrame:
    """by, b, value: as `replicates_of`, by plain draws of units (by, unit, s, n) in blocks."""
    placed_units = settled(numbered_blocks(units, by, unit).select(*by, "block", "place", "s", "n"))
    kinds = [f"`{c}` {placed_units.schema[c].dataType.simpleString()}" for c in by]
    keys = [*by, "block"]

    def weigh(drawn: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        s, n = np.zeros(len(own)), np.zeros(len(own))
        at = own["place"].to_numpy()
        s[at], n[at] = own["s"].to_numpy(float), own["n"].to_numpy(float)
        if equal_weight:
            s, n = s / n, np.ones(len(own))
        w = [np.bincount(np.frombuffer(p, np.uint16), minlength=len(own)) for p in drawn["places"]]
        out = pd.DataFrame({"b": drawn["b"].to_numpy(), "top": [float(x @ s) for x in w], "low": [float(x @ n) for x in w]})
        for k, c in enumerate(by):
            out.insert(k, c, [own[c].iloc[0]] * len(out))
        return out

    drawn = plain_draws(units, by, replicates, seed).groupBy(*keys)
    met = drawn.cogroup(placed_units.groupBy(*keys)).applyInPandas(weigh, ", ".join([*kinds, "b int, top double, low double"]))
    return met.groupBy(*by, "b").agg((F.sum("top") / F.sum("low")).alias("value"))


def _grouped(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs)


def cluster_ci(rows: DataFrame, by: list[str], unit: str, value: str, replicates: int = 2000, seed: int | str = 0, equal_weight: bool = False, tree: bool = False) -> DataFrame:
    """by, mean, lo, hi, p: cluster bootstrap; p is two-sided about zero, one added to both counts. `tree`: very many units (see above)."""
    return _interval(settled(unit_sums(rows, by, unit, value)), by, unit, replicates, seed, equal_weight, tree)


def _interval(units: DataFrame, by: list[str], unit: str, replicates: int, seed: int | str, equal_weight: bool, tree: bool = False) -> DataFrame:
    most = units.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if tree or most <= LEAF:
        drawn = replicates_of(*_leaves_first(units, by, unit), replicates, seed, equal_weight)
    else:
        drawn = plain_replicates(units, by, unit, replicates, seed, equal_weight)
    reps = _grouped(
        drawn,
        by,
        F.expr("percentile(value, 0.025)").alias("lo"),
        F.expr("percentile(value, 0.975)").alias("hi"),
        F.least(F.lit(1.0), 2.0 * (F.least(F.sum((F.col("value") >= 0).cast("int")), F.sum((F.col("value") <= 0).cast("int"))) + 1) / (replicates + 1)).alias("p"),
    )
    mean = F.avg(F.col("s") / F.col("n")) if equal_weight else F.sum("s") / F.sum("n")
    point = _grouped(units, by, mean.alias("mean"), F.count("*").alias("n_units"))
    return point.join(reps, by) if by else point.join(reps)


def multiseed_ci(rows: DataFrame, by: list[str], unit: str, value: str, seeds: list[int], replicates: int = 500) -> DataFrame:
    """by, mean, lo (least), hi (most), agree: the envelope over seeds and whether all intervals lie on one side of zero."""
    units = settled(unit_sums(rows, by, unit, value))
    runs = None
    for s in seeds:
        one = _interval(units, by, unit, replicates, s, False)
        runs = one if runs is None else runs.unionByName(one)
    side = F.when(F.col("lo") > 0, 1).when(F.col("hi") < 0, -1).otherwise(0)
    return runs.groupBy(*by).agg(F.first("mean").alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.count_distinct(side) == 1).alias("agree"))


def unit_weights(names: DataFrame, name: str, replicates: int, seed: int | str, weight: str) -> DataFrame:
    """b, name, weight: how often each replicate draws a unit (units that it does not draw have no row), by plain draws."""
    names = settled(names)
    if names.count() <= LEAF:
        parts, levels = leaves(names, [], name)
        return drawn_units(parts, [], levels, replicates, seed).groupBy("b", F.col(f"item.{name}").alias(name)).agg(F.count("*").alias(weight))
    kind = names.schema[name].dataType.simpleString()
    own = settled(numbered_blocks(names, [], name))

    def count(drawn: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values("place")
        w = np.array([np.bincount(np.frombuffer(p, np.uint16), minlength=len(units)) for p in drawn["places"]]).reshape(len(drawn), len(units))
        at, place = np.nonzero(w)
        return pd.DataFrame({"b": drawn["b"].to_numpy()[at], name: units[name].to_numpy()[place], "_w": w[at, place]})

    drawn = plain_draws(names, [], replicates, seed).groupBy("block").cogroup(own.groupBy("block")).applyInPandas(count, f"b int, `{name}` {kind}, _w long")
    return drawn.groupBy("b", name).agg(F.sum("_w").alias(weight)) if names.count() > DRAWS else drawn.withColumnRenamed("_w", weight)


def two_way_ci(rows: DataFrame, rater: str, item: str, value: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """One row: mean, lo, hi where raters and items are both drawn; a cell weighs the product of its draws."""
    cells = settled(rows.groupBy(rater, item).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n")))
    axis = lambda name, salt: unit_weights(cells.select(name).distinct(), name, replicates, f"{seed}{salt}", f"w_{name}")
    # raters are summed away first: then a replicate has a row per item; both are large, so neither goes through the driver
    w = F.col(f"w_{rater}")
    each = cells.hint("merge").join(axis(rater, "r"), rater).groupBy("b", item).agg(F.sum(w * F.col("s")).alias("s"), F.sum(w * F.col("n")).alias("n"))
    w = F.col(f"w_{item}")
    reps = each.hint("merge").join(axis(item, "i"), ["b", item]).groupBy("b").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("n"))).alias("value"))
    point = cells.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return point.join(reps.agg(F.expr("percentile(value, 0.025)").alias("lo"), F.expr("percentile(value, 0.975)").alias("hi")))


def guess_pairs(guesses: DataFrame, by: list[str], unit: str, author: str, guess: str) -> DataFrame:
    """by, author, guess, w, units: weights of guesses, where a unit's sum to 1, and how many units these are, each counted once.

    A unit has one value of `by`. The sums of a coarser `by` are those of its parts.
    """
    within = Window.partitionBy(unit)
    sized = guesses.select(*by, unit, F.col(author).alias("author"), F.col(guess).alias("guess")).withColumns({"_k": 1.0 / F.count("*").over(within), "_one": (F.row_number().over(within.orderBy(unit)) == 1) & F.col(unit).isNotNull()})
    return sized.groupBy(*by, "author", "guess").agg(F.sum("_k").alias("w"), F.count_if("_one").alias("units"))


def null_of_pairs(pairs: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """by, observed, null_mean, lo, hi, p, reached_chance of `guess_pairs`; pairs are read several times."""
    names = pairs.select(*by, "author").distinct()
    base = placed(names, by, "author", "i").select(*by, "i", F.col("author").alias("_new"))
    reps = names.select(*by, "author", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    keyed = reps.withColumn("_key", hash_key(seed, F.col("b"), F.col("author")))
    perm = placed(keyed, [*by, "b"], "_key", "i", hash_part(F.col("_key"))).select(*by, "b", "author", "i")
    renamed = joined(perm, base, [*by, "i"]).filter(F.col("author").isNotNull()).select(*by, "b", "author", F.col("_new").alias("guess"))
    # an author's new name is one guess, so a replicate meets a pair for each author at most
    met = renamed.join(pairs.select(*by, "author", "guess", "w").filter("guess IS NOT NULL"), [*by, "author", "guess"], "left")
    hits = met.groupBy(*by, "b").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("hits"))
    totals = pairs.groupBy(*by).agg(F.sum("units").alias("n"), F.sum(F.when(F.col("author") == F.col("guess"), F.col("w")).otherwise(0.0)).alias("_right"))
    v = joined(hits, totals, by).select(*by, (F.col("hits") / F.col("n")).alias("v"), (F.col("_right") / F.col("n")).alias("observed"))
    out = v.groupBy(*by).agg(F.first("observed").alias("observed"), F.avg("v").alias("null_mean"), F.expr("percentile(v, 0.025)").alias("lo"), F.expr("percentile(v, 0.975)").alias("hi"), ((F.sum((F.round("v", 12) >= F.round("observed", 12)).cast("int")) + 1) / (replicates + 1)).alias("p"))
    return out.withColumn("reached_chance", F.col("observed").between(F.col("lo"), F.col("hi")))


def block_null(guesses: DataFrame, unit: str, author: str, guess: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """One row: observed, null_mean, lo, hi, p, reached_chance: accuracy when whole authors are renamed at random.

    A replicate's renaming is a permutation: authors in hash order take the names of authors in order. Guesses are read once.
    """
    return null_of_pairs(settled(guess_pairs(guesses, [], unit, author, guess)), [], replicates, seed)


def auc_replicates(rows: DataFrame, unit: str, replicates: int, seed: int | str, score: str = "score", label: str = "label") -> DataFrame:
    """b, auc: AUC with units drawn, from the exact win counts of each pair of units, never ranked again."""
    rows = rows.select(unit, F.col(score).alias("_score"), label)
    score = "_score"
    s = rows.groupBy(unit, score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    units = rows.select(F.col(unit).alias("u")).distinct()
    pos, neg = s.filter("p > 0").select(F.col(unit).alias("i"), F.col(score).alias("x"), "p"), s.filter("n > 0").select(F.col(unit).alias("j"), F.col(score).alias("y"), "n")
    # cumulative negatives of each unit at each positive's score, without pairing the rows: both sides in one sorted stream
    marks = pos.select("x").distinct()
    w = Window.partitionBy("j").orderBy("x", "kind")
    stream = neg.select("j", F.col("y").alias("x"), F.lit(1).alias("kind"), "n").unionByName(units.select(F.col("u").alias("j")).join(marks, how="cross").select("j", "x", F.lit(0).alias("kind"), F.lit(0.0).alias("n")))
    below = stream.withColumn("below", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).filter("kind = 0").select("j", "x", "below")
    equal = neg.select("j", F.col("y").alias("x"), F.col("n").alias("equal"))
    wins = pos.join(below.join(equal, ["j", "x"], "left").na.fill(0.0, ["equal"]), "x").groupBy("i", "j").agg(F.sum(F.col("p") * (F.col("below") + F.col("equal") / 2)).alias("win"))
    totals = s.groupBy(F.col(unit).alias("u")).agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    parts, levels = leaves(units, [], "u")
    d = settled(drawn_units(parts, [], levels, replicates, seed).groupBy("b", F.col("item.u").alias("u")).agg(F.count("*").alias("w")))
    top = d.select("b", F.col("u").alias("i"), F.col("w").alias("wi")).join(wins, "i").join(d.select(F.col("b").alias("b2"), F.col("u").alias("j"), F.col("w").alias("wj")), ["j"]).filter("b = b2").groupBy("b").agg(F.sum(F.col("wi") * F.col("wj") * F.col("win")).alias("top"))
    sizes = d.join(totals, "u").groupBy("b").agg(F.sum(F.col("w") * F.col("P")).alias("P"), F.sum(F.col("w") * F.col("N")).alias("N"))
    return top.join(sizes, "b").select("b", F.try_divide("top", F.col("P") * F.col("N")).alias("auc"))


def equivalence(estimates: DataFrame, delta: float = 0.1) -> DataFrame:
    """mean, lo, hi, se, p_lower, p_upper, mde, verdict of rows with mean (a difference), lo and hi: two one-sided tests within delta."""
    se = (F.col("hi") - F.col("lo")) / (2 * 1.96)
    out = estimates.withColumn("se", se).withColumns({"p_lower": 1 - normal_cdf((F.col("mean") + delta) / F.col("se")), "p_upper": normal_cdf((F.col("mean") - delta) / F.col("se")), "mde": 2.8 * F.col("se")})
    verdict = F.when(F.col("se") == 0, "degenerate").when(F.greatest("p_lower", "p_upper") < 0.05, "equivalent").when((F.col("lo") > 0) | (F.col("hi") < 0), "different").otherwise("inconclusive")
    return out.withColumn("verdict", verdict)

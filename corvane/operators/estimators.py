"""Estimators over scored and labelled rows; every variant has a name of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import choose, wilson
from corvane.operators.prefix import joined, prefix_sums, value_part, with_total
from corvane.sources.stores import settled


def auc(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """by, auc, n_pos, n_neg: Mann-Whitney, ties half; null where a group has one class only.

    Counted per distinct score, so rows are summed before any sort; negatives below are summed in two levels (`prefix`).
    """
    s = settled(rows.groupBy(*by, score).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_n")))
    won = prefix_sums(s, by, score, {"_below": F.col("_n")}, value_part(s, score)).groupBy(*by).agg(F.sum(F.col("_p") * (2 * F.col("_below") + F.col("_n"))).alias("_twice"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return won.select(*by, F.try_divide(F.col("_twice").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def stratified_auc(rows: DataFrame, strata: list[str], **names: str) -> DataFrame:
    """One row: AUC within strata, weighted by their pairs; and the plain mean over strata with both classes."""
    each = auc(rows, strata, **names)
    weight = (F.col("n_pos") * F.col("n_neg")).cast("double")
    return each.agg((F.sum(weight * F.col("auc")) / F.sum(weight)).alias("pair_weighted"), F.avg("auc").alias("mean_of_strata"))


def tpr_at_fpr(rows: DataFrame, by: list[str], fpr: float, score: str = "score", label: str = "label") -> DataFrame:
    """by, tpr_linear, tpr_higher, tpr_best.

    linear and higher: the share of positives above the negatives' quantile at 1 - fpr, interpolated or
    the next value up; best: the highest true rate among thresholds (score at least) within the false rate.
    """
    s = settled(rows.groupBy(*by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n")))
    part = value_part(s, score)
    neg = rows.filter(F.col(label) == 0)
    cum = prefix_sums(s.filter("n > 0"), by, score, {"below": F.col("n")}, part).withColumn("cum", F.col("below") + F.col("n"))
    place = F.ceil((F.col("all") - 1) * F.lit(1 - fpr) - 1e-9) + 1
    higher = with_total(cum, by, all=F.sum("n")).filter(F.col("cum") >= place).groupBy(*by).agg(F.min(score).alias("higher"))
    cuts = joined(neg.groupBy(*by).agg(F.expr(f"percentile({score}, {1 - fpr})").alias("linear")), higher, by)
    met = joined(rows.filter(F.col(label) == 1), cuts, by)
    first = met.groupBy(*by).agg(F.avg((F.col(score) > F.col("linear")).cast("double")).alias("tpr_linear"), F.avg((F.col(score) > F.col("higher")).cast("double")).alias("tpr_higher"))
    above = prefix_sums(s, by, score, {"_p": F.col("p"), "_n": F.col("n")}, part, descending=True)
    t = with_total(above, by, all_p=F.sum("p"), all_n=F.sum("n")).select(*by, ((F.col("_p") + F.col("p")) / F.col("all_p")).alias("t"), ((F.col("_n") + F.col("n")) / F.col("all_n")).alias("f"))
    best = t.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("f") <= fpr, F.col("t"))), F.lit(0.0)).alias("tpr_best"))
    return joined(first, best, by)


def tie_rate(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, tie_rate (share of rows whose score another row has), floor_mass (share at the lowest score)."""
    s = with_total(rows.groupBy(*by, score).agg(F.count("*").alias("_k")), by, _low=F.min(score))
    return s.groupBy(*by).agg((F.sum(F.when(F.col("_k") > 1, F.col("_k")).otherwise(0)) / F.sum("_k")).alias("tie_rate"), (F.sum(F.when(F.col(score) == F.col("_low"), F.col("_k")).otherwise(0)) / F.sum("_k")).alias("floor_mass"))


def rank_at_k(rows: DataFrame, by: list[str], k: int, score: str = "score", label: str = "label") -> DataFrame:
    """by, hit, precision: expected over random orders of tied scores that a positive is among the top k, and their share."""
    s = settled(rows.groupBy(*by, score).agg(F.sum(label).alias("_m"), F.count("*").alias("_g")))
    s = prefix_sums(s, by, score, {"_before": F.col("_g"), "_hits": F.col("_m")}, value_part(s, score), descending=True).filter(F.col("_before") < k)
    r = F.least(F.col("_g"), k - F.col("_before"))
    s = s.withColumns({"_mean": F.col("_m") * r / F.col("_g"), "_none": choose(F.col("_g") - F.col("_m"), r) / choose(F.col("_g"), r), "_r": r})
    return s.groupBy(*by).agg((1 - F.min(F.when(F.col("_m") > 0, F.col("_none")).otherwise(1.0))).alias("_last"), F.max(F.when((F.col("_m") > 0) & (F.col("_r") == F.col("_g")), 1.0).otherwise(0.0)).alias("_sure"), (F.sum("_mean") / F.sum("_r")).alias("precision")).select(*by, F.greatest("_last", "_sure").alias("hit"), "precision")


def hypergeometric_chance(n: Column, m: Column, k: int) -> Column:
    """Chance that k of n drawn at random hold at least one of m."""
    return 1 - choose(n - m, F.lit(k)) / choose(n, F.lit(k))


def adjusted(pvalues: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Rows with holm and bh, to four places; rows of one p get the same.

    Worked out per distinct p and in two levels (`prefix`): highest Holm and least BH terms per part of the order, then a window
    within a part. No frame reaches to the end of a group, as Spark would go through such a one anew for each row.
    """
    s = settled(pvalues.groupBy(*by, p).agg(F.count("*").alias("_c")))
    part = value_part(s, p)
    below = with_total(prefix_sums(s, by, p, {"_below": F.col("_c")}, part), by, _m=F.sum("_c"))
    value, last = F.col(p), F.col("_below") + F.col("_c")
    holm = F.greatest((F.col("_m") - F.col("_below")) * value, (F.col("_m") - last + 1) * value)
    bh = F.least(value * F.col("_m") / (F.col("_below") + 1), value * F.col("_m") / last)
    terms = settled(below.select(*by, p, part.alias("_part"), holm.alias("_h"), bh.alias("_b")))
    parts = terms.groupBy(*by, "_part").agg(F.max("_h").alias("h"), F.min("_b").alias("b"))
    lists = parts.groupBy(*by).agg(F.collect_list(F.struct("_part", "h", "b")).alias("_all"))  # a few hundred parts at most
    side = lambda test, name: F.transform(F.filter("_all", lambda x: test(x["_part"])), lambda x: x[name])
    own = F.col("_one._part")
    around = lists.select(*by, "_all", F.explode("_all").alias("_one")).select(*by, own.alias("_part"), F.array_max(side(lambda k: k < own, "h")).alias("_before"), F.array_min(side(lambda k: k > own, "b")).alias("_after"))
    within = lambda order: Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = terms.withColumns({"_h": F.max("_h").over(within(F.asc(p))), "_b": F.min("_b").over(within(F.desc(p)))})
    met = joined(run, around, [*by, "_part"])
    found = met.select(*by, p, F.round(F.least(F.lit(1.0), F.greatest("_h", "_before")), 4).alias("holm"), F.round(F.least(F.lit(1.0), F.least("_b", "_after")), 4).alias("bh"))
    return joined(pvalues, found, [*by, p])


def soft_accuracy(guesses: DataFrame, by: list[str], unit: str, guess: str, truth: str) -> DataFrame:
    """by, accuracy: mean over units of the share of right guesses; a null guess is wrong."""
    right = F.coalesce((F.col(guess) == F.col(truth)).cast("double"), F.lit(0.0))
    return guesses.groupBy(*by, unit).agg(F.avg(right).alias("u")).groupBy(*by).agg(F.avg("u").alias("accuracy"), F.count("*").alias("n_units"))


def variance_parts(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: mean, variance between units and within, and the half-width of a 95 % interval by units."""
    each = rows.groupBy(unit).agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.var_samp(value).alias("v"))
    return each.agg(F.avg("m").alias("mean"), F.var_samp("m").alias("between"), F.avg("v").alias("within"), (1.96 * F.sqrt(F.var_samp("m") / F.count("*"))).alias("half_width"))


def dispersion(rows: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """by, n_units, mean, sd of the units' means (population), and the sd that independent answers would give."""
    each = rows.groupBy(*by, unit).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    mean = F.sum(F.col("m") * F.col("n")) / F.sum("n")
    return each.groupBy(*by).agg(F.count("*").alias("n_units"), mean.alias("mean"), F.stddev_pop("m").alias("sd"), F.sqrt(mean * (1 - mean) * F.avg(1 / F.col("n"))).alias("binomial_sd"))


def dispersion_detail(rows: DataFrame, by: list[str], cluster: str, person: str, value: str) -> DataFrame:
    """by, n, mean, clusters, sd, least, most (of the clusters' means), binomial_sd, leaky_clusters, persons, all_right, none_right, leaky_persons.

    Leaky: Wilson's interval lies above one half.
    """

    def level(unit: str) -> DataFrame:
        each = rows.groupBy(*by, unit).agg(F.sum(value).alias("h"), F.count("*").alias("n"))
        return each.withColumns({"m": F.col("h") / F.col("n"), "leaky": wilson(F.col("h"), F.col("n"))[0] > 0.5})

    mean = F.sum("h") / F.sum("n")
    clusters = level(cluster).groupBy(*by).agg(F.sum("n").alias("n"), mean.alias("mean"), F.count("*").alias("clusters"), F.stddev_pop("m").alias("sd"), F.min("m").alias("least"), F.max("m").alias("most"), F.sqrt(mean * (1 - mean) / F.avg("n")).alias("binomial_sd"), F.count_if("leaky").alias("leaky_clusters"))
    persons = level(person).groupBy(*by).agg(F.count("*").alias("persons"), F.avg((F.col("m") == 1).cast("int")).alias("all_right"), F.avg((F.col("m") == 0).cast("int")).alias("none_right"), F.count_if("leaky").alias("leaky_persons"))
    return clusters.join(persons, by) if by else clusters.join(persons)


def trend(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares y = intercept + slope / x."""
    return rows.agg(F.regr_slope(y, 1 / F.col(x)).alias("slope"), F.regr_intercept(y, 1 / F.col(x)).alias("intercept"))

"""Forced choices between drafts: the items that judges get, with the probes that test the judges, and what the answers say.

A judge must choose A or B. Every pair is asked in both orders, by different judges, so that a liking for A cancels.
Probes ride on the first units: `self` (the same text twice) shows that liking; `pad` (one side longer by filler) and
`fmt` (one side without markup) must not sway the judge; `cut` (one side without some of its sentences) must. A judge that does
not notice the finest cut cannot vouch for a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.numeric import hash_key, hash_number
from corvane.operators import resampling as B

#: Sentences that say nothing, for the longer side of `pad`.
FILLER = [
    "It helps to keep the whole picture in mind here.", "Every case has its own details, of course.", "This is something to think about with some care.",
    "There is often more than one way to look at it.", "As always, the situation matters.", "These points deserve attention in their own right.",
    "A measured view is usually the better one.", "Much depends on what is wanted in the end.", "That said, the general idea stays the same.", "It is good to come back to this from time to time.",
]
CUTS = [0.1, 0.25, 0.5]
#: Normal quantiles: two-sided .05, power .80, one-sided .05 (fixed values).
Z_TWO, Z_POWER, Z_ONE = 1.959964, 0.841621, 1.644854


def padded(text: Column, factor: float = 1.25, filler: list[str] | None = None) -> Column:
    """The text with filler sentences until it is `factor` times as long (or the filler is used up)."""
    target = F.floor(F.length(text) * F.lit(factor))
    step = lambda t, f: F.when(F.length(t) < target, F.concat(t, F.lit(" "), f)).otherwise(t)
    return F.trim(F.aggregate(F.array(*[F.lit(f) for f in filler or FILLER]), text, step))


def without_sentences(text: Column, share: float, *salt: Column | str | int) -> Column:
    """The text without a share of its sentences (one at least), those with the least hashes; null if fewer than two would stay."""

    def cut(ss: Column) -> Column:
        k = F.greatest(F.lit(1), F.floor(share * F.size(ss) + 0.5).cast("int"))
        order = F.array_sort(F.transform(ss, lambda s, i: F.struct(hash_key("cut", *salt, i).alias("h"), i.alias("i"))))
        gone = F.transform(F.slice(order, F.lit(1), k), lambda x: x["i"])
        return T.let(gone, lambda g: F.when(F.size(ss) - k >= 2, F.array_join(F.filter(ss, lambda s, i: ~F.array_contains(g, i)), " ")))

    return T.let(T.sentences(text), cut)


def _batched(items: DataFrame, batches: int) -> DataFrame:
    """batch: all items of a pair by its hash, its second order half the batches on; a rebuild (`arm_r2`) one batch after its first build."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("unit", "kind", "x", "y", "p")]
    plain = [F.regexp_replace(p, r"_r\d+$", "") for p in parts]
    other = F.concat_ws("|", *plain) != F.concat_ws("|", *parts)
    second = F.when(F.coalesce(F.col("order"), F.lit(0)) == 1, batches // 2).otherwise(0)
    return items.withColumn("batch", ((hash_number(*plain) + other.cast("long")) % batches + second).cast("long") % batches)


def export(drafts: DataFrame, contrasts: list[tuple[str, str]], probe_arm: str, n_probes: int = 60, n_cut: int = 60, cuts: list[float] | None = None, batches: int = 0, most: int = 40, seed: int | str = 0) -> DataFrame:
    """pid, kind, unit, expert, cluster, x, y, p, order, a, b, batch, slot: the items of contrasts and probes.

    drafts: unit (a number from 0), expert, cluster, arm, text. a and b are the texts as shown. `batches` of 0: as many as hold
    `most` items each, two at least. `slot`: the item's place in its batch, in the order of hashes.
    """
    arm = lambda name: drafts.filter(F.col("arm") == name)
    orders = F.explode(F.array(F.lit(0), F.lit(1))).alias("order")
    head = ["unit", "expert", "cluster"]
    blank = F.lit(None).cast("string")

    def both(rows: DataFrame, kind: str, pid: Column, first: Column, second: Column, x: Column = blank, y: Column = blank, p: Column = F.lit(None).cast("double")) -> DataFrame:
        """Items in two orders; order 0 shows `first` as A."""
        wide = rows.select(*head, first.alias("f"), second.alias("s"), pid.alias("stem"), x.alias("x"), y.alias("y"), p.alias("p"), orders)
        even = F.col("order") == 0
        return wide.select(F.concat("stem", F.col("order").cast("string")).alias("pid"), F.lit(kind).alias("kind"), *head, "x", "y", "p", "order", F.when(even, F.col("f")).otherwise(F.col("s")).alias("a"), F.when(even, F.col("s")).otherwise(F.col("f")).alias("b"))

    parts = []
    for k, (x, y) in enumerate(contrasts):
        met = arm(x).join(arm(y).select("unit", F.col("text").alias("other")), "unit")
        parts.append(both(met, "contrast", F.format_string(f"C{k}%03d", "unit"), F.col("text"), F.col("other"), F.lit(x), F.lit(y)))
    probes = arm(probe_arm).filter(F.col("unit") < n_probes)
    same = probes.select(F.format_string("S%03d0", "unit").alias("pid"), F.lit("self").alias("kind"), *head, blank.alias("x"), blank.alias("y"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("int").alias("order"), F.col("text").alias("a"), F.col("text").alias("b"))
    parts.append(same)
    parts.append(both(probes, "pad", F.format_string("P%03d", "unit"), padded(F.col("text")), F.col("text")))
    parts.append(both(probes, "fmt", F.format_string("F%03d", "unit"), F.col("text"), T.strip_markdown(F.col("text"))))
    plain = arm(probe_arm).filter(F.col("unit") < n_cut).withColumn("text", T.strip_numbering(F.col("text")))
    for j, share in enumerate(cuts or CUTS):
        shorter = plain.withColumn("_cut", without_sentences(F.col("text"), share, seed, F.col("unit"), j)).filter("_cut IS NOT NULL")
        parts.append(both(shorter, "cut", F.format_string(f"X{j}%03d", "unit"), F.col("text"), F.col("_cut"), p=F.lit(float(share))))
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    n = batches or max(2, -(-items.count() // most))
    if n < 2:
        raise ValueError("two orders of a pair need two batches")
    from pyspark.sql import Window

    dealt = _batched(items, n)
    return dealt.withColumn("slot", F.row_number().over(Window.partitionBy("batch").orderBy(hash_key("slot", seed, F.col("pid")), "pid")) - 1)


def answered(items: DataFrame, picks: DataFrame) -> DataFrame:
    """Items with rep, choice and win (of the full, longer, richer or first text); items without any answer are an error.

    picks: pid, rep, choice; choices other than A and B and unknown pids do not count, a judge's last answer does not either if it is repeated.
    """
    good = picks.withColumn("choice", F.upper(F.substring(F.trim("choice"), 1, 1))).filter(F.col("choice").isin("A", "B")).dropDuplicates(["pid", "rep"])
    holes = items.join(good.select("pid").distinct(), "pid", "left_anti").count()
    if holes:
        raise ValueError(f"{holes} items have no answer")
    meta = items.drop("a", "b", "batch", "slot")
    win = F.when(F.col("kind") == "self", F.col("choice") == "A").otherwise((F.col("choice") == "A") == (F.coalesce(F.col("order"), F.lit(0)) == 0))
    return meta.join(good.select("pid", "rep", "choice"), "pid").withColumn("win", win.cast("double"))


def battery(answers: DataFrame, replicates: int = 2000, seed: int | str = 0) -> DataFrame:
    """probe (self, pad, fmt, cut@share), rate, lo, hi, n, ok: what the probes say of the judges; intervals draw experts.

    ok: pad is not above one half, fmt's interval holds one half, a cut's lies above it; of self it is null, for a forced choice
    between equal texts has to fall somewhere.
    """
    rows = answers.filter("kind <> 'contrast'").withColumn("probe", F.when(F.col("kind") == "cut", F.concat(F.lit("cut@"), F.col("p").cast("string"))).otherwise(F.col("kind")))
    units = rows.groupBy("probe", "unit", "expert").agg(F.avg("win").alias("v"))
    ci = B.cluster_ci(units, ["probe"], "expert", "v", replicates, seed).select("probe", F.col("mean").alias("rate"), "lo", "hi")
    ok = F.when(F.col("probe") == "pad", ~(F.col("lo") > 0.5)).when(F.col("probe") == "fmt", (F.col("lo") <= 0.5) & (F.col("hi") >= 0.5)).when(F.col("probe").startswith("cut@"), F.col("lo") > 0.5)
    return ci.join(units.groupBy("probe").agg(F.count("*").alias("n")), "probe").withColumn("ok", ok)


def battery_verdict(probes: DataFrame) -> DataFrame:
    """One row: position (the rate of A between equal texts), smallest_cut (noticed), finest_cut (tested), passed."""
    share = F.when(F.col("probe").startswith("cut@"), F.substring_index("probe", "@", -1).cast("double"))
    out = probes.withColumn("share", share).agg(
        F.max(F.when(F.col("probe") == "self", F.col("rate"))).alias("position"),
        F.min(F.when(F.col("ok"), F.col("share"))).alias("smallest_cut"),
        F.min("share").alias("finest_cut"),
        F.coalesce(F.bool_and(F.when(F.col("probe").isin("pad", "fmt"), F.col("ok"))), F.lit(True)).alias("fair"),
    )
    return out.select("position", "smallest_cut", "finest_cut", (F.col("fair") & F.coalesce(F.col("smallest_cut") <= F.col("finest_cut") + 1e-9, F.lit(False))).alias("passed"))


def contrast_verdicts(answers: DataFrame, pooled: list[str], passed: bool, delta: float = 0.1, replicates: int = 2000, seed: int | str = 0) -> DataFrame:
    """x, y, win, lo, hi, mde, agreement, sd, n_units, n_clusters, clustered_by, verdict of each contrast.

    A contrast with a pooled arm draws clusters, for their members share a card; others draw experts. agreement: how often the
    same arm wins in both orders (of the last judge). Without a `passed` battery there is no tie.
    """
    rows = answers.filter("kind = 'contrast'").withColumn("shared", F.col("x").isin(pooled) | F.col("y").isin(pooled))
    units = rows.groupBy("x", "y", "shared", "unit", F.when(F.col("shared"), F.col("cluster")).otherwise(F.col("expert")).cast("string").alias("g")).agg(F.avg("win").alias("v"))
    ci = B.cluster_ci(units, ["x", "y"], "g", "v", replicates, seed).select("x", "y", F.col("mean").alias("win"), "lo", "hi")
    size = units.groupBy("x", "y", "shared").agg(F.count("*").alias("n_units"), F.count_distinct("g").alias("n_clusters"), F.stddev_samp("v").alias("sd"))
    last = rows.groupBy("x", "y", "unit", "order").agg(F.max_by("win", "rep").alias("w"))
    agreement = last.groupBy("x", "y", "unit").agg(F.count("*").alias("k"), F.min("w").alias("a"), F.max("w").alias("b")).filter("k = 2").groupBy("x", "y").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))
    out = ci.join(size, ["x", "y"]).join(agreement, ["x", "y"], "left")
    se = (F.col("hi") - F.col("lo")) / (2 * Z_TWO)
    out = out.withColumn("se", se).withColumn("mde", (Z_TWO + Z_POWER) * F.col("se"))
    equal = (F.col("win") - Z_ONE * F.col("se") > 0.5 - delta) & (F.col("win") + Z_ONE * F.col("se") < 0.5 + delta)
    powered = F.col("mde") < delta
    differs = (F.col("lo") > 0.5) | (F.col("hi") < 0.5)
    verdict = F.when(differs & (F.col("win") > 0.5), "x better").when(differs, "y better").when(F.lit(not passed), "no verdict").when(equal & powered, "tie").when(~powered, "underpowered").otherwise("inconclusive")
    return out.select("x", "y", "win", "lo", "hi", "mde", "agreement", "sd", "n_units", "n_clusters", F.when(F.col("shared"), "cluster").otherwise("expert").alias("clustered_by"), verdict.alias("verdict"))


def units_needed(contrasts: DataFrame, effects: list[float]) -> DataFrame:
    """effect, units: how many units would show an effect at the contrasts' mean deviation per unit."""
    sd = contrasts.agg(F.avg("sd").alias("sd"))
    each = sd.select("sd", F.explode(F.array(*[F.lit(e) for e in effects])).alias("effect"))
    return each.select("effect", F.round(F.pow((Z_TWO + Z_POWER) * F.col("sd") / F.col("effect"), 2)).cast("long").alias("units"))


def score(spark: SparkSession, items: DataFrame, picks: DataFrame, pooled: list[str], delta: float = 0.1, replicates: int = 2000, seed: int | str = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(battery, its verdict, contrasts) of one export's answers."""
    answers = answered(items, picks)
    probes = battery(answers, replicates, seed)
    verdict = battery_verdict(probes)
    passed = bool(verdict.first()["passed"])  # one row
    return probes, verdict, contrast_verdicts(answers, pooled, passed, delta, replicates, seed)

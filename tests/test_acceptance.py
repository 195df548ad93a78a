"""Release verdicts: floors, additive builds, gates, ablations, partitions; what must abort does."""

import pytest
from corvane.plans import acceptance as A
from pyspark.sql import functions as F


def test_floor(spark):
    rows = [(f"a{k}", f"{chr(97 + k) * 9} shared words here") for k in range(8)]
    df = spark.createDataFrame(rows, "author string, text string")
    own = A.floor_sweep(df, df, 4, 3).first()
    assert (own.chance, own.mean, own.least, own.most, own.above, own.seeds, own.verdict) == (0.25, 1.0, 1.0, 1.0, 3, 3, "above chance on all seeds")
    turned = df.select(F.concat(F.lit("a"), ((F.substring("author", 2, 1).cast("int") + 1) % 8).cast("string")).alias("author"), "text")
    assert A.floor_sweep(df, turned, 8, 2).first().verdict == "not above chance on any seed"


def test_additive_only(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    more = old.unionByName(spark.createDataFrame([(4, "d")], "k int, v string"))
    assert tuple(A.additive_only(old, more, ["k"], "v").first()) == (3, 0, 0, 1, True)
    worse = more.filter("k <> 1").withColumn("v", F.when(F.col("k") == 2, "b").otherwise(F.col("v")))
    assert tuple(A.additive_only(old, worse, ["k"], "v").first()) == (3, 1, 1, 1, False)
    assert tuple(A.additive_only(old.limit(0), old.limit(0), ["k"], "v").first()) == (0, 0, 0, 0, True)


def test_drop_gate_and_power(spark):
    cells = spark.createDataFrame([(4, 0, 1, 100), (4, 0, 2, 100), (8, 0, 0, 50), (16, 0, 60, 100), (12, 0, 0, 0)], "k int, seed int, n_dropped long, n_content long")
    gated = A.drop_gate(cells, ["k", "seed"], 0.1)
    got = {r.k: (r.cards, r.passed) for r in gated.collect()}
    assert got == {4: (2, True), 8: (1, True), 16: (1, False), 12: (1, True)}
    p = A.achieved_power(gated, "k", 0.3).first()
    mean = (4 * 2 + 8 + 12) / 4
    sxx = 2 * (4 - mean) ** 2 + (8 - mean) ** 2 + (12 - mean) ** 2
    assert p.cards == 4 and p.sxx == pytest.approx(sxx) and p.mde == pytest.approx(2.8 * 0.3 * 8 / sxx**0.5)


def answers(spark, shift):
    rows = [("indiv", f"c{k % 6}", k, f"u{k % 5}", 1.0, 0.2) for k in range(30)]
    for k in range(30):
        rows.append(("ne", f"c{k % 6}", k, f"u{k % 5}", float(k % 2), 0.2))
        rows.append(("v6", f"c{k % 6}", k, f"u{k % 5}", float(k % 2) * (1 - shift), 0.2))
    return spark.createDataFrame(rows, "arm string, card string, bracket int, unit string, hit double, chance double")


def test_ablation(spark):
    same = A.ablation_verdict(answers(spark, 0.0), "indiv", "v6", "ne", 100).first()
    assert same.control_clears and not same.detected and not same.passed and same.diff == 0 and same.pairs == 30 and same.cards == 6
    less = A.ablation_verdict(answers(spark, 0.9).filter("bracket % 2 = 1"), "indiv", "v6", "ne", 100).first()
    assert less.detected and less.passed and less.hi < 0
    with pytest.raises(ValueError, match="no answer"):
        A.ablation_verdict(answers(spark, 0.0).withColumn("hit", F.when(F.col("bracket") != 3, F.col("hit"))), "indiv", "v6", "ne", 5)
    with pytest.raises(ValueError, match="brackets differ"):
        A.ablation_verdict(answers(spark, 0.0).filter("NOT (arm = 'ne' AND bracket = 3)"), "indiv", "v6", "ne", 5)


def test_partitions_abort_on_holes(spark):
    df = spark.createDataFrame([(p, f"u{k}", 0.5) for p in range(3) for k in range(4)], "p int, u string, v double")
    r = A.partition_marginal(df, "p", "u", "v", 0.6, 50).first()
    assert (r.persons, r.partitions, r["mean"], r.clear) == (4, 3, 0.5, True)
    with pytest.raises(ValueError, match="1 persons"):
        A.partition_marginal(df.filter("NOT (p = 1 AND u = 'u2')"), "p", "u", "v", 0.6, 5)


def test_exposed_wording(spark):
    members = spark.createDataFrame([(0, "a", [1.0, 0.0]), (0, "b", [0.0, 1.0]), (0, "c", [0.6, 0.8])], "cluster int, owner string, vec array<double>")
    lines = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.7071, 0.7071]), (0, 3, [-1.0, 0.0])], "cluster int, item int, vec array<double>")
    got = {r.item: (r.near_owners, r.exposed) for r in A.exposed_wording(lines, members).collect()}
    assert got == {1: (2, False), 2: (3, False), 3: (0, False)}
    assert {r.item: r.exposed for r in A.exposed_wording(lines, members.filter("owner <> 'c'")).collect()} == {1: True, 2: False, 3: False}


def test_char_gram_counts(spark):
    from corvane.functions import text as T
    from corvane.plans import acceptance
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "The  the\nthe"), ("a", "Ünder the"), ("b", "abc"), ("b", None), (None, "abcd")], "author string, text string").repartition(2)
    got = acceptance.char_gram_counts(df, "author", 4).groupBy("author", "gram").agg(F.sum("tf"))
    want = df.select("author", F.explode(T.char_grams(F.col("text"), 4)).alias("gram")).groupBy("author", "gram").agg(F.count("*"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

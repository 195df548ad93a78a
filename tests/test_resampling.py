"""The tree of leaves behind the bootstrap: binomials, draws and numbering."""

import hashlib
import math
import random

import numpy as np
import pytest
from corvane.operators import prefix as X
from corvane.operators import resampling as B
from pyspark.sql import functions as F


@pytest.mark.parametrize("n, p", [(1, 0.3), (7, 0.5), (60, 0.02), (500, 0.9)])
def test_binomial_quantile(n, p):
    chances = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    cdf = np.cumsum(chances)
    for u in (0.001, 0.2, 0.49, 0.77, 0.999):
        assert B.binomial_quantile(n, p, u) == int((cdf <= u).sum())


def test_binomials_of_very_many_draws_have_the_right_moments():
    rng = random.Random(1)
    n, p = 10**9, 0.37
    z = [(B.binomial_quantile(n, p, rng.random()) - n * p) / math.sqrt(n * p * (1 - p)) for _ in range(300)]
    assert abs(np.mean(z)) < 0.25 and 0.85 < np.std(z) < 1.15


def test_split_draws_keep_their_sum_and_shares():
    counts = np.array([100, 0, 300, 50, 0, 0, 25, 25])
    rng = random.Random(2)
    drawn = np.array([B.split_draws(counts, 500, lambda node: rng.random()) for _ in range(400)])
    assert (drawn.sum(axis=1) == 500).all() and (drawn[:, counts == 0] == 0).all()
    assert np.allclose(drawn.mean(axis=0), counts, atol=5)


def plain(values, replicates, seed, levels):
    """The draws of `cluster_ci` in Python: values by unit."""
    size = 1 << levels
    leaf = lambda u: int(hashlib.sha1(f"leaf|{u}".encode()).hexdigest()[:8], 16) % size if levels else 0
    own = [[values[u] for u in sorted(values) if leaf(u) == k] for k in range(size)]
    out = []
    for b in range(replicates):
        uniform = lambda node: int(hashlib.sha1(f"{seed}|{b}|{node}".encode()).hexdigest()[:13], 16) / 2.0**52  # noqa: E731, B023
        drawn = B.split_draws(np.array([len(x) for x in own]), len(values), uniform) if levels else [len(values)]
        picked = []
        for k, d in enumerate(drawn):
            node = f"{k + size}|" if levels else ""
            picked += [own[k][int(hashlib.sha1(f"{seed}|{b}|{node}{j}".encode()).hexdigest()[:8], 16) % len(own[k])] for j in range(d)]
        out.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
    return out


@pytest.mark.parametrize("leaf", [4096, 20])
def test_replicates_are_those_of_a_plain_version(spark, monkeypatch, leaf):
    monkeypatch.setattr(B, "LEAF", leaf)
    rng = random.Random(3)
    rows = [(g, f"u{rng.randrange(200)}", rng.random()) for g in ("a", "a", "a", "b") for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    parts, levels = B.leaves(B.unit_sums(df, ["g"], "u", "v"), ["g"], "u", "s", "n")
    assert (levels > 0) == (leaf == 20)
    got = {(r.g, r.b): r.value for r in B.replicates_of(parts, ["g"], levels, 40, "x").collect()}
    for g in "ab":
        values = {}
        for h, u, v in rows:
            if h == g:
                s, n = values.get(u, (0.0, 0))
                values[u] = (s + v, n + 1)
        want = plain(values, 40, "x", levels)
        assert [got[g, b] for b in range(40)] == pytest.approx(want)


def test_no_leaf_is_much_larger_than_the_others(spark, monkeypatch):
    monkeypatch.setattr(B, "LEAF", 500)
    units = spark.range(20_000).select(F.col("id").alias("u"), F.lit("one").alias("g"), F.lit(1.0).alias("s"), F.lit(1).alias("n"))
    parts, levels = B.leaves(units, ["g"], "u", "s", "n")
    sizes = [r[0] for r in parts.select(F.size("items")).collect()]
    assert levels == 6 and sum(sizes) == 20_000 and max(sizes) < 1.5 * 20_000 / 64
    plan = B.replicates_of(parts, ["g"], levels, 3, 0)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("cuts", [256, 4])
def test_numbering_in_two_levels(spark, monkeypatch, cuts):
    monkeypatch.setattr(X, "CUTS", cuts)
    rng = random.Random(4)
    rows = [(g, w) for g in "xy" for w in rng.sample([*map(str, range(400)), None], 150)]
    df = spark.createDataFrame(rows, "g string, w string").repartition(4)
    got = {(r.g, r.w): r.i for r in X.placed(df, ["g"], "w", "i").collect()}
    want = {(g, w): k + 1 for g in "xy" for k, w in enumerate(sorted((w for h, w in rows if h == g), key=lambda w: (w is not None, w or "")))}
    assert got == want
    alone = X.placed(df.select("w").filter("w IS NOT NULL").distinct(), [], "w", "i").collect()
    assert [r.w for r in sorted(alone, key=lambda r: r.i)] == sorted({w for _, w in rows if w is not None})


def test_prefix_sums_of_null_groups_and_both_ways(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", None]), k, rng.randrange(9)) for k in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(3)
    for down in (False, True):
        got = {r.k: r.s for r in X.prefix_sums(df, ["g"], "k", {"s": F.col("v")}, X.value_part(df, "k", 7), down).collect()}
        assert got == {k: sum(v for h, j, v in rows if h == g and (j > k if down else j < k)) for g, k, _ in rows}


@pytest.mark.parametrize("equal", [False, True])
def test_plain_draws_in_blocks(spark, monkeypatch, equal):
    monkeypatch.setattr(B, "LEAF", 16)
    monkeypatch.setattr(B, "DRAWS", 50)
    rng = random.Random(7)
    rows = [(g, rng.randrange(130), rng.random()) for g in ("a", None) for _ in range(400)] + [("a", None, 0.5)]
    df = spark.createDataFrame(rows, "g string, u int, v double").repartition(3)
    units = B.unit_sums(df, ["g"], "u", "v")
    got = {(r.g, r.b): r.value for r in B.plain_replicates(units, ["g"], "u", 9, "x", equal).collect()}
    for g in ("a", None):
        values = {}
        for h, u, v in rows:
            if h == g:
                s, n = values.get(u, (0.0, 0))
                values[u] = (s + v, n + 1)
        own = [values[u] for u in sorted(values, key=lambda u: (u is None, u or 0))]
        for b in range(9):
            picked = [own[int(hashlib.sha1(f"x|{b}|{j}".encode()).hexdigest()[:8], 16) % len(own)] for j in range(len(own))]
            want = sum(s / n for s, n in picked) / len(own) if equal else sum(s for s, _ in picked) / sum(n for _, n in picked)
            assert got[g, b] == pytest.approx(want)


def test_intervals_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.randrange(60), rng.randrange(7), rng.random()) for _ in range(500)], "u int, i int, v double")
    once = lambda: (B.cluster_ci(df, [], "u", "v", 20, 3).first(), B.two_way_ci(df, "u", "i", "v", 20, 3).first())
    whole = once()
    monkeypatch.setattr(B, "LEAF", 5)
    for a, b in zip(whole, once()):
        assert list(a) == pytest.approx(list(b))

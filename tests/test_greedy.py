"""Greedy choices in blocks and rounds against plain passes over whole groups."""

import random

import numpy as np
import pytest
from corvane.operators import greedy as G
from corvane.operators import pairing as P
from pyspark.sql import functions as F


def caliper(rows, width):
    """rows (group, side, item, score); the plain order of decisions."""
    out = []
    for g in sorted({r[0] for r in rows}):
        used = set()
        neg = sorted((s, i) for h, side, i, s in rows if h == g and not side and s is not None)
        for score, item in sorted((s, i) for h, side, i, s in rows if h == g and side and s is not None):
            free = [(abs(s - score), s, i) for s, i in neg if i not in used]
            if free and min(free)[0] <= width:
                used.add(min(free)[2])
                out.append((g, item, min(free)[2]))
    return sorted(out)


def scored(seed, n, groups, grid):
    rng = random.Random(seed)
    rows = [(rng.choice(groups), rng.randrange(2), i, rng.choice([rng.randrange(grid) / grid, None]) if rng.random() < 0.05 else rng.randrange(grid) / grid) for i in range(n)]
    return rows


@pytest.mark.parametrize("block, grid", [(50_000, 1024), (60, 1024), (9, 1024), (25, 16)])
def test_caliper_match_in_blocks(spark, block, grid):
    # one group has most rows, and scores tie
    rows = scored(block, 400, ["hot"] * 8 + ["a", "b"], grid)
    df = spark.createDataFrame(rows, "g string, side int, i long, s double").repartition(5)
    got = P.caliper_match(df.filter("side = 1"), df.filter("side = 0"), "g", "s", "i", 0.03125, block)
    assert sorted(map(tuple, got.select("g", "i", "match").collect())) == caliper(rows, 0.03125)


def batches(rows, size):
    out = []
    for g in sorted({r[0] for r in rows}):
        cards, count = [], []
        for _, item, a, b in sorted(r for r in rows if r[0] == g):
            k = next((k for k in range(len(cards)) if count[k] < size and not {a, b} & cards[k]), len(cards))
            if k == len(cards):
                cards.append(set())
                count.append(0)
            cards[k] |= {a, b}
            count[k] += 1
            out.append((g, item, k))
    return sorted(out)


@pytest.mark.parametrize("block, size", [(50_000, 4), (37, 3), (11, 5)])
def test_disjoint_batches_in_blocks(spark, block, size):
    rng = random.Random(block)
    card = lambda: rng.choice([0, 0, 0, *range(12)])
    rows = [(rng.choice(["hot", "hot", "hot", "x"]), i, card(), card()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, a int, b int").repartition(5)
    got = P.disjoint_batches(df, "g", "i", "a", "b", size, block)
    assert sorted(map(tuple, got.select("g", "i", "batch").collect())) == batches(rows, size)


@pytest.mark.parametrize("last", [0, 5, 20_000])
def test_rounds_give_the_pass_in_order(spark, last):
    rng = random.Random(last)
    pairs = {(g, *sorted(rng.sample(range(60), 2))) for g in "hhhx" for _ in range(150)}
    pairs |= {("chain", k, k + 1) for k in range(9)}
    want = set()
    for g in "hx", "chain":
        for h in g if g == "hx" else [g]:
            gone = set()
            for x, a, b in sorted(pairs, key=lambda p: (p[2], p[1])):
                if x == h and a not in gone:
                    gone.add(b)
            want |= {(h, b) for b in gone}
    df = spark.createDataFrame(sorted(pairs), "g string, first int, second int")
    got = G.kept_in_order(df, "g", last)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("block", [1_000, 7])
def test_near_vectors_are_dropped_in_order(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(12, 4))
    x = np.concatenate([base[rng.integers(0, 12, 80)] + 0.2 * rng.normal(size=(80, 4)), np.zeros((2, 4))])
    groups = ["hot" if k % 4 else "cold" for k in range(len(x))]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = []
    for g in ("hot", "cold"):
        kept = []
        for k in sorted((k for k in range(len(x)) if groups[k] == g), key=lambda k: (-(k % 5), k)):
            if all(unit[k] @ unit[j] < 0.8 for j in kept):
                kept.append(k)
        want += kept
    df = spark.createDataFrame([(groups[k], k, x[k].tolist()) for k in range(len(x))], "g string, i long, vec array<double>")
    pairs = G.near_pairs(df, "g", "i", (-(F.col("i") % 5)).cast("double"), "vec", 0.8, block)
    gone = {r["item"] for r in G.kept_in_order(pairs, "g").collect()}
    assert sorted(set(range(len(x))) - gone) == sorted(want)
    assert sorted(r.i for r in P.drop_near_vectors(df, "g", "i", -(F.col("i") % 5)).collect()) == sorted(want)


def test_nothing(spark):
    df = spark.createDataFrame([], "g string, i long, s double, a int, b int")
    assert P.caliper_match(df, df, "g", "s", "i").count() == 0 and P.disjoint_batches(df, "g", "i", "a", "b", 3).count() == 0
    assert G.kept_in_order(spark.createDataFrame([], "g string, first int, second int"), "g").count() == 0


@pytest.mark.parametrize("room, last", [(2 << 20, 20_000), (2_000, 0)])
def test_near_sets_in_blocks(spark, monkeypatch, room, last):
    # templates with copies and small changes, sizes from 1 to 300, subjects for some
    rng, rows = random.Random(room), []
    bases = [[f"{k}w{j}" for j in range(size)] for k, size in enumerate([1, 2, 3, 5, 8, 40, 90, 130, 300])]
    for i in range(400):
        w = [x for x in rng.choice(bases) if rng.random() < rng.choice([0.4, 0.7, 1.0])] + [f"x{rng.randrange(900)}" for _ in range(rng.randrange(4))]
        rows.append((rng.choice(["a", "a", "b"]), i, " ".join(w), rng.choice(["s", "t", None])))
    monkeypatch.setattr(G.near_set_candidates, "__defaults__", (room,))
    monkeypatch.setattr(G.kept_in_order, "__defaults__", (last, None))
    df = spark.createDataFrame(rows, "g string, i long, t string, s string").repartition(5)
    for subject in (None, "s"):
        kept = {}
        for g, i, t, s in rows:
            own = set(t.split())
            near = lambda w, o: len(own & w) > (0.3 if subject and s and s == o else 0.5) * len(own | w)
            if own and not any(near(w, o) for _, w, o in kept.get(g, [])):
                kept.setdefault(g, []).append((i, own, s))
        got = P.drop_near_sets(df, "g", "i", F.filter(F.split("t", " "), lambda x: x != ""), subject)
        assert sorted(map(tuple, got.select("g", "i").collect())) == sorted((g, i) for g, found in kept.items() for i, _, _ in found)


def test_copies_of_sets_are_no_pairs(spark, monkeypatch):
    seen = []
    real = G.near_set_candidates
    monkeypatch.setattr(P, "near_set_candidates", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.range(300).select(F.lit("g").alias("g"), "id", F.lit("one two three four").alias("t"))
    assert [r.id for r in P.drop_near_sets(df, "g", "id", F.split("t", " ")).collect()] == [0]
    assert seen[0].count() == 0

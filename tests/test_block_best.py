"""Best products by blocks, beside all pairs."""

import random

import pytest
from corvane.operators import pairing as P


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(9)
    rows = []
    for i in range(90):
        vec = [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]
        vec = None if i % 17 == 3 else [1.0, None, 2.0] if i % 19 == 4 else vec[:2] if i % 13 == 5 else vec
        rows.append((None if i == 40 else i % 2, i, None if i % 23 == 6 else f"o{i % 4}", vec))
    return rows, spark.createDataFrame(rows, "cluster int, item int, owner string, vec array<float>").repartition(3)


def product(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    return sum(a * b for a, b in zip(x, y))


@pytest.mark.parametrize("block", [2_000, 7])
def test_best_of_all_pairs(vectors, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "ROWS", 5)
    rows, df = vectors
    want = {}
    for c, i, o, v in rows:
        for d, _, p, w in rows:
            if c is not None and c == d and o is not None and p is not None and o != p:
                want.setdefault((c, i, o, p), []).append(product(v, w))
    want = {k: max((x for x in v if x is not None), default=None) for k, v in want.items()}
    assert {(r.cluster, r.item, r.owner, r.other): r.best for r in P.best_match(df, df, "cluster", "owner", "item").collect()} == want


def test_ties_take_the_least_item_and_pairs_are_no_rows(vectors, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    rows, df = vectors
    got = {}
    for r in P.block_best(df, df.withColumnRenamed("item", "j"), "cluster", ["item"], "owner", take=["j"]).collect():
        if r.best is not None:
            got[r.item] = max(got.get(r.item, (-99, 0)), (r.best, -r.j))
    for c, i, _, v in rows:
        found = [(x, -j) for d, j, _, w in rows if c is not None and c == d and (x := product(v, w)) is not None]
        assert got.get(i) == max(found, default=None)

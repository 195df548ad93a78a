"""Forced choices: items and probes, batches, and the verdicts on answers, beside plain versions."""

import re

import numpy as np
import pytest
from corvane.plans import forced_choice as C
from pyspark.sql import functions as F

TEXT = "One thing is **true**. Two things are not. 3. Three is a number. Four is even. Five is odd. Six ends it."


@pytest.fixture(scope="module")
def drafts(spark):
    rows = [(u, f"e{u % 4}", f"c{u % 2}", arm, f"{arm} {u} " + TEXT) for u in range(12) for arm in ("in", "ne", "tpar", "tpar_r2")] + [(12, "e0", "c0", arm, "Too short.") for arm in ("in", "ne")]
    return spark.createDataFrame(rows, "unit int, expert string, cluster string, arm string, text string")


@pytest.fixture(scope="module")
def items(spark, drafts):
    return C.export(drafts, [("ne", "in"), ("ne", "tpar"), ("ne", "tpar_r2")], "in", n_probes=5, n_cut=13, cuts=[0.2, 0.5], batches=5, seed=3).cache()


def test_items(items):
    rows = {r.pid: r for r in items.collect()}
    assert len(rows) == items.count()
    kinds = {}
    for r in rows.values():
        kinds[r.kind] = kinds.get(r.kind, 0) + 1
    assert kinds == {"contrast": 2 * (13 + 12 + 12), "self": 5, "pad": 10, "fmt": 10, "cut": 2 * 12 * 2}
    assert rows["C00030"].a.startswith("ne 3") and rows["C00031"].b.startswith("ne 3") and rows["S0020"].a == rows["S0020"].b
    assert len(rows["P0010"].a) >= len(rows["P0010"].b) * 1.25 - 1 and rows["P0010"].a.startswith(rows["P0010"].b) and rows["P0011"].b == rows["P0010"].a
    assert "**" in rows["F0000"].a and "**" not in rows["F0000"].b
    full, cut = rows["X10040"].a, rows["X10040"].b
    assert "3." not in full and len(re.split(r"(?<=[.!?])\s+", full)) - len(re.split(r"(?<=[.!?])\s+", cut)) == 3
    assert all(s in full for s in cut.split(". ")[:-1])
    for stem in {p[:-1] for p, r in rows.items() if r.kind != "self"}:
        assert rows[stem + "0"].batch != rows[stem + "1"].batch
    assert all(rows[f"C1{u:03d}{o}"].batch != rows[f"C2{u:03d}{o}"].batch for u in range(12) for o in (0, 1))
    slots = {}
    for r in rows.values():
        slots.setdefault(r.batch, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def picks(spark, items, judge):
    return spark.createDataFrame([(r.pid, rep, judge(r, rep)) for r in items.drop("a", "b").collect() for rep in ("r1", "r2")], "pid string, rep string, choice string")


def target(r, yes):
    return "A" if (r.order or 0) == (0 if yes else 1) else "B"


def good(r, rep):
    if r.kind == "self":
        return "a"
    if r.kind == "cut":
        return target(r, True)
    if r.kind in ("pad", "fmt"):
        return target(r, False) if r.kind == "pad" else "A"
    return target(r, r.y == "in") if r.y != "tpar" else "A"


def test_a_good_judge(spark, items):
    probes, verdict, found = C.score(spark, items, picks(spark, items, good), ["ne"], replicates=200)
    p = {r.probe: r for r in probes.collect()}
    assert p["self"].rate == 1.0 and p["self"].ok is None and p["pad"].ok and p["fmt"].ok and p["cut@0.2"].ok and p["cut@0.5"].rate == 1.0 and p["cut@0.2"].n == 12
    v = verdict.first()
    assert v.passed and v.position == 1.0 and v.smallest_cut == v.finest_cut == 0.2
    c = {r.y: r for r in found.collect()}
    assert c["in"].verdict == "x better" and c["in"].win == 1.0 and c["in"].agreement == 1.0 and c["in"].n_units == 13 and c["in"].n_clusters == 2 and c["in"].clustered_by == "cluster"
    assert c["tpar"].verdict == "tie" and c["tpar"].agreement == 0.0 and c["tpar_r2"].verdict == "y better"
    needed = {r.effect: r.units for r in C.units_needed(found, [0.1]).collect()}
    sd = np.mean([r.sd for r in c.values()])
    assert needed[0.1] == round(((C.Z_TWO + C.Z_POWER) * sd / 0.1) ** 2)


def test_a_blind_judge_gives_no_ties(spark, items):
    _, verdict, found = C.score(spark, items, picks(spark, items, lambda r, rep: "A"), [], replicates=100)
    assert not verdict.first().passed and verdict.first().smallest_cut is None
    assert {r.verdict for r in found.collect()} == {"no verdict"} and {r.clustered_by for r in found.collect()} == {"expert"}


def test_length_lovers_fail_and_holes_abort(spark, items):
    lover = lambda r, rep: target(r, True)
    probes, verdict, _ = C.score(spark, items, picks(spark, items, lover), [], replicates=100)
    assert not {r.probe: r.ok for r in probes.collect()}["pad"] and not verdict.first().passed
    some = picks(spark, items, lover)
    with pytest.raises(ValueError):
        C.answered(items, some.filter("pid <> 'S0010'"))
    odd = some.unionByName(spark.createDataFrame([("nobody", "r1", "A"), ("S0010", "r9", "C")], "pid string, rep string, choice string")).unionByName(some.limit(3))
    assert C.answered(items, odd).count() == some.count()


def test_text_probes(spark):
    df = spark.createDataFrame([("a. b.",), ("One one. Two two. Three three.",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(C.without_sentences(F.col("t"), 0.1, 1)).collect()]
    assert got[0] is None and len(got[1].split(". ")) == 2 and got[2] is None and got[3] is None
    assert [r[0] for r in df.select(C.padded(F.col("t"), 1.25, ["xx"])).collect()] == ["a. b. xx", "One one. Two two. Three three. xx", None, ""]

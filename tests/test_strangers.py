"""Strangers in hash order without rows for their pairs, beside the pairs themselves."""

import hashlib
import random
import re

import pytest
from corvane.functions.hashing import sha1_heads, tails
from corvane.operators import pairing as P
from pyspark.sql import functions as F


def test_heads_of_sha1():
    texts = [b"", b"|1", *[b"|%d" % k for k in range(95, 300)], b"x" * 60]
    for prefix in (b"", b"2afc|7", b"y" * 50):
        want = [int.from_bytes(hashlib.sha1(prefix + t).digest()[:8], "big") for t in texts]
        assert sha1_heads(prefix, tails(texts), len(texts)).tolist() == want


@pytest.fixture(scope="module")
def membership(spark):
    rng = random.Random(5)
    rows = [(c, u) for c in range(12) for u in rng.sample(range(90), 7)]
    return spark.createDataFrame(rows, "g int, u long")


@pytest.mark.parametrize("authors, hashes", [(20_000, 1_000_000), (13, 40)])
def test_picks_are_those_of_all_pairs(membership, monkeypatch, authors, hashes):
    monkeypatch.setattr(P, "AUTHORS", authors)
    monkeypatch.setattr(P, "HASHES", hashes)
    pairs = P.strangers(membership, "g", "u")
    want = {(r.g, r.u, r.rank) for r in P.hash_pick(pairs, ["g"], "u", 4, "s", 1).collect()}
    got = P.picked_strangers(membership, "g", "u", 4, "s", 1)
    assert {(r.g, r.u, r.rank) for r in got.collect()} == want and len(want) == 48
    met = membership.withColumnRenamed("u", "member").join(pairs, "g")
    want = {(r.g, r.member, r.u) for r in P.hash_pick(met, ["g", "member"], "u", 3, "s").collect()}
    got = P.picked_strangers(membership, "g", "u", 3, "s", per_member=True)
    assert {(r.g, r.member, r.u) for r in got.collect()} == want and len(want) == 12 * 7 * 3
    assert P.picked_strangers(membership, "g", "u", 10_000, "s").count() == pairs.count()


def test_copies_of_all_authors_are_bounded(membership, monkeypatch):
    monkeypatch.setattr(P, "AUTHORS", 13)
    monkeypatch.setattr(P, "HASHES", 1)
    plan = P.picked_strangers(membership, "g", "u", 3, "s", per_member=True)._jdf.queryExecution().optimizedPlan().toString()
    parts = [int(n) for n in re.findall(r"pmod\(xxhash64\([^()]*\), (?:cast\()?(\d+)", plan)]
    assert len(parts) == 2 and max(parts) <= 64  # 84 seekers


def test_counts_are_those_of_all_pairs(membership):
    one = membership.select("u", (F.col("u") % 17).cast("int").alias("g")).distinct()
    two = membership.filter("u % 3 > 0").select("u", (F.col("u") % 29).cast("int").alias("g")).distinct()
    more = two.unionByName(two.filter("u % 5 = 0").withColumn("g", F.col("g") + 1))  # some in two groups
    for unions in ([], [one], [one, more], [more]):
        want = {r.g: r["count"] for r in P.strangers(membership, "g", "u", unions).groupBy("g").count().collect()}
        assert {r.g: r.n for r in P.stranger_counts(membership, "g", "u", unions).collect()} == want



"""The null of renamed authors: read once, by groups, against a count by hand."""

import hashlib

from corvane.operators import resampling as B
from pyspark.sql import functions as F

ROWS = [(u, f"a{u % 5}", f"a{(u * u + k) % 6}" if (u + k) % 4 else None) for u in range(60) for k in range(1 + u % 3)]
SCHEMA = "u int, author string, guess string"


def by_hand(rows, replicates, seed):
    size, units = {}, {u for u, _, _ in rows}
    for u, _, _ in rows:
        size[u] = size.get(u, 0) + 1
    right = lambda name: sum(1 / size[u] for u, a, g in rows if g is not None and g == name(a)) / len(units)
    names = sorted({a for _, a, _ in rows})
    values = []
    for b in range(replicates):
        order = sorted(names, key=lambda a: hashlib.sha1(f"{seed}|{b}|{a}".encode()).hexdigest())
        values.append(right(dict(zip(order, names)).get))
    return right(lambda a: a), sum(values) / replicates, (sum(round(v, 12) >= round(right(lambda a: a), 12) for v in values) + 1) / (replicates + 1)


def test_guesses_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def told(unit):
        seen.add(1)
        return True

    found = B.block_null(spark.createDataFrame(ROWS, SCHEMA).filter(told("u")), "u", "author", "guess", 40, 3).first()
    assert seen.value == len(ROWS)
    assert all(abs(x - y) < 1e-12 for x, y in zip((found.observed, found.null_mean, found.p), by_hand(ROWS, 40, 3)))


def test_groups_are_told_apart_and_add_up(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("half", F.col("u") % 2)
    pairs = B.guess_pairs(df, ["half"], "u", "author", "guess").cache()
    halves = {r.half: r for r in B.null_of_pairs(pairs, ["half"], 40, 3).collect()}
    every = B.null_of_pairs(pairs.groupBy("author", "guess").agg(F.sum("w").alias("w"), F.sum("units").alias("units")), [], 40, 3).first()
    for found, rows in ((halves[0], [r for r in ROWS if r[0] % 2 == 0]), (halves[1], [r for r in ROWS if r[0] % 2]), (every, ROWS)):
        assert all(abs(x - y) < 1e-12 for x, y in zip((found.observed, found.null_mean, found.p), by_hand(rows, 40, 3)))

"""Runs of words as hashes, against runs that are written out."""

import random

from corvane.functions import text as T
from corvane.operators import overlap as O
from pyspark.sql import functions as F


def test_runs_are_those_of_the_words(spark, monkeypatch):
    from corvane.functions import runs

    rng = random.Random(5)
    word = lambda: rng.choice(["A", "b", "it's", "Ünd", "c1d", "'", "Kelvin"])
    rows = [(k % 7, k, " ".join(word() for _ in range(rng.randrange(12)))) for k in range(200)] + [(0, 200, None), (None, 201, "a b c d"), (1, 202, "")]
    monkeypatch.setattr(runs, "CHARS", 300)
    df = spark.createDataFrame(rows, "g long, i int, t string").repartition(3)
    got = sorted((r.i, r.pos, tuple(r.gram)) for r in O.positioned_grams(df, ["g", "i"], "t", 3).collect())
    want = sorted((r.i, r.pos, r.run) for r in df.select("i", F.posexplode(T.grams(T.words(F.col("t")), 3)).alias("pos", "run")).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    names = {}
    for (_, _, h), (_, _, run) in zip(got, want):
        assert names.setdefault(run, h) == h
    assert len(set(names.values())) == len(names)
    pool = O.pool_keys(spark.createDataFrame([(r,) for r in names] + [("one",)], "gram string"))
    assert set(names.values()) < {tuple(r.gram) for r in pool.collect()}


def test_only_cards_that_share_a_run_are_counted(spark):
    cards = spark.createDataFrame([(k, f"u{'abcdefghij'[k % 10]} v w x y z") for k in range(40)] + [(99, "one two three four five six seven")], "card long, text string")
    pool = O.gram_rows(spark.createDataFrame([(1, "two three four five six seven eight")], "author int, text string"), ["author"], "text", 6).distinct()
    scores = O.overlap_scores(O.text_lines(cards, ["card"]), "card", pool, "author", 6)
    assert [tuple(r) for r in scores.collect()] == [(99, 1, 1.0, 1.0, 0.5)]
    assert "left_semi" in scores._jdf.queryExecution().toString().lower().replace("leftsemi", "left_semi")

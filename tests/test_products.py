"""Sums over shared features of all pairs, by blocks: against brute force, and pairs that do not move."""

import random
from itertools import combinations

from corvane.operators import products as R
from corvane.plans import instruments as I
from corvane.registry import queries
from pyspark.sql import functions as F


def test_pair_sums_by_blocks(spark, monkeypatch):
    for name, small in (("KEYS", 7), ("CELLS", 40), ("DENSE", 2), ("SPARSE", 8)):
        monkeypatch.setattr(R, name, small)
    rng = random.Random(3)
    rows = {(f"k{k}", f"f{f}"): rng.randint(1, 5) for k in range(40) for f in range(30) if rng.random() < (0.9 if f < 3 else 0.1)}
    more = {(f"k{k}", f) for k in range(0, 40, 2) for f in range(4) if rng.random() < 0.5}
    first = spark.createDataFrame([(k, f, w, w) for (k, f), w in rows.items()], "key string, feature string, wa long, wb long")
    second = spark.createDataFrame([(k, f, 3, 1) for k, f in more], "key string, feature long, wa long, wb long")
    marks = spark.createDataFrame([(f"k{k}", k % 3) for k in range(40)], "key string, mark int")
    got = {(r.a, r.b): (r.dot, r.n) for r in R.pair_sums({"dot": first, "n": second}, "key", marks).collect()}
    want = {}
    for a, b in combinations(sorted(f"k{k}" for k in range(40)), 2):
        dot = sum(rows.get((a, f"f{f}"), 0) * rows.get((b, f"f{f}"), 0) for f in range(30))
        if dot and int(a[1:]) % 3 != int(b[1:]) % 3:
            want[a, b] = (dot, sum(3 for f in range(4) if (a, f) in more and (b, f) in more))
    assert got == want and len(want) > 300


def test_shared_runs_over_many_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = spark.createDataFrame([(k, "a b c d e f g a b c d e f" + (" only here it is so" if k == 5 else " twice in all of it" if k % 7 == 3 else "")) for k in range(50)] + [(50, None), (None, "a b c d e f")], "key long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = R.shared_runs(texts, "key", "text", 6).collect()
        sums = {(r.a, r.b): r.n for r in R.pair_sums({"n": R.shared_runs(texts, "key", "text", 6)}, "key").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    sets = {k: {" ".join(w[i : i + 6]) for i in range(len(w) - 5)} for k, w in ((r.key, r.text.split()) for r in texts.filter("key IS NOT NULL AND text IS NOT NULL").collect())}
    assert sums == {(a, b): len(sets[a] & sets[b]) for a, b in combinations(range(50), 2)}
    assert len({r.feature for r in got}) == 2  # all 50, and those of 3 modulo 7


def still(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    return "Join" not in plan and "keys=[a#" not in plan


def test_pairs_of_cards_do_not_move(spark):
    cards = spark.createDataFrame([(f"c{k}", k % 2, f"alpha beta gamma card{'abcdefghij'[k]}") for k in range(10)], "card string, seed int, text string")
    found = I.linkage(cards, cards.select("card", F.lit(1).alias("author")), longer=8)
    assert still(found) and found.count() == 25


def test_pairs_of_documents_do_not_move(spark, tmp_path):
    spark.createDataFrame([(k, f"w{'abcdefghij'[k]} one two three four five six seven", "s0") for k in range(10)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["c13_card_pairs"](spark, str(tmp_path))
    assert still(found) and found.count() == 33

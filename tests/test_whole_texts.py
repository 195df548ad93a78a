"""Queries that compare whole texts."""

import difflib
import random

import numpy as np
from corvane.catalog import plans, sequences
from corvane.operators import overlap as O


def test_shared_block():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(30))] for _ in range(2))
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
        assert O.shared_block(np.array(a, object), np.array(b, object)) == want


def test_token_blocks_beyond_the_beginning(spark, tmp_path):
    shared = " ".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    text = lambda c: " ".join(f"{c}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)) + " " + shared
    rows = [(1, text("x"), "en", "one", 3000), (2, text("y"), "en", "one", 3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in sequences.i09_token_blocks(spark, str(tmp_path)).collect()] == [(1, 2, 100)]


def _tables(spark, path, documents, benchmark=()):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark) or [(0, "a")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_auc_counts_every_card(spark, tmp_path):
    words = "one two three four five six seven eight"
    path = _tables(spark, tmp_path, [(10, "", "en", "s", 0), (11, words, "en", "s", 40), (13, "nothing", "en", "s", 7)], [(3, words), (4, "other")])
    got = {r.score: r.auc for r in plans.k09_membership_auc(spark, path).collect()}
    assert got["s1"] == 1.0  # of cards 10, 11, 13 with authors 3 and 4 only (11, 3) is a member, and it alone scores


def test_long_texts_can_be_degenerate(spark, tmp_path):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(1200))
    path = _tables(spark, tmp_path, [(1, long, "en", "s", len(long)), (2, "x " + long, "en", "s", len(long) + 2)])
    r = plans.k05_degeneracy(spark, path).first()
    assert (r.card, r.degenerate) == ("s", True) and r.run_share == 1.0

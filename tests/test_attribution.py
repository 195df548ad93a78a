"""Attribution by topic: counts of words where texts lie, frequent and rare terms, ties, authors without a name."""

import math
from collections import Counter, defaultdict

from corvane.functions import text as T
from corvane.operators import overlap as O
from pyspark.sql import functions as F

ROWS = [
    (1, "ann", "river river stone the and boat"),
    (2, "ann", "river lantern"),
    (3, "bob", "stone stone stone cabin river"),
    (4, "cy", "violin melody [name] melody"),
    (6, "cy", None),
    (7, None, "river violin orphan"),
    (8, "dee", "violin melody melody"),
    (9, "empty", "the of to"),
]
ASKED = [(10, "river boat lantern"), (20, "melody violin violin"), (30, "cabin STONE"), (40, "unknown words"), (50, None), (60, "orphan"), (70, "river stone")]


def by_hand():
    words = lambda t: Counter(w for w in __import__("re").findall("[a-z]{3,}", __import__("re").sub(r"\[[a-z]+\]", " ", (t or "").lower())) if w not in T.STOP_WORDS)
    docs = [(a, words(t)) for _, a, t in ROWS]
    n, df, tf = sum(bool(w) for _, w in docs), Counter(), defaultdict(Counter)
    for a, w in docs:
        df.update(w.keys())
        tf[a].update(w)
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in df}
    out = {}
    for k, t in ASKED:
        q = {x: c * idf[x] for x, c in words(t).items() if x in idf}
        found = []
        for a, w in tf.items():
            p = {x: c * idf[x] for x, c in w.items()}
            if a is not None and set(p) & set(q):
                found.append((-round(sum(p[x] * q[x] for x in q if x in p) / math.sqrt(sum(v * v for v in p.values())) / math.sqrt(sum(v * v for v in q.values())), 9), a))
        if found:
            out[k] = (min(found)[1], round(-min(found)[0], 6))
    return out


def frames(spark):
    return spark.createDataFrame(ROWS, "doc_id int, author string, text string").repartition(3), spark.createDataFrame(ASKED, "doc_id int, text string").repartition(2)


def test_frequent_and_rare_terms_give_the_same(spark):
    known, asked = frames(spark)
    want = by_hand()
    assert want[20][0] == "cy" and want[10][0] == "ann" and 60 not in want  # cy and dee tie: the first name
    for hot in (0, 10, 1000):
        got = {r.doc_id: (r.predicted, round(r.cosine, 6)) for r in O.attributed(known, asked, "author", "doc_id", hot=hot).collect()}
        assert got == want, hot


def test_counts_are_those_of_content_words(spark, monkeypatch):
    known, _ = frames(spark)
    want = {(r.author, r.term): r.tf for r in O.terms(known, ["author"], T.content_words(F.col("text"))).collect()}
    for at_once in (1, 1 << 22):
        monkeypatch.setattr(O, "COUNTED", at_once)
        rows = O.content_counts(known, "author").groupBy("author", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).collect()
        assert {(r.author, r.term): r.tf for r in rows if r.term} == want
        assert {r.author: r.df for r in rows if r.term is None} == {"ann": 2, "bob": 1, "cy": 1, None: 1, "dee": 1}
        assert next(r.df for r in rows if r.author == "ann" and r.term == "river") == 2


def test_texts_are_not_shuffled_to_be_attributed(spark):
    """Words of all texts were grouped by document, and placed among their author's, before they were counted."""
    plan = O.content_counts(frames(spark)[0], "author")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Window" not in plan

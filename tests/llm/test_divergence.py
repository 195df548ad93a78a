"""Source divergence against a plain version that goes through every pair and term."""

import random
import re
from collections import Counter, defaultdict

import corvane.llm.source_divergence as m
import pytest
from corvane.llm.source_divergence import divergences
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, part string, term string, p int, n string"


def plain(rows, min_docs=3, top=200):
    groups, seen, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = ["".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in seen[lang].items() if k >= min_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 1) // (sum(x.values()) + len(kept)) for t, c in x.items()} for s, x in own.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergences(df, **more).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA).repartition(3)


def some(seed=1, sources=9):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "BETA", "gamma9delta", "é", "Éa", "日本", "x_y", "it's", "zz", "q", "long" * 4000]
    rows = []
    for k in range(150):
        lang = rng.choice(["en", "en", "en", "fr", None])
        source = rng.choice(["hot", "hot", "hot", *[f"s{j}" for j in range(sources)], None])
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        rows.append((k, rng.choice([text, text, text, text.upper(), None, "", "1 2 3"]), lang, source))
    return rows + rows[:5] + [(900, "12 34", "none", "a"), (901, None, "none", "b"), (902, "lonely word", "few", "a"), (903, "word", "few", "b"), (904, "alpha", "one", "only")]


@pytest.mark.parametrize("min_docs, top", [(3, 200), (1, 2)])
def test_divergences(spark, min_docs, top):
    rows = some()
    assert got(table(spark, rows), min_docs=min_docs, top=top) == plain(rows, min_docs, top)


def test_small_blocks_and_slices(spark, monkeypatch):
    for name, value in (("KEPT", 7), ("BLOCK", 3), ("BLOCKS", 2), ("PAIRS", 11), ("SALTS", 2)):
        monkeypatch.setattr(m, name, value)
    rows = some(2)
    assert got(table(spark, rows)) == plain(rows)


def test_very_large_counts_are_exact(spark):
    n, own, v = 9_300_000_000, 30_000_000_000_000, 12_345
    df = spark.createDataFrame([(n, own, v), (0, own, v), (5, 9, 0), (8_999_999_000, 8_999_999_000, 7)], "n long, own long, v long")
    assert [r[0] for r in df.select(m.rate(F.col("n"), F.col("own"), F.col("v"))).collect()] == [1 + 10**9 * (n + 1) // (own + v), 1 + 10**9 // (own + v), None, 1 + 10**9 * 8_999_999_001 // 8_999_999_007]


def test_odd_and_empty_tables(spark, odd, nothing):
    assert got(nothing) == []
    rows = [tuple(r)[:4] for r in odd.collect()]
    assert got(odd) == plain(rows)

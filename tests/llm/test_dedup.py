import hashlib
import random

import brute
import numpy as np
import pytest
from corvane.llm import line_edit, simhash_anchor, substring_rk
from corvane.llm.common import slices
from corvane.llm.components import connected_components
from corvane.llm.exact_bloom import drop_exact_copies, exact_copies
from pyspark.sql import functions as F


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_copies(docs, rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i))
    want = sorted((i, min(groups[squeezed(t)])[1], len(groups[squeezed(t)]), i == min(groups[squeezed(t)])[1], hashlib.sha256(squeezed(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert tuples(exact_copies(docs)) == want
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if w[3]]


def test_exact_copies_of_odd_rows(odd, nothing):
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in exact_copies(odd).collect()) == [("5", 4, False), ("5", 4, False), ("7", 1, True), ("None", 1, True), ("None", 4, False), ("None", 4, True)]
    assert drop_exact_copies(odd).count() == 3
    assert exact_copies(nothing).count() == 0 and drop_exact_copies(nothing).count() == 0


def test_near_copies(docs, rows):
    got = tuples(simhash_anchor.near_copies(docs))
    want = brute.near_copies([r[:2] for r in rows])
    assert got == want
    kept = simhash_anchor.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, c in want if d == c]


def test_near_copies_of_odd_rows(odd, nothing):
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_anchor.near_copies(odd).collect())
    assert got == [("5", "5"), ("5", "5"), ("7", "7"), ("None", "5"), ("None", "5"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in simhash_anchor.drop_near_copies(odd).collect()) == ["5", "7", "None"]
    assert simhash_anchor.near_copies(nothing).count() == 0 and simhash_anchor.drop_near_copies(nothing).count() == 0


def test_anchors_meet_within_threshold():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    (fx, cx), (fy, cy) = (simhash_anchor._replicas(v.view(np.int64)) for v in (x, y))
    of = lambda f, c: {(a, b) for a, b in zip(f.tolist(), c.tolist())}
    own, other = {}, {}
    for f, c in of(fx, cx):
        own.setdefault(f, set()).add(c)
    for f, c in of(fy, cy):
        other.setdefault(f, set()).add(c)
    assert all(own[a] & other[b] for a, b in zip(x.view(np.int64).tolist(), y.view(np.int64).tolist()))
    assert max(map(len, own.values())) <= 34


@pytest.mark.parametrize("block", [3, 100_000])
def test_links_in_blocks(spark, block):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = {center} | {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {tuple(r) for r in simhash_anchor.links(df, block=block).collect()}
    dist = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert all(dist(a, b) <= 4 for a, b in found)
    at = {f: i for i, f in enumerate(signed)}
    every = [(i, j) for i in range(len(signed)) for j in range(i) if dist(signed[i], signed[j]) <= 4]
    assert brute.smallest_reachable(signed, [(at[a], at[b]) for a, b in found]) == brute.smallest_reachable(signed, every)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7), (40, 41), (41, 40)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for p in links for x in p})
    at = {n: i for i, n in enumerate(nodes)}
    want = dict(zip(nodes, brute.smallest_reachable(nodes, [(at[a], at[b]) for a, b in links])))
    assert all(got.get(n, n) == c for n, c in want.items())


@pytest.mark.parametrize(("hot", "gram"), [(1, 8), (100_000, 8), (100_000, 0)])
def test_window_dedup(docs, rows, hot, gram):
    out = substring_rk.without_repeats(docs, hot=hot, gram=gram)
    got = tuples(out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("s")))
    want = brute.window_dedup([r[:2] for r in rows])
    assert got == want
    assert sum(w[2] for w in want) > 500


def test_window_dedup_of_odd_rows(spark, odd, nothing):
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_rk.without_repeats(odd).collect()) == [("5", 5, 0), ("5", 5, 0), ("7", 2, 0), ("None", 0, 0), ("None", 5, 0), ("None", 5, 0)]
    assert substring_rk.without_repeats(nothing).count() == 0
    long = " ".join(map(str, range(60)))
    twice = spark.createDataFrame([(3, long), (3, long), (3, "x " + long), (None, long + " y"), (9, long)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_rk.without_repeats(twice).collect()) == [("3", 60, 0), ("3", 60, 0), ("3", 61, 0), ("9", 60, 60), ("None", 61, 60)]


def test_line_dedup(docs, rows):
    out = line_edit.without_near_lines(docs)
    got = tuples(out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("s")))
    assert got == brute.line_dedup([r[:2] for r in rows])


def test_line_dedup_in_blocks(spark):
    rng = random.Random(5)
    line = "the quick brown fox jumps over a lazy dog"
    lines = {line} | {line[:k] + c + line[k + j :] for k in range(0, 40, 3) for c in ("x", "") for j in (0, 1)} | {"".join(rng.choice("ab ") for _ in range(30)) for _ in range(30)}
    docs = [(i, f"short\n{x}\n") for i, x in enumerate(sorted(lines))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = tuples(line_edit.without_near_lines(df, block=4).select("doc_id", "n_removed"))
    assert got == [(d, n) for d, _, n, _ in brute.line_dedup(docs)]


def test_short_lines_go_if_equal(spark):
    df = spark.createDataFrame([(1, "Yes.\nNo.\n\n"), (2, " Yes. \nNoo.\n\n"), (3, "No.")], "doc_id long, text string")
    assert tuples(line_edit.without_near_lines(df)) == [(1, 4, 0, "Yes.\nNo.\n\n"), (2, 4, 1, "Noo.\n\n"), (3, 1, 1, "")]


def test_hot_keys_are_passed_on(spark):
    """With tiny buckets and a tiny limit of lines per key, the same keys and lines come out."""
    rng = random.Random(8)
    line = "a line which very many others are like, but for one"
    texts = [line[:k] + c + line[k + 1 :] for k in range(len(line)) for c in "xyz"] + ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    pairs = lambda **k: set(tuple(r) for r in line_edit.shared_keys(df, len(texts), 2, 20, **k).collect())
    one = pairs(per_bucket=1 << 30)
    assert one and one == pairs(per_bucket=1 << 30, hot=5)
    gathered = line_edit.Gathered(0, 5, 40)
    out = [gathered.add(np.array([2 * (k % 3) + 1, 1 << 20 | 2 * k], np.uint32), np.array([k, k])) for k in range(100)]
    out = [b for b in [*out, gathered.end()] if b is not None]
    assert {(k, h) for b in out for k, h in zip(b.column("key").to_pylist(), b.column("h").to_pylist())} == {(k % 3, k) for k in range(100)}
    assert len(gathered.passed) == 3 and gathered.held < 220


def test_line_dedup_of_odd_rows(spark, nothing):
    same = "a line that is long enough to be compared"
    df = spark.createDataFrame([(None, same), (4, same + "\n" + same), (4, same + "\n" + same), (9, None), (9, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in line_edit.without_near_lines(df).collect())
    assert got == [("4", 2, 1, same), ("4", 2, 1, same), ("9", 0, 0, ""), ("9", 1, 0, ""), ("None", 1, 1, "")]
    assert line_edit.without_near_lines(nothing).count() == 0


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randrange(3) for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() < 0.85] + [rng.randrange(3)] * rng.randrange(2)
        for most in (1, 2, 3):
            got = line_edit.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most)
            assert got == min(brute.edit_distance(a, b), most + 1)


def test_slices_cover_all():
    assert slices(np.array([0, 5, 5, 30, 31, 32]), 10) == [(0, 2), (2, 3), (3, 5)]
    assert slices(np.array([0]), 10) == []

"""The similarity ratio against difflib."""

import difflib
import random
import time

import pytest
from corvane.operators.ratio import longest_run, matched, similarity_ratio


def lists(seed, n, symbols):
    rng = random.Random(seed)
    a = [rng.randrange(symbols) for _ in range(rng.randrange(n))]
    b = list(a)
    for _ in range(rng.randrange(1 + n // 3)):
        at = rng.randrange(len(b) + 1)
        b[at : at + rng.randrange(4)] = [rng.randrange(symbols) for _ in range(rng.randrange(4))]
    return (a, b) if rng.random() < 0.5 else (a, [rng.randrange(symbols) for _ in range(rng.randrange(n))])


@pytest.mark.parametrize("n, symbols", [(9, 2), (30, 4), (300, 30), (500, 90), (500, 7)])
@pytest.mark.parametrize("popular", [True, False])
def test_shared_tokens_are_difflibs(n, symbols, popular):
    for seed in range(60):
        a, b = lists(seed, n, symbols)
        m = difflib.SequenceMatcher(None, a, b, autojunk=popular)
        assert matched(a, b, popular) == sum(x.size for x in m.get_matching_blocks()), (a, b)


def test_the_first_of_several_runs():
    assert longest_run([1, 2, 9, 1, 2], [5, 1, 2, 1, 2]) == (0, 1, 2)
    assert longest_run([1, 2], [3, 1, 2, 1, 2, 4]) == (0, 1, 2) and longest_run([1], [2]) == (0, 0, 0)


def test_long_texts_take_little_time():
    rng = random.Random(1)
    a = [int(rng.paretovariate(0.6)) for _ in range(20_000)]
    b = [t for k, t in enumerate(a) if k % 97] + a[:500]
    began = time.time()
    assert 0.9 < 2 * matched(a, b) / (len(a) + len(b)) < 1
    assert time.time() - began < 20


def test_nulls_and_empty_lists(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], []), (None, ["a"]), (["a"], None), (["x"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(similarity_ratio("a", "b")).collect()] == [pytest.approx(2 / 3), 1.0, None, None, 0.0]

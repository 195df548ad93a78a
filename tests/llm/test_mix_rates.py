"""Mixing at high mean repetition rates."""

import hashlib
from decimal import Decimal, getcontext

import numpy as np
import pytest
from corvane.llm import mix_poisson


def copies(mean, key):
    """The inverse Poisson distribution in 60 digits."""
    getcontext().prec = 60
    u = Decimal(int(hashlib.md5(key.encode()).hexdigest()[:13], 16)) / (1 << 52)
    n, p = 0, (-mean).exp()
    c = p
    while c <= u:
        n += 1
        p *= mean / n
        c += p
    return n


@pytest.mark.parametrize("epochs", [3, 600, 2500])
def test_any_rate(spark, epochs):
    df = spark.createDataFrame([(k, "x" * 9, "one") for k in range(30)], "doc_id long, text string, source string")
    got = {r.doc_id: r["count"] for r in mix_poisson.mixed_copies(df, epochs=float(epochs), seed=42).groupBy("doc_id").count().collect()}
    want = {k: copies(Decimal(epochs), f"42|{k}") for k in range(30)}
    assert got == {k: n for k, n in want.items() if n}


def test_tiny_null_source_beside_large_ones(spark):
    rows = [(k, "y" * 99_999, f"s{k % 3}") for k in range(30)] + [(99, None, None)]
    out = mix_poisson.mixed_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), power=0.0).filter("source IS NULL")
    assert out.first().rate > 500_000
    assert abs(out.count() - 750_000) < 6 * 750_000**0.5


def test_sums_are_finite_and_ascend():
    for rate in (0.0, 1e-9, 0.5, 1.0, 499.9, 745.0, 1e4, 1e8):
        least, sums = mix_poisson.poisson_sums(rate)
        assert least >= 0 and np.isfinite(sums).all() and (np.diff(sums) >= 0).all() and abs(sums[-1] - 1) < 1e-9

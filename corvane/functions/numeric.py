"""Hash keys and small statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column | str | int) -> Column:
    """sha1 of the parts joined by bars; strings and numbers are literals. Equal in any engine."""
    return F.sha1(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def hash_number(*parts: Column | str | int) -> Column:
    """The first 32 bits of `hash_key` as a number."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")


def hash_parity(*parts: Column | str | int) -> Column:
    """The parity of the whole hash: that of its last digit."""
    return F.conv(F.substring(hash_key(*parts), 40, 1), 16, 10).cast("int") % 2


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share."""
    p, k = F.try_divide(hits.cast("double"), n), F.lit(z * z)
    middle, spread = p + k / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + k / (4 * n * n))
    return (middle - spread) / (1 + k / n), (middle + spread) / (1 + k / n)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a rational approximation (absolute error below 1e-7)."""
    t = 1 / (1 + F.abs(x) * 0.2316419)
    # Coefficients of the approximation.
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * series
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double; 0 if k is more than n."""
    one = F.lit(1.0)
    product = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), one, lambda acc, i: acc * (n - k + i) / i)
    return F.when(k > n, F.lit(0.0)).otherwise(product)


def dot(a: Column, b: Column) -> Column:
    """Product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def vector_cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

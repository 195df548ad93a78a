"""The sanitizer's rounds."""

from corvane.plans import sanitize
from pyspark.sql import functions as F


def test_a_line_may_settle_in_the_last_of_five_rounds(spark):
    line = " ".join(f"{chr(97 + k)}{chr(97 + k)}" for k in range(20))
    df = spark.createDataFrame([(1, line)], "line_no int, line string")
    pool = spark.createDataFrame([(" ".join(line.split()[:6]),)], "gram string")
    late = lambda text, runs, r: F.when(F.lit(r) < 4, text).otherwise(F.concat(F.lit("zz"), F.substring(text, 3, 999)))
    out = sanitize.sanitized(df, ["line_no"], pool, edit=late).first()
    assert (out.tier, out.rounds) == ("edited", 4)

"""Group filters (B14 to B16), sorts and limits (F), set operations (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog.base import benchmark, LINES, clicks, corpus, document_lines, pool, query, table
from corvane.functions.numeric import hash_key
from corvane.operators import overlap as O


@query("""SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, list(l_suppkey) AS cands FROM lineitem GROUP BY ALL) WHERE len(list_intersect(cands, [1, 3, 5, 7])) > 0""")
def b14_signal_groups(spark, d):
    members = F.array(*[F.lit(x).cast("long") for x in (1, 3, 5, 7)])
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_suppkey").cast("long")).alias("cands"))
    return g.filter(F.arrays_overlap("cands", members)).select("o_orderkey")


@query("""SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events)""")
def b15_complete_arms(spark, d):
    e = clicks(spark, d)
    every = e.agg(F.count_distinct("user_id").alias("every"))  # one row
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")).join(F.broadcast(every)).filter("n = every").select("event_type", "n")


@query("SELECT event_id FROM events WHERE event_type = 'view' OR event_type IS NULL AND value > 10")
def b16_topic_negatives(spark, d):
    return clicks(spark, d).filter("event_type = 'view' OR event_type IS NULL AND value > 10").select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 45")
def f01_multi_key_sort(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def f02_top_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'click')::INTEGER DESC, sha1('cap|' || event_id), event_id) AS rn FROM events)
SELECT user_id, event_id, event_type FROM r WHERE rn <= 22""")
def f03_stratified_cap(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc((F.col("event_type") == "click").cast("int")), hash_key("cap", F.col("event_id")), "event_id")
    return clicks(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 22").select("user_id", "event_id", "event_type")


@query("SELECT doc_id FROM documents ORDER BY sha1('sub|0|' || doc_id) LIMIT 30")
def f04_seeded_subsample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(hash_key("sub", 0, F.col("doc_id"))).limit(30)


@query(f"WITH {LINES}, u AS (SELECT gram FROM pool UNION SELECT gram FROM line_grams) SELECT count(*) AS n FROM u")
def g01_union_of_runs(spark, d):
    own = O.gram_rows(document_lines(spark, d), [], "line", 6)
    return pool(spark, d).union(own).distinct().agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT gram FROM pool INTERSECT SELECT gram FROM line_grams")
def g02_intersection_of_runs(spark, d):
    return O.exploded_grams(benchmark(spark, d), [], "text", 6).intersect(O.exploded_grams(document_lines(spark, d), [], "line", 6))


@query("SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def g03_except(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").distinct().join(orders, "c_custkey", "left_anti")


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'only_a' ELSE 'only_b' END AS side
FROM (SELECT DISTINCT user_id FROM events WHERE value > 95) a FULL JOIN (SELECT DISTINCT user_id FROM events WHERE value < 5 AND event_type = 'click') b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL""")
def g04_symmetric_difference(spark, d):
    e = clicks(spark, d)
    a = e.filter("value > 95").select("user_id").distinct().withColumn("a", F.lit(1))
    b = e.filter("value < 5 AND event_type = 'click'").select("user_id").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "user_id", "full_outer").filter("a IS NULL OR b IS NULL")
    return both.select("user_id", F.when(F.col("b").isNull(), "only_a").otherwise("only_b").alias("side"))


@query("SELECT wave, count(*) AS n FROM (SELECT 1 AS wave, event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 2, event_id FROM events WHERE event_id % 3 < 2) GROUP BY wave")
def g05_union_of_waves(spark, d):
    e = clicks(spark, d).select("event_id")
    waves = e.filter("event_id % 3 = 0").withColumn("wave", F.lit(1)).unionByName(e.filter("event_id % 3 < 2").withColumn("wave", F.lit(2)))
    return waves.groupBy("wave").agg(F.count("*").alias("n"))

"""Aggregations and estimators (D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog.base import ELEMENTS, SCORES, clicks, corpus, elements, query, scores, table
from corvane.catalog.pairs import MEMBERS, members
from corvane.functions.text import CONCRETE_ELEMENTS, CONDITIONAL, NAMED, NUMBERED, mechanical_coverage, words
from corvane.functions.numeric import choose, normal_cdf, vector_cosine, wilson
from corvane.operators import estimators as E
from corvane.operators import overlap as O
from corvane.operators import resampling as B

#: Outcomes: value above 50, by user within event type.
WINS = "wins AS (SELECT event_id, user_id, event_type, (value > 50)::INTEGER::DOUBLE AS win FROM events)"


def wins(spark, d):
    return clicks(spark, d).withColumn("win", (F.col("value") > 50).cast("int").cast("double"))


def draws_sql(units: str, replicates: int, seed: str, by: str = "") -> str:
    """Draws of units (by, u, n_units) in SQL."""
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}b, u, count(*) AS w FROM (SELECT {keys}b, ('0x' || substr(sha1('{seed}|' || b || '|' || j), 1, 8))::BIGINT % n_units AS u FROM (SELECT {keys}n_units, b, unnest(range(n_units)) AS j FROM (SELECT {keys}n_units, unnest(range({replicates})) AS b FROM (SELECT DISTINCT {keys}n_units FROM {units})))) GROUP BY ALL"


@query("SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def d01_nunique_having(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_custkey", "o_orderkey").agg(F.count_distinct("l_suppkey").alias("n")).filter("n = 1").select("o_custkey").distinct()


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def d02_ordered_strings(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return x.select("conv_id", F.array_join("x.text", "\n").alias("text"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_min(value, (ts, event_id)) FILTER (value > 20) AS first_value FROM events GROUP BY user_id")
def d03_first_by_time(spark, d):
    o = F.struct("ts", "event_id")
    return clicks(spark, d).groupBy("user_id").agg(F.min_by("event_type", o).alias("first_type"), F.min_by("value", F.when(F.col("value") > 20, o)).alias("first_value"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS n_click, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) >= 40 AND count(*) FILTER (event_type = 'click') >= 8 AND count(DISTINCT event_type) >= 3")
def d04_multi_having(spark, d):
    g = clicks(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("n_click"), F.count_distinct("event_type").alias("kinds"))
    return g.filter("n >= 40 AND n_click >= 8 AND kinds >= 3")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def d05_class_counts(spark, d):
    return clicks(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


_GUESS = "g AS (SELECT event_id // 5 AS unit, (event_id // 5) % 7 AS truth, CASE WHEN event_id % 11 > 0 THEN user_id % 7 END AS guess FROM events)"


def guesses(spark, d):
    unit = F.floor(F.col("event_id") / 5)
    return clicks(spark, d).select(unit.alias("unit"), (unit % 7).alias("truth"), F.when(F.col("event_id") % 11 > 0, F.col("user_id") % 7).alias("guess"))


@query(f"WITH {_GUESS}, u AS (SELECT unit, truth, avg(coalesce((guess = truth)::INTEGER, 0)) AS a FROM g GROUP BY ALL) SELECT truth, round(avg(a), 6) AS accuracy, count(*) AS n_units FROM u GROUP BY truth")
def d06_soft_accuracy(spark, d):
    return E.soft_accuracy(guesses(spark, d).withColumn("t", F.col("truth")), ["t"], "unit", "guess", "truth").select(F.col("t").alias("truth"), F.round("accuracy", 6).alias("accuracy"), "n_units")


@query(f"""WITH {_GUESS}, k AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY unit) AS w FROM g), n AS (SELECT count(DISTINCT unit) AS n FROM g), a AS (SELECT truth, row_number() OVER (ORDER BY truth) AS i FROM (SELECT DISTINCT truth FROM g)),
r AS (SELECT truth, b, row_number() OVER (PARTITION BY b ORDER BY sha1('0|' || b || '|' || truth), truth) AS i FROM (SELECT truth, unnest(range(200)) AS b FROM a)),
p AS (SELECT r.b, r.truth, a.truth AS new FROM r JOIN a USING (i)), v AS (SELECT b, sum(w * coalesce((guess = new)::INTEGER, 0)) / any_value(n) AS v FROM p JOIN k USING (truth), n GROUP BY b),
o AS (SELECT sum(w * coalesce((guess = truth)::INTEGER, 0)) / any_value(n) AS observed FROM k, n)
SELECT round(any_value(observed), 5) AS observed, round(avg(v), 5) AS null_mean, round(quantile_cont(v, 0.025) + 1e-9, 5) AS lo, round(quantile_cont(v, 0.975) + 1e-9, 5) AS hi, round((count(*) FILTER (round(v, 12) >= round(observed, 12)) + 1) / 201, 5) AS p FROM v, o""")
def d07_block_null(spark, d):
    b = B.block_null(guesses(spark, d), "unit", "truth", "guess", 200, 0)
    b = b.withColumns({c: F.col(c) + 1e-9 for c in ("lo", "hi")})  # they often lie halfway, where engines round apart
    return b.select(*[F.round(c, 5).alias(c) for c in ("observed", "null_mean", "lo", "hi", "p")])


def _ci_sql(source: str, unit: str, value: str, replicates: int, seed: str, by: str = "", columns: str = "mean, lo, hi", equal: bool = False) -> str:
    keys, on, part = (f"{by}, ", f"USING ({by})", f"PARTITION BY {by}") if by else ("", "ON true", "")
    top = "sum(w * s / n) / sum(w)" if equal else "sum(w * s) / sum(w * n)"
    mean = "avg(s / n)" if equal else "sum(s) / sum(n)"
    return f"""s AS (SELECT {keys}{unit}, sum({value}) AS s, count(*) AS n FROM {source} GROUP BY ALL), q AS (SELECT *, row_number() OVER ({part} ORDER BY {unit}) - 1 AS u, count(*) OVER ({part}) AS n_units FROM s),
d AS ({draws_sql('q', replicates, seed, by)}), v AS (SELECT {keys}b, {top} AS v FROM d JOIN q USING ({keys}u) GROUP BY ALL), pt AS (SELECT {keys}{mean} AS mean, count(*) AS n_units FROM q{' GROUP BY ' + by if by else ''}),
ci AS (SELECT {keys}quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, least(1.0, 2.0 * (least(count(*) FILTER (v >= 0), count(*) FILTER (v <= 0)) + 1) / {replicates + 1}) AS p FROM v{' GROUP BY ' + by if by else ''}), est AS (SELECT * FROM pt JOIN ci {on})"""


@query(f"WITH {WINS}, {_ci_sql('wins', 'event_id', 'win', 50, '0', 'event_type')} SELECT event_type, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM est")
def d08_row_bootstrap(spark, d):
    return B.cluster_ci(wins(spark, d), ["event_type"], "event_id", "win", 50, 0).select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


def _tree_sql(units: str, replicates: int, seed: str, most_levels: int = 5) -> str:
    """Draws of many units (unit, s, n) of one statistic in SQL: leaves by hash, binomials from the root down, then hashes again."""
    steps = ["t0 AS (SELECT b, 1::BIGINT AS node, (SELECT count(*) FROM sums) AS d FROM (SELECT unnest(range(%d)) AS b))" % replicates]
    for level in range(most_levels):
        steps.append(f"""h{level} AS (SELECT t.b, t.node, t.d, p.units, coalesce(l.units, 0) AS left_units, ('0x' || substr(sha1('{seed}|' || t.b || '|' || t.node), 1, 13))::BIGINT / 4503599627370496 AS u
          FROM t{level} t JOIN nodes p ON p.node = t.node LEFT JOIN nodes l ON l.node = 2 * t.node, depth WHERE {level} < levels AND t.d > 0),
        k{level} AS (SELECT *, unnest(range(greatest(0, floor(d * left_units / units - 10 * sqrt(d) - 40)::BIGINT), least(d, ceil(d * left_units / units + 10 * sqrt(d) + 40)::BIGINT) + 1)) AS k FROM h{level} WHERE left_units BETWEEN 1 AND units - 1),
        c{level} AS (SELECT b, node, u, k, min(k) OVER w AS low, sum(exp(lgamma(d + 1) - lgamma(k + 1) - lgamma(d - k + 1) + k * ln(left_units / units) + (d - k) * ln(1 - left_units / units))) OVER (PARTITION BY b, node ORDER BY k) AS c FROM k{level} WINDOW w AS (PARTITION BY b, node)),
        x{level} AS (SELECT b, node, any_value(low) + count(*) FILTER (c <= u) AS x FROM c{level} GROUP BY ALL),
        y{level} AS (SELECT h.b, h.node, h.d, CASE WHEN h.left_units = 0 THEN 0 WHEN h.left_units = h.units THEN h.d ELSE x.x END AS x FROM h{level} h LEFT JOIN x{level} x USING (b, node)),
        t{level + 1} AS (SELECT b, 2 * node AS node, x AS d FROM y{level} UNION ALL SELECT b, 2 * node + 1, d - x FROM y{level} UNION ALL SELECT t.* FROM t{level} t, depth WHERE {level} >= levels)""")
    return f"""depth AS (SELECT CASE WHEN (count(*) - 1) // 4096 = 0 THEN 0 ELSE length(bin((count(*) - 1) // 4096)) END AS levels FROM {units}),
      sums AS (SELECT *, (1::BIGINT << levels) + ('0x' || substr(sha1('leaf|' || unit), 1, 8))::BIGINT % (1::BIGINT << levels) AS node, levels FROM {units}, depth),
      nodes AS (SELECT node >> up AS node, count(*) AS units FROM (SELECT node, unnest(range(levels + 1)) AS up FROM sums) GROUP BY ALL),
      {', '.join(steps)},
      placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY unit) - 1 AS place, count(*) OVER (PARTITION BY node) AS units FROM sums),
      made AS (SELECT t.b, t.node, ('0x' || substr(sha1('{seed}|' || t.b || '|' || t.node || '|' || j), 1, 8))::BIGINT % p.units AS place FROM (SELECT *, unnest(range(d)) AS j FROM t{most_levels}) t JOIN nodes p USING (node)),
      v AS (SELECT m.b, sum(p.s) / sum(p.n) AS v FROM made m JOIN placed p USING (node, place) GROUP BY m.b)"""


@query(f"""WITH units AS (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS unit, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS s, count(*) AS n FROM lineitem GROUP BY ALL), {_tree_sql('units', 20, '5')}
SELECT round((SELECT sum(s) / sum(n) FROM units), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi, (SELECT count(*) FROM units) AS n_units FROM v""")
def d08b_row_bootstrap_of_many(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("unit"), (F.col("l_returnflag") == "R").cast("double").alias("v"))
    return B.cluster_ci(rows, [], "unit", "v", 20, 5, tree=True).select(*[F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")], "n_units")


@query(f"WITH {WINS}, {_ci_sql('wins', 'user_id', 'win', 400, '0', 'event_type')} SELECT event_type, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, n_units FROM est")
def d09_cluster_bootstrap(spark, d):
    return B.cluster_ci(wins(spark, d), ["event_type"], "user_id", "win", 400, 0).select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "n_units")


@query(f"WITH diffs AS (SELECT user_id, event_id, value - 50 AS win FROM events WHERE event_type = 'click'), {_ci_sql('diffs', 'user_id', 'win', 400, '3')} SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p FROM est")
def d09b_paired_cluster_bootstrap(spark, d):
    diffs = clicks(spark, d).filter("event_type = 'click'").withColumn("win", F.col("value") - 50)
    return B.cluster_ci(diffs, [], "user_id", "win", 400, 3).select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "p")])


@query(f"""WITH {WINS}, c AS (SELECT user_id, event_type, sum(win) AS s, count(*) AS n FROM wins GROUP BY ALL), ru AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u, count(*) OVER () AS n_units FROM (SELECT DISTINCT user_id FROM wins)),
iu AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS u, count(*) OVER () AS n_units FROM (SELECT DISTINCT event_type FROM wins)), rd AS ({draws_sql('ru', 200, '0r')}), xd AS ({draws_sql('iu', 200, '0i')}),
v AS (SELECT rd.b, sum(rd.w * xd.w * s) / sum(rd.w * xd.w * n) AS v FROM c JOIN ru USING (user_id) JOIN iu USING (event_type) JOIN rd ON rd.u = ru.u JOIN xd ON xd.u = iu.u AND xd.b = rd.b GROUP BY rd.b)
SELECT round((SELECT sum(s) / sum(n) FROM c), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v""")
def d10_two_way_bootstrap(spark, d):
    return B.two_way_ci(wins(spark, d), "user_id", "event_type", "win", 200, 0).select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


_PVALUES = "p AS (SELECT event_type AS family, user_id AS id, round(min(value) / 100, 4) AS p FROM events GROUP BY ALL)"


@query(f"""WITH {_PVALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, p, round(max(holm), 4) AS holm, round(min(bh), 4) AS bh FROM (SELECT family, p, least(1.0, max((m - r + 1) * p) OVER (PARTITION BY family ORDER BY r)) AS holm, least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM r) GROUP BY family, p""")
def d11_holm_and_bh(spark, d):
    p = clicks(spark, d).groupBy(F.col("event_type").alias("family"), "user_id").agg(F.round(F.min("value") / 100, 4).alias("p"))
    return E.adjusted(p, ["family"]).groupBy("family", "p").agg(F.max("holm").alias("holm"), F.min("bh").alias("bh"))


@query(f"WITH {WINS}, {_ci_sql('wins', 'user_id', 'win', 200, '9', equal=True)} SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM est")
def d12_equal_weight_bootstrap(spark, d):
    return B.cluster_ci(wins(spark, d), [], "user_id", "win", 200, 9, equal_weight=True).select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(f"""WITH {WINS}, a AS (WITH {_ci_sql('wins', 'user_id', 'win', 200, '1')} SELECT * FROM est), b AS (WITH {_ci_sql('wins', 'user_id', 'win', 200, '2')} SELECT * FROM est)
SELECT round(any_value(mean), 6) AS mean, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, count(DISTINCT CASE WHEN lo > 0 THEN 1 WHEN hi < 0 THEN -1 ELSE 0 END) = 1 AS agree FROM (FROM a UNION ALL FROM b)""")
def d13_multiseed_envelope(spark, d):
    return B.multiseed_ci(wins(spark, d), [], "user_id", "win", [1, 2], 200).select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "agree")


_AUC = "sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END)"


@query(f"WITH {SCORES} SELECT round({_AUC} / count(*), 6) AS auc, (SELECT sum(label) FROM scores) AS n_pos, (SELECT sum(1 - label) FROM scores) AS n_neg FROM scores x, scores y WHERE x.label = 1 AND y.label = 0")
def d14_auc(spark, d):
    return E.auc(scores(spark, d), []).select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


@query(f"WITH {SCORES} SELECT x.unit, round({_AUC} / count(*), 6) AS auc FROM scores x JOIN scores y ON x.unit = y.unit WHERE x.label = 1 AND y.label = 0 GROUP BY x.unit")
def d14b_grouped_auc(spark, d):
    return E.auc(scores(spark, d), ["unit"]).filter("auc IS NOT NULL").select("unit", F.round("auc", 6).alias("auc"))


_BY_UNIT = f"a AS (SELECT x.unit, {_AUC} / count(*) AS auc, count(*) AS pairs FROM scores x JOIN scores y ON x.unit = y.unit WHERE x.label = 1 AND y.label = 0 GROUP BY x.unit)"


@query(f"WITH {SCORES}, {_BY_UNIT} SELECT round(sum(pairs * auc) / sum(pairs), 6) AS pair_weighted, round(avg(auc), 6) AS mean_of_strata FROM a")
def d15_stratified_auc(spark, d):
    return E.stratified_auc(scores(spark, d), ["unit"]).select(F.round("pair_weighted", 6).alias("pair_weighted"), F.round("mean_of_strata", 6).alias("mean_of_strata"))


@query(f"WITH {SCORES}, {_BY_UNIT}, {_ci_sql('a', 'unit', 'auc', 200, '4')} SELECT round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM est")
def d16_mean_of_cluster_auc(spark, d):
    a = E.auc(scores(spark, d), ["unit"]).filter("auc IS NOT NULL")
    return B.cluster_ci(a, [], "unit", "auc", 200, 4).select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


@query(f"""WITH {SCORES}, n AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS k FROM scores WHERE label = 0), c AS (SELECT (SELECT quantile_cont(score, 0.9) FROM scores WHERE label = 0) AS linear, (SELECT min(score) FROM n WHERE r >= ceil((k - 1) * 0.9 - 1e-9) + 1) AS higher),
t AS (SELECT s, (SELECT avg((label = 1 AND score >= s)::INTEGER) / avg(label) FROM scores) AS tpr, (SELECT sum((label = 0 AND score >= s)::INTEGER) / sum(1 - label) FROM scores) AS fpr FROM (SELECT DISTINCT score AS s FROM scores))
SELECT round(avg((score > linear)::INTEGER), 6) AS tpr_linear, round(avg((score > higher)::INTEGER), 6) AS tpr_higher, round((SELECT coalesce(max(tpr), 0) FROM t WHERE fpr <= 0.1), 6) AS tpr_best FROM scores, c WHERE label = 1""")
def d17_tpr_at_fpr(spark, d):
    return E.tpr_at_fpr(scores(spark, d), [], 0.1).select(*[F.round(c, 6).alias(c) for c in ("tpr_linear", "tpr_higher", "tpr_best")])


@query(f"""WITH {SCORES}, k AS (SELECT unit, doc_id, score, label, row_number() OVER (PARTITION BY unit ORDER BY doc_id) AS i FROM scores), p AS (SELECT b, unit, doc_id, row_number() OVER (PARTITION BY b, unit ORDER BY sha1('perm|' || b || '|' || doc_id), doc_id) AS i FROM (SELECT unit, doc_id, unnest(range(100)) AS b FROM scores)),
z AS (SELECT p.b, s.score, k.label FROM p JOIN scores s USING (doc_id) JOIN k ON k.unit = p.unit AND k.i = p.i), v AS (SELECT b, avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS v FROM z GROUP BY b), o AS (SELECT avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS o FROM scores)
SELECT round(any_value(o), 6) AS observed, round((count(*) FILTER (abs(round(v, 9)) >= abs(round(o, 9))) + 1) / 101, 6) AS p FROM v, o""")
def d18_label_permutation(spark, d):
    from corvane.functions.numeric import hash_key

    s = scores(spark, d)
    own = s.withColumn("i", F.row_number().over(Window.partitionBy("unit").orderBy("doc_id"))).select("unit", "i", "label")
    reps = s.select("unit", "doc_id", "score", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("b"))
    perm = reps.withColumn("i", F.row_number().over(Window.partitionBy("b", "unit").orderBy(hash_key("perm", F.col("b"), F.col("doc_id")), "doc_id")))
    gap = F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))
    v = perm.join(own, ["unit", "i"]).groupBy("b").agg(gap.alias("v")).join(F.broadcast(s.agg(gap.alias("o"))))
    return v.agg(F.round(F.first("o"), 6).alias("observed"), F.round((F.sum((F.abs(F.round("v", 9)) >= F.abs(F.round("o", 9))).cast("int")) + 1) / 101, 6).alias("p"))


@query(f"WITH {SCORES}, k AS (SELECT unit, score, count(*) AS k, min(score) OVER (PARTITION BY unit) AS low FROM scores GROUP BY unit, score) SELECT unit, round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / sum(k), 6) AS tie_rate, round(sum(CASE WHEN score = low THEN k ELSE 0 END) / sum(k), 6) AS floor_mass FROM k GROUP BY unit")
def d19_tie_rate(spark, d):
    return E.tie_rate(scores(spark, d), ["unit"]).select("unit", F.round("tie_rate", 6).alias("tie_rate"), F.round("floor_mass", 6).alias("floor_mass"))


@query(f"""WITH {SCORES}, g AS (SELECT unit, score, sum(label) AS m, count(*) AS g FROM scores GROUP BY ALL), w AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY unit ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
t AS (SELECT *, least(g, 5 - before)::INTEGER AS r FROM w WHERE before < 5), x AS (SELECT *, CASE WHEN g - m < r THEN 0.0 ELSE exp(lgamma(g - m + 1) - lgamma(g - m - r + 1) - lgamma(g + 1) + lgamma(g - r + 1)) END AS none FROM t)
SELECT unit, round(1 - min(CASE WHEN m > 0 THEN none ELSE 1.0 END), 6) AS hit, round(sum(m * r / g) / sum(r), 6) AS precision FROM x GROUP BY unit""")
def d20_rank_at_k(spark, d):
    return E.rank_at_k(scores(spark, d), ["unit"], 5).select("unit", F.round("hit", 6).alias("hit"), F.round("precision", 6).alias("precision"))


@query("SELECT p_partkey, round(1 - exp(lgamma(60 - p_size + 1) - lgamma(60 - p_size - 7) - lgamma(61) + lgamma(53)), 6) AS chance FROM part WHERE p_size <= 50")
def d20b_hypergeometric_chance(spark, d):
    p = table(spark, d, "part").filter("p_size <= 50")
    return p.select("p_partkey", F.round(E.hypergeometric_chance(F.lit(60), F.col("p_size"), 8), 6).alias("chance"))


@query("SELECT p_size AS r, round(exp(sum(ln(p)) OVER (ORDER BY p_size)), 6) AS survival FROM (SELECT p_size, 1 - 1.0 / (10 + count(*)) AS p FROM part GROUP BY p_size)")
def d21_structural_null(spark, d):
    p = table(spark, d, "part").groupBy("p_size").agg((1 - 1.0 / (10 + F.count("*"))).alias("p"))  # a row per round
    return p.select(F.col("p_size").alias("r"), F.round(F.exp(F.sum(F.log("p")).over(Window.orderBy("p_size"))), 6).alias("survival"))


@query("SELECT depth, count(*) AS n, round(avg(late), 6) AS hit FROM (SELECT user_id, count(*) FILTER (value > 80) AS depth, max((value > 99)::INTEGER) AS late FROM events GROUP BY user_id) GROUP BY depth")
def d22_survival_histogram(spark, d):
    u = clicks(spark, d).groupBy("user_id").agg(F.count_if(F.col("value") > 80).alias("depth"), F.max((F.col("value") > 99).cast("int")).alias("late"))
    return u.groupBy("depth").agg(F.count("*").alias("n"), F.round(F.avg("late"), 6).alias("hit"))


@query(f"WITH {WINS}, u AS (SELECT user_id, avg(win) AS m, var_samp(win) AS v FROM wins GROUP BY user_id) SELECT round(avg(m), 6) AS mean, round(var_samp(m), 6) AS between, round(avg(v), 6) AS within, round(1.96 * sqrt(var_samp(m) / count(*)), 6) AS half_width FROM u")
def d24_variance_parts(spark, d):
    return E.variance_parts(wins(spark, d), "user_id", "win").select(*[F.round(c, 6).alias(c) for c in ("mean", "between", "within", "half_width")])


@query(f"""WITH {WINS}, n AS (SELECT n, sqrt(var_samp(m)) AS sd, count(*) AS cards FROM (SELECT n, user_id, avg(win) AS m FROM wins, range(1, 5) t(n) WHERE event_id % 4 < n GROUP BY ALL) GROUP BY n), f AS (SELECT regr_slope(sd * sd, 1.0 / n) AS slope, sqrt(greatest(regr_intercept(sd * sd, 1.0 / n), 0.0)) AS floor FROM n)
SELECT n::INTEGER AS n, round(sd, 6) AS sd, round(slope, 6) AS slope, round(floor, 6) AS floor, round(1.96 * floor / sqrt(cards), 6) AS half_width, round(2.8 * floor / sqrt(cards), 6) AS mde FROM n, f""")
def d25_variance_trend(spark, d):
    from corvane.plans.instruments import seed_power

    w = wins(spark, d).withColumn("seed", F.col("event_id") % 4)
    return seed_power(w, "user_id", "seed", "win", 4).select("n", *[F.round(c, 6).alias(c) for c in ("sd", "slope", "floor", "half_width", "mde")])


@query(f"""WITH {WINS}, k AS (SELECT user_id, sum(win) AS h, count(*) AS n, avg(win) AS p FROM wins GROUP BY user_id)
SELECT user_id, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM k""")
def d26_wilson(spark, d):
    k = wins(spark, d).groupBy("user_id").agg(F.sum("win").alias("h"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("h"), F.col("n"))
    return k.select("user_id", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_WILSON_LOW = "(h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query(f"""WITH {WINS}, {MEMBERS}, x AS (SELECT * FROM wins JOIN m USING (user_id)), c AS (SELECT event_type, cluster, sum(win) AS h, count(*) AS n FROM x GROUP BY ALL), pu AS (SELECT event_type, user_id, sum(win) AS h, count(*) AS n FROM x GROUP BY ALL),
a AS (SELECT event_type, sum(n)::BIGINT AS n, sum(h) / sum(n) AS mean, count(*) AS clusters, stddev_pop(h / n) AS sd, min(h / n) AS least, max(h / n) AS most, sqrt(sum(h) / sum(n) * (1 - sum(h) / sum(n)) / avg(n)) AS binomial_sd, count(*) FILTER ({_WILSON_LOW} > 0.5) AS leaky_clusters FROM c GROUP BY event_type),
b AS (SELECT event_type, count(*) AS persons, avg((h = n)::INTEGER) AS all_right, avg((h = 0)::INTEGER) AS none_right, count(*) FILTER ({_WILSON_LOW} > 0.5) AS leaky_persons FROM pu GROUP BY event_type)
SELECT event_type, n, clusters, leaky_clusters, persons, leaky_persons, round(mean, 6) AS mean, round(sd, 6) AS sd, round(least, 6) AS least, round(most, 6) AS most, round(binomial_sd, 6) AS binomial_sd, round(all_right, 6) AS all_right, round(none_right, 6) AS none_right FROM a JOIN b USING (event_type)""")
def d27_dispersion(spark, d):
    x = wins(spark, d).join(members(spark, d), "user_id")
    e = E.dispersion_detail(x, ["event_type"], "cluster", "user_id", "win")
    return e.select("event_type", "n", "clusters", "leaky_clusters", "persons", "leaky_persons", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "least", "most", "binomial_sd", "all_right", "none_right")])


@query(f"""WITH diffs AS (SELECT user_id, event_type, (value - 50) / 100 AS win FROM events), {_ci_sql('diffs', 'user_id', 'win', 200, '5', 'event_type')}, z AS (SELECT *, (hi - lo) / 3.92 AS se FROM est)
SELECT event_type, round(mean, 6) AS mean, round(se, 6) AS se, round(2.8 * se, 6) AS mde, CASE WHEN se = 0 THEN 'degenerate' WHEN mean + 1.644854 * se < 0.1 AND mean - 1.644854 * se > -0.1 THEN 'equivalent' WHEN lo > 0 OR hi < 0 THEN 'different' ELSE 'inconclusive' END AS verdict FROM z""")
def d28_equivalence(spark, d):
    diffs = clicks(spark, d).withColumn("win", (F.col("value") - 50) / 100)
    e = B.equivalence(B.cluster_ci(diffs, ["event_type"], "user_id", "win", 200, 5), 0.1)
    return e.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "se", "mde")], "verdict")


@query("""WITH z AS (SELECT event_type, greatest(-5, least(5, (value - 50) / 25)) AS z FROM events), c AS (SELECT event_type, z, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(40), lambda k: pow(z, 2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))) AS p FROM z)
SELECT event_type, round(avg(p), 4) AS mean, round(min(p), 4) AS least, round(max(p), 4) AS most, count(*) FILTER (p > 0.975) AS high FROM c GROUP BY event_type""")
def d28b_normal_cdf(spark, d):
    p = clicks(spark, d).select("event_type", normal_cdf(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col("value") - 50) / 25))).alias("p"))
    return p.groupBy("event_type").agg(F.round(F.avg("p"), 4).alias("mean"), F.round(F.min("p"), 4).alias("least"), F.round(F.max("p"), 4).alias("most"), F.count_if(F.col("p") > 0.975).alias("high"))


@query(f"""WITH {WINS}, {MEMBERS}, x AS (SELECT * FROM wins JOIN m USING (user_id)), a AS (WITH {_ci_sql('x', 'user_id', 'win', 200, '6')} SELECT hi < 0.6 AS ok FROM est), b AS (WITH {_ci_sql('x', 'cluster', 'win', 200, '6')} SELECT hi < 0.6 AS ok FROM est)
SELECT bool_and(ok) AS certified FROM (FROM a UNION ALL FROM b)""")
def d29_dual_certification(spark, d):
    x = wins(spark, d).join(members(spark, d), "user_id")
    both = B.cluster_ci(x, [], "user_id", "win", 200, 6).unionByName(B.cluster_ci(x, [], "cluster", "win", 200, 6))
    return both.agg(F.bool_and(F.col("hi") < 0.6).alias("certified"))


@query(f"WITH {WINS}, o AS (SELECT event_type, user_id, avg(win) FILTER (event_id % 2 = 0) AS o0, avg(win) FILTER (event_id % 2 = 1) AS o1 FROM wins GROUP BY ALL) SELECT event_type, round(avg((coalesce(o0, o1) + coalesce(o1, o0)) / 2), 6) AS value, round(avg(o1 - o0), 6) AS position FROM o GROUP BY event_type")
def d30_forced_choice_units(spark, d):
    side = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("win")))
    o = wins(spark, d).groupBy("event_type", "user_id").agg(side(0).alias("o0"), side(1).alias("o1"))
    return o.groupBy("event_type").agg(F.round(F.avg((F.coalesce("o0", "o1") + F.coalesce("o1", "o0")) / 2), 6).alias("value"), F.round(F.avg(F.col("o1") - F.col("o0")), 6).alias("position"))


@query("SELECT l_orderkey, round(avg((a = b)::INTEGER), 6) AS agreement FROM (SELECT l_orderkey, l_suppkey % 2 AS a, l_partkey % 2 AS b FROM lineitem) GROUP BY l_orderkey")
def d31_agreement(spark, d):
    same = (F.col("l_suppkey") % 2 == F.col("l_partkey") % 2).cast("int")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(same), 6).alias("agreement"))


@query(f"""WITH {MEMBERS}, w AS (SELECT 'w' || (event_id % 3) AS tag, event_type AS x, user_id AS unit, (value > 50)::INTEGER::DOUBLE AS value FROM events), k AS (SELECT tag, CASE WHEN tag = 'w1' AND x = 'view' THEN 'look' ELSE x END AS x, unit, value FROM w WHERE NOT (tag = 'w2' AND x = 'click')),
fc AS (SELECT tag, x, unit, cluster, avg(value) AS value FROM k JOIN m ON m.user_id = k.unit GROUP BY ALL), {_ci_sql('fc', 'cluster', 'value', 200, '0', 'x')}, t AS (SELECT x, count(*) AS units FROM fc GROUP BY x), z AS (SELECT *, (hi - lo) / 3.92 AS se FROM est JOIN t USING (x))
SELECT x, 'base' AS y, units AS n_units, round(mean, 6) AS win, round(lo, 6) AS lo, round(hi, 6) AS hi, round(se, 6) AS se, round(2.8 * se, 6) AS mde, lo > 0.4 AS noninferior,
CASE WHEN lo > 0.5 THEN 'x better' WHEN hi < 0.5 THEN 'y better' WHEN mean - 1.645 * se > 0.4 AND mean + 1.645 * se < 0.6 AND 2.8 * se < 0.1 THEN 'tie' WHEN 2.8 * se >= 0.1 THEN 'underpowered' ELSE 'inconclusive' END AS verdict FROM z""")
def d32_waves_with_aliases(spark, d):
    from corvane.plans.instruments import pooled_waves

    w = wins(spark, d).join(members(spark, d), "user_id").select(F.concat(F.lit("w"), F.col("event_id") % 3).alias("tag"), F.col("event_type").alias("x"), F.lit("base").alias("y"), F.col("user_id").alias("unit"), "cluster", F.col("win").alias("value"))
    p = pooled_waves(w, [("w2", "click", "base")], [("w1", "view", "base", "look", "base")], "cluster", 200)
    return p.select("x", "y", "n_units", "noninferior", "verdict", *[F.round(c, 6).alias(c) for c in ("win", "lo", "hi", "se", "mde")])


_SUPPORT = f"{ELEMENTS}, sup AS (SELECT a.cluster, a.item, 1 + count(DISTINCT b.owner) AS support FROM elements a LEFT JOIN elements b ON a.cluster = b.cluster AND a.owner <> b.owner AND round(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) >= 0.2 GROUP BY ALL)"


def support(spark, d, least=0.2):
    from corvane.operators.pairing import best_match

    e = elements(spark, d)
    m = best_match(e, e, "cluster", "owner", "item").filter(F.round("best", 6) >= least)
    s = m.groupBy("cluster", "item").agg(F.count_distinct("other").alias("n"))
    return e.select("cluster", "item").join(s, ["cluster", "item"], "left").select("cluster", "item", (1 + F.coalesce("n", F.lit(0))).alias("support"))


@query(f"WITH {_SUPPORT} SELECT least(support, 8) AS support, count(*) AS n FROM sup GROUP BY ALL")
def d33_support_histogram(spark, d):
    return support(spark, d).groupBy(F.least("support", F.lit(8)).alias("support")).agg(F.count("*").alias("n"))


@query(f"WITH {ELEMENTS} SELECT a.owner, round(avg(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])), 5) AS vacuity FROM elements a JOIN elements b ON a.owner = b.owner AND a.item < b.item GROUP BY a.owner")
def d38_mean_pairwise_cosine(spark, d):
    # the sum over all pairs is half of |sum of vectors|^2 less the count: no pairs are made
    e = elements(spark, d).select("owner", "item", F.posexplode("vec").alias("k", "x"), F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"))
    sums = e.groupBy("owner", "k").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("own"), F.count("*").alias("n"))
    t = sums.groupBy("owner").agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"), F.first("n").alias("n"))
    return t.filter("n > 1").select("owner", F.round((F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1)), 5).alias("vacuity"))


@query("SELECT source, round(100 * sum(n_lines) / sum(n_words), 6) AS per_100 FROM (SELECT source, len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n_words FROM documents) GROUP BY source")
def d39_per_100_words(spark, d):
    from corvane.functions.text import words

    t = table(spark, d, "documents").select("source", F.size(F.split("text", "\n")).alias("l"), F.size(words(F.col("text"))).alias("w"))
    return t.groupBy("source").agg(F.round(100 * F.sum("l") / F.sum("w"), 6).alias("per_100"))


@query(f"WITH {ELEMENTS}, m AS (SELECT a.item, b.owner AS other, max(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])) AS best FROM elements a JOIN elements b ON a.cluster = b.cluster AND a.item <> b.item GROUP BY ALL), i AS (SELECT item, count(*) FILTER (round(best, 6) >= .25) AS n, max(best) AS top FROM m GROUP BY item) SELECT n AS n_members, count(*) AS items, round(avg(top), 5) AS top FROM i GROUP BY n")
def d40_census(spark, d):
    from corvane.operators.pairing import block_best

    e = elements(spark, d)
    m = block_best(e, e, "cluster", ["item"], "owner", ("item", "item")).groupBy("item", "other").agg(F.max("best").alias("best"))
    i = m.groupBy("item").agg(F.count_if(F.round("best", 6) >= 0.25).alias("n"), F.max("best").alias("top"))
    return i.groupBy(F.col("n").alias("n_members")).agg(F.count("*").alias("items"), F.round(F.avg("top"), 5).alias("top"))


@query(f"""WITH {ELEMENTS}, r AS (SELECT *, (item // 25) % 3 AS side FROM elements), n AS (SELECT cluster, least(count(*) FILTER (side = 1), count(*) FILTER (side = 2)) AS k FROM r GROUP BY cluster),
p AS (SELECT * FROM (SELECT cluster, side, item, vec, row_number() OVER (PARTITION BY cluster, side ORDER BY sha1('shuf|e1a|' || cluster || '|' || item), item) AS rn FROM r WHERE side > 0) JOIN n USING (cluster) WHERE rn <= k),
b AS (SELECT c.cluster, c.item, round(max(list_dot_product(c.vec::DOUBLE[], p.vec::DOUBLE[])) FILTER (p.side = 1), 6) AS m, round(max(list_dot_product(c.vec::DOUBLE[], p.vec::DOUBLE[])) FILTER (p.side = 2), 6) AS s FROM r c JOIN p USING (cluster) WHERE c.side = 0 GROUP BY ALL)
SELECT tau::DOUBLE AS tau, count(*) AS n_lines, round(avg((m >= tau)::INTEGER), 6) AS member, round(avg((s >= tau)::INTEGER), 6) AS stranger, round(avg((m >= tau)::INTEGER) - avg((s >= tau)::INTEGER), 6) AS gap FROM b, (VALUES (0.1), (0.15), (0.2), (0.25), (0.3), (0.7), (0.95)) t(tau) GROUP BY tau""")
def d41_threshold_sweep(spark, d):
    from corvane.plans.instruments import threshold_sweep

    side = lambda k: elements(spark, d).filter(f"(item div 25) % 3 = {k}").select("cluster", "item", "vec")
    t = threshold_sweep(side(0), side(1), side(2), [0.1, 0.15, 0.2, 0.25, 0.3, 0.7, 0.95], "e1a")
    return t.select("tau", "n_lines", *[F.round(c, 6).alias(c) for c in ("member", "stranger", "gap")])


@query("SELECT user_id, round(list_avg(list_sort(list(value), 'DESC')[1:5]), 6) AS top5mean, max(value) AS top, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def d42_tier_aggregates(spark, d):
    top = F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, 5)
    g = clicks(spark, d).groupBy("user_id").agg(top.alias("t"), F.max("value").alias("top"), F.avg("value").alias("mean"))
    mean5 = F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.size("t")
    return g.select("user_id", F.round(mean5, 6).alias("top5mean"), "top", F.round("mean", 6).alias("mean"))


@query(r"""WITH t AS (SELECT doc_id, text AS a, regexp_replace(text, '\d+', '[n]', 'g') AS b FROM documents), w AS (SELECT *, regexp_extract_all(lower(a), '[a-z'']+') AS wa, regexp_extract_all(lower(b), '[a-z'']+') AS wb FROM t),
g AS (SELECT *, list_distinct(CASE WHEN len(wa) >= 6 THEN list_transform(range(1, len(wa) - 4), lambda i: array_to_string(wa[i:i + 5], ' ')) ELSE [] END) AS ga, CASE WHEN len(wb) >= 6 THEN list_transform(range(1, len(wb) - 4), lambda i: array_to_string(wb[i:i + 5], ' ')) ELSE [] END AS gb FROM w)
SELECT doc_id, trim(a, ' ' || chr(10) || chr(9) || chr(13)) = trim(b, ' ' || chr(10) || chr(9) || chr(13)) AS same, round(len(list_intersect(ga, gb)) / nullif(len(ga), 0), 6) AS kept6, round(len(wb) / greatest(1, len(wa)), 6) AS length_ratio FROM g""")
def d43_no_op_census(spark, d):
    new = F.regexp_replace("text", r"\d+", "[n]")
    return O.rewrite_census(table(spark, d, "documents").select("doc_id", "text", new.alias("new")), ["doc_id"], "text", "new").select("doc_id", "same", F.round("kept6", 6).alias("kept6"), F.round("length_ratio", 6).alias("length_ratio"))


@query()
def d43b_word_similarity(spark, d):
    from corvane.operators.ratio import similarity_ratio

    docs = table(spark, d, "documents")
    new = docs.select("lang", words(F.col("text")).alias("a"), words(F.regexp_replace("text", r"(?m)^[^.\n]{0,40}\.", "")).alias("b"))
    r = new.select("lang", similarity_ratio("a", "b", popular=True).alias("r"))
    return r.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("r"), 4).alias("wordsim_mean"), F.round(F.median("r"), 4).alias("wordsim_median"))


@query("SELECT lang, count(*) AS n, round(avg((n_chars < 500)::INTEGER), 6) AS drop_rate, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def d44_rate_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("n_chars") < 500).cast("int")), 6).alias("drop_rate"), F.sum("n_chars").alias("chars"))


@query("SELECT event_type, round(sum((m - g) * (m - g)) / sum((value - g) * (value - g)), 6) AS share FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS g, avg(value) OVER (PARTITION BY event_type, user_id) AS m FROM events) GROUP BY event_type")
def d45_variance_share(spark, d):
    e = clicks(spark, d).withColumns({"g": F.avg("value").over(Window.partitionBy("event_type")), "m": F.avg("value").over(Window.partitionBy("event_type", "user_id"))})
    sq = lambda a: F.sum((F.col(a) - F.col("g")) * (F.col(a) - F.col("g")))
    return e.groupBy("event_type").agg(F.round(sq("m") / sq("value"), 6).alias("share"))


@query("""WITH c AS (SELECT source, count(*) AS n, count(l.doc_id) AS got FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source), a AS (SELECT 1 - sum(got) / sum(n) AS all_miss FROM c)
SELECT source, n, got, n >= 3 AND 1 - got / n > 3 * all_miss AS skewed, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)
 JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) USING (o_custkey) JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS y FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) USING (o_custkey) WHERE x <> y) AS conflicts FROM c, a""")
def d46_skewed_dropout(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("g")), "doc_id", "left")
    c = docs.groupBy("source").agg(F.count("*").alias("n"), F.count("g").alias("got"))
    a = c.agg((1 - F.sum("got") / F.sum("n")).alias("all_miss"))
    # answers of one customer that differ between two generations
    last = lambda k, name: table(spark, d, "orders").filter(f"o_orderkey % 2 = {k}").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias(name))
    conflicts = last(0, "x").join(last(1, "y"), "o_custkey").agg(F.count_if(F.col("x") != F.col("y")).alias("conflicts"))
    skewed = (F.col("n") >= 3) & (1 - F.col("got") / F.col("n") > 3 * F.col("all_miss"))
    return c.join(F.broadcast(a)).join(F.broadcast(conflicts)).select("source", "n", "got", skewed.alias("skewed"), "conflicts")


def linkage_records(spark, d):
    """Pairs of documents as matched pairs of cards, two channels: even ids against odd ones, the last two of ten as controls."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.expr("doc_id div 2").alias("mi"), F.col("source").alias("cluster"), (F.col("doc_id") * 7 % 3 % 2).cast("int").alias("n6"), F.when(F.col("doc_id") % 10 >= 8, "ctrl").when(F.col("doc_id") % 2 == 0, "pos").otherwise("neg").alias("kind"), "n_chars")
    p = lambda x: (x % 51 + 50) / 100.0
    one = docs.select(F.lit("ne").alias("channel"), "pid", "mi", "cluster", "n6", "kind", p(F.col("n_chars") + 9 * (F.col("kind") == "pos").cast("int")).alias("p"))
    return one.unionByName(docs.select(F.lit("v6").alias("channel"), "pid", "mi", "cluster", "n6", "kind", p(F.col("n_chars") * 3).alias("p")))


_LINKAGE = """base AS (SELECT doc_id AS pid, doc_id // 2 AS mi, source AS cluster, doc_id * 7 % 3 % 2 AS n6, CASE WHEN doc_id % 10 >= 8 THEN 'ctrl' WHEN doc_id % 2 = 0 THEN 'pos' ELSE 'neg' END AS kind, n_chars FROM documents),
rec AS (SELECT 'ne' AS channel, pid, mi, cluster, n6, kind, ((n_chars + CASE kind WHEN 'pos' THEN 9 ELSE 0 END) % 51 + 50) / 100 AS p FROM base UNION ALL SELECT 'v6', pid, mi, cluster, n6, kind, (n_chars * 3 % 51 + 50) / 100 FROM base),
lab AS (SELECT * FROM rec WHERE kind <> 'ctrl'), wins AS (SELECT x.channel, x.cluster AS i, y.cluster AS j, x.mi AS xm, y.mi AS ym, CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0.0 END AS w, CASE WHEN x.n6 > y.n6 THEN 1.0 WHEN x.n6 = y.n6 THEN 0.5 ELSE 0.0 END AS w6 FROM lab x JOIN lab y ON x.channel = y.channel AND x.kind = 'pos' AND y.kind = 'neg'),
un AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS u, count(*) OVER () AS n_units FROM (SELECT DISTINCT cluster FROM lab)),
mat AS (SELECT channel, a.u AS i, b.u AS j, sum(w) AS w FROM wins JOIN un a ON a.cluster = wins.i JOIN un b ON b.cluster = wins.j GROUP BY ALL),
dr AS ({draws}), sz AS (SELECT b, sum(w * np) AS np, sum(w * nn) AS nn FROM dr JOIN (SELECT u, count(*) FILTER (kind = 'pos') AS np, count(*) FILTER (kind = 'neg') AS nn FROM lab JOIN un USING (cluster) WHERE channel = 'ne' GROUP BY u) USING (u) GROUP BY b),
reps AS (SELECT channel, x.b, sum(x.w * y.w * mat.w) / any_value(np * nn) AS auc FROM mat JOIN dr x ON x.u = mat.i JOIN dr y ON y.u = mat.j AND y.b = x.b JOIN sz ON sz.b = x.b GROUP BY ALL)"""


def _linkage_sql() -> str:
    return _LINKAGE.replace("{draws}", draws_sql("un", 60, "0"))


@query(f"""WITH {_linkage_sql()}, free AS (SELECT channel, mi FROM lab GROUP BY ALL HAVING max(n6) = 0 AND count(DISTINCT kind) = 2), ci AS (SELECT channel, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM reps GROUP BY channel),
au AS (SELECT channel, avg(w) AS auc, avg(w6) AS rare6 FROM wins GROUP BY channel), vf AS (SELECT wins.channel, avg(w) AS vf_auc FROM wins JOIN free a ON a.channel = wins.channel AND a.mi = xm JOIN free b ON b.channel = wins.channel AND b.mi = ym GROUP BY wins.channel)
SELECT channel, round(auc, 6) AS auc, round(lo, 6) AS lo, round(hi, 6) AS hi, round(rare6, 6) AS rare6, round(vf_auc, 6) AS vf_auc, (SELECT count(*) FROM free WHERE free.channel = au.channel) AS n_vf, round((SELECT avg(p) FROM rec WHERE kind = 'ctrl' AND rec.channel = au.channel), 6) AS ctrl_mean,
(SELECT count(*) FROM lab WHERE kind = 'pos' AND lab.channel = au.channel) AS n_pos, (SELECT count(*) FROM rec WHERE kind = 'ctrl' AND rec.channel = au.channel) AS n_ctrl FROM au JOIN ci USING (channel) JOIN vf USING (channel)""")
def d47b_linkage_channels(spark, d):
    from corvane.plans.linkage import channel_scores

    s = channel_scores(linkage_records(spark, d), ["ne", "v6"], 60, 0)
    return s.select("channel", *[F.round(c, 6).alias(c) for c in ("auc", "lo", "hi", "rare6", "vf_auc", "ctrl_mean")], "n_vf", "n_pos", "n_ctrl")


@query(f"""WITH {_linkage_sql()}, ds AS (SELECT a.auc - b.auc AS d FROM reps a JOIN reps b ON a.b = b.b AND a.channel = 'ne' AND b.channel = 'v6')
SELECT round((SELECT avg(w) FILTER (channel = 'ne') - avg(w) FILTER (channel = 'v6') FROM wins), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, (SELECT count(*) FROM un) AS clusters,
CASE WHEN quantile_cont(d, 0.025) > 0 THEN 'second less linkable' WHEN quantile_cont(d, 0.975) < 0 THEN 'second more linkable' ELSE 'no paired difference' END AS reading FROM ds""")
def d47c_paired_difference(spark, d):
    from corvane.plans.linkage import paired_difference

    s = paired_difference(linkage_records(spark, d), "ne", "v6", 60, 0)
    return s.select(*[F.round(c, 6).alias(c) for c in ("difference", "lo", "hi")], "clusters", "reading")


@query(f"""WITH {SCORES}, q AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS u, count(*) OVER () AS n_units FROM (SELECT DISTINCT unit FROM scores)), d AS ({draws_sql('q', 40, '8')}),
w AS (SELECT b, s.score, s.label, w FROM d JOIN q USING (u) JOIN scores s USING (unit)),
p AS (SELECT x.b, sum(x.w * y.w * CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) / sum(x.w * y.w) AS auc FROM w x JOIN w y ON x.b = y.b WHERE x.label = 1 AND y.label = 0 GROUP BY x.b)
SELECT b, round(auc, 6) AS auc FROM p""")
def d47_auc_replicates(spark, d):
    return B.auc_replicates(scores(spark, d), "unit", 40, 8).filter("auc IS NOT NULL").select("b", F.round("auc", 6).alias("auc"))


_ELEMENTS = "[" + ", ".join(f"'{p}'" for p in CONCRETE_ELEMENTS) + "]"


@query(rf"""SELECT doc_id, round(100 * len(regexp_extract_all(text, '{NAMED}')) / n, 6) AS named, round(100 * len(regexp_extract_all(text, '{NUMBERED}')) / n, 6) AS num, round(100 * len(regexp_extract_all(text, '{CONDITIONAL}')) / n, 6) AS cond,
round(list_sum(list_transform({_ELEMENTS}, lambda p: regexp_matches(lower(text), p)::INTEGER)) / {len(CONCRETE_ELEMENTS)}, 6) AS mechanical FROM (SELECT doc_id, regexp_replace(text, '[\x{{C0}}-\x{{24F}}]', '_', 'g') AS text, greatest(1, len(regexp_extract_all(text, '\S+'))) AS n FROM documents)""")
def d48_concreteness(spark, d):
    from corvane.functions.text import word_count

    n = F.greatest(F.lit(1), word_count(F.col("text")))
    rate = lambda pattern, name: F.round(100 * F.regexp_count("text", F.lit(pattern)) / n, 6).alias(name)
    return table(spark, d, "documents").select("doc_id", rate(NAMED, "named"), rate(NUMBERED, "num"), rate(CONDITIONAL, "cond"), F.round(mechanical_coverage(F.col("text")), 6).alias("mechanical"))


@query("SELECT event_type, user_id % 3 AS seed, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type, user_id % 3), (event_type), ())")
def d49_grouping_sets(spark, d):
    e = clicks(spark, d).withColumn("seed", F.col("user_id") % 3)
    return e.groupingSets([["event_type", "seed"], ["event_type"], []], "event_type", "seed").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT source, round((avg((n_chars > 1500)::INTEGER) - 1.0 / 20) / (1 - 1.0 / 20), 6) AS lift FROM documents GROUP BY source")
def d50_normalised_lift(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round((F.avg((F.col("n_chars") > 1500).cast("int")) - 1 / 20) / (1 - 1 / 20), 6).alias("lift"))


@query("SELECT min(v) AS lo, quantile_cont(v, 0.5) AS mid, max(v) AS hi FROM (SELECT user_id % 10 AS s, round(avg((value > 50)::INTEGER), 6) AS v FROM events GROUP BY 1)")
def d51_floor_sweep(spark, d):
    v = wins(spark, d).groupBy((F.col("user_id") % 10).alias("s")).agg(F.round(F.avg("win"), 6).alias("v"))
    return v.agg(F.min("v").alias("lo"), F.expr("percentile(v, 0.5)").alias("mid"), F.max("v").alias("hi"))


@query("SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS rate FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def d52_base_rates(spark, d):
    c = clicks(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.select("user_id", "event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("rate"))

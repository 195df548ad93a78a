"""Windows, ranking and sequencing (E), and what needs Python (I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog.base import LINES, benchmark, clicks, corpus, document_lines, elements, grams_sql, pool, query, table, words_sql
from corvane.functions.numeric import hash_key, hash_number
from corvane.operators import overlap as O
from corvane.operators import pairing as P
from corvane.operators import selection as G
from corvane.operators import sequencing as Q
from corvane.sources.stores import settled

_USERS = "u AS (SELECT DISTINCT user_id FROM events)"


@query()
def e07b_text_kmeans(spark, d):
    return G.text_kmeans(table(spark, d, "documents"), "doc_id", "text", 8, 20, 600, 0)


@query(f"WITH {_USERS} SELECT user_id, row_number() OVER (ORDER BY sha1('shuf|7|' || user_id), user_id) AS place FROM u")
def e01_hash_shuffle(spark, d):
    return Q.shuffled(clicks(spark, d).select("user_id").distinct(), [], "user_id", 7)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('pick|' || source || '|' || doc_id), doc_id) AS r FROM documents) WHERE r > 2 AND r <= 5")
def e02_rank_slice(spark, d):
    return P.hash_pick(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 3, "pick", skip=2).select("source", "doc_id")


@query("""WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha1('shuf|e|' || event_type || '|' || event_id), event_id) AS place, ceil(count(*) OVER (PARTITION BY event_type) / 8.0)::INTEGER AS n FROM events)
SELECT event_type, gidx, count(*) AS size FROM (SELECT event_type, place, (place - 1 - CASE WHEN place - 1 < (c % n) * (c // n + 1) THEN 0 ELSE c % n END) // CASE WHEN place - 1 < (c % n) * (c // n + 1) THEN c // n + 1 ELSE c // n END AS gidx FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS c FROM p)) GROUP BY ALL""")
def e03_even_groups(spark, d):
    placed = Q.shuffled(clicks(spark, d).select("event_type", "event_id"), ["event_type"], "event_id", "e", wide=True)
    return Q.even_groups(placed, ["event_type"], wide=True).groupBy("event_type", F.col("gidx").cast("long").alias("gidx")).agg(F.count("*").alias("size"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY n_chars, doc_id) - 1) % 7)::INTEGER AS batch FROM documents")
def e04_round_robin(spark, d):
    return Q.round_robin(table(spark, d, "documents").select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")], 7).select("doc_id", "batch")


@query(f"WITH {_USERS} SELECT user_id, least((row_number() OVER (ORDER BY sha1('shuf|g|' || user_id), user_id) - 1) // 8, greatest(count(*) OVER () // 8 - 1, 0))::INTEGER AS cluster FROM u")
def e05_random_groups(spark, d):
    return Q.random_groups(clicks(spark, d).select("user_id").distinct(), "user_id", 8, "g").select("user_id", "cluster")


@query()
def e06_knn_groups(spark, d):
    return G.vector_groups(elements(spark, d).withColumnRenamed("cluster", "pool"), "pool", "item", "vec", 8, nearest=True)


@query()
def e06b_diverse_groups(spark, d):
    return G.vector_groups(elements(spark, d).withColumnRenamed("owner", "label"), "label", "item", "vec", 8, nearest=False)


@query()
def e07_balanced_kmeans(spark, d):
    return G.balanced_kmeans(elements(spark, d), "item", "vec", k=10, least=20)


@query(f"""WITH {LINES}, h AS (SELECT doc_id, line_no, pos FROM line_grams SEMI JOIN pool USING (gram)), n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, line_no ORDER BY pos) <= 6 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS run FROM n) SELECT doc_id, line_no, min(pos) AS first, max(pos) + 5 AS last, max(pos) + 6 - min(pos) AS n_words FROM r GROUP BY doc_id, line_no, run""")
def e08_merged_runs(spark, d):
    hits = O.positioned_grams(document_lines(spark, d), ["doc_id", "line_no"], "line", 6).join(O.sent(pool(spark, d)), "gram", "left_semi")
    return O.merged_runs(hits, ["doc_id", "line_no"], 6).select("doc_id", "line_no", "first", "last", "n_words")


@query("SELECT user_id, arg_max(event_type, (event_id % 3, event_id)) AS choice FROM events GROUP BY user_id")
def e09_last_record(spark, d):
    e = clicks(spark, d).select("user_id", "event_type", "event_id", (F.col("event_id") % 3).alias("file"))
    return P.last_record(e, "user_id", ["file", "event_id"]).select("user_id", F.col("event_type").alias("choice"))


@query("SELECT user_id, arg_max(event_type, (value, event_id)) AS best, max(value) AS top FROM events GROUP BY user_id")
def e10_argmax(spark, d):
    return clicks(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("best"), F.max("value").alias("top"))


def tournament(spark, d):
    """groups and winners of all rounds: brackets are event types, candidates users, the answerer prefers a hash."""
    cand = clicks(spark, d).select(F.col("event_type").alias("bid"), F.col("user_id").cast("long").alias("candidate")).distinct()
    cand = settled(cand)
    most = cand.groupBy("bid").count().agg(F.max("count")).first()[0] or 0
    rounds = 1
    while 8**rounds < most:  # groups of eight, until the largest bracket has one winner
        rounds += 1
    groups, won, every, all_won = Q.grouped(cand, 1, wide=most > Q.WIDE), None, None, None
    for r in range(1, rounds + 1):
        groups = settled(groups)
        pick = groups.withColumn("h", hash_number("pref", F.col("candidate")))
        best = pick.groupBy("bid", "round", "gidx").agg(F.max_by("slot", F.struct("h", "candidate")).alias("slot"), F.max("h").alias("h"))
        answers = best.select("bid", "round", "gidx", F.chr(F.lit(65) + F.col("slot")).alias("choice"), (50 + F.col("h") % 50).cast("double").alias("conf"))
        won = Q.winners(groups, answers)
        every = groups if every is None else every.unionByName(groups)
        all_won = won if all_won is None else all_won.unionByName(won)
        if r < rounds:
            groups = Q.next_round(won, r + 1, wide=most > Q.WIDE)
    return every, all_won


@query("SELECT event_type AS bid, arg_max(user_id, (('0x' || substr(sha1('pref|' || user_id), 1, 8))::BIGINT, user_id)) AS winner FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type")
def e11_knockout(spark, d):
    groups, won = tournament(spark, d)
    last = won.groupBy("bid").agg(F.max("round").alias("round"))
    return won.join(last, ["bid", "round"]).select("bid", "winner")


@query()
def d23_candidate_scores(spark, d):
    groups, won = tournament(spark, d)
    return Q.candidate_scores(groups, won)


@query(f"""WITH {LINES}, s AS (SELECT item_id, item_id % 8 AS author, unnest(range(len(w) - 5)) AS pos_b, unnest({grams_sql('w', 6)}) AS gram FROM (SELECT item_id, {words_sql('text')} AS w FROM benchmark) WHERE len(w) >= 6),
m AS (SELECT l.doc_id, l.line_no, s.author, s.item_id, l.pos, l.pos - s.pos_b AS diagonal FROM line_grams l JOIN s USING (gram)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line_no, item_id, diagonal ORDER BY pos) AS island FROM m),
r AS (SELECT doc_id, author, count(*) + 5 AS run FROM i GROUP BY doc_id, line_no, author, item_id, diagonal, island) SELECT doc_id, author, least(max(run), 20) AS s4 FROM r GROUP BY doc_id, author""")
def e12_longest_shared_run(spark, d):
    src = benchmark(spark, d).withColumn("author", F.col("item_id") % 8)
    return O.longest_shared_run(document_lines(spark, d), "doc_id", src, "author", 6)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('shuf|rr|' || source || '|' || doc_id), doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 50")
def e13_round_robin_groups(spark, d):
    return Q.round_robin_groups(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 50, "rr").select("source", "doc_id")


@query("SELECT l_orderkey, l_linenumber, ((('0x' || substr(sha1('fc|' || l_orderkey), 1, 8))::BIGINT + (l_linenumber % 2) * 5) % 10)::INTEGER AS batch FROM lineitem")
def e14_order_batches(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", F.lit("fc"), "l_orderkey").alias("pair"), (F.col("l_linenumber") % 2).alias("order"))
    return Q.order_batches(li, 10, F.col("pair")).select("l_orderkey", "l_linenumber", "batch")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 4 AS targeted, row_number() OVER (PARTITION BY user_id ORDER BY sha1('abl|' || user_id || '|' || event_id), event_id) <= 4 AS random FROM events")
def e15_ablation(spark, d):
    w = Window.partitionBy("user_id")
    return clicks(spark, d).select("user_id", "event_id", (F.row_number().over(w.orderBy(F.desc("value"), "event_id")) <= 4).alias("targeted"), (F.row_number().over(w.orderBy(hash_key("abl", F.col("user_id"), F.col("event_id")), "event_id")) <= 4).alias("random"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 12")
def e16_prolific_first(spark, d):
    return clicks(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(12)


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id), r AS (SELECT e.user_id, event_type, event_id, row_number() OVER (PARTITION BY e.user_id, event_type ORDER BY sha1('shuf|m|' || e.user_id || '|' || event_type || '|' || event_id), event_id) AS rn, least(a, b) AS k FROM events e JOIN c USING (user_id) WHERE event_type IN ('click', 'view'))
SELECT user_id, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM r WHERE rn <= k GROUP BY ALL""")
def e17_matched_counts(spark, d):
    e = clicks(spark, d).filter("event_type IN ('click', 'view')").select("user_id", "event_type", "event_id")
    w = Window.partitionBy("user_id")
    k = F.least(F.count_if(F.col("event_type") == "click").over(w), F.count_if(F.col("event_type") == "view").over(w))
    s = Q.hash_sample(e.withColumn("k", k), ["user_id", "event_type"], "event_id", F.col("k"), "m")
    return s.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT user_id, event_id, max(value) OVER w AS top, min(value) OVER w AS low, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def e18_running_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return clicks(spark, d).select("user_id", "event_id", F.max("value").over(w).alias("top"), F.min("value").over(w).alias("low"), F.round(F.sum("value").over(w), 6).alias("total"))


@query()
def i09_token_blocks(spark, d):
    from corvane.functions.text import uwords

    docs = corpus(spark, d).select("doc_id", "author", "pos", uwords(F.col("text")).alias("t"))
    pairs = docs.filter("pos % 2 = 0").select("author", F.col("pos").alias("p"), F.col("doc_id").alias("x"), F.col("t").alias("a")).join(docs.filter("pos % 2 = 1").select("author", (F.col("pos") - 1).alias("p"), F.col("doc_id").alias("y"), F.col("t").alias("b")), ["author", "p"])
    return O.longest_token_block(pairs.select("x", "y", "a", "b"), ["x", "y"], "a", "b")


@query()
def i09b_similarity_ratio(spark, d):
    from corvane.functions.text import uwords

    turns = table(spark, d, "conversations").select("conv_id", "turn", uwords(F.col("text")).alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b"))
    return turns.withColumnRenamed("w", "a").join(after, ["conv_id", "turn"]).select("conv_id", "turn", G.similarity_ratio("a", "b").alias("ratio"))


@query("SELECT page_id, len(string_split(url, '/')) AS n FROM pages")
def i06_line_explode(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.split("url", "/")).alias("part")).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT doc_id, unnest({grams_sql('w', 6)}) AS run FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents))
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(n.n, 0) AS n_runs, coalesce(n.k, 0) AS n_distinct FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT run) AS k FROM r GROUP BY doc_id) n USING (doc_id)""")
def i06b_table_functions(spark, d):
    from corvane.functions.tables import register

    register(spark)
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("table_function_texts")
    return spark.sql("""WITH l AS (SELECT d.doc_id, count(*) AS n_lines FROM table_function_texts d, LATERAL text_lines(d.text) GROUP BY d.doc_id),
        r AS (SELECT key AS doc_id, count(*) AS n_runs, count_if(fresh) AS n_distinct FROM word_runs(TABLE(table_function_texts) PARTITION BY (doc_id), 'doc_id', 'text', 6, TRUE) GROUP BY key)
        SELECT doc_id, n_lines, coalesce(n_runs, 0L) AS n_runs, coalesce(n_distinct, 0L) AS n_distinct FROM l LEFT JOIN r USING (doc_id)""")


@query()
def i05_html_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", G.unescaped(F.regexp_replace("html", "<[^>]+>", " ")).alias("text"))

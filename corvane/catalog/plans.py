"""Composite pipelines (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.aggregates import WINS, _ci_sql, wins
from corvane.catalog.base import CORPUS, ELEMENTS, LINES, SCORES, benchmark, clicks, corpus, document_lines, elements, grams_sql, pool, query, scores, table, words_sql
from corvane.catalog.pairs import MEMBERS, members
from corvane.catalog.text import _CONTENT
from corvane.functions import text as T
from corvane.operators import estimators as E
from corvane.operators import overlap as O
from corvane.operators import pairing as P
from corvane.operators import resampling as B
from corvane.plans import acceptance as A
from corvane.plans import forced_choice as C
from corvane.plans import instruments as I
from corvane.plans import linkage as L
from corvane.plans import sanitize as S
from corvane.sources.stores import settled

KEYS = ["doc_id", "line_no"]


@query(f"WITH {LINES}, h AS (SELECT DISTINCT doc_id, line_no FROM line_grams SEMI JOIN pool USING (gram)) SELECT author, count(*) AS n_lines, count(h.doc_id) AS n_hit, round(count(h.doc_id) / count(*), 6) AS share FROM lines LEFT JOIN h USING (doc_id, line_no) GROUP BY author")
def k04_lexical_certificate(spark, d):
    return O.certificate(document_lines(spark, d), "author", KEYS, pool(spark, d), 6)


_ROUTES = f"""{LINES}, h AS (SELECT doc_id, line_no, pos FROM line_grams SEMI JOIN pool USING (gram)), n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, line_no ORDER BY pos) <= 6 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS run FROM n), c AS (SELECT doc_id, line_no, sum(w) AS covered FROM (SELECT doc_id, line_no, max(pos) + 6 - min(pos) AS w FROM r GROUP BY doc_id, line_no, run) GROUP BY ALL),
routed AS (SELECT l.doc_id, l.line_no, CASE WHEN covered IS NULL THEN 'verbatim' WHEN covered / len(w) > 0.9 THEN 'rewrite' ELSE 'edit' END AS route, coalesce(covered, 0) AS covered FROM lines l LEFT JOIN c USING (doc_id, line_no))"""


@query(f"WITH {_ROUTES} SELECT doc_id, line_no, route, covered FROM routed")
def k01_routes(spark, d):
    return S.routes(document_lines(spark, d), KEYS, pool(spark, d)).select("doc_id", "line_no", "route", "covered")


@query()
def k01_sanitize(spark, d):
    return S.sanitized(document_lines(spark, d), KEYS, pool(spark, d))


@query(f"WITH {_ROUTES} SELECT count(*) AS n_lines, 0 AS n_hit FROM routed WHERE true")
def k01_certificate_after(spark, d):
    lines = document_lines(spark, d)
    out = S.sanitized(lines, KEYS, pool(spark, d))
    after = out.filter("text IS NOT NULL").select(*KEYS, F.col("text").alias("line"))
    hit = O.lines_hit(after, KEYS, pool(spark, d)).withColumn("h", F.lit(1))
    return out.select(*KEYS).join(hit, KEYS, "left").agg(F.count("*").alias("n_lines"), F.count("h").cast("int").alias("n_hit"))


@query()
def k02_full_rewrite(spark, d):
    own = settled(pool(spark, d))
    routed = settled(S.routes(document_lines(spark, d), KEYS, own).filter("route <> 'verbatim'"))
    return S._rounds(routed, KEYS, own, S.edit_whole, S.word_fidelity, F.lit(S.STRICT_MIDDLE), F.lit(S.RELAXED_MIDDLE), True, "rewritten", S.ROUNDS, 6)[0]


@query()
def k03_audit(spark, d):
    lines = document_lines(spark, d)
    return S.audit(lines, S.sanitized(lines, KEYS, pool(spark, d)), KEYS, "author")


@query(f"""WITH {ELEMENTS}, l AS (SELECT * FROM elements WHERE (item // 25) % 2 = 0), e AS (SELECT *, item % 9 AS support FROM elements WHERE (item // 25) % 2 = 1),
m AS (SELECT l.item AS line, e.owner, e.item, e.support, round(list_dot_product(l.vec::DOUBLE[], e.vec::DOUBLE[]), 6) AS c FROM l JOIN e USING (cluster)), o AS (SELECT line, owner, max(c) AS c FROM m GROUP BY ALL)
SELECT line, arg_max(item, (c, -item)) AS top, arg_max(owner, (c, -item)) AS owner, arg_max(support, (c, -item)) AS support, max(c) AS cosine, (SELECT count(*) FROM o WHERE o.line = m.line AND o.c >= 0.25) AS n_near, max(c) < 0.25 AS unattributed FROM m GROUP BY line""")
def k03b_provenance(spark, d):
    e = elements(spark, d)
    lines = e.filter("(item div 25) % 2 = 0").select(F.col("item").alias("line"), "cluster", "vec")
    return S.provenance(lines, e.filter("(item div 25) % 2 = 1").withColumn("support", F.col("item") % 9), ["line"], near=0.25)


@query()
def k05_degeneracy(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("card"), F.col("doc_id").alias("member"), "text")
    firsts = O.sent(docs.groupBy("card").agg(F.min("member").alias("member")).select("member"))  # a row per source, so that texts need not move
    return I.degeneracy(docs.join(firsts, "member", "left_semi").select("card", "text"), docs.join(firsts, "member", "left_anti"))


@query()
def k06_consensus(spark, d):
    return I.consensus(elements(spark, d), quorum=2, match=0.2)


@query(f"""WITH {ELEMENTS}, b AS (SELECT a.cluster, a.item, b.owner AS other, round(max(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])), 6) AS best FROM elements a JOIN elements b ON a.cluster = b.cluster AND a.owner <> b.owner GROUP BY ALL)
SELECT cluster, item, 1 + count(DISTINCT other) FILTER (best >= 0.3 OR best >= 0.1 AND (item + other) % 2 = 0) AS support FROM b GROUP BY ALL""")
def k07_decomposed_pooling(spark, d):
    e = elements(spark, d)
    b = P.best_match(e, e, "cluster", "owner", "item").withColumn("best", F.round("best", 6))
    verdicts = b.select("item", "other", ((F.col("item") + F.col("other")) % 2 == 0).alias("same")).distinct()
    m = I.adjudicated(b, verdicts, 0.3, 0.1)
    return m.groupBy("cluster", "item").agg((1 + F.count_distinct(F.when(F.col("match"), F.col("other")))).alias("support"))


@query("""WITH e AS (SELECT DISTINCT event_type AS bid, user_id AS c FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY ('0x' || substr(sha1('pref|' || c), 1, 8))::BIGINT DESC, c DESC) AS r FROM e)
SELECT bid, count(*) AS n, max(CASE WHEN r = 1 THEN c END) AS winner FROM h GROUP BY bid""")
def k08_naming_readout(spark, d):
    from corvane.catalog.sequences import tournament

    groups, won = tournament(spark, d)
    last = won.groupBy("bid").agg(F.max_by("winner", "round").alias("winner"))
    return groups.filter("round = 1").groupBy("bid").agg(F.count("*").alias("n")).join(last, "bid")


def _vmia(spark, d):
    cards = table(spark, d, "documents").select(F.col("doc_id").alias("card"), "text")
    texts = benchmark(spark, d).select((F.col("item_id") % 8).alias("author"), "text")
    return I.membership_inference(cards, texts, cards.select("card", (F.col("card") % 8).alias("author")))


@query(f"""WITH {LINES}, src AS (SELECT DISTINCT item_id % 8 AS author, unnest(CASE WHEN len(w) >= 6 THEN list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' ')) ELSE [] END) AS gram FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM benchmark)),
cl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents), cw AS (SELECT *, regexp_extract_all(lower(line), '[a-z'']+') AS w FROM cl), big AS (SELECT doc_id, count(*) AS n FROM cw WHERE len(w) >= 6 GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id, line_no, author FROM (SELECT doc_id, line_no, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS gram FROM cw WHERE len(w) >= 6) JOIN src USING (gram)), s AS (SELECT doc_id, author, count(*) AS k FROM hit GROUP BY ALL)
SELECT d.doc_id AS card, a.author, round(coalesce(s.k / b.n, 0), 6) AS s1, (d.doc_id % 8 = a.author)::INTEGER AS label FROM documents d CROSS JOIN (SELECT DISTINCT item_id % 8 AS author FROM benchmark) a LEFT JOIN s ON s.doc_id = d.doc_id AND s.author = a.author LEFT JOIN big b ON b.doc_id = d.doc_id""")
def k09_membership_inference(spark, d):
    return _vmia(spark, d).select("card", "author", F.round("s1", 6).alias("s1"), "label")


@query()
def k09_membership_auc(spark, d):
    v = settled(_vmia(spark, d))  # four scores are read from it
    parts = [E.auc(v, [], score=s).select(F.lit(s).alias("score"), F.round("auc", 6).alias("auc")) for s in ("s1", "s2", "s3", "s4")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PAIRS = f"""{MEMBERS}, st AS (SELECT c.cluster, u.user_id FROM (SELECT DISTINCT cluster FROM m) c CROSS JOIN u ANTI JOIN m ON m.cluster = c.cluster AND m.user_id = u.user_id),
pr AS (SELECT * FROM (SELECT m.cluster, m.user_id AS member, st.user_id AS stranger, row_number() OVER (PARTITION BY m.cluster, m.user_id ORDER BY sha1('2afc|' || m.cluster || '|' || m.user_id || '|' || st.user_id), st.user_id) AS r FROM m JOIN st USING (cluster)) WHERE r <= 4)"""


def _two_way(spark, d):
    m = members(spark, d)
    return I.two_way_pairs(m, "cluster", "user_id", 4, "2afc")


@query(f"WITH {_PAIRS} SELECT cluster, member, stranger, CASE WHEN ('0x' || substr(sha1('2afc|' || cluster || '|' || member || '|' || stranger), 40, 1))::INTEGER % 2 = 0 THEN 'A' ELSE 'B' END AS member_slot FROM pr")
def k10_two_way_pairs(spark, d):
    return _two_way(spark, d)


def _two_way_hits(spark, d):
    mean = clicks(spark, d).groupBy(F.col("user_id").alias("author")).agg(F.round(F.avg("value"), 6).alias("score"))
    return settled(I.two_way_scores(_two_way(spark, d), mean, "cluster"))  # read by both kinds of clusters


@query(f"""WITH {_PAIRS}, sc AS (SELECT user_id, round(avg(value), 6) AS s FROM events GROUP BY user_id), hits AS (SELECT cluster, member, CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END AS hit FROM pr JOIN sc a ON a.user_id = member JOIN sc b ON b.user_id = stranger),
x AS (WITH {_ci_sql('hits', 'cluster', 'hit', 200, '0')} SELECT 'cluster' AS key, * FROM est), y AS (WITH {_ci_sql('hits', 'member', 'hit', 200, '0')} SELECT 'member' AS key, * FROM est)
SELECT key, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, hi < 0.6 AS clear FROM (FROM x UNION ALL FROM y)""")
def k10_two_way_certified(spark, d):
    c = I.certified(_two_way_hits(spark, d), ["cluster", "member"], "hit", replicates=200)
    return c.select("key", *[F.round(x, 6).alias(x) for x in ("mean", "lo", "hi")], "clear")


@query(f"WITH {WINS}, o AS (SELECT event_type, user_id, event_id // 2 AS pair, avg(win) AS v FROM wins GROUP BY ALL), {_ci_sql('o', 'user_id', 'v', 200, '11', 'event_type')} SELECT event_type, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0.5 THEN 'win' WHEN hi < 0.5 THEN 'loss' ELSE 'tie' END AS verdict FROM est")
def k11_forced_choice(spark, d):
    o = wins(spark, d).groupBy("event_type", "user_id", F.floor(F.col("event_id") / 2).alias("pair")).agg(F.avg("win").alias("v"))
    c = B.cluster_ci(o, ["event_type"], "user_id", "v", 200, 11)
    return c.select("event_type", *[F.round(x, 6).alias(x) for x in ("mean", "lo", "hi")], F.when(F.col("lo") > 0.5, "win").when(F.col("hi") < 0.5, "loss").otherwise("tie").alias("verdict"))


def forced_choice_items(spark, d):
    """Documents as units; a draft of each arm: the text, without digits, without markup, and cut after 3,000 characters."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("unit"), F.col("source").alias("expert"), F.col("lang").alias("cluster"), F.coalesce("text", F.lit("")).alias("t"))
    arms = F.array(F.struct(F.lit("in").alias("arm"), F.col("t").alias("text")), F.struct(F.lit("ne").alias("arm"), F.regexp_replace("t", r"\d", "").alias("text")), F.struct(F.lit("staab").alias("arm"), F.regexp_replace("t", r"[*_#]", "").alias("text")))
    drafts = docs.select("unit", "expert", "cluster", F.explode(arms).alias("x")).select("unit", "expert", "cluster", "x.arm", "x.text")
    return C.export(drafts, [("ne", "in"), ("staab", "in")], "in", n_probes=200, n_cut=200, batches=0, most=60, seed=0)


@query()
def k11b_forced_choice_export(spark, d):
    items = forced_choice_items(spark, d)
    return items.select("pid", "kind", "unit", "x", "y", "p", "order", "batch", "slot", F.length("a").alias("n_a"), F.length("b").alias("n_b"))


def _judged(items):
    """Two judges' answers by hashes: they notice cuts at 97 in 100, and choose A at 52 in 100 elsewhere."""
    from corvane.functions.numeric import hash_number

    each = items.select("pid", "kind", "order", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("rep"))
    low = hash_number(F.col("rep"), F.col("pid")) % 100 < F.when(F.col("kind") == "cut", 97).otherwise(52)
    a = F.when(F.col("kind") == "cut", low == (F.col("order") == 0)).otherwise(low)
    return each.select("pid", "rep", F.when(a, "A").otherwise("B").alias("choice"))


@query(f"""WITH base AS (SELECT doc_id AS unit, source, lang FROM documents), c AS (SELECT * FROM (VALUES (0, 'ne', 'in', true), (1, 'staab', 'in', false)) t(ci, x, y, pooled)),
pk AS (SELECT x || '-' || y AS contrast, pooled, unit, o, rep, CASE WHEN pooled THEN lang ELSE source END AS g, ((('0x' || substr(sha1(rep || '|' || printf('C%d%03d%d', ci, unit, o)), 1, 8))::BIGINT % 100 < 52) = (o = 0))::INTEGER AS win
  FROM base, c, (SELECT unnest([0, 1]) AS o), (SELECT unnest(['r1', 'r2']) AS rep)),
w AS (SELECT contrast, unit, g, avg(win) AS v FROM pk GROUP BY ALL), {_ci_sql('w', 'g', 'v', 200, '0', 'contrast')},
ag AS (SELECT contrast, avg((a = b)::INTEGER) AS agreement FROM (SELECT contrast, unit, max(win) FILTER (o = 0) AS a, max(win) FILTER (o = 1) AS b FROM pk WHERE rep = 'r2' GROUP BY ALL) GROUP BY contrast),
z AS (SELECT *, (hi - lo) / (2 * 1.959964) AS se FROM est JOIN ag USING (contrast) JOIN (SELECT contrast, count(*) AS units, stddev_samp(v) AS sd FROM w GROUP BY contrast) USING (contrast))
SELECT split_part(contrast, '-', 1) AS x, split_part(contrast, '-', 2) AS y, round(mean, 6) AS win, round(lo, 6) AS lo, round(hi, 6) AS hi, round(2.801585 * se, 6) AS mde, round(agreement, 6) AS agreement, round(sd, 6) AS sd, units AS n_units, n_units AS n_clusters,
CASE WHEN lo > 0.5 THEN 'x better' WHEN hi < 0.5 THEN 'y better' WHEN mean - 1.644854 * se > 0.4 AND mean + 1.644854 * se < 0.6 AND 2.801585 * se < 0.1 THEN 'tie' WHEN 2.801585 * se >= 0.1 THEN 'underpowered' ELSE 'inconclusive' END AS verdict FROM z""")
def k11c_forced_choice_score(spark, d):
    items = forced_choice_items(spark, d)
    _, _, found = C.score(spark, items, _judged(items), ["ne"], 0.1, 200, 0)
    return found.select("x", "y", *[F.round(c, 6).alias(c) for c in ("win", "lo", "hi", "mde", "agreement", "sd")], "n_units", "n_clusters", "verdict")


@query(f"""WITH {CORPUS}, c AS (SELECT concat_ws('|', author, pos % 2, pos // 128) AS card, pos % 2 AS seed, doc_id % 9 AS member, text FROM corpus),
tf AS (SELECT card, term, count(*) AS tf FROM (SELECT card, unnest({_CONTENT}) AS term FROM c) GROUP BY ALL), nm AS (SELECT card, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY card),
dots AS (SELECT a.card AS a, b.card AS b, sum(a.tf * b.tf) AS dot FROM tf a JOIN tf b ON a.term = b.term AND a.card < b.card GROUP BY ALL),
m AS (SELECT DISTINCT card, member FROM c), co AS (SELECT a.card AS a, b.card AS b, count(*) AS n FROM m a JOIN m b ON a.member = b.member AND a.card < b.card GROUP BY ALL),
g AS (SELECT DISTINCT card, unnest({grams_sql('w', 6)}) AS gram FROM (SELECT card, {words_sql('text')} AS w FROM c)),
r AS (SELECT a.card AS a, b.card AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.card < b.card GROUP BY ALL), s AS (SELECT DISTINCT card, seed FROM c)
SELECT dots.a, dots.b, coalesce(co.n, 0) AS shared_members, round(dot / (na.norm * nb.norm), 6) AS cosine, coalesce(r.n, 0) AS shared_runs FROM dots JOIN nm na ON na.card = dots.a JOIN nm nb ON nb.card = dots.b
JOIN s sa ON sa.card = dots.a JOIN s sb ON sb.card = dots.b LEFT JOIN co ON co.a = dots.a AND co.b = dots.b LEFT JOIN r ON r.a = dots.a AND r.b = dots.b WHERE sa.seed <> sb.seed""")
def k12_linkage(spark, d):
    # an author's documents go to two seeds in turn; a card holds the texts of up to 64 documents of an author and seed
    docs = corpus(spark, d).withColumn("seed", F.col("pos") % 2).withColumn("card", F.concat_ws("|", "author", "seed", F.expr("pos div 128")))
    pairs = I.linkage(docs.select("card", "seed", "text"), docs.select("card", (F.col("doc_id") % 9).alias("author")))
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query()
def k12b_linkage_gates(spark, d):
    docs = corpus(spark, d).withColumn("seed", F.col("pos") % 2).withColumn("card", F.concat_ws("|", "author", "seed", F.expr("pos div 16")))
    pairs = I.linkage(docs.select("card", "seed", "text"), docs.select("card", (F.col("doc_id") % 211).alias("author")), longer=8)
    gates = L.census_gates(L.matched_pairs(pairs))
    return gates.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in gates.dtypes])


@query(f"""WITH t AS (SELECT lang AS card, unnest({_CONTENT}) AS term FROM documents), a AS (SELECT card, term, count(*) AS tf FROM t GROUP BY ALL), q AS (SELECT term, sum(tf) / (SELECT sum(tf) FROM a) AS q FROM a GROUP BY term),
p AS (SELECT card, term, tf / sum(tf) OVER (PARTITION BY card) AS p FROM a), f AS (SELECT s.card, q.q, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT card FROM a) s CROSS JOIN q LEFT JOIN p ON p.card = s.card AND p.term = q.term)
SELECT card, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2, 6) AS jsd FROM f GROUP BY card""")
def k13_closeness(spark, d):
    tf = O.terms(corpus(spark, d).select(F.col("lang").alias("card"), "text"), ["card"], T.content_words(F.col("text")))
    return O.jensen_shannon(tf, "card", tf.groupBy("term").agg(F.sum("tf").alias("tf"))).select("card", F.round("jsd", 6).alias("jsd"))


@query(f"""WITH {WINS}, u AS (SELECT user_id, avg(win) FILTER (event_type = 'click') AS a, avg(win) FILTER (event_type = 'view') AS b, sum(win) AS h, count(*) AS n FROM wins GROUP BY user_id)
SELECT count(*) AS n, round(stddev_pop(h / n), 6) AS sd, count(*) FILTER ((h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) > 0.5) AS leaky, round(corr(a, b), 6) AS channel_corr FROM u""")
def k14_dispersion(spark, d):
    from corvane.functions.numeric import wilson

    side = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("win")))
    u = wins(spark, d).groupBy("user_id").agg(side("click").alias("a"), side("view").alias("b"), F.sum("win").alias("h"), F.count("*").alias("n"))
    leaky = F.count_if(wilson(F.col("h"), F.col("n"))[0] > 0.5)
    return u.agg(F.count("*").alias("n"), F.round(F.stddev_pop(F.col("h") / F.col("n")), 6).alias("sd"), leaky.alias("leaky"), F.round(F.corr("a", "b"), 6).alias("channel_corr"))


@query()
def k15_rebuild_check(spark, d):
    lines, runs = document_lines(spark, d), pool(spark, d)
    return S.rebuild_check(S.routes(lines, KEYS, runs), S.sanitized(lines, KEYS, runs), S.sanitized(lines, KEYS, runs, rounds=1), KEYS, "doc_id")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY sha1('drop|' || event_id), event_id) AS h FROM events)
SELECT user_id, round(avg(value) FILTER (h > 4) - avg(value) FILTER (t > 4), 6) AS diff FROM r GROUP BY user_id""")
def k16_ablation_verdict(spark, d):
    from pyspark.sql import Window

    from corvane.functions.numeric import hash_key

    w = Window.partitionBy("user_id")
    r = clicks(spark, d).withColumns({"t": F.row_number().over(w.orderBy(F.desc("value"), "event_id")), "h": F.row_number().over(w.orderBy(hash_key("drop", F.col("event_id")), "event_id"))})
    side = lambda c: F.avg(F.when(F.col(c) > 4, F.col("value")))
    return r.groupBy("user_id").agg(F.round(side("h") - side("t"), 6).alias("diff"))


@query("SELECT source, count(*) AS expected, count(l.doc_id) AS got, count(*) - count(l.doc_id) AS missing, count(l.doc_id) = count(*) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def k17_coverage_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("g")), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("expected"), F.count("g").alias("got"), (F.count("*") - F.count("g")).alias("missing"), (F.count("g") == F.count("*")).alias("complete"))


@query("""WITH lim AS (SELECT user_id, min(ts) + INTERVAL 20 DAY AS t FROM events GROUP BY user_id), ex AS (SELECT e.user_id, event_id AS pid FROM events e WHERE event_id % 5 <> 0 UNION ALL SELECT DISTINCT user_id, -1 FROM events WHERE user_id % 3 = 0)
SELECT ex.user_id::VARCHAR AS pack, count(*) = count(e.event_id) FILTER (e.ts <= lim.t) AS complete, count(*) AS expected, count(e.event_id) FILTER (e.ts <= lim.t) AS got FROM ex JOIN lim USING (user_id) LEFT JOIN events e ON e.event_id = ex.pid GROUP BY ALL""")
def k17b_coverage_stream(spark, d):
    """A user's events as answers: those not divisible by five are expected within twenty days, and of every third user one that never comes."""
    from corvane.streaming.coverage import run_gate
    from corvane.streaming.events import file_stream

    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    limits = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 20 DAYS")).alias("limit"))
    pids = e.filter("event_id % 5 <> 0").select("user_id", F.col("event_id").alias("pid")).unionByName(e.filter("user_id % 3 = 0").select("user_id", F.lit(-1).cast("long").alias("pid")).distinct())
    expected = pids.join(limits, "user_id").select(F.col("user_id").alias("pack"), "pid", "limit")
    stream = file_stream(spark, d, "events.parquet", table(spark, d, "events").schema).select(F.col("user_id").alias("pack"), F.col("event_id").alias("pid"), "ts")
    return run_gate(spark, stream, expected).select("pack", "complete", "expected", "got")


@query()
def k18_deidentification_ladder(spark, d):
    """Per channel: accuracy against the block null, Holm's p over the channels; the topic channel guesses the author by TF-IDF."""
    from corvane.catalog.aggregates import guesses
    from corvane.catalog.text import d35_topic_attribution

    half = F.when(F.col("unit") % 2 == 0, "even").when(F.col("unit") % 2 == 1, "odd").alias("channel")
    halves = settled(B.guess_pairs(guesses(spark, d).select("*", half), ["channel"], "unit", "truth", "guess"))
    every = halves.groupBy(F.lit("all").alias("channel"), "author", "guess").agg(F.sum("w").alias("w"), F.sum("units").alias("units"))
    own = every.unionByName(halves.filter("channel IS NOT NULL")).withColumns({c: F.col(c).cast("string") for c in ("author", "guess")})
    docs = table(spark, d, "documents").select("doc_id", "source")
    found = docs.join(d35_topic_attribution(spark, d), "doc_id").withColumn("channel", F.lit("topic"))
    topic = B.guess_pairs(found, ["channel"], "doc_id", "source", "predicted")
    out = settled(B.null_of_pairs(settled(own.unionByName(topic)), ["channel"], 100, 1).select("observed", "null_mean", "lo", "hi", "p", "reached_chance", "channel"))
    return E.adjusted(out, [])


@query("""WITH q AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars >= 200) SELECT source, doc_id, CASE WHEN rn <= 12 THEN 'card' WHEN rn = 13 THEN 'ref' ELSE 'target' END AS part FROM q WHERE n >= 14 AND rn <= 14""")
def k19_dataset_build(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source")
    q = table(spark, d, "documents").filter("n_chars >= 200").select("source", "doc_id", F.row_number().over(w.orderBy("doc_id")).alias("rn"), F.count("*").over(w).alias("n"))
    part = F.when(F.col("rn") <= 12, "card").when(F.col("rn") == 13, "ref").otherwise("target")
    return q.filter("n >= 14 AND rn <= 14").select("source", "doc_id", part.alias("part"))


@query(f"WITH {SCORES} SELECT unit, round(avg((label = (score > 10)::INTEGER)::INTEGER), 6) AS accuracy FROM scores GROUP BY unit")
def k20_open_world(spark, d):
    return scores(spark, d).groupBy("unit").agg(F.round(F.avg((F.col("label") == (F.col("score") > 10).cast("int")).cast("int")), 6).alias("accuracy"))


@query(f"WITH {WINS}, z AS (SELECT *, event_id % 3 AS part FROM wins), {_ci_sql('z', 'user_id', 'win', 200, '0', 'part')} SELECT part, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, (SELECT count(DISTINCT user_id) FROM wins) - n_units AS holes, hi < 0.55 AND (SELECT count(DISTINCT user_id) FROM wins) = n_units AS clear FROM est")
def k21_partition_verdicts(spark, d):
    v = I.partition_verdict(wins(spark, d).withColumn("part", F.col("event_id") % 3), "part", "user_id", "win", 0.55, 200)
    return v.select("part", *[F.round(x, 6).alias(x) for x in ("mean", "lo", "hi")], "holes", "clear")


@query(f"WITH {WINS}, s AS (SELECT user_id, event_id % 4 AS seed, avg(win) AS m FROM wins GROUP BY ALL) SELECT seed, round(stddev_samp(m), 6) AS sd, round(2.8 * stddev_samp(m) / sqrt(count(*)), 6) AS mde FROM s GROUP BY seed")
def k22_power(spark, d):
    s = wins(spark, d).groupBy("user_id", (F.col("event_id") % 4).alias("seed")).agg(F.avg("win").alias("m"))
    return s.groupBy("seed").agg(F.round(F.stddev_samp("m"), 6).alias("sd"), F.round(2.8 * F.stddev_samp("m") / F.sqrt(F.count("*")), 6).alias("mde"))


@query("SELECT conv_id, max(CASE WHEN role = 'assistant' THEN length(text) END) AS drafted, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def k23_external_drafts(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.length("text"))).alias("drafted"), F.count_if(F.col("role") == "user").alias("asked"))


@query()
def k24_retry_budget(spark, d):
    lines = document_lines(spark, d)
    tiers = [S.sanitized(lines, KEYS, pool(spark, d), rounds=r).groupBy("tier").agg(F.count("*").alias("n")).withColumn("budget", F.lit(r)) for r in (S.ROUNDS, 12)]
    return tiers[0].unionByName(tiers[1])


@query("WITH t AS (SELECT conv_id, arg_max((role = 'user')::INTEGER, (length(text), turn)) AS hit, count(*) AS n FROM conversations GROUP BY conv_id) SELECT round(avg(hit), 6) AS accuracy, round(avg(1 / n), 6) AS chance, round((avg(hit) - avg(1 / n)) / (1 - avg(1 / n)), 6) AS lift FROM t")
def k25_lineups(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("score"), (F.col("role") == "user").cast("int").alias("label"))
    return I.lineup_accuracy(c, "conv_id", "turn").select(*[F.round(x, 6).alias(x) for x in ("accuracy", "chance", "lift")])


@query("SELECT k, round(avg(v), 6) AS mean, count(*) AS units FROM (SELECT user_id, event_id % 5 AS k, avg(value) AS v FROM events GROUP BY ALL) GROUP BY k")
def k26_utility_curve(spark, d):
    u = clicks(spark, d).groupBy("user_id", (F.col("event_id") % 5).alias("k")).agg(F.avg("value").alias("v"))
    return u.groupBy("k").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("units"))


@query(f"WITH {SCORES}, p AS (SELECT CASE WHEN unit < 'src5' THEN 'a' ELSE 'b' END AS ds, * FROM scores) SELECT coalesce(ds, 'pooled') AS ds, count(*) AS n, round(avg(label), 6) AS share FROM p GROUP BY GROUPING SETS ((ds), ())")
def k27_pooled_readers(spark, d):
    p = scores(spark, d).withColumn("ds", F.when(F.col("unit") < "src5", "a").otherwise("b"))
    return p.rollup("ds").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("share")).select(F.coalesce("ds", F.lit("pooled")).alias("ds"), "n", "share")


@query("SELECT event_type, user_id % 3 AS seed, round(avg((value > 50)::INTEGER), 6) AS acc, round(avg((value > 50)::INTEGER) - (SELECT avg((value > 50)::INTEGER) FROM events), 6) AS drop FROM events GROUP BY ALL")
def k28_score_grid(spark, d):
    w = wins(spark, d)
    every = w.agg(F.avg("win").alias("all"))
    g = w.groupBy("event_type", (F.col("user_id") % 3).alias("seed")).agg(F.avg("win").alias("acc")).join(F.broadcast(every))
    return g.select("event_type", "seed", F.round("acc", 6).alias("acc"), F.round(F.col("acc") - F.col("all"), 6).alias("drop"))


@query(f"""WITH {ELEMENTS}, p AS (SELECT a.cluster, a.item, b.owner AS o, round(max(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])), 6) AS best FROM elements a JOIN elements b ON a.cluster = b.cluster GROUP BY ALL)
SELECT cluster, item, count(*) FILTER (best >= 0.2) AS near_owners, max(best) AS top, count(*) FILTER (best >= 0.2) = 1 AND max(best) >= 0.75 AS exposed FROM p GROUP BY ALL""")
def k07b_exposed_wording(spark, d):
    e = elements(spark, d)
    return A.exposed_wording(e, e, near=0.2, high=0.75)


_ABLATED = """ans AS (SELECT CASE event_id % 3 WHEN 0 THEN 'indiv' WHEN 1 THEN 'ne' ELSE 'v6' END AS arm, user_id AS card, (event_id // 3) % 4 AS bracket, user_id % 40 AS unit, (value > CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 50 ELSE 60 END)::INTEGER::DOUBLE AS hit FROM events WHERE (event_id // 3) % 4 < 4),
pr AS (SELECT card, bracket, avg(hit) FILTER (arm = 'v6') AS x, avg(hit) FILTER (arm = 'ne') AS y FROM ans GROUP BY ALL), df AS (SELECT card, x - y AS d FROM pr WHERE x IS NOT NULL AND y IS NOT NULL), ctl AS (SELECT unit, hit FROM ans WHERE arm = 'indiv')"""


@query(f"""WITH {_ABLATED}, a AS (WITH {_ci_sql('ctl', 'unit', 'hit', 200, '0')} SELECT * FROM est), b AS (WITH {_ci_sql('df', 'card', 'd', 200, '0')} SELECT * FROM est)
SELECT round(a.mean, 6) AS control_rate, round(a.lo, 6) AS control_lo, 0.5::DOUBLE AS chance, a.lo > 0.5 AS control_clears, round(b.mean, 6) AS diff, round(b.lo, 6) AS lo, round(b.hi, 6) AS hi, (SELECT count(*) FROM df) AS pairs, b.n_units AS cards, b.lo > 0 OR b.hi < 0 AS detected, a.lo > 0.5 AND (b.lo > 0 OR b.hi < 0) AS passed FROM a, b""")
def k16b_ablation_gates(spark, d):
    e = clicks(spark, d)
    arm = F.when(F.col("event_id") % 3 == 0, "indiv").when(F.col("event_id") % 3 == 1, "ne").otherwise("v6")
    limit = F.when(F.col("event_id") % 3 == 0, 30).when(F.col("event_id") % 3 == 1, 50).otherwise(60)
    answers = e.select(arm.alias("arm"), F.col("user_id").alias("card"), (F.expr("event_id div 3") % 4).alias("bracket"), (F.col("user_id") % 40).alias("unit"), (F.col("value") > limit).cast("double").alias("hit"), F.lit(0.5).alias("chance"))
    keys = answers.filter("arm = 'v6'").select("card", "bracket").distinct().join(answers.filter("arm = 'ne'").select("card", "bracket").distinct(), ["card", "bracket"])
    answers = answers.filter("arm = 'indiv'").unionByName(answers.filter("arm <> 'indiv'").join(keys, ["card", "bracket"]).select(*answers.columns))
    v = A.ablation_verdict(answers, "indiv", "v6", "ne", 200, 0)
    return v.select(*[F.round(c, 6).alias(c) for c in ("control_rate", "control_lo", "chance", "diff", "lo", "hi")], "control_clears", "pairs", "cards", "detected", "passed")


@query(f"""WITH {WINS}, z AS (SELECT user_id, event_id % 3 AS part, avg(win) AS m FROM wins GROUP BY ALL), w AS (SELECT user_id, avg(m) AS m FROM z GROUP BY user_id), a AS (WITH {_ci_sql('w', 'user_id', 'm', 200, '0')} SELECT * FROM est), b AS (WITH {_ci_sql('z', 'user_id', 'm', 200, '0', 'part')} SELECT * FROM est)
SELECT n_units AS persons, 3 AS partitions, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round((SELECT max(hi) FROM b), 6) AS worst, hi < 0.6 AND (SELECT max(hi) FROM b) < 0.6 AS clear FROM a""")
def k21b_person_marginal(spark, d):
    v = A.partition_marginal(wins(spark, d).withColumn("part", F.col("event_id") % 3), "part", "user_id", "win", 0.6, 200, 0)
    return v.select("persons", "partitions", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "worst")], "clear")


@query("""SELECT count(o.doc_id) AS n_old, count(*) FILTER (o.doc_id IS NOT NULL AND n.doc_id IS NOT NULL AND o.v <> n.v) AS changed, count(*) FILTER (n.doc_id IS NULL) AS deleted, count(*) FILTER (o.doc_id IS NULL) AS added,
count(*) FILTER (o.doc_id IS NOT NULL AND n.doc_id IS NOT NULL AND o.v <> n.v) = 0 AND count(*) FILTER (n.doc_id IS NULL) = 0 AS sound
FROM (SELECT doc_id, n_chars AS v FROM documents WHERE doc_id % 7 > 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN -1 ELSE n_chars END AS v FROM documents WHERE doc_id % 97 > 0) n USING (doc_id)""")
def k22b_additive_only(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v"))
    new = docs.filter("doc_id % 97 > 0").withColumn("v", F.when(F.col("doc_id") % 100 == 1, -1).otherwise(F.col("v")))
    return A.additive_only(docs.filter("doc_id % 7 > 0"), new, ["doc_id"], "v")


_CELLS = "g AS (SELECT (CASE user_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 12 ELSE 16 END) AS k, user_id % 3 AS seed, count(*) AS cards, sum(d)::BIGINT AS dropped, sum(n)::BIGINT AS content FROM (SELECT user_id, event_type, count(*) FILTER (value > 89) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL), c AS (SELECT *, dropped / greatest(1, content) AS rate FROM g)"


@query(f"""WITH {_CELLS}, l AS (SELECT k, sum(cards) AS n FROM c WHERE rate <= 0.11 GROUP BY k), m AS (SELECT sum(k * n) / sum(n) AS mean FROM l), x AS (SELECT sum(n)::BIGINT AS cards, sum(n * power(k - mean, 2)) AS sxx, max(k) - min(k) AS span FROM l, m)
SELECT cards, round(sxx, 6) AS sxx, round(1.96 * 0.3 * span / nullif(sqrt(sxx), 0), 6) AS half_width, round(2.8 * 0.3 * span / nullif(sqrt(sxx), 0), 6) AS mde, (SELECT count(*) FROM c WHERE rate > 0.11) AS excluded FROM x""")
def k22c_build_acceptance(spark, d):
    per_card = clicks(spark, d).groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 89).alias("n_dropped"), F.count("*").alias("n_content"))
    k = F.element_at(F.array(F.lit(4), F.lit(8), F.lit(12), F.lit(16)), (F.col("user_id") % 4 + 1).cast("int"))
    gated = A.drop_gate(per_card.withColumns({"k": k, "seed": F.col("user_id") % 3}), ["k", "seed"], 0.11)
    p = A.achieved_power(gated, "k", 0.3).crossJoin(gated.agg(F.count_if(~F.col("passed")).alias("excluded")))
    return p.select("cards", *[F.round(c, 6).alias(c) for c in ("sxx", "half_width", "mde")], "excluded")


_GRAMS4 = "list_transform(range(1, len(t) - 2), lambda i: t[i:i + 3])"


@query(f"""WITH {CORPUS}, n AS (SELECT author || '|' || lang AS author, pos % 2 AS side, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM corpus WHERE text IS NOT NULL),
g AS (SELECT author, side, unnest({_GRAMS4}) AS gram FROM n WHERE len(t) >= 4), tf AS (SELECT author, side, gram, count(*) AS tf FROM g GROUP BY ALL), nm AS (SELECT author, side, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM tf GROUP BY ALL),
w AS (SELECT tf.author, tf.side, gram, tf / norm AS w FROM tf JOIN nm USING (author, side)), au AS (SELECT author FROM n WHERE side = 0 INTERSECT SELECT author FROM n WHERE side = 1),
r AS (SELECT seed, author, row_number() OVER (PARTITION BY seed ORDER BY sha1('shuf|floor|' || seed || '|' || author), author) AS place, count(*) OVER (PARTITION BY seed) AS n FROM au, (SELECT unnest(range(5)) AS seed)), gr AS (SELECT seed, author, least((place - 1) // 4, greatest(n // 4 - 1, 0)) AS cluster FROM r),
cs AS (SELECT x.seed, a.author AS a, b.author AS b, round(sum(a.w * b.w), 9) AS c FROM gr x JOIN gr y ON x.seed = y.seed AND x.cluster = y.cluster JOIN w a ON a.author = x.author AND a.side = 0 JOIN w b ON b.author = y.author AND b.side = 1 AND a.gram = b.gram GROUP BY ALL),
pk AS (SELECT seed, a, b, row_number() OVER (PARTITION BY seed, a ORDER BY c DESC, b) AS k FROM cs), rt AS (SELECT seed, count(*) FILTER (a = b) / (SELECT count(*) FROM au) AS rate FROM pk WHERE k = 1 GROUP BY seed)
SELECT 0.25::DOUBLE AS chance, round(avg(rate), 6) AS mean, round(min(rate), 6) AS least, round(quantile_cont(rate, 0.5), 6) AS middle, round(max(rate), 6) AS most, count(*) FILTER (rate > 0.25) AS above, count(*) AS seeds,
CASE WHEN count(*) FILTER (rate > 0.25) = count(*) THEN 'above chance on all seeds' WHEN count(*) FILTER (rate > 0.25) = 0 THEN 'not above chance on any seed' ELSE 'unstable over seeds' END AS verdict FROM rt""")
def d51b_stylometric_floor(spark, d):
    docs = corpus(spark, d).select(F.concat_ws("|", "author", "lang").alias("author"), "pos", "text")
    s = A.floor_sweep(docs.filter("pos % 2 = 0"), docs.filter("pos % 2 = 1"), 4, 5)
    return s.select(*[F.round(c, 6).alias(c) for c in ("chance", "mean", "least", "middle", "most")], "above", "seeds", "verdict")

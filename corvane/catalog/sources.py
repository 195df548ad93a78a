"""Scans, readers and writers (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.base import benchmark, corpus, query, table

from corvane.functions.text import strip_bom
from corvane.sources import archives as A
from corvane.sources import readers as R
from corvane.sources import stores as W
from corvane.sources.keyed_store import KeyedStore
from corvane.sources.versions import VersionedTable


@query("SELECT doc_id, source AS author, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 7")
def a01_capped_scan(spark, d):
    return R.capped(table(spark, d, "documents"), "source", ["doc_id"], 7).select("doc_id", F.col("source").alias("author"), "n_chars")


@query("""SELECT source AS author, lang AS folder, doc_id, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS rn FROM documents WHERE lang IN ('en', 'fr')) WHERE rn <= 7 AND source <> 'src3'""")
def a01b_mail_archive(spark, d):
    docs = table(spark, d, "documents").select("source", F.concat(F.lit("maildir/"), "source", F.lit("/"), F.initcap("lang"), F.lit("/"), F.lpad("doc_id", 12, "0")).alias("member"), "text")
    path = W.shared_folder(spark)
    names = [r[0] for r in A.write_archives(docs, path, "source", "member", "text").collect()]  # one per source
    found = A.mail_archive(spark, path, folders="en,fr", perAuthor=7).filter(F.col("author").isin([n for n in names if n != "src3"]))
    return found.select("author", "folder", F.regexp_extract("member", r"0*(\d+)$", 1).cast("long").alias("doc_id"), F.length("text").alias("n"))


@query("SELECT doc_id, source || '@x.org' AS frm, lang || ' ' || doc_id AS subject, length(text) AS n FROM documents")
def a02_mail_parse(spark, d):
    raw = F.concat(F.lit("From: "), "source", F.lit("@x.org\nSubject:  "), "lang", F.lit(" "), "doc_id", F.lit("\n\n"), "text")
    return R.parsed_mail(table(spark, d, "documents").select("doc_id", raw.alias("raw")), ["doc_id"]).select("doc_id", "frm", "subject", F.length("body").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def a03_census(spark, d):
    return R.census(table(spark, d, "documents"), "source")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def a04_projected_scan(spark, d):
    return table(spark, d, "orders").filter("o_orderdate >= TIMESTAMP '1997-01-01'").select("o_orderkey", "o_totalprice")


@query("SELECT 'c' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier")
def a05_multi_file_union(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return c.unionByName(s).orderBy("kind", "key")


@query("SELECT p_partkey AS id, p_name AS title, p_size AS score FROM part")
def a07_xml_rows(spark, d):
    path = W.shared_folder(spark)
    table(spark, d, "part").select(F.col("p_partkey").alias("_Id"), F.col("p_name").alias("_Title"), F.col("p_size").alias("_Score")).write.format("xml").option("rowTag", "row").option("rootTag", "posts").save(path)
    return R.xml_rows(spark, path, "_Id long, _Title string, _Score int").select(F.col("_Id").alias("id"), F.col("_Title").alias("title"), F.col("_Score").alias("score"))


@query("""SELECT l_suppkey AS expert, count(DISTINCT l_orderkey) AS answers, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN l_orderkey END) AS gold
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 20""")
def a08_two_pass_build(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("l_suppkey").alias("expert")).agg(F.count_distinct("l_orderkey").alias("answers"), F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("l_orderkey"))).alias("gold")).filter("answers >= 20")


@query("SELECT 'k' || item_id AS key, text AS value FROM benchmark")
def a09_json_records(spark, d):
    path = W.shared_folder(spark)
    pairs = benchmark(spark, d).select(F.expr("item_id div 500").alias("file"), F.concat(F.lit("k"), "item_id").alias("k"), F.col("text").alias("v"))
    whole = pairs.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # 500 records a file
    W.write_files(whole.select(F.concat(F.lit("records_"), "file", F.lit(".json")).alias("file"), F.concat(F.lit("﻿"), F.to_json("m")).alias("value")), path)
    return R.json_records(spark, path)


def _answers(spark, d) -> str:
    """A folder of answer files, 1,000 records each, made from all events, with a stray and a malformed one."""
    path = W.shared_folder(spark)
    e = table(spark, d, "events")
    rec = F.to_json(F.struct(F.concat(F.lit("p"), F.col("event_id") % 600).alias("pid"), F.when(F.col("event_id") % 7 == 0, "??").otherwise(F.concat(F.lit("pick "), F.chr(F.lit(65) + F.col("user_id") % 4))).alias("choice"), F.floor("value").cast("double").alias("conf")))
    each = e.groupBy(F.expr("event_id div 1000 + 1").alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", rec.alias("r")))).alias("x"))
    text = F.concat(F.lit("["), F.array_join("x.r", ","), F.lit("]"))
    stray = spark.range(1).select(F.lit("ans_backup.json").alias("file"), F.lit('[{"pid": "p1", "choice": "A"}]').alias("value"))
    broken = spark.range(1).select(F.lit("ans_broken.json").alias("file"), F.lit('[{"pid": "p1", "choice": ').alias("value"))
    W.write_files(each.select(F.concat(F.lit("ans_"), "k", F.lit(".json")).alias("file"), text.alias("value")).unionByName(stray).unionByName(broken), path)
    return path


_ANSWERS = """e AS (SELECT *, 'ans_' || (event_id // 1000 + 1) || '.json' AS file FROM events),
a AS (SELECT file, 'p' || (event_id % 600) AS pid, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE chr((65 + user_id % 4)::INTEGER) END AS letter, floor(value)::DOUBLE AS conf FROM e)"""


@query(f"WITH {_ANSWERS} SELECT file, pid, CASE WHEN letter IS NOT NULL THEN 'C' END AS choice, conf FROM a")
def a10_answer_files(spark, d):
    return R.answer_files(spark, _answers(spark, d)).select("file", "pid", "choice", "conf")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'r1' ELSE 'r2' END AS gen, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS part, count(*) AS n FROM events GROUP BY ALL")
def a11_generations(spark, d):
    e = table(spark, d, "events").withColumn("file", F.when(F.col("event_id") % 3 == 0, "ans_1.json").otherwise("ans_r2_2.json"))
    return W.generations(e).groupBy("gen", "part").agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 > 0 THEN floor(value)::DOUBLE END, 50.0) AS conf FROM events")
def a12_confidence_default(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 5 > 0, F.floor("value").cast("double")), F.lit(50.0)).alias("conf"))


@query("SELECT item_id, text FROM benchmark")
def a13_bom_tolerant(spark, d):
    return benchmark(spark, d).select("item_id", strip_bom(F.concat(F.lit("﻿"), "text")).alias("text"))


@query("""SELECT user_id, event_type, upper(event_type) AS v FROM events""")
def a14_response_cache(spark, d):
    requests = table(spark, d, "events").select("user_id", "event_type", W.request_key(F.lit("m"), F.col("event_type"), F.lit("{}")).alias("k"))
    cache = requests.filter("event_type IN ('click', 'view')").select("k", F.upper("event_type").alias("v")).distinct()
    return W.through_cache(requests, cache, lambda r: r.withColumn("v", F.upper("event_type")))[0].select("user_id", "event_type", "v")


def _bracketed(batch: list[str]) -> list[str]:
    return [f"<{x}>" for x in batch]


@query("SELECT o_custkey AS custkey, o_orderpriority AS priority, '<' || o_custkey || '|' || o_orderpriority || '>' AS v FROM orders")
def a14b_keyed_store(spark, d):
    """Responses by (customer, priority): a third is there from a former run, and what is missing is computed in batches of 256."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"))
    asked = orders.withColumn("payload", F.concat_ws("|", "custkey", "priority")).withColumn("k", W.request_key(F.lit("m"), F.col("payload"), F.lit("{}")))
    path = W.shared_folder(spark)
    store = KeyedStore(spark, "answers_" + path[-12:], path, buckets=12)
    store.add(asked.filter("custkey % 3 = 0").select("k", F.concat(F.lit("<"), "payload", F.lit(">")).alias("v")))
    return store.get_or_compute(asked, _bracketed).select("custkey", "priority", "v")


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def a24_versioned_update(spark, d):
    """Totals by priority, kept up to date by one committed update for each remainder of the keys."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.lit(1).cast("long").alias("n"), F.col("o_totalprice").cast("double").alias("total"))
    kept = VersionedTable(spark, W.shared_folder(spark), "priority string, n long, total double")
    for k in range(3):
        new = orders.filter(F.col("key") % 3 == k).drop("key")
        kept.update(lambda rows, new=new: rows.unionByName(new).groupBy("priority").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    return kept.read().select("priority", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id % 10 AS s, count(DISTINCT event_type) AS n FROM events GROUP BY ALL")
def a15_sample_keys(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("s"), W.request_key(F.lit("m"), F.col("event_type"), (F.col("user_id") % 10).cast("string")).alias("k"))
    return e.groupBy("s").agg(F.count_distinct("k").alias("n"))


@query("SELECT user_id, round(avg((value > 50)::INTEGER), 6) AS p_unsafe FROM events GROUP BY user_id")
def a16_sampled_probability(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("p_unsafe"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0))")
def a18_missing_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    return W.missing(docs, docs.filter("doc_id % 2 = 0")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, n_chars, (('0x' || substr(sha1('pack|' || doc_id), 1, 8))::BIGINT % ceil((SELECT count(*) FROM documents) / 100.0)::BIGINT)::INTEGER AS batch FROM documents""")
def a20_batch_pack(spark, d):
    path = W.shared_folder(spark)
    W.write_batches(W.batches(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 100, "pack"), path)
    return spark.read.schema("doc_id long, n_chars long, batch int").json(path)


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def a21_resume(spark, d):
    c = corpus(spark, d)
    return W.not_done(c, c.filter(F.col("author").isin("src1", "src2")), ["author"]).select("doc_id")


@query("""SELECT batch, sha1(string_agg(h, '|' ORDER BY doc_id)) AS digest FROM (SELECT doc_id, doc_id % 9 AS batch, sha1(text) AS h FROM documents) GROUP BY batch""")
def a22_batch_digests(spark, d):
    return W.batch_digests(table(spark, d, "documents").withColumn("batch", F.col("doc_id") % 9), "doc_id", "text")


@query("SELECT DISTINCT 'ans_' || (event_id // 1000 + 1) || '.json' AS file, true AS good FROM events UNION ALL SELECT 'ans_backup.json', true UNION ALL SELECT 'ans_broken.json', false")
def a23_malformed_files(spark, d):
    return R.malformed_files(spark, _answers(spark, d))


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS t, ((row_number() OVER (PARTITION BY source ORDER BY sha1('lineup|' || source || '|' || doc_id), doc_id) - 1) // 8)::INTEGER AS g, row_number() OVER (PARTITION BY source ORDER BY sha1('lineup|' || source || '|' || doc_id), doc_id) AS r, text FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY source, g ORDER BY r) AS slot FROM p), c AS (SELECT source, g, string_agg('[' || slot || '] ' || text, chr(10) ORDER BY slot) AS candidates FROM s GROUP BY ALL)
SELECT source || '_T' || lpad(t::VARCHAR, 6, '0') AS trial, doc_id AS author, slot::INTEGER AS true_candidate, sha256('TARGET:' || chr(10) || text || chr(10) || 'CANDIDATES:' || chr(10) || candidates) AS trial_sha256 FROM s JOIN c USING (source, g)""")
def a25_trial_dump(spark, d):
    """Trials as text and their key, through files and back."""
    from pyspark.sql import Window

    from corvane.functions.numeric import hash_key

    w = Window.partitionBy("source")
    ids = table(spark, d, "documents").select("doc_id", "source")
    r = F.row_number().over(w.orderBy(hash_key("lineup", F.col("source"), F.col("doc_id")), "doc_id"))
    placed = ids.withColumns({"t": F.row_number().over(w.orderBy("doc_id")), "r": r}).withColumn("g", F.expr("(r - 1) div 8"))
    placed = placed.withColumn("slot", (F.pmod(F.col("r") - 1, F.lit(8)) + 1).cast("int")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    trials, key = W.trials(placed, ["source", "g"], "doc_id", "slot", "text", F.concat(F.col("source"), F.lit("_T"), F.lpad(F.col("t").cast("string"), 6, "0")))
    path = W.shared_folder(spark)
    trials.write.json(path)
    read = spark.read.schema("trial string, value string").json(path)
    return key.join(read.select("trial", F.sha2(F.col("value").cast("binary"), 256).alias("trial_sha256")), "trial").select("trial", F.col("doc_id").alias("author"), "true_candidate", "trial_sha256")


@query("""SELECT conv_id, string_agg('@@@@@ ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def a26_consolidate(spark, d):
    return W.consolidated(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("""SELECT batch, count(*) AS n FROM (SELECT (('0x' || substr(sha1('again|' || doc_id), 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM documents) / 64.0)::BIGINT))::INTEGER AS batch FROM documents) GROUP BY batch""")
def a27_rebatch(spark, d):
    return W.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 64, "again").groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT 'a' AS dataset, count(*) AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', count(*) FROM documents WHERE doc_id % 2 = 1")
def a29_dataset_column(spark, d):
    docs = table(spark, d, "documents").withColumn("dataset", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    return docs.groupBy("dataset").agg(F.count("*").alias("n"))

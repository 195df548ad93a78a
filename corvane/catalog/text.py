"""Scalar functions (H), predicates (B7 to B13, B19) and vectors over words (D34 to D37)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.base import CORPUS, LINES, benchmark, corpus, document_lines, grams_sql, pool, query, table, words_sql
from corvane.functions import scrub as S
from corvane.functions import text as T
from corvane.operators import overlap as O


@query(f"SELECT item_id, len({words_sql('text')}) AS n_words, list_sort(list_distinct({grams_sql(words_sql('text'), 6)})) AS grams FROM benchmark")
def h01_shingles(spark, d):
    return benchmark(spark, d).select("item_id", F.size(T.words(F.col("text"))).alias("n_words"), F.array_sort(T.shingles(F.col("text"), 6)).alias("grams"))


@query("""SELECT item_id, len(w) AS n, w[1:3] AS first_three, CASE WHEN len(w) >= 2 THEN array_to_string(w[1:2], ' ') END AS first_pair
FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark)""")
def h02_unicode_words(spark, d):
    w = T.uwords(F.col("text"))
    return benchmark(spark, d).select("item_id", F.size(w).alias("n"), F.slice(w, 1, 3).alias("first_three"), F.get(T.grams(w, 2), F.lit(0)).alias("first_pair"))


@query("""WITH t AS (SELECT item_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM benchmark),
g AS (SELECT item_id, unnest(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) AS gram FROM t WHERE length(t) >= 4)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def h03_char_grams(spark, d):
    return benchmark(spark, d).select(F.explode(T.char_grams(F.col("text"), 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_CONTENT = f"list_filter(regexp_extract_all(regexp_replace(lower(text), '\\[[a-z]+\\]', ' ', 'g'), '[a-z]{{3,}}'), lambda w: NOT list_contains({_STOP}, w))"


@query(f"SELECT doc_id, len({_CONTENT}) AS n, len(list_distinct({_CONTENT})) AS n_distinct FROM documents")
def h04_content_words(spark, d):
    c = T.content_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(c).alias("n"), F.size(F.array_distinct(c)).alias("n_distinct"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.\\-]+@[A-Za-z0-9_.\\-]+\\.[A-Za-z0-9_]+', '[EMAIL]', 'g'),
 '(?i)\\b(?:https?://|www\\.)\\S+', '[URL]', 'g'), '(?i)\\b(?:ext|x|extension)\\.?\\s*[:#]?\\s*\\d{3,5}\\b', '[PHONE]', 'g') AS masked FROM documents""")
def h06_contact_patterns(spark, d):
    t = F.col("text")
    for pattern, tag in ((S.EMAIL, "[EMAIL]"), (S.URL, "[URL]"), (S.EXTENSION, "[PHONE]")):
        t = F.regexp_replace(t, pattern, tag)
    return table(spark, d, "documents").select("doc_id", t.alias("masked"))


@query()
def h05_scrub_cascade(spark, d):
    return S.scrub(table(spark, d, "documents").select("doc_id", "text"), "text", entities=S.ENTITIES).select("doc_id", "scrubbed")


@query("""WITH m AS (SELECT page_id, lower(regexp_extract(url, '://([^/]+)', 1)) AS host FROM pages),
p AS (SELECT page_id, list_filter(string_split(regexp_replace(host, '[^a-z.]+', '.', 'g'), '.'), lambda x: length(x) >= 2) AS parts FROM m)
SELECT page_id, list_sort(list_distinct(CASE WHEN len(parts) >= 2 THEN list_concat(parts, [array_to_string(parts, ' '), parts[1] || ' ' || parts[-1]]) ELSE parts END)) AS names FROM p""")
def h07_address_names(spark, d):
    host = F.lower(F.regexp_extract("url", "://([^/]+)", 1))
    return table(spark, d, "pages").select("page_id", F.array_sort(S.address_names(host)).alias("names"))


@query()
def h08_footer_and_sign_off(spark, d):
    note = F.concat("text", F.lit("\nBest,\nJane Doe\n\nThis e-mail is confidential and more"))
    return S.mask_signed(benchmark(spark, d).select("item_id", S.cut_footer(note).alias("t")), "t")


@query()
def h09_name_pairs(spark, d):
    return benchmark(spark, d).select("item_id", S.mask_pairs(F.concat(F.lit("Payment Date for Jane Doe and John Q. Public, Master Swap. "), "text")).alias("t"))


@query("""SELECT item_id, '[PERSON] and [URL] x ' || text AS t FROM benchmark""")
def h10_collapse_placeholders(spark, d):
    return benchmark(spark, d).select("item_id", S.collapse(F.concat(F.lit("[PERSON], [PERSON]'s [ORG] and [URL][URL] x "), "text")).alias("t"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s\\x{00A0}]+', ' ', 'g')) AS plain FROM pages""")
def h11_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("plain"))


@query()
def h12_sentences(spark, d):
    t = T.strip_numbering(T.strip_markdown(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(t)).alias("n_sentences"), F.length(t).alias("n_chars"), T.truncated(t, 400).alias("cut"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, unnest(range(len(string_split(text, '. ')))) AS i FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha1('cut|7|' || doc_id || '|' || i)) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM s)
SELECT doc_id, count(*) AS kept, sum(i)::BIGINT AS places FROM r WHERE rn > greatest(1, floor(0.3 * n + 0.5)) GROUP BY doc_id""")
def h13_sentence_deletion(spark, d):
    from corvane.functions.numeric import hash_key
    from pyspark.sql import Window

    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    w = Window.partitionBy("doc_id")
    r = s.withColumns({"rn": F.row_number().over(w.orderBy(hash_key("cut", 7, F.col("doc_id"), F.col("i")))), "n": F.count("*").over(w)})
    return r.filter(F.col("rn") > F.greatest(F.lit(1), F.floor(0.3 * F.col("n") + 0.5))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("i").alias("places"))


@query("""SELECT item_id, ['a b', regexp_replace(text, '[^A-Za-z]', '', 'g')] AS items FROM benchmark""")
def h14_json_array(spark, d):
    word = F.regexp_replace("text", "[^A-Za-z]", "")
    fenced = F.concat(F.lit("```json\n[\"a b\", \""), word, F.lit("\"]\n```"))
    bulleted = F.concat(F.lit("- a b\n- "), word)
    return benchmark(spark, d).select("item_id", T.json_strings(F.when(F.col("item_id") % 2 == 0, fenced).otherwise(bulleted)).alias("items"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'A' WHEN event_id % 3 = 1 THEN 'B' END AS choice,
 CASE WHEN event_id % 3 = 2 THEN 50.0 ELSE greatest(50.0, least(100.0, floor(value)::DOUBLE)) END AS conf FROM events""")
def h15_answer_parse(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, "a ").when(F.col("event_id") % 3 == 1, "B: ").otherwise("none")
    raw = F.concat(raw, F.when(F.col("event_id") % 3 < 2, F.floor("value").cast("string")).otherwise(""))
    return table(spark, d, "events").select("event_id", T.letter_first(raw).alias("choice"), T.confidence(raw).alias("conf"))


@query("""SELECT doc_id, sha1('7|' || doc_id) AS key, ('0x' || substr(sha1('7|' || doc_id), 1, 8))::BIGINT AS number, (('0x' || substr(sha1('7|' || doc_id), 40, 1))::INTEGER % 2) AS parity FROM documents""")
def h16_hash_keys(spark, d):
    from corvane.functions.numeric import hash_key, hash_number, hash_parity

    return table(spark, d, "documents").select("doc_id", hash_key(7, F.col("doc_id")).alias("key"), hash_number(7, F.col("doc_id")).alias("number"), hash_parity(7, F.col("doc_id")).alias("parity"))


@query("SELECT item_id, 'Card ' || item_id || ': ' || text || ' [end]' AS prompt FROM benchmark")
def h17_prompt_template(spark, d):
    return benchmark(spark, d).select("item_id", F.format_string("Card %d: %s [end]", "item_id", "text").alias("prompt"))


@query("SELECT event_id, 'u' || user_id || '#x' AS person, event_type AS seed FROM events")
def h18_row_id_parse(spark, d):
    e = table(spark, d, "events").withColumn("rid", F.concat(F.lit("u"), "user_id", F.lit("#x#"), "event_type"))
    return e.select("event_id", F.regexp_extract("rid", "^(.*)#[^#]*$", 1).alias("person"), F.substring_index("rid", "#", -1).alias("seed"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber AS k, (l_suppkey % 5)::INTEGER AS seed, 'G' || l_partkey AS cluster FROM lineitem")
def h19_cell_key_parse(spark, d):
    li = table(spark, d, "lineitem").withColumn("cell", F.concat(F.lit("k"), "l_linenumber", F.lit("_s"), (F.col("l_suppkey") % 5).cast("string"), F.lit("_G"), "l_partkey"))
    part = lambda i: F.regexp_extract("cell", r"k(\d+)_s(\d+)_(.*)", i)
    return li.select("l_orderkey", "l_linenumber", part(1).cast("int").alias("k"), part(2).cast("int").alias("seed"), part(3).alias("cluster"))


@query("""SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log2(p_retailprice), 6) AS lg, round(sqrt(p_retailprice), 6) AS rt,
 round(exp(-p_size / 10.0), 6) AS ex, round(gamma(p_size + 1) / (gamma(4) * gamma(p_size - 2)), 0) AS triples FROM part WHERE p_size >= 4""")
def h20_numeric_functions(spark, d):
    from corvane.functions.numeric import choose

    p = table(spark, d, "part").filter("p_size >= 4")
    return p.select("p_partkey", F.round(F.log("p_retailprice"), 6).alias("ln"), F.round(F.log2("p_retailprice"), 6).alias("lg"), F.round(F.sqrt("p_retailprice"), 6).alias("rt"), F.round(F.exp(-F.col("p_size") / 10), 6).alias("ex"), F.round(choose(F.col("p_size"), F.lit(3)), 0).alias("triples"))


@query("SELECT doc_id, list_filter(['the', 'of', 'que', 'und'], lambda k: contains(text, k)) AS keys FROM documents")
def h21_keyword_scan(spark, d):
    keys = F.array(*[F.lit(k) for k in ("the", "of", "que", "und")])
    return table(spark, d, "documents").select("doc_id", F.filter(keys, lambda k: F.contains(F.col("text"), k)).alias("keys"))


@query("""WITH s AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(trim(line), '\\d+', 'the agreed amount', 'g'), '[A-Z][a-z]+', 'the relevant party', 'g') AS s
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents) WHERE length(trim(line)) >= 15),
k AS (SELECT *, substring(regexp_replace(lower(s), '[^\\p{L}\\p{N}_]+', ' ', 'g'), 1, 60) AS key FROM s)
SELECT key, s FROM (SELECT key, arg_min(s, (doc_id, line_no)) AS s, min((doc_id, line_no)) AS o FROM k GROUP BY key) ORDER BY o LIMIT 14""")
def h22_generic_floor(spark, d):
    lines = O.text_lines(corpus(spark, d), ["doc_id"]).withColumn("s", F.trim("line")).filter(F.length("s") >= 15)
    s = F.regexp_replace(F.regexp_replace("s", r"\d+", "the agreed amount"), "[A-Z][a-z]+", "the relevant party")
    k = lines.withColumn("s", s).withColumn("key", F.substring(F.regexp_replace(F.lower("s"), r"[^\p{L}\p{N}_]+", " "), 1, 60))
    once = k.groupBy("key").agg(F.min_by("s", F.struct("doc_id", "line_no")).alias("s"), F.min(F.struct("doc_id", "line_no")).alias("o"))
    return once.orderBy("o").limit(14).select("key", "s")


@query("""SELECT doc_id FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) WHERE n BETWEEN 40 AND 1500 AND length(text) >= 200""")
def b01_length_filter(spark, d):
    n = T.word_count(F.col("text"))
    return table(spark, d, "documents").filter(n.between(40, 1500) & (F.length("text") >= 200)).select("doc_id")


@query("""WITH m AS (SELECT doc_id, string_split('> quoted' || chr(10) || 'From: x' || chr(10) || ' 12/19/2000 10:09 AM ' || chr(10) || 'on Monday she wrote:' || chr(10) || '--' || chr(10) || chr(10) || 'Original Message board is down' || chr(10)
  || coalesce(text, '') || chr(10) || CASE doc_id % 3 WHEN 0 THEN '  ---- original message ---' WHEN 1 THEN 'On Monday Bob wrote:' ELSE '> On Monday Bob wrote:' END || chr(10) || 'Ann Lee@ECT' || chr(10) || 'last', chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, lines, list_transform(lines, lambda l: trim(l, chr(9) || ' ')) AS s FROM m),
k AS (SELECT *, list_position(list_transform(s, lambda l: regexp_matches(l, '^-+[ \t]*(Original Message|Forwarded by|----)', 'i') OR regexp_matches(l, '^On .+wrote:$')), true) AS mark FROM t),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS n, coalesce(nullif(mark, 0), len(s) + 1) AS upto FROM k)
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS own FROM e WHERE n < upto AND NOT (starts_with(s, '>') OR regexp_matches(s, '^(From|To|Sent|Cc|Bcc|Subject|Date)\\s*:', 'i') OR regexp_matches(s, '^\\d{1,2}/\\d{1,2}/\\d{2,4}\\s+\\d{1,2}:\\d{2}\\s*(AM|PM)?\\s*$', 'i') OR s = 'Ann Lee@ECT') GROUP BY doc_id""")
def b02_quote_strip(spark, d):
    docs = table(spark, d, "documents")
    close = F.when(F.col("doc_id") % 3 == 0, "  ---- original message ---").when(F.col("doc_id") % 3 == 1, "On Monday Bob wrote:").otherwise("> On Monday Bob wrote:")
    mail = F.concat(F.lit("> quoted\nFrom: x\n 12/19/2000 10:09 AM \non Monday she wrote:\n--\n\nOriginal Message board is down\n"), F.coalesce("text", F.lit("")), F.lit("\n"), close, F.lit("\nAnn Lee@ECT\nlast"))
    return docs.select("doc_id", S.own_lines(mail).alias("own"))


@query("""SELECT doc_id, substring(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT starts_with(ltrim(s), '>')), ' '), '\\s+', ' ', 'g')), 1, 1500) AS t FROM documents""")
def b03_comment_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_comment(F.col("text")).alias("t"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)^\\s*\\*\\*\\*|has been marked as a duplicate|Created attachment|\\(In reply to') AS automatic FROM documents""")
def b04_automatic(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("text").rlike(T.AUTOMATIC), F.lit(False)).alias("automatic"))


@query("""SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)dup(?:licate)?(?:$|[^\\p{L}\\p{N}_])|wontfix|won''?t fix|invalid|works ?for ?me|worksforme|not a bug')""")
def b05_leak(spark, d):
    return table(spark, d, "documents").filter(~F.col("text").rlike(T.LEAK)).select("doc_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IS NOT NULL AND o_orderkey <> o_custkey AND length(o_orderpriority) >= 6""")
def b06_class_filter(spark, d):
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_custkey").isNotNull() & (F.col("o_orderkey") != F.col("o_custkey")) & (F.length("o_orderpriority") >= 6)).select("o_orderkey")


@query(f"WITH {LINES} SELECT doc_id, author, count(*) AS n FROM lines GROUP BY doc_id, author")
def b07_content_lines(spark, d):
    return document_lines(spark, d).groupBy("doc_id", "author").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents),
s AS (SELECT doc_id, trim(regexp_replace(raw, '^\\s*[-*•\\d.)#]+\\s*', '')) AS line FROM l)
SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM s WHERE len(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+')) >= 5 AND NOT (upper(line) = line AND lower(line) <> line) GROUP BY doc_id""")
def b08_card_lines(spark, d):
    return O.card_lines(corpus(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("""SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars >= 300
 AND regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(how|why|which|when|calculat|test|model|regress|distribut|estimat|variance|interval|hypothesi|bayes|likelihood|sampl|correlat|significan|assumption|method|interpret|predict|classif|cluster|anova|mixed|effect)(?:$|[^\\p{L}\\p{N}_])')
 AND NOT regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(should i|career|vs\\.?|versus|better|worth|opinion|book|resource|software|which language|jobs?)(?:$|[^\\p{L}\\p{N}_])')""")
def b09_gold_question(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").filter((F.col("n_chars") >= 300) & t.rlike(T.TECHNICAL) & ~t.rlike(T.OPINION))
    return docs.join(table(spark, d, "labels").filter("quality = 1"), "doc_id").select("doc_id")


@query("""WITH l AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN '- ' WHEN 1 THEN '12. ' WHEN 2 THEN '## ' ELSE '' END AS p, trim(line) AS b
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents) WHERE regexp_matches(line, '^[A-Za-z]'))
SELECT doc_id, line_no, p AS prefix, b AS body FROM l""")
def b10_prefix_split(spark, d):
    l = O.text_lines(corpus(spark, d), ["doc_id"]).filter(F.col("line").rlike("^[A-Za-z]"))
    mark = F.when(F.col("line_no") % 4 == 0, "- ").when(F.col("line_no") % 4 == 1, "12. ").when(F.col("line_no") % 4 == 2, "## ").otherwise("")
    l = l.withColumn("line", F.concat(mark, F.col("line")))
    return l.select("doc_id", "line_no", T.line_prefix(F.col("line")).alias("prefix"), T.line_body(F.col("line")).alias("body"))


@query("""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%?'))) AS nums,
 len(list_filter(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%?')), lambda x: NOT list_contains(regexp_extract_all(substring(text, 1, 200), '\\d+(?:\\.\\d+)?%?'), x))) AS lost FROM documents""")
def b11_numbers(spark, d):
    n = T.numbers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_sort(n).alias("nums"), F.size(F.array_except(n, T.numbers(F.substring("text", 1, 200)))).alias("lost"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(request|ask|clarif|more information|more info|additional information|need.{0,20}(steps|details|info))(?:$|[^\\p{L}\\p{N}_])') AS asks FROM documents""")
def b12_request_status(spark, d):
    return table(spark, d, "documents").select("doc_id", T.asks(F.col("text")).alias("asks"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS o, len(regexp_extract_all(substring(text, 1, 900), '\\S+')) AS n FROM documents)
SELECT doc_id, abs(n - o) <= greatest(3, floor(0.3 * o)) AS kept FROM c""")
def b13_length_tolerance(spark, d):
    return table(spark, d, "documents").select("doc_id", T.length_kept(F.col("text"), F.substring("text", 1, 900)).alias("kept"))


@query(f"""WITH {CORPUS} SELECT author, substring(trim(regexp_replace(array_to_string(list(text ORDER BY pos), ' || '), '\\s+', ' ', 'g')), 1, 900) AS reference FROM corpus WHERE pos BETWEEN 2 AND 5 GROUP BY author""")
def b17_reference_text(spark, d):
    c = corpus(spark, d).filter(F.col("pos").between(2, 5)).groupBy("author").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return c.select("author", F.substring(F.trim(F.regexp_replace(F.array_join("x.text", " || "), r"\s+", " ")), 1, 900).alias("reference"))


@query(f"""WITH {CORPUS}, p AS (SELECT author, max(CASE WHEN pos = 12 THEN text END) AS held, max(CASE WHEN pos = 0 THEN text END) AS card FROM corpus GROUP BY author)
SELECT author, sha1(coalesce(held, '')) AS held, sha1(coalesce(card, '')) AS matched, coalesce(held = card, false) AS same FROM p""")
def b18_source_conditions(spark, d):
    p = corpus(spark, d).groupBy("author").agg(F.max(F.when(F.col("pos") == 12, F.col("text"))).alias("h"), F.max(F.when(F.col("pos") == 0, F.col("text"))).alias("c"))
    key = lambda c: F.sha1(F.coalesce(c, F.lit("")).cast("binary"))
    return p.select("author", key(F.col("h")).alias("held"), key(F.col("c")).alias("matched"), F.coalesce(F.col("h") == F.col("c"), F.lit(False)).alias("same"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\S+')) >= 240 AND NOT regexp_matches(text, '[.!?][\\s*_`"''’”)\\]]*$') AS cut FROM documents""")
def b19_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 300).alias("cut"))


@query(f"""WITH g AS (SELECT DISTINCT source AS author, unnest({grams_sql('w', 3)}) AS gram FROM (SELECT source, {words_sql('text')} AS w FROM documents))
SELECT df, count(*) AS n FROM (SELECT gram, count(*) AS df FROM g GROUP BY gram) GROUP BY df""")
def d34_document_frequency(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("author"), "text")
    return O.author_frequency(O.gram_rows(docs, ["author"], "text", 3), "author").groupBy("df").agg(F.count("*").alias("n"))


_TERMS = f"t AS (SELECT doc_id, source AS author, unnest({_CONTENT}) AS term FROM documents), tf AS (SELECT doc_id, author, term, count(*) AS tf FROM t GROUP BY ALL)"


@query(f"""WITH {_TERMS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tf WHERE doc_id % 5 > 0), i AS (SELECT term, ln((n + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM tf, n WHERE doc_id % 5 > 0 GROUP BY term, n),
p AS (SELECT author, term, sum(tf) * any_value(idf) AS w FROM tf JOIN i USING (term) WHERE doc_id % 5 > 0 GROUP BY author, term), q AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN i USING (term) WHERE doc_id % 5 = 0),
pn AS (SELECT author, sqrt(sum(w * w)) AS n FROM p GROUP BY author), qn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM q GROUP BY doc_id),
c AS (SELECT q.doc_id, p.author, sum(p.w * q.w) AS d FROM p JOIN q USING (term) GROUP BY ALL)
SELECT doc_id, arg_max(author, round(d / pn.n / qn.n, 9)) AS predicted, round(max(d / pn.n / qn.n), 6) AS cosine FROM c JOIN pn USING (author) JOIN qn USING (doc_id) GROUP BY doc_id""")
def d35_topic_attribution(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("author"), "text")
    return O.attributed(docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0"), "author", "doc_id").select("doc_id", "predicted", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH a AS (SELECT item_id, unnest(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) AS g FROM (SELECT item_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM benchmark)),
c AS (SELECT item_id, g, count(*) AS tf FROM a GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM c GROUP BY item_id)
SELECT x.item_id AS a, y.item_id AS b, round(sum(x.tf * y.tf) / any_value(nx.n) / any_value(ny.n), 6) AS cosine FROM c x JOIN c y ON x.g = y.g JOIN n nx ON nx.item_id = x.item_id JOIN n ny ON ny.item_id = y.item_id WHERE x.item_id < y.item_id GROUP BY ALL""")
def d36_char_gram_cosines(spark, d):
    tf = O.terms(benchmark(spark, d), ["item_id"], T.char_grams(F.col("text"), 4))
    c = O.sparse_cosines(tf.withColumnRenamed("item_id", "a"), "a", tf.withColumnRenamed("item_id", "b"), "b")
    return c.filter("a < b").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_TERMS}, pop AS (SELECT term, sum(tf) AS tf FROM tf GROUP BY term), q AS (SELECT term, tf / sum(tf) OVER () AS q FROM pop),
a AS (SELECT author, term, sum(tf) AS tf FROM tf GROUP BY ALL), p AS (SELECT author, term, tf / sum(tf) OVER (PARTITION BY author) AS p FROM a),
f AS (SELECT s.author, q.q, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT author FROM a) s CROSS JOIN q LEFT JOIN p ON p.author = s.author AND p.term = q.term)
SELECT author, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2, 6) AS jsd FROM f GROUP BY author""")
def d37_jensen_shannon(spark, d):
    tf = O.terms(corpus(spark, d).select("author", "text"), ["author"], T.content_words(F.col("text")))
    return O.jensen_shannon(tf, "author", tf.groupBy("term").agg(F.sum("tf").alias("tf"))).select("author", F.round("jsd", 6).alias("jsd"))

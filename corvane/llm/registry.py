"""Queries opN_<name> over the fixture tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.shard_kd import kd_shards

    out = kd_shards(documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.simhash_anchor import near_copies

    return near_copies(documents(spark, sf_dir))


def op3_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality_gam import THRESHOLD, held_out, scored, trained

    docs = documents(spark, sf_dir)
    out = scored(docs, trained(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.url_trie import judged

    return judged(documents(spark, sf_dir, "pages"), URL_RULES)


def op5_bloom_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.exact_bloom import exact_copies

    return exact_copies(documents(spark, sf_dir))


def op6_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.line_edit import without_near_lines

    out = without_near_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_hyperplane_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.embed_hyperplane import near_vectors

    return near_vectors(documents(spark, sf_dir, "embeddings"))


def op8_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.pack_gga import packed

    return packed(documents(spark, sf_dir), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.mix_poisson import mixed_copies

    out = mixed_copies(documents(spark, sf_dir), power=0.5, epochs=1.0, seed=42)
    return out.select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"), "shuffle_key", "text")


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.substring_rk import without_repeats

    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.conversation_repair import damaged, repaired, report

    return report(repaired(damaged(documents(spark, sf_dir, "conversations")), present="here"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.bpe_verify import decoded, encoded

    path = tokenizer_path("byte_bpe_50k.json")
    out = decoded(encoded(documents(spark, sf_dir).select("doc_id", "text"), path, drop_text=True), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.source_divergence import divergences

    return divergences(documents(spark, sf_dir), min_docs=3, top=200)


OP4_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
parsed AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
fits AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parsed p LEFT JOIN fits f USING (page_id)
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

OP9_SQL = r"""
WITH sized AS (SELECT *, coalesce('=' || source, 'null') AS src, coalesce(strlen(text), 0) + 1 AS size FROM documents),
sums AS (SELECT src, sum(size)::DOUBLE AS bytes FROM sized GROUP BY src),
rated AS (SELECT src, sqrt(bytes) / (SELECT sum(sqrt(bytes)) FROM sums) * (SELECT sum(bytes) FROM sums) / bytes AS rate FROM sums),
steps AS (SELECT src, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 21)::BIGINT)) AS k FROM rated),
cdf AS (SELECT src, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS c FROM steps),
drawn AS (SELECT doc_id, source, src, text, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM sized),
counted AS (SELECT d.doc_id, count(*) AS copies FROM drawn d JOIN cdf USING (src) WHERE cdf.c <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.source, k::INTEGER AS copy, round(r.rate, 9) AS rate, md5('42|' || d.doc_id || '|' || k) AS shuffle_key, d.text
FROM (SELECT doc_id, unnest(range(0, copies)) AS k FROM counted) c JOIN drawn d USING (doc_id) JOIN rated r USING (src)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS whole FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n)::HUGEINT AS own FROM counts GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(o.own, 0) + s.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (s.whole + s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term) LEFT JOIN own o USING (lang, source)),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM cells WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kd_shards, op2_anchor_simhash, op3_additive_quality, op4_url_trie, op5_bloom_exact, op6_segment_lines, op7_hyperplane_vectors, op8_genetic_packing, op9_poisson_mix, op10_window_dedup, op11_conversation_repair, op12_bpe_round_trip, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_trie": OP4_SQL, "op5_bloom_exact": OP5_SQL, "op9_poisson_mix": OP9_SQL, "op13_source_divergence": OP13_SQL}

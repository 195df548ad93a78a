"""Shared word runs: exploded shingles, semi-joins on them, and what they say about lines and authors.

Runs are joined as rows. Both sides are distinct per unit before a join, so a frequent run costs its
units once each, and Spark may split its partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.runs import run_rows, written_rows
from corvane.functions.text import CONTENT_WORD, STOP_WORDS, bare_words, card_line, grams, is_shouted, uwords, words
from corvane.sources.stores import settled


def text_lines(texts: DataFrame, keys: list[str], text: str = "text", pattern: str = "\n") -> DataFrame:
    """keys, line_no (from 0), line."""
    return texts.select(*keys, F.posexplode(F.split(text, pattern)).alias("line_no", "line"))


def content_lines(texts: DataFrame, keys: list[str], text: str = "text", n: int = 6) -> DataFrame:
    """keys, line_no, line, tokens (its plain words) of the lines that can hold a run of `n` words."""
    split = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), words(line).alias("tokens")))
    found = texts.select(*keys, F.posexplode(split).alias("line_no", "_line")).select(*keys, "line_no", "_line.line", "_line.tokens")
    return found.filter((F.size("tokens") >= n) & ~is_shouted(F.col("line")))


def _tokens(texts: DataFrame, text: str) -> Column:
    """The words of a column; those of `content_lines` are at hand."""
    return F.col("tokens") if text == "line" and "tokens" in texts.columns else words(F.col(text))


def card_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines without bullets that have five words and are not shouted."""
    found = text_lines(texts, keys, text).withColumn("line", card_line(F.col("line")))
    return found.filter((F.size(uwords(F.col("line"))) >= 5) & ~is_shouted(F.col("line")))


def exploded_grams(texts: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """keys, gram: the distinct runs of each row's text."""
    return texts.select(*keys, F.explode(F.array_distinct(grams(_tokens(texts, text), n))).alias("gram"))


def gram_rows(texts: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """keys, gram: the runs of each row's text as hashes, with repeats."""
    return run_rows(texts, keys, F.col(text), n)


def positioned_grams(texts: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """keys, pos (from 0), gram: all runs in order, as hashes."""
    return run_rows(texts, keys, F.col(text), n, pos=True)


def pool_keys(pool: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The distinct gram (and `on`) of a pool, as hashes; runs that are written out are hashed here."""
    rows = written_rows(pool, on or []) if pool.schema["gram"].dataType.simpleString() == "string" else pool
    return rows.select("gram", *(on or [])).distinct()


#: Rows of a pool that go to every task, so that the lines' runs need not move; larger pools are joined by a shuffle.
SENT = 500_000


def sent(pool: DataFrame, most: int | None = None) -> DataFrame:
    """A pool, worked out once, and to be broadcast if it has at most `most` (SENT) rows."""
    kept = settled(pool)
    return F.broadcast(kept) if kept.count() <= (SENT if most is None else most) else kept


def lines_hit(lines: DataFrame, keys: list[str], pool: DataFrame, n: int = 6, on: list[str] | None = None) -> DataFrame:
    """keys of the lines that share a run with `pool` (gram: hashes of runs, and the columns `on` that must agree)."""
    on = on or []
    units = gram_rows(lines, list(dict.fromkeys([*keys, *on])), "line", n)
    return units.join(sent(pool_keys(pool, on)), ["gram", *on], "left_semi").select(*keys).distinct()


def certificate(lines: DataFrame, group: str, keys: list[str], pool: DataFrame, n: int = 6) -> DataFrame:
    """Per group: lines, lines that share a run of `n` words with the pool, and their share."""
    hit = lines_hit(lines, keys, pool, n).withColumn("hit", F.lit(1))
    out = lines.select(group, *[k for k in keys if k != group]).join(hit, keys, "left").groupBy(group)
    return out.agg(F.count("*").alias("n_lines"), F.count("hit").alias("n_hit"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


def merged_runs(hits: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """Hit positions that overlap or touch, as maximal runs: keys, first, last (words, inclusive), n_words."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = hits.withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) <= n, 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "run").agg(F.min("pos").alias("first"), (F.max("pos") + n - 1).alias("last"))
    return out.select(*keys, "run", "first", "last", (F.col("last") - F.col("first") + 1).alias("n_words"))


def coverage(lines: DataFrame, keys: list[str], pool: DataFrame, n: int = 6) -> DataFrame:
    """keys, n_words, covered, n_runs of every line: how much of it lies in runs that the pool holds."""
    hits = positioned_grams(lines, keys, "line", n).join(sent(pool_keys(pool)), "gram", "left_semi")
    runs = merged_runs(hits, keys, n).groupBy(*keys).agg(F.sum("n_words").alias("covered"), F.count("*").alias("n_runs"))
    every = lines.select(*keys, F.size(_tokens(lines, "line")).alias("n_words"))
    return every.join(runs, keys, "left").na.fill(0, ["covered", "n_runs"])


def rewrite_census(texts: DataFrame, keys: list[str], old: str, new: str, n: int = 6) -> DataFrame:
    """keys, same (but for white space at the ends), kept6 (of the old text's runs, the share that the new one has; null: it has none), length_ratio in words."""
    bare = lambda c: F.btrim(F.col(c), F.lit(" \n\t\r"))
    both = texts.select(*keys, (bare(old) == bare(new)).alias("same"), words(F.col(old)).alias("_a"), words(F.col(new)).alias("_b"))
    runs = both.select(*keys, "same", (F.size("_b") / F.greatest(F.lit(1), F.size("_a"))).alias("length_ratio"), F.array_distinct(grams(F.col("_a"), n)).alias("_ga"), grams(F.col("_b"), n).alias("_gb"))
    return runs.select(*keys, "same", (F.size(F.array_intersect("_ga", "_gb")) / F.nullif(F.size("_ga"), F.lit(0))).alias("kept6"), "length_ratio")


def author_frequency(grams_of: DataFrame, author: str) -> DataFrame:
    """gram, df: in how many authors' texts. Most runs occur once, so rows move as they are, and once."""
    return grams_of.select("gram", author).repartition("gram").distinct().groupBy("gram").agg(F.count(author).alias("df"))


def overlap_scores(card_lines_: DataFrame, card: str, pool: DataFrame, author: str, n: int, rare_df: int = 2) -> DataFrame:
    """card, author, s1, s2, s3: the share of a card's lines that share a run, or a rare run, with the author's texts, and the share of the card's runs.

    Only pairs that share a run are returned; all others score zero.
    """
    rare = author_frequency(pool, author).withColumn("rare", F.col("df") <= rare_df).select("gram", "rare")
    met = settled(gram_rows(card_lines_, [card, "line_no"], "line", n).join(sent(pool.select("gram", author).distinct().join(rare, "gram")), "gram"))
    # one row per line, then per card: no distinct counts side by side
    per_line = met.groupBy(card, author, "line_no").agg(F.max("rare").alias("rare"))
    shared = met.select(card, author, "gram").distinct().groupBy(card, author).agg(F.count("*").alias("shared"))
    hits = per_line.groupBy(card, author).agg(F.count("*").alias("hit"), F.count_if("rare").alias("rare_hit")).join(shared, [card, author])
    # only cards that share a run have scores, so only theirs are counted
    own = card_lines_.join(met.select(card).distinct(), card, "left_semi")
    lines = own.filter(F.size(_tokens(own, "line")) >= n).groupBy(card).agg(F.count("*").alias("n_lines"))
    sizes = lines.join(gram_rows(own, [card], "line", n).groupBy(card).agg(F.count_distinct("gram").alias("n_grams")), card)
    return hits.join(sizes, card).select(card, author, (F.col("hit") / F.col("n_lines")).alias("s1"), (F.col("rare_hit") / F.col("n_lines")).alias("s2"), (F.col("shared") / F.col("n_grams")).alias("s3"))


def longest_shared_run(card_lines_: DataFrame, card: str, texts: DataFrame, author: str, n: int, most: int = 20, text: str = "text") -> DataFrame:
    """card, author, s4: the longest run of n to `most` words that a line shares with the author's texts.

    Runs of `n` that a line and a text share are laid on diagonals (difference of their places); a
    sequence of neighbours on a diagonal is a longer run.
    """
    a = positioned_grams(card_lines_, [card, "line_no"], "line", n)
    b = positioned_grams(texts.withColumn("_text", F.monotonically_increasing_id()), [author, "_text"], text, n).withColumnRenamed("pos", "pos_b")
    met = a.join(sent(b), "gram").withColumn("diagonal", F.col("pos") - F.col("pos_b"))
    keys = [card, "line_no", author, "_text", "diagonal"]
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    runs = met.withColumn("island", island).groupBy(*keys, "island").agg((F.count("*") + n - 1).alias("run"))
    return runs.groupBy(card, author).agg(F.least(F.max("run"), F.lit(most)).alias("s4"))


def shared_block(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest run of equal tokens, by names of the runs of each power of two (exact, n log n)."""
    n, most = len(x), min(len(x), len(y))
    names = np.unique(np.concatenate([x, y]).astype(str), return_inverse=True)[1] if most else np.zeros(0, np.int64)
    a, b = names[:n], names[n:]

    def longer(a: np.ndarray, b: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        base = int(max(a.max(), b.max())) + 1
        return a[: len(a) - by] * base + a[by:], b[: len(b) - by] * base + b[by:]

    if not most or not np.isin(a, b).any():
        return 0
    size = 1
    while 2 * size <= most:
        c, d = longer(a, b, size)
        if not np.isin(c, d).any():
            break
        names = np.unique(np.concatenate([c, d]), return_inverse=True)[1]
        a, b, size = names[: len(c)], names[len(c) :], 2 * size
    low, high = size, min(2 * size - 1, most)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.isin(*longer(a, b, middle - size)).any() else (low, middle - 1)
    return low


def longest_token_block(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, block: the longest run of equal tokens of two arrays; a null array has none."""

    @F.pandas_udf("long")
    def block(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else shared_block(x, y) for x, y in zip(left, right)], dtype="int64")

    return pairs.select(*keys, block(a, b).alias("block"))


def terms(texts: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """keys, term, tf of an array of tokens."""
    return texts.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def sparse_cosines(a: DataFrame, key_a: str, b: DataFrame, key_b: str, on: list[str] | None = None, weight: str = "tf") -> DataFrame:
    """key_a, key_b, cosine of all pairs of sparse vectors (key, term, weight) that share a term (and `on`)."""
    on = on or []
    norm = lambda v, k: v.groupBy(k).agg(F.sqrt(F.sum(F.col(weight).cast("double") * F.col(weight))).alias(f"_norm_{k}"))
    left = a.select(key_a, *on, "term", F.col(weight).cast("double").alias("_wa"))
    right = b.select(key_b, *on, "term", F.col(weight).cast("double").alias("_wb"))
    dots = left.join(right, ["term", *on]).groupBy(key_a, key_b).agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot"))
    out = dots.join(norm(a, key_a), key_a).join(norm(b, key_b), key_b)
    return out.select(key_a, key_b, (F.col("_dot") / (F.col(f"_norm_{key_a}") * F.col(f"_norm_{key_b}"))).alias("cosine"))


#: Characters of texts that a task counts at once.
COUNTED = 1 << 22


def content_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, df: content words and how many texts have them, per key within parts of Arrow batches; sums are the caller's.

    A row without a term counts the texts that have any. With a key of one text each, a row is a text's own count.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(CONTENT_WORD)
        for batch in batches:
            low, at = batch.column(1), 0
            while at < len(low):
                found, start, size = [], at, 0
                while at < len(low) and size < COUNTED:
                    one = low[at].as_py()
                    found.append(word.findall(one))
                    size += len(one) + 50
                    at += 1
                codes, names = pd.factorize(np.array(list(chain.from_iterable(found)), object))
                plain = ~np.isin(codes, np.flatnonzero(pd.Index(names, dtype=object).isin(STOP_WORDS)))
                owner = np.repeat(np.arange(len(found)), [len(w) for w in found])[plain]
                if not len(owner):
                    continue
                width = len(names) + 1  # the last place counts the texts
                cells, tf = np.unique(np.concatenate([owner * width + codes[plain], np.unique(owner) * width + len(names)]), return_counts=True)
                own = batch.column(0).slice(start, len(found)).dictionary_encode()
                kinds = own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                keyed = kinds[cells // width] * width + cells % width
                order = np.argsort(keyed, kind="stable")
                keyed = keyed[order]
                first = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]]))
                kind, term = np.divmod(keyed[first], width)
                take = lambda values, index, none: values.take(pa.array(index, mask=index == none))
                columns = [take(own.dictionary, kind, len(own.dictionary)), take(pa.array(names, pa.string()), term, len(names)), pa.array(np.add.reduceat(tf[order], first)), pa.array(np.diff(np.append(first, len(keyed))))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "tf", "df"])

    return texts.select(key, bare_words(F.col(text)).alias("_bare")).mapInArrow(counted, f"`{key}` {texts.schema[key].dataType.simpleString()}, term string, tf bigint, df bigint")


#: Entries of profiles (author and term) of the most frequent terms that go to every task; the other terms are joined by a shuffle.
HOT = 1 << 19


def attributed(known: DataFrame, asked: DataFrame, author: str, doc: str, text: str = "text", hot: int | None = None) -> DataFrame:
    """doc, predicted, cosine: the author whose known texts are nearest to an asked text by TF-IDF of content words (ties to 9 places: the first name).

    `doc` is a key of `asked`, and a row of `known` is one document. A text meets the profiles of frequent terms where it lies, so its
    sums are made there; only its rare terms, which few authors have, move.
    """
    own = settled(content_counts(known, author, text).repartition("term").groupBy(author, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))
    n = own.filter(F.col("term").isNull()).agg(F.sum("df").alias("n"))
    df = own.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    weights = settled(df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    profile = settled(own.filter(F.col(author).isNotNull()).join(weights.select("term", "idf"), "term").select(author, "term", "idf", (F.col("tf") * F.col("idf")).alias("_w")))
    # a term's row without an author stands for the asked text itself
    entries = profile.unionByName(weights.select(F.lit(None).cast(profile.schema[author].dataType).alias(author), "term", "idf", F.lit(None).cast("double").alias("_w")))
    norms = profile.groupBy(author).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    most = (HOT if hot is None else hot) // (norms.count() + 1)
    terms_hot = settled(weights.orderBy(F.desc("df"), "term").limit(most).select("term"))
    texts = settled(content_counts(asked, doc, text).filter(F.col("term").isNotNull()).select(doc, "term", "tf"))
    w = F.col("tf") * F.col("idf")
    dot = F.sum(w * F.coalesce(F.col("_w"), w)).alias("_dot")
    here = texts.join(F.broadcast(settled(entries.join(F.broadcast(terms_hot), "term", "left_semi"))), "term").groupBy(doc, author).agg(dot)
    # most of these pairs are met once, so rows move as they are
    rare = texts.join(F.broadcast(terms_hot), "term", "left_anti").join(entries.join(F.broadcast(terms_hot), "term", "left_anti"), "term").select(doc, author, (w * F.coalesce(F.col("_w"), w)).alias("_dot"))
    dots = here.unionByName(rare).repartition(doc).groupBy(doc, author).agg(F.sum("_dot").alias("_dot"))
    sized = dots.withColumn("_own", F.sqrt(F.max(F.when(F.col(author).isNull(), F.col("_dot"))).over(Window.partitionBy(doc))))
    cosines = sized.join(norms, author).select(doc, author, (F.col("_dot") / (F.col("_norm") * F.col("_own"))).alias("cosine"))
    return cosines.groupBy(doc).agg(F.min_by(author, F.struct(-F.round("cosine", 9), F.col(author))).alias("predicted"), F.max("cosine").alias("cosine"))


def jensen_shannon(a: DataFrame, key: str, population: DataFrame) -> DataFrame:
    """key, jsd: divergence (base 2) of each key's term distribution from the population's (term, tf)."""
    total = population.agg(F.sum("tf").alias("n"))
    q = population.join(F.broadcast(total)).select("term", (F.col("tf") / F.col("n")).alias("q"))
    own = a.groupBy(key).agg(F.sum("tf").alias("own"))
    p = a.join(own, key).select(key, "term", (F.col("tf") / F.col("own")).alias("p"))
    # terms of the population that a key lacks add q / 2 each: their sum is what its own terms leave of 1
    met = p.join(q, "term", "left").na.fill(0.0, ["q"])
    m = (F.col("p") + F.col("q")) / 2
    part = F.col("p") * F.log2(F.col("p") / m) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / m)).otherwise(0.0)
    return met.groupBy(key).agg(((F.sum(part) + (1 - F.sum("q"))) / 2).alias("jsd"))

"""How the sources of a language diverge in their use of terms: chi-squared distances of smoothed term rates.

A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps the terms of
at least `min_docs` of its documents. With V kept terms and N occurrences of them, a source's (or the language's)
rate of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), and two rates differ by f(p, q) = floor((p - q)^2 / q).

Pairs of sources are never compared term by term. Each starts at V times the f of two zero counts, the baseline.
Terms that one side has correct it: postings of a source are summed by count first, for all terms of a count
have one correction. Where both sides have a term the two corrections miss the truth by a fixed amount, which
the term's posting list adds; tasks sum these by pair in blocks and emit what is not zero.

Counting is by task in Python (a regular expression over bytes), the rest in SQL functions but for the
posting lists. The largest group is a term's list, one entry per source of the language; the answer holds
the square of that.

Defined results: null text, lang and source count as ''; empty texts and texts without letters have no terms, but
their source is there; repeated rows are separate documents; a language without kept terms has pairs of value 0;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_split, lean, small_batches, written

#: Rates are whole numbers of this part.
UNIT = 1_000_000_000
#: Distinct (source, term) counts that a task holds before it emits them.
KEPT = 500_000
#: Sources of a block of pairs, blocks that a task holds, and pairs that are compared at a time.
BLOCK = 256
BLOCKS = 32
PAIRS = 1 << 18
#: Tasks at least over which the pairs of one language are spread.
SALTS = 32
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term), summed over parts of the table only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = defaultdict(Counter), defaultdict(Counter)

        def emit() -> list[pa.RecordBatch]:
            parts = []
            for (lang, source), own in n.items():
                seen = docs.pop((lang, source))
                terms, size = pa.array(own.keys(), pa.binary()).cast(pa.string()), len(own)
                names = [pa.DictionaryArray.from_arrays(np.zeros(size, np.int32), [x]).cast(pa.string()) for x in (lang, source)]
                counts = [np.fromiter(x, np.int64, size) for x in (own.values(), map(seen.__getitem__, own))]
                parts.append(pa.RecordBatch.from_arrays([*names, terms, *map(pa.array, counts)], names=["lang", "source", "term", "n", "docs"]))
            n.clear()
            return parts

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                found = _TERM.findall(text.as_py().encode().lower())
                own, group = docs[lang.as_py(), source.as_py()], n[lang.as_py(), source.as_py()]
                held -= len(group)
                group.update(found)
                own.update(set(found))
                held += len(group)
                if held >= KEPT:
                    yield from emit()
                    held = 0
        yield from emit()

    small_batches(docs.sparkSession)
    some = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return some.mapInArrow(lean(scan), "lang string, source string, term string, n long, docs long")


def rate(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + terms)), in longs where the product fits and in decimals beyond."""
    over = F.when(terms > 0, total + terms)
    small = F.call_function("div", F.lit(UNIT) * (n + 1), over)
    large = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), over.cast("decimal(20,0)"))
    return F.when(over < 9_000_000_000, small).otherwise(large) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, source, n, total (in the language), head (true in one row of the term)."""
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = counts.select("*", F.sum("docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).alias("head"))
    return seen.filter(F.col("all_docs") >= min_docs).select("lang", "term", "source", "n", "total", "head")


def sources(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, no (from 0 by language), terms (V), own (N of the source), whole (N of the language), zero (rate of count 0), rows."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("rows"), F.sum(F.col("head").cast("long")).alias("heads"))
    lang = Window.partitionBy("lang")
    zero = F.coalesce(F.col("own"), F.lit(0))
    out = groups.join(own, ["lang", "source"], "left").select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("no"), zero.alias("own"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce(F.sum("heads").over(lang), F.lit(0)).alias("terms"), F.sum(zero).over(lang).alias("whole"))
    return out.withColumn("zero", rate(F.lit(0), F.col("own"), F.col("terms")))


def shared_corrections(rated: DataFrame) -> DataFrame:
    """lang, a, b (numbers of sources), value: what the terms of both add to the corrections of each side."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, x, y), block in blocks.items():
                a, b = np.nonzero(block)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + x * BLOCK), pa.array(b + y * BLOCK), pa.array(block[a, b])], names=["lang", "a", "b", "value"])
            blocks.clear()

        def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (p - q) ** 2 // q

        for batch in batches:
            lists, langs = batch.column("posting"), batch.column("lang").to_pylist()
            first = lists.offsets.to_numpy().astype(np.int64)
            no, p, zero = (c.to_numpy() for c in lists.values.flatten())
            row = np.repeat(np.arange(len(langs)), np.diff(first))
            size = np.diff(first)[row]
            _, lang_of = np.unique(np.array(langs, object), return_inverse=True)
            upto, entry = np.concatenate([[0], np.cumsum(size)]), first[0]
            begin = 0
            while begin < len(row):
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PAIRS, side="right")) - 1)
                n = size[begin:end]
                i = np.repeat(np.arange(begin, end), n) + entry
                j = np.repeat(first[row[begin:end]], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                i, j = i[i != j], j[i != j]
                value = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
                x, y = no[i] // BLOCK, no[j] // BLOCK
                wide = int(y.max(initial=0)) + 1
                kind = (lang_of[row[i - entry]] * wide + x) * wide + y
                for own in np.unique(kind).tolist():
                    here = np.flatnonzero(kind == own)
                    key = (langs[row[i[here[0]] - entry]], int(x[here[0]]), int(y[here[0]]))
                    if key not in blocks and len(blocks) >= BLOCKS:
                        yield from emit()
                    block = blocks.setdefault(key, np.zeros((BLOCK, BLOCK), np.int64))
                    np.add.at(block, (no[i[here]] % BLOCK, no[j[here]] % BLOCK), value[here])
                begin = end
        yield from emit()

    lists = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "zero")).alias("posting")).filter(F.size("posting") > 1)
    parts = lists.select("lang", "posting").mapInArrow(lean(scan), "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_distances(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value: f summed over all kept terms."""
    histogram = rated.groupBy("lang", "no", "p").agg(F.count("*").alias("k")).groupBy("lang", "no").agg(F.collect_list(F.struct("p", "k")).alias("histogram"))
    sides = groups.join(histogram, ["lang", "no"], "left").select("lang", "no", "source", "terms", "zero", F.coalesce("histogram", F.array().cast("array<struct<p:bigint,k:bigint>>")).alias("histogram"))
    a = sides.select("lang", F.pmod("no", F.lit(SALTS)).alias("salt"), *[F.col(c).alias(f"{c}_a") for c in ("no", "source", "zero", "histogram")], "terms")
    b = sides.select("lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("no", "source", "zero", "histogram")])
    pairs = a.join(b, ["lang", "salt"]).filter(F.col("no_a") != F.col("no_b"))
    base = distance(F.col("zero_a"), F.col("zero_b"))
    of_a = F.aggregate("histogram_a", F.lit(0).cast("long"), lambda s, x: s + x["k"] * (distance(x["p"], F.col("zero_b")) - F.col("base")))
    of_b = F.aggregate("histogram_b", F.lit(0).cast("long"), lambda s, x: s + x["k"] * (distance(F.col("zero_a"), x["p"]) - F.col("base")))
    rough = pairs.withColumn("base", base).select("lang", F.col("no_a").cast("long").alias("a"), F.col("no_b").cast("long").alias("b"), F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.when(F.col("terms") > 0, F.col("terms") * F.col("base") + of_a + of_b).otherwise(F.lit(0)).alias("rough"))
    both = rough.join(shared_corrections(rated), ["lang", "a", "b"], "left")
    return both.select("lang", "source", "item", (F.col("rough") + F.coalesce("value", F.lit(0))).alias("value"))


def divergences(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: every other source of the language by distance. Part `term`: the `top` terms that the source
    uses more than the language as a whole.
    """
    postings = written(kept_postings(docs, min_docs))
    groups = written(sources(docs, postings))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    rated = written(join_split(postings, groups, ["lang", "source"], "rows", total).withColumn("p", rate(F.col("n"), F.col("own"), F.col("terms"))))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    q = rate(F.col("total"), F.col("whole"), F.col("terms"))
    terms = rated.withColumn("q", q).filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    pairs = pair_distances(rated, groups).withColumn("rank", F.row_number().over(ranked))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))

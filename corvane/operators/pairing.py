"""Joins that pair records: paired differences, coverage, negatives, matched controls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.hashing import sha1_heads, tails
from corvane.functions.numeric import hash_key
from corvane.functions.text import run_key
from corvane.operators.greedy import BLOCK_ROWS, BatchPass, CaliperPass, chained, kept_in_order, near_pairs, near_set_candidates
from corvane.sources.stores import settled


def lookup(left: DataFrame, table: DataFrame, key: str, table_key: str, value: str, most: int = 1_000_000) -> DataFrame:
    """`left` with the table's value, null where it has none; the table is broadcast only if it has at most `most` rows."""
    side = table.select(F.col(table_key).alias("_key"), value)
    side = F.broadcast(side) if side.limit(most + 1).count() <= most else side
    return left.join(side, F.col(key) == F.col("_key"), "left").drop("_key")


def coverage_gaps(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: missing (expected, not there) or extra (there, not expected)."""
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(got.select(*keys).distinct().withColumn("_g", F.lit(1)), keys, "full_outer")
    return both.filter(F.col("_e").isNull() | F.col("_g").isNull()).select(*keys, F.when(F.col("_g").isNull(), "missing").otherwise("extra").alias("state"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, a, b, diff, state (both, only_a, only_b): nothing unpaired is lost silently."""
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    out = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), keys, "full_outer")
    state = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return out.select(*keys, "a", "b", (F.col("a") - F.col("b")).alias("diff"), state.alias("state"))


def unique_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of several waves, with _copies: in a sound merge it is 1 everywhere."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("_copies", F.count("*").over(Window.partitionBy(*keys)))


def last_record(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the given order (file names in the order of their letters, then place)."""
    value = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("_v")).select(key, "_v.*")


def nearest(scores: DataFrame, by: list[str], candidate: str, score: str, m: int, nearest_first: bool = True) -> DataFrame:
    """The `m` candidates of each group with the highest (or lowest) score; ties by candidate."""
    order = F.desc(score) if nearest_first else F.asc(score)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, candidate))).filter(F.col("rank") <= m)


def hash_pick(rows: DataFrame, by: list[str], item: str, m: int, *salt: Column | str | int, skip: int = 0) -> DataFrame:
    """`m` items of each group in the order of salted hashes, after `skip`."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_key(*salt, *[F.col(b) for b in by], F.col(item)), item))
    return rows.withColumn("rank", rank).filter((F.col("rank") > skip) & (F.col("rank") <= skip + m))


#: Authors of a block, and hashes that one row of work makes (about), unless CHUNKS chunks of seekers are not enough for that.
AUTHORS = 20_000
HASHES = 1_000_000
#: Each chunk of seekers meets a copy of all authors, so their number must not grow with the seekers.
CHUNKS = 64


def picked_strangers(membership: DataFrame, cluster: str, author: str, m: int, *salt: str | int, per_member: bool = False) -> DataFrame:
    """cluster, (member,) author, rank: the `m` strangers of each cluster, or of each of its members, with the least salted hashes.

    The same as `hash_pick` of `strangers`, whose pairs are never rows: seekers in chunks meet authors in blocks, and a seeker
    leaves a block with at most `m` authors. Every hash is still made, so the work is that of all pairs. A cluster's members
    come with its seekers.
    """
    kinds = {c: membership.schema[c].dataType.simpleString() for c in (cluster, author)}
    tail = lambda c: F.coalesce(F.concat(F.lit("|"), F.col(c).cast("string")), F.lit(""))  # noqa: E731  # as concat_ws has it
    everyone = membership.select(author).distinct()
    own = membership.groupBy(cluster).agg(F.collect_set(F.col(author).cast("string")).alias("_own"))
    seekers = membership.select(cluster, F.col(author).alias("member")).distinct() if per_member else membership.select(cluster).distinct()
    n_authors, n_seekers = everyone.count(), seekers.count()
    blocks = max(1, -(-n_authors // AUTHORS))
    chunk = max(1, HASHES * blocks // max(1, n_authors))
    chunks = max(1, min(CHUNKS, -(-n_seekers // chunk)))
    names = [cluster, "member"] if per_member else [cluster]
    prefix = F.concat_ws("|", *[F.lit(str(s)) for s in salt], *[F.col(c).cast("string") for c in names])
    asked = seekers.join(own, cluster).groupBy(F.pmod(F.xxhash64(*names), F.lit(chunks)).alias("_chunk")).agg(F.collect_list(F.struct(*names, prefix.alias("_prefix"), "_own")).alias("_seekers"))
    offered = everyone.groupBy(F.pmod(F.xxhash64(author), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(F.col(author).alias("author"), tail(author).alias("tail"))).alias("_authors"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for found, authors in zip(frame["_seekers"], frame["_authors"]):
                out = []
                texts = [a["tail"] for a in authors]
                at = {t: k for k, t in enumerate(texts)}
                rest, n = tails([t.encode() for t in texts]), len(texts)
                for s in found:
                    heads = sha1_heads(s["_prefix"].encode(), rest, n)
                    barred = [at[f"|{o}"] for o in s["_own"] if f"|{o}" in at]
                    heads[barred] = np.iinfo(np.uint64).max
                    least = np.flatnonzero(heads <= np.partition(heads, m - 1)[m - 1]) if n > m else np.arange(n)
                    gone = set(barred)
                    # equal heads at the border all stay: the whole hash decides
                    out += [(*[s[c] for c in names], authors[k]["author"]) for k in least.tolist() if k not in gone]
                yield pd.DataFrame(out, columns=[*names, author], dtype=object)

    schema = ", ".join([f"`{cluster}` {kinds[cluster]}", *[f"member {kinds[author]}"] * per_member, f"`{author}` {kinds[author]}"])
    work = asked.crossJoin(offered).select("_seekers", "_authors").repartition(min(2_000, chunks * blocks))
    return hash_pick(work.mapInPandas(pick, schema), names, author, m, *salt)


def stranger_counts(membership: DataFrame, cluster: str, author: str, unions: list[DataFrame] | None = None) -> DataFrame:
    """cluster, n: how many `strangers` each cluster has (clusters without any have no row).

    Authors in the same groups of all other groupings are one class, barred as a whole by a cluster with a member in one of
    these groups: a cluster meets classes, not authors. Members of classes that are not barred are taken off singly.
    """
    everyone, own = membership.select(author).distinct(), membership.select(cluster, author).distinct()
    total = everyone.agg(F.count("*").alias("_all"))
    groups = None
    for k, other in enumerate(unions or []):
        one = other.select(author, F.struct(F.lit(k).alias("k"), F.col(cluster).cast("string").alias("g")).alias("_g")).filter("_g.g IS NOT NULL")
        groups = one if groups is None else groups.unionByName(one)
    if groups is None:
        barred = own.filter(F.col(author).isNotNull()).groupBy(cluster).agg(F.count("*").alias("_n"))
    else:
        classed = everyone.join(groups.groupBy(author).agg(F.array_sort(F.collect_set("_g")).alias("_class")), author)
        classes = classed.groupBy("_class").agg(F.count("*").alias("_size"))
        met = own.join(groups, author).select(cluster, "_g").distinct()
        shut = met.join(classes.select("_class", "_size", F.explode("_class").alias("_g")), "_g").select(cluster, "_class", "_size").distinct()
        single = own.filter(F.col(author).isNotNull()).join(classed, author, "left").join(shut.select(cluster, "_class", F.lit(1).alias("_shut")), [cluster, "_class"], "left").filter("_shut IS NULL").select(cluster, F.lit(1).cast("long").alias("_n"))
        barred = shut.select(cluster, F.col("_size").alias("_n")).unionByName(single).groupBy(cluster).agg(F.sum("_n").alias("_n"))
    out = membership.select(cluster).distinct().join(barred, cluster, "left").crossJoin(F.broadcast(total))
    return out.select(cluster, (F.col("_all") - F.coalesce("_n", F.lit(0))).alias("n")).filter("n > 0")


def strangers(membership: DataFrame, cluster: str, author: str, unions: list[DataFrame] | None = None) -> DataFrame:
    """cluster, author: everyone who is not a member of the cluster, nor shares a group with a member under the other groupings."""
    clusters, everyone = membership.select(cluster).distinct(), membership.select(author).distinct()
    barred = membership.select(cluster, author)
    for other in unions or []:
        mates = other.select(F.col(author).alias("_m"), F.col(cluster).alias("_g")).join(other.select(F.col(cluster).alias("_g"), F.col(author)), "_g")
        barred = barred.unionByName(membership.select(cluster, F.col(author).alias("_m")).join(mates, "_m").select(cluster, author))
    # bounded by the number of clusters times authors, which is the size of the answer
    return clusters.join(everyone, how="cross").join(barred.distinct(), [cluster, author], "left_anti")


#: Vectors of a block, and those of them that are scored at once against another block.
BLOCK = 2_000
ROWS = 250


def _scores(x: list, y: list) -> np.ndarray:
    """Products of two lists of vectors; -inf where a vector is missing or has another length."""
    size = lambda v: -1 if v is None else len(v)
    sizes = [np.array([size(v) for v in side], np.int64) for side in (x, y)]
    out = np.full((len(x), len(y)), -np.inf)
    for n in set(sizes[0].tolist()) & set(sizes[1].tolist()) - {-1}:
        i, j = (np.flatnonzero(s == n) for s in sizes)
        both = [np.array([side[k] for k in at.tolist()], float).reshape(len(at), n) for side, at in ((x, i), (y, j))]
        out[np.ix_(i, j)] = both[0] @ both[1].T
    return out


def block_best(left: DataFrame, right: DataFrame, by: str, keys: list[str], other: str, mark: tuple[str, str] | None = None, take: list[str] | None = None, block: int | None = None) -> DataFrame:
    """by, keys, other, best, (take): the highest product of each left vector with those of each `other` in its group.

    A row per block of `right`: the caller takes the best of these. `mark`: columns of left and right that must differ. `take`: columns of
    the right row with the best product (rounded to six places; ties: the least in the order of these columns). best is null where no
    vector has a product. A group is dealt by hash into blocks of some BLOCK vectors; a task multiplies two blocks, so
    pairs are no rows and its memory does not grow with the group.
    """
    block, take = block or BLOCK, take or []
    marks = mark or ()
    whole = F.when(~F.exists("vec", lambda c: c.isNull()), F.col("vec"))  # a vector that holds a null has no product
    lefts = left.select(by, *keys, whole.alias("_v"), *([F.col(mark[0]).alias("_m")] if mark else [])).filter(F.col(by).isNotNull())
    rights = right.select(by, F.col(other).alias("_o"), whole.alias("_v"), *take, *([F.col(mark[1]).alias("_m")] if mark else [])).filter(F.col(by).isNotNull())
    if marks:
        lefts, rights = lefts.filter("_m IS NOT NULL"), rights.filter("_m IS NOT NULL")
    blocks = lambda rows, name: rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(lefts, "_nl").join(blocks(rights, "_nr"), by)
    deal = lambda rows, own, n, far, m: rows.join(sizes, by).withColumns({own: F.pmod(F.xxhash64("_v", *[c for c in rows.columns if c in (*keys, *take, "_o")]), F.col(n)).cast("int"), far: F.explode(F.sequence(F.lit(0), F.col(m) - 1))}).drop("_nl", "_nr")
    kinds = {**{c: left.schema[c].dataType.simpleString() for c in (by, *keys)}, "other": right.schema[other].dataType.simpleString(), **{c: right.schema[c].dataType.simpleString() for c in take}}

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [by, *keys, "other", "best", *take]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names, dtype=object)
        codes = pd.factorize(b["_o"], use_na_sentinel=False)[0]
        order = np.lexsort([*(b[c].to_numpy() for c in reversed(take)), codes])
        b, codes = b.iloc[order].reset_index(drop=True), codes[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        end = np.r_[first[1:], len(b)]
        same = pd.factorize(pd.concat([a["_m"], b["_m"]]))[0] if marks else None
        parts = []
        for k in range(0, len(a), ROWS):
            some = a.iloc[k : k + ROWS]
            x = _scores(some["_v"].tolist(), b["_v"].tolist())
            met = np.tile(end - first, (len(some), 1))
            if marks:
                equal = same[k : k + len(some), None] == same[None, len(a) :]
                x[equal] = -np.inf
                met = met - np.add.reduceat(equal, first, axis=1, dtype=np.int64)
            top = np.maximum.reduceat(x, first, axis=1)
            i, g = np.nonzero(met > 0)
            value = top[i, g]
            out = {c: some[c].to_numpy()[i] for c in (by, *keys)} | {"other": b["_o"].to_numpy()[first[g]], "best": np.where(np.isneginf(value), None, value)}
            if take:
                rounded = np.round(x, 6)
                at = np.stack([s + rounded[:, s:e].argmax(axis=1) for s, e in zip(first, end)], axis=1)[i, g]
                out |= {c: b[c].to_numpy()[at] for c in take}
            parts.append(pd.DataFrame(out, columns=names))
        return pd.concat(parts, ignore_index=True).astype(object)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (by, *keys, "other")], "best double", *[f"`{c}` {kinds[c]}" for c in take]])
    pair = [by, "_l", "_r"]
    one, two = deal(lefts, "_l", "_nl", "_r", "_nr"), deal(rights, "_r", "_nr", "_l", "_nl")
    two = two.toDF(*two.columns)  # both may come from one table
    return one.groupBy(*pair).cogroup(two.groupBy(*pair)).applyInPandas(best, schema)


def best_match(a: DataFrame, b: DataFrame, cluster: str, owner: str, item: str) -> DataFrame:
    """cluster, item, owner, other, best: each item's highest product among each other owner's items of its cluster."""
    left = a.select(cluster, F.col(owner).alias("owner"), F.col(item).alias("item"), "vec")
    met = block_best(left, b, cluster, ["item", "owner"], owner, ("owner", owner))
    return met.groupBy(cluster, "item", "owner", "other").agg(F.max("best").alias("best"))


def caliper_match(positives: DataFrame, negatives: DataFrame, by: str, score: str, item: str, width: float = 0.03, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """by, item, match: each positive's nearest unused negative within the caliper, positives in the order of score and item.

    Of equally near ones the lower score, then the lesser item is taken. One pass by score in blocks (`greedy.chained`): what a
    block must know of the one before lies within the caliper of its border. Rows without a score match nothing.
    """
    kind = positives.schema[item].dataType.simpleString()
    both = positives.select(by, item, F.col(score).cast("double").alias("_score"), F.lit(1).alias("_side")).unionByName(negatives.select(by, item, F.col(score).cast("double").alias("_score"), F.lit(0).alias("_side")))
    return chained(both, by, ["_score", "_side", item], ["_score", "_side", item], lambda: CaliperPass(width), f"{item} {kind}, match {kind}", block_rows)


def drop_near_sets(docs: DataFrame, by: str, order: str, tokens: str, subject: str | None = None, high: float = 0.5, low: float = 0.3) -> DataFrame:
    """by, order: the documents that stay, read in order: token sets at Jaccard above `high` to one kept, or above `low` with an equal subject, go.

    Later copies of a set (and subject) always go, so only the first of them is compared. Pairs that can pass are found by bitmaps
    in blocks (`greedy.near_set_candidates`); the order is then followed in rounds (`greedy.kept_in_order`), which check by their
    whole sets only the pairs whose first is kept.
    """
    subject_col = F.coalesce(F.col(subject), F.lit("")) if subject else F.lit("")
    sets = settled(docs.select(by, order, F.transform(F.array_distinct(tokens), lambda w: F.xxhash64(w)).alias("_t"), subject_col.alias("_s")).filter(F.size("_t") > 0))
    low = low if subject else high
    keyed = sets.filter(F.col(by).isNotNull()).select(by, order, "_s", run_key(F.array_sort("_t")).alias("_key"))
    firsts = keyed.groupBy(by, "_s", "_key").agg(F.min(order).alias(order)).select(by, order)
    own = settled(firsts.unionByName(sets.filter(F.col(by).isNull()).select(by, order)))  # without a group, no rivals
    alone = sets.join(own, [by, order], "left_semi")
    met = near_set_candidates(alone, by, order, high, low)
    side = lambda k, t, s: sets.select(F.col(by), F.col(order).alias(k), F.col("_t").alias(t), F.col("_s").alias(s))

    def true(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("first", "_a", "_sa"), [by, "first"]).join(side("second", "_b", "_sb"), [by, "second"]).withColumn("_k", F.size(F.array_intersect("_a", "_b")))
        bound = F.when((F.col("_sa") != "") & (F.col("_sa") == F.col("_sb")), F.lit(low)).otherwise(F.lit(high))
        return both.filter(F.col("_k") > bound * (F.size("_a") + F.size("_b") - F.col("_k"))).select(*pairs.columns)

    gone = kept_in_order(met, by, true=true).withColumnRenamed("item", order)
    return own.join(gone, [by, order], "left_anti")


def drop_near_vectors(items: DataFrame, by: str, item: str, rank: Column | list[Column], vec: str = "vec", threshold: float = 0.8) -> DataFrame:
    """by, item: items in the order of `rank` (a number) and item that are below the cosine threshold to all kept before them in their group."""
    rank = rank[0] if isinstance(rank, list) else rank
    pairs = near_pairs(items, by, item, rank.cast("double"), vec, threshold)
    gone = kept_in_order(pairs, by).withColumnRenamed("item", item)
    return items.select(by, item).join(gone, [by, item], "left_anti")


def disjoint_batches(items: DataFrame, by: str, item: str, left: str, right: str, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """by, item, batch: first-fit in the order of `item`, within each group, into batches of `size` in which no card occurs twice.

    First-fit is a chain by its nature: a block of a group's items waits for the one before it, and groups go side by side.
    """
    kind = items.schema[item].dataType.simpleString()
    return chained(items, by, [item], [item, left, right], lambda: BatchPass(size), f"{item} {kind}, batch int", block_rows, guess=False)

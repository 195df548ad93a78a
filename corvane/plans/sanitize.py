"""Removal of word runs that a text shares with its members, under five gates.

All lines take part in each step as rows; a round rewrites only the lines that no round before has
settled. Rewriters and the fidelity measure are parameters; the defaults are deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import asks, length_kept, numbers, overlap_ratio, shingles, uwords, words
from corvane.operators.overlap import gram_rows, merged_runs, pool_keys, positioned_grams, sent
from corvane.operators.pairing import block_best
from corvane.operators.ratio import similarity_ratio
from corvane.sources.stores import settled

# Coverage above which a line is rewritten whole, and the fidelity that edits need.
WHOLE, MIDDLE = 0.90, 0.70
STRICT, RELAXED = 0.90, 0.80
STRICT_MIDDLE, RELAXED_MIDDLE = 0.75, 0.65
ROUNDS = 5
CAPITALS = r"\b[A-Z][A-Za-z0-9+.#-]{2,}\b"

Rewriter = Callable[[Column, Column, int], Column]
_WORD = re.compile("[a-z']+")


def _replaced(line: str, places: set[int]) -> str:
    out, end = [], 0
    for i, m in enumerate(_WORD.finditer(line.lower())):
        if i in places:
            out += [line[end : m.start()], "something"]
            end = m.end()
    return "".join(out) + line[end:]


def edit_runs(line: Column, runs: Column, round_no: int) -> Column:
    """Every sixth word of a run (the place moves with the round) becomes another word, so no window of six stays."""

    @F.pandas_udf("string")
    def edit(lines: pd.Series, spans: pd.Series) -> pd.Series:
        place = lambda r: {p for p in range(r["first"], r["last"] + 1) if (p - r["first"]) % 6 == (5 - round_no) % 6}
        return pd.Series([_replaced(x, set().union(*[place(r) for r in s])) for x, s in zip(lines, spans)])

    return edit(line, runs)


def edit_whole(line: Column, runs: Column, round_no: int) -> Column:
    """Every sixth word of the line becomes another word."""

    @F.pandas_udf("string")
    def edit(lines: pd.Series) -> pd.Series:
        return pd.Series([_replaced(x, set(range((5 - round_no) % 6, len(_WORD.findall(x.lower())), 6))) for x in lines])

    return edit(line)


def word_fidelity(old: Column, new: Column) -> Column:
    """Jaccard similarity of the two texts' words."""
    return overlap_ratio(F.array_distinct(uwords(old)), F.array_distinct(uwords(new)))


def routes(lines: DataFrame, keys: list[str], pool: DataFrame, n: int = 6) -> DataFrame:
    """keys, line, n_words, runs, covered, route: verbatim, edit or rewrite, by the share of words in shared runs."""
    hits = positioned_grams(lines, keys, "line", n).join(sent(pool_keys(pool)), "gram", "left_semi")
    runs = merged_runs(hits, keys, n).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("n_words").alias("covered"))
    out = lines.select(*keys, "line", F.size(words(F.col("line"))).alias("n_words")).join(runs, keys, "left").na.fill(0, ["covered"])
    share = F.col("covered") / F.greatest(F.col("n_words"), F.lit(1))
    return out.withColumn("share", share).withColumn("route", F.when(F.col("runs").isNull(), "verbatim").when(F.col("share") > WHOLE, "rewrite").otherwise("edit"))


def _gated(tried: DataFrame, keys: list[str], pool: DataFrame, fidelity, own: bool, n: int) -> DataFrame:
    """`tried` (line, new) with the gates' results: hit, lost numbers, status, length, fid."""
    hit = gram_rows(tried, keys, "new", n).join(pool_keys(pool), "gram", "left_semi").select(*keys).distinct().withColumn("hit", F.lit(True))
    out = tried.join(hit, keys, "left").na.fill(False, ["hit"])
    if own:
        out = out.withColumn("hit", F.col("hit") | F.arrays_overlap(shingles(F.col("line"), n), shingles(F.col("new"), n)))
    return out.withColumns(
        {
            "lost": F.size(F.array_except(numbers(F.col("line")), numbers(F.col("new")))) > 0,
            "turned": asks(F.col("line")) != asks(F.col("new")),
            "long": ~length_kept(F.col("line"), F.col("new")),
            "fid": fidelity(F.col("line"), F.col("new")),
            "empty": F.length(F.trim("new")) == 0,
        }
    )


def _rounds(todo: DataFrame, keys: list[str], pool: DataFrame, rewrite: Rewriter, fidelity, strict: Column, relaxed: Column, own: bool, tier: str, rounds: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(settled: keys, text, tier, rounds; the rest): tries in rounds, then the best near miss above the relaxed bar."""
    done, misses = None, None
    for r in range(rounds):
        tried = todo.withColumn("new", rewrite(F.col("line"), F.col("runs"), r))
        failed = F.col("empty") | F.col("hit") | F.col("lost") | F.col("turned")
        gated = settled(_gated(tried, keys, pool, fidelity, own, n).withColumn("ok", ~(failed if own else failed | F.col("long"))))
        good = gated.filter(F.col("ok") & (F.col("fid") >= strict)).select(*keys, F.col("new").alias("text"), F.lit(tier).alias("tier"), F.lit(r).alias("rounds"))
        near = gated.filter(F.col("ok") & (F.col("fid") < strict) & (F.col("fid") >= relaxed)).select(*keys, "fid", F.lit(-r).alias("early"), F.col("new").alias("text"))
        done = good if done is None else done.unionByName(good)
        misses = near if misses is None else misses.unionByName(near)
        todo = settled(todo.join(good, keys, "left_anti"))
    best = misses.groupBy(*keys).agg(F.max_by("text", F.struct("fid", "early")).alias("text")).join(todo.select(*keys), keys, "left_semi")
    done = settled(done.unionByName(best.select(*keys, "text", F.lit(f"{tier}_relaxed").alias("tier"), F.lit(rounds).alias("rounds"))))
    return done, todo.join(done, keys, "left_anti")


def sanitized(lines: DataFrame, keys: list[str], pool: DataFrame, edit: Rewriter = edit_runs, rewrite: Rewriter = edit_whole, fidelity=word_fidelity, rounds: int = ROUNDS, n: int = 6) -> DataFrame:
    """keys, text, tier, rounds of every line: verbatim if clean, else edited, else rewritten whole, else dropped (text null)."""
    pool, routed = settled(pool_keys(pool)), settled(routes(lines, keys, pool, n))
    clean = routed.filter("route = 'verbatim'").select(*keys, F.col("line").alias("text"), F.lit("verbatim").alias("tier"), F.lit(0).alias("rounds"))
    middle = F.col("share") > MIDDLE
    edited, left = _rounds(routed.filter("route = 'edit'"), keys, pool, edit, fidelity, F.when(middle, STRICT_MIDDLE).otherwise(STRICT), F.when(middle, RELAXED_MIDDLE).otherwise(RELAXED), False, "edited", rounds, n)
    whole = routed.filter("route = 'rewrite'").unionByName(left)
    rewritten, lost = _rounds(whole, keys, pool, rewrite, fidelity, F.lit(STRICT_MIDDLE), F.lit(RELAXED_MIDDLE), True, "rewritten", rounds, n)
    dropped = lost.select(*keys, F.lit(None).cast("string").alias("text"), F.lit("dropped").alias("tier"), F.lit(rounds).alias("rounds"))
    return clean.unionByName(edited).unionByName(rewritten).unionByName(dropped)


def missing_capitals(old: Column, new: Column) -> Column:
    """The capitalised names of a line, but for its first word, that the new line does not hold, in order."""
    rest = F.regexp_replace(F.btrim(old, F.lit(" \t\n\r\x0b\x0c")), r"^\S+(?:\s+|\z)", "")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(rest, F.lit(CAPITALS), F.lit(0))))
    return F.filter(names, lambda t: ~F.contains(new, t))


def audit(lines: DataFrame, out: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per group: lines by tier, the dropped share, the mean changed share of words (by the similarity ratio), and the lines that lost a capitalised name."""
    met = lines.select(*dict.fromkeys([group, *keys, "line"])).join(out, keys)
    parts = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    changed = F.round(1 - similarity_ratio(parts(F.col("line")), parts(F.col("text")), popular=True), 3)
    each = met.withColumn("_changed", changed).withColumn("_lost", F.size(missing_capitals(F.col("line"), F.col("text"))) > 0)
    return each.groupBy(group).agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("tier") == "verbatim").alias("n_verbatim"),
        F.count_if(F.col("tier") == "dropped").alias("n_dropped"),
        F.round(F.avg((F.col("tier") == "dropped").cast("int")), 6).alias("drop_rate"),
        F.round(F.avg("_changed"), 6).alias("changed"),
        F.count_if(F.col("text").isNotNull() & F.col("_lost")).alias("caps_missing_lines"),
    )


def provenance(lines: DataFrame, elements: DataFrame, keys: list[str], near: float = 0.55) -> DataFrame:
    """keys, top, owner, support, cosine, n_near, unattributed: each line's nearest element of its cluster (ties: the first), and how
    many owners have one at `near` or above. lines (keys, cluster, vec), elements (cluster, item, owner, support, vec)."""
    met = block_best(lines, elements, "cluster", keys, "owner", take=["item", "support"]).withColumnRenamed("other", "owner").withColumn("cosine", F.round("best", 6))
    owners = met.groupBy(*keys, "owner").agg(F.max("cosine").alias("cosine"), F.max_by(F.struct("item", "support"), F.struct("cosine", -F.col("item"))).alias("_x"))
    best = owners.groupBy(*keys).agg(F.max_by(F.struct("_x", "owner"), F.struct("cosine", -F.col("_x.item"))).alias("_b"), F.max("cosine").alias("cosine"), F.count_if(F.col("cosine") >= near).alias("n_near"))
    return best.select(*keys, F.col("_b._x.item").alias("top"), F.col("_b.owner").alias("owner"), F.col("_b._x.support").alias("support"), "cosine", "n_near", (F.col("cosine") < near).alias("unattributed"))


def rebuild_check(routed: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], card: str, fidelity=word_fidelity, most_dropped: float = 0.10) -> DataFrame:
    """One row about a second build beside the first: hard failures, drop rates, changed shares, and the veto.

    routed: the lines as `routes` sees them; first and second: `sanitized` builds; `card`: the key of a line's card.
    Hard: a tier that the route does not allow (in either build), a clean line that changed, a lost number, a
    turned request status, an edit of wrong length, a fidelity below the rewriting floor, a drop rate above
    `most_dropped`. Veto: the mean changed share moves by more than 0.10 or that of the fallback tiers by more
    than 0.15. same_cards counts cards whose changed lines are all equal in both builds: no new sample was drawn.
    """
    a = first.select(*keys, F.col("tier").alias("t1"), F.col("text").alias("x1"))
    b = second.select(*keys, F.col("tier").alias("t2"), F.col("text").alias("x2"))
    both = routed.select(*dict.fromkeys([*keys, card]), "line", "route").join(a, keys, "left").join(b, keys, "left")
    allowed = {"verbatim": ["verbatim"], "edit": ["edited", "edited_relaxed", "rewritten", "rewritten_relaxed", "dropped"], "rewrite": ["rewritten", "rewritten_relaxed", "dropped"]}
    fits = lambda t: sum([((F.col("route") == r) & F.col(t).isin(*tiers)).cast("int") for r, tiers in allowed.items()], F.lit(0)).cast("boolean")
    fallback = lambda t: F.col(t).isin("edited_relaxed", "rewritten_relaxed") | ((F.col(t) == "rewritten") & (F.col("route") == "edit"))
    changed = lambda x, t: F.when(F.col(x).isNotNull() & (F.col(t) != "verbatim"), 1 - overlap_ratio(F.array_distinct(uwords(F.col("line"))), F.array_distinct(uwords(F.col(x)))))
    new = F.col("x2").isNotNull() & (F.col("t2") != "verbatim")
    each = both.withColumns(
        {
            "bad_route": ~(F.coalesce(fits("t1"), F.lit(False)) & F.coalesce(fits("t2"), F.lit(False))),
            "bad_clean": (F.col("t2") == "verbatim") & ~F.col("x2").eqNullSafe(F.col("line")),
            "bad_number": new & (F.size(F.array_except(numbers(F.col("line")), numbers(F.col("x2")))) > 0),
            "bad_request": new & (asks(F.col("line")) != asks(F.col("x2"))),
            "bad_length": new & F.col("t2").isin("edited", "edited_relaxed") & ~length_kept(F.col("line"), F.col("x2")),
            "bad_fidelity": new & (fidelity(F.col("line"), F.col("x2")) < RELAXED_MIDDLE),
            "c1": changed("x1", "t1"),
            "c2": changed("x2", "t2"),
            "same": F.when(new & (F.col("t1") != "verbatim") & F.col("x1").isNotNull(), F.col("x1") == F.col("x2")),
        }
    )
    each = settled(each.select(card, "t1", "t2", "route", "c1", "c2", "same", *[c for c in each.columns if c.startswith("bad_")]))
    hard = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in each.columns if c.startswith("bad_")]
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    cards = each.groupBy(card).agg(F.bool_and("same").alias("same")).agg(F.count_if("same").alias("same_cards"))
    out = each.agg(F.count("*").alias("n"), *hard, share(F.col("t1") == "dropped").alias("drop_first"), share(F.col("t2") == "dropped").alias("drop_second"), F.avg("c1").alias("changed_first"), F.avg("c2").alias("changed_second"), share(fallback("t1")).alias("fallback_first"), share(fallback("t2")).alias("fallback_second"), F.avg(F.col("same").cast("int")).alias("same_share"))
    failed = sum([F.col(c) for c in each.columns if c.startswith("bad_")], F.lit(0)) + (F.col("drop_second") > most_dropped).cast("int")
    veto = (F.abs(F.coalesce(F.col("changed_first") - F.col("changed_second"), F.lit(0.0))) > 0.10) | (F.abs(F.col("fallback_first") - F.col("fallback_second")) > 0.15)
    return out.join(cards).withColumns({"hard_failures": failed, "veto": veto})

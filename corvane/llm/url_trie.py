"""URL filter: a trie over reversed host labels and path segments, with longest-match precedence.

A rule is a host and the beginning of a path. It fits that host and all subdomains where the url's path
starts with the rule's; its last segment may therefore end inside a segment of the url. Of the rules
that fit, the one with the longest path-and-host wins whether it blocks or allows. The trie holds the
rules only, so what is sent to the executors has the size of the rule list and not of the data; a list of
more than `MOST_RULES` is not broadcast but joined by host and directory, the steps of the trie.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and gets
the default verdict; hosts compare without regard to the case of A-Z; an empty table gives an empty
result; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_split, written

#: Rules that are broadcast at most: some 20 MB.
MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """A trie of rules (verdict, host, path); the path starts with a slash or is empty.

    Below the host's labels, last first, the key ``/`` leads to the path's segments; in there the key
    None holds the rules that end: the lengths of the beginnings of the segment in which they do, and the rules by these.
    """
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        *whole, last = path.split("/")
        node = node.setdefault("/", {})
        for segment in whole:
            node = node.setdefault(segment, {})
        lengths, ends = node.setdefault(None, (set(), {}))
        lengths.add(len(last))
        ends[last] = (len(host) + len(path), host + path, verdict)
    return root


def longest_match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the longest rule that fits."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        below = node.get("/")
        for segment in path.split("/") if below is not None else ():
            lengths, ends = below.get(None, ((), {}))
            for n in lengths:
                rule = ends.get(segment[:n]) if n <= len(segment) else None
                if rule is not None and (best is None or rule > best):
                    best = rule
            below = below.get(segment)
            if below is None:
                break
    return best and best[1:]


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", keys: tuple[str, ...] = ("page_id",), most_rules: int = MOST_RULES) -> DataFrame:
    """`keys`, host, path, rule (null: none fits) and verdict of every row's url."""
    parsed = pages.select(*keys, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) > most_rules:
        return _joined(parsed, rules, default, keys)
    trie = pages.sparkSession.sparkContext.broadcast(url_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [longest_match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return parsed.withColumn("_judged", judge("host", "path")).select(*keys, "host", "path", "_judged.rule", "_judged.verdict")


def _joined(parsed: DataFrame, rules: list[tuple[str, str, str]], default: str, keys: tuple[str, ...]) -> DataFrame:
    """The same by a join: a url names every end of its host and every directory of its path, a rule its own."""
    parsed = written(parsed.withColumn("_row", F.monotonically_increasing_id()))
    table = parsed.sparkSession.createDataFrame(rules, "verdict string, _host string, begin string").withColumn("_host", F.lower("_host"))
    rule = F.struct((F.length("_host") + F.length("begin")).alias("size"), F.concat("_host", "begin").alias("rule"), "verdict", "begin")
    side = table.groupBy("_host", F.regexp_extract("begin", "^.*/", 0).alias("_dir")).agg(F.collect_list(rule).alias("_rules"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.regexp_extract_all("path", F.lit("[^/]*/"), F.lit(0))
    dirs = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ""))
    asked = parsed.select("_row", "path", F.explode(hosts).alias("_host"), dirs.alias("_dirs")).select("_row", "path", "_host", F.explode("_dirs").alias("_dir"))
    counts = asked.groupBy("_host", "_dir").agg(F.count("*").alias("_n"))
    side = written(side.join(counts, ["_host", "_dir"]))
    total = side.agg(F.sum("_n")).first()[0] or 0
    met = join_split(asked, side, ["_host", "_dir"], "_n", total)
    best = met.withColumn("_best", F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["begin"])))).filter("_best IS NOT NULL")
    best = best.groupBy("_row").agg(F.max("_best").alias("_best"))
    out = parsed.join(best, "_row", "left")
    return out.select(*keys, "host", "path", "_best.rule", F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

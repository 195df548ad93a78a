"""Text functions as column expressions; nothing here leaves the JVM.

Two kinds of words exist and are kept apart: plain words (`words`: a-z and apostrophes of the
lower-cased text) carry every overlap measure, letters-and-digits words (`uwords`: any script) carry
counts, degeneracy and linkage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_WORD = "[a-z']+"
ANY_WORD = r"[\p{L}\p{N}_]+"

# They must be these for equal results.
NUMBER = r"\d+(?:\.\d+)?%?"
PREFIX = r"^(\s*(?:[-•]\s*|\*\s+|\d+[.)]\s*|#+\s+)+)"
REQUEST = r"(?i)\b(request|ask|clarif|more information|more info|additional information|need.{0,20}(steps|details|info))\b"
AUTOMATIC = r"(?i)^\s*\*\*\*|has been marked as a duplicate|Created attachment|\(In reply to"
LEAK = r"(?i)dup(?:licate)?\b|wontfix|won'?t fix|invalid|works ?for ?me|worksforme|not a bug"
TECHNICAL = r"(?i)\b(how|why|which|when|calculat|test|model|regress|distribut|estimat|variance|interval|hypothesi|bayes|likelihood|sampl|correlat|significan|assumption|method|interpret|predict|classif|cluster|anova|mixed|effect)\b"
OPINION = r"(?i)\b(should i|career|vs\.?|versus|better|worth|opinion|book|resource|software|which language|jobs?)\b"
CODE = r"(?i)<code>|<pre>|CREATE\s|SELECT\s|WITH\s|INSERT\s|UPDATE\s|import\s|library\(|lm\(|glm\("
NAMED = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*\b"
NUMBERED = r"\b\d[\d,.]*\b|\$\d|%"
CONDITIONAL = r"(?i)\b(if|unless|when|whenever|provided|otherwise|else|in case|should)\b"
CONCRETE_ELEMENTS = [
    r"deadline|friday|by \w+day|due",
    r"\$|dollar|threshold|amount|limit",
    r"sign[- ]?off|approv|authoriz|escalat",
    r"fallback|if .*refus|alternativ|otherwise|backup|contingen",
    r"confidential|nda|non-?disclos|privile",
]
STOP_WORDS = (
    "the a an and or but if then else of to in on for with at by from as is are was were be been being this "
    "that these those it its they them their he she his her you your we our us i me my mine will would can could "
    "should shall may might must do does did done have has had having not no nor so than too very just about "
    "into over under out up down off above below again further once here there when where why how all any both "
    "each few more most other some such only own same now also per re fw fwd dear thanks thank regards please "
    "let know need get got like want make made see send sent email message"
).split()


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern; of null, none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often (and in whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return found(F.lower(text), PLAIN_WORD)


def uwords(text: Column) -> Column:
    return found(F.lower(text), ANY_WORD)


def grams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of `n` neighbouring tokens, none if there are fewer."""
    runs = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), sep)))
    return let(tokens, lambda t: F.coalesce(runs(t), F.array().cast("array<string>")))


def run_key(run: Column) -> Column:
    return F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit("run"), run).alias("b"))


def shingles(text: Column, n: int = 6) -> Column:
    """The set of a text's runs of `n` plain words."""
    return F.array_distinct(grams(words(text), n))


def char_grams(text: Column, n: int = 4) -> Column:
    """Runs of `n` characters of the lower-cased text with white space collapsed, with repeats."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    runs = lambda x: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - (n - 1)), lambda i: F.array_join(F.slice(x, i, n), "")))
    return let(F.filter(F.split(t, ""), lambda c: c != ""), lambda x: F.coalesce(runs(x), F.array().cast("array<string>")))


#: Words of three letters or more.
CONTENT_WORD = "[a-z]{3,}"


def bare_words(text: Column) -> Column:
    """A text in small letters without placeholders."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\[[a-z]+\]", " ")


def content_words(text: Column) -> Column:
    """Words of three letters or more that are no stop words, with repeats, placeholders removed."""
    return F.filter(found(bare_words(text), CONTENT_WORD), lambda w: ~w.isin(*STOP_WORDS))  # a hash set to Catalyst


def mechanical_coverage(text: Column) -> Column:
    """The share of the concrete elements that a text mentions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [low.rlike(p).cast("int") for p in CONCRETE_ELEMENTS]
    return sum(hits[1:], hits[0]) / len(CONCRETE_ELEMENTS)


def is_shouted(s: Column) -> Column:
    """Has letters, and no small one."""
    return (F.upper(s) == s) & (F.lower(s) != s)


def is_content(s: Column, n: int = 6) -> Column:
    """A line that can hold a run of `n` plain words and is not shouted."""
    return (F.size(words(s)) >= n) & ~is_shouted(s)


def line_prefix(s: Column) -> Column:
    """Bullets, numbers and header marks at a line's begin; bold marks belong to the body."""
    return F.regexp_extract(s, PREFIX, 1)


def line_body(s: Column) -> Column:
    return F.trim(F.substring(s, F.length(line_prefix(s)) + 1, F.length(s)))


def card_line(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"^\s*[-*•\d.)#]+\s*", ""))


def bare_line(s: Column) -> Column:
    """A line without bullets, numbers and emphasis, for similarity by line."""
    cut = F.regexp_replace(F.trim(s), r"^\s*(?:[-*•>–—]+|\d+[.)]\s|#+\s|\*\*)\s*", "")
    return F.trim(F.btrim(cut, F.lit("*_` ")))


def lines(text: Column) -> Column:
    """Lines by any line end, without the empty one after a final line end."""
    split = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]")
    return let(split, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def numbers(s: Column) -> Column:
    return F.array_distinct(found(s, NUMBER))


def word_count(s: Column) -> Column:
    """Number of parts between white space."""
    t = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def length_kept(old: Column, new: Column) -> Column:
    """The new text's word count differs by at most 3 or three tenths."""
    return F.abs(word_count(new) - word_count(old)) <= F.greatest(F.lit(3), F.floor(word_count(old) * 0.3))


def asks(s: Column) -> Column:
    return s.rlike(REQUEST)


def clean_comment(t: Column, most: int = 1500) -> Column:
    """Quoted lines off, white space collapsed, cut."""
    own = F.filter(F.split(t, "\r\n|[\n\r]"), lambda x: ~F.ltrim(x).startswith(">"))
    return F.substring(F.trim(F.regexp_replace(F.array_join(own, " "), r"\s+", " ")), 1, most)


_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Tags off, the common entities back to characters, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    for name, char in _ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def strip_markdown(t: Column) -> Column:
    bare = F.regexp_replace(t, r"(?m)\*\*|`|^#{1,6}\s*|^\s*[-+]\s+(?=\S)", "")
    return F.trim(F.regexp_replace(bare, "[ \t]{2,}", " "))


def strip_numbering(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?:(?<=\s)|^)\d+\.(?=\s)", ""), r"\s{2,}", " "))


def sentences(t: Column) -> Column:
    return F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 3)


def ends_finished(t: Column) -> Column:
    return t.rlike("[.!?][\\s*_`\"'’”)\\]]*$")


def truncated(t: Column, cap: int) -> Column:
    """As long as four fifths of the cap and without a sentence's end."""
    return (word_count(t) >= 0.8 * cap) & ~ends_finished(t)


def strip_bom(t: Column) -> Column:
    return F.regexp_replace(t, "^﻿", "")


def json_strings(t: Column) -> Column:
    """A JSON array of strings, with or without a code fence; else the bulleted lines."""
    bare = F.regexp_replace(F.trim(t), r"(?s)^```[a-z]*\s*|\s*```$", "")
    parsed = F.from_json(bare, "array<string>")
    items = F.filter(F.transform(F.split(bare, "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda s: F.length(s) > 0)
    return F.when(F.substring(bare, 1, 1) == "[", parsed).otherwise(items)


def letter_anywhere(t: Column, letters: str = "A-H") -> Column:
    """The first letter of the range found anywhere; null if none."""
    return F.nullif(F.regexp_extract(F.upper(t), f"[{letters}]", 0), F.lit(""))


def letter_first(t: Column, letters: str = "AB") -> Column:
    c = F.substring(F.upper(F.trim(t)), 1, 1)
    return F.when(c.rlike(f"^[{letters}]$"), c)


def letter_only(t: Column, letters: str = "A-H") -> Column:
    c = F.upper(F.trim(t))
    return F.when(c.rlike(f"^[{letters}]$"), c)


def confidence(t: Column, default: float = 50.0, low: float = 50.0, high: float = 100.0) -> Column:
    """The first number, clamped."""
    value = F.regexp_extract(t, r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets given as arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))

"""Masking of identifiers with typed placeholders, as chained replacements in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let

# Patterns, triggers and word lists that must be these for equal results.
EMAIL = r"[\w.\-]+@[\w.\-]+\.\w+"
HANDLE_PATH = r"\b[\w. ]+?/[A-Z]{2,}(?:/[A-Z]{2,})*@[A-Z]{2,}\b"
HANDLE_AT = r"\b[A-Z][A-Za-z]+(?: [A-Z]\.?)? [A-Z][A-Za-z]+@(?:ECT|EES|ENRON|Enron|Corp|NA)\b"
URL = r"(?i)\b(?:https?://|www\.)\S+"
PHONE = r"(?<!\d)(?:\+?1[ .\-]?)?(?:\(?\d{3}\)?[ .\-]?)?\d{3}[ .\-]\d{4}(?!\d)"
EXTENSION = r"(?i)\b(?:ext|x|extension)\.?\s*[:#]?\s*\d{3,5}\b"
PLACEHOLDERS = ["EMAIL", "PHONE", "URL", "PERSON", "ORG", "LOC", "ENTITY"]
HEADER = r"(?i)^(From|To|Sent|Cc|Bcc|Subject|Date)\s*:"
FORWARD = r"(?iU)^-+\s*(Original Message|Forwarded by|----)"
REPLY = r"^On .+wrote:$"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
STAMP = r"(?i)^\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}\s*(AM|PM)?\s*$"
FOOTER = (
    r"(?is)(this e-?mail[^\n]*(confiden|intend|privile|proprietary)|"
    r"the information (contained|transmitted) in this|"
    r"if you (are not|have received) this (message|e-?mail|communication) in error|"
    r"named addressee|legally exempt from disclosure|"
    r"if you wish not to receive|donotemail|to unsubscribe|"
    r"future e-?mail notifications|\*{6,}|={6,}|_{10,}|-{20,}).*$"
)
SIGN_OFF = (
    r"(?i)^(best( regards)?|regards|thanks( a lot| again)?|thank you|cheers|sincerely|"
    r"warm(est)? regards|talk soon|take care|love|yours( truly)?|respectfully|"
    r"best wishes|ciao|later|cordially|kind regards)[\s,.!]*$"
)
SIGNED_INLINE = (
    r"(?i)^(\s*(?:best(?: regards)?|regards|thanks(?:[ ,.!a-z]*)?|thank you|cheers|sincerely|"
    r"love|cordially|warm(?:est)? regards|kind regards|yours(?: truly)?)"
    r"[\s,.!]*[-.]*\s*)([A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)?)\s*$"
)
SIGNED_NAME = r"^[A-Z][a-zA-Z.'\- ]+$"
LAST_NAME = r"^[A-Z][a-zA-Z.'\-]+(?: [A-Z][a-zA-Z.'\-]+)?$"
NO_LAST_NAMES = ["thanks", "ok", "thank you"]
PLACEHOLDER_TAIL = "('s|s)?"
PLACEHOLDER_GAP = r"\s*[,/&]?\s*"
NAME_PAIR = r"\b[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+\b"
NOT_NAMES = (
    "monday tuesday wednesday thursday friday saturday sunday jan feb mar apr may jun jul aug sep sept oct nov dec "
    "january february march april june july august september october november december "
    "the this that these those we you they he she it if and but or so for please thanks thank best regards dear hi hello "
    "date time number no order payment invoice account service master swap agreement agreements rate dept department "
    "director manager managing president vice chief officer counsel group team desk zone comm committee list path "
    "inquiries inquiry report protocol notice subject update status summary draft final version section schedule exhibit "
    "north south east west left right next last first second third other same new old mr mrs ms dr re fw fwd"
).split()
ENTITIES = [
    "Raptor", "Raptors", "Chewco", "JEDI", "JEDI II", "Azurix", "Sitara", "GMS", "Enpower",
    "EnronOnline", "Enron Online", "EOL", "LJM", "LJM1", "LJM2", "Whitewing", "Osprey",
    "Mariner", "Condor", "Talon", "Timberwolf", "Porcupine", "Braveheart", "Rawhide",
    "Yosemite", "Marlin", "Firefly", "EES", "ENA", "Enron Net Works", "ENW", "EBS",
    "Enron Broadband", "TWA", "Dabhol", "DPC", "Transwestern", "Northern Border",
    "RAC", "Cinergy", "CERA", "FERC", "CPUC", "ISO", "PX", "Sundevil", "Backbone",
    "RADR", "Cuiaba", "Nahanni", "Nile", "Hawaii", "Bob West", "Margaux", "Catalytica",
    "Risk Management Protocol", "DASH", "DPR", "tagg", "TAGG",
]


def own_lines(text: Column) -> Column:
    """The author's own lines, each judged alone: up to the first mark of a quoted mail, without quotes, headers, routing and time stamps.

    A line ends where any system ends one; what stays is joined by line feeds. Null stays null.
    """

    def mark(line: Column) -> Column:
        return let(F.btrim(line, F.lit(WHITE)), lambda s: s.rlike(FORWARD) | s.rlike(REPLY))

    def keep(line: Column) -> Column:
        def test(s: Column) -> Column:
            routed = (F.size(F.split(s, f"[{WHITE}]+")) <= 8) & (s.rlike("^" + HANDLE_AT[2:]) | s.rlike("^" + HANDLE_PATH[2:]))
            return ~(s.startswith(">") | s.rlike(HEADER) | routed | s.rlike(STAMP))

        return let(F.btrim(line, F.lit(WHITE)), test)

    every = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)
    before = let(every, lambda lines: let(F.array_position(F.transform(lines, mark), F.lit(True)), lambda k: F.when(k > 0, F.slice(lines, F.lit(1), (k - 1).cast("int"))).otherwise(lines)))
    return F.array_join(F.filter(before, keep), "\n")


def cut_footer(text: Column) -> Column:
    return F.regexp_replace(text, FOOTER, "")


def _where(text: Column, guard: Column, pattern: str, mask: str) -> Column:
    """A replacement that is tried only where a cheap test says that it may find something."""
    return F.when(guard, F.regexp_replace(text, pattern, mask)).otherwise(text)


def mask_contacts(text: Column, entities: list[str] | None = None) -> Column:
    """E-mail addresses, routing handles, links, extensions, telephone numbers and named entities."""
    at = lambda t: t.contains("@")
    text = let(text, lambda t: _where(t, at(t), EMAIL, "[EMAIL]"))
    # a handle is of one line: only lines with its marks are searched for it
    line = lambda x: _where(x, at(x) & x.contains("/"), HANDLE_PATH, "[PERSON]")
    text = let(text, lambda t: F.when(at(t), F.array_join(F.transform(F.split(t, "\n"), line), "\n")).otherwise(t))
    text = let(text, lambda t: _where(t, at(t), HANDLE_AT, "[PERSON]"))
    text = F.regexp_replace(F.regexp_replace(text, URL, "[URL]"), EXTENSION, "[PHONE]")
    text = let(text, lambda t: _where(t, t.rlike(r"\d{3}[ .\-]\d{4}"), PHONE, "[PHONE]"))
    if entities:
        longest = sorted(set(entities), key=lambda e: (-len(e), e))
        text = F.regexp_replace(text, r"\b(" + "|".join(r"\Q" + e + r"\E" for e in longest) + r")\b", "[ENTITY]")
    return text


def _few_words(line: Column) -> Column:
    return F.size(F.split(line, r"\s+")) <= 3


def _masked_lines(text: Column) -> Column:
    """Names in a sign-off line, and in the first line with words of the two after a line that is a sign-off only.

    The lines are folded from the first to the last; `wait` is how many more lines may hold the name.
    """

    def step(state: Column, line: Column) -> Column:
        words = F.trim(line)
        named = (state["wait"] > 0) & (words != "") & _few_words(words) & words.rlike(SIGNED_NAME)
        masked = F.when(named, F.regexp_replace(line, r"\S.*", "[PERSON]")).otherwise(line)

        def close(own: Column) -> Column:
            inline = own.rlike(SIGNED_INLINE)
            wait = F.when(inline, 0).when(F.trim(own).rlike(SIGN_OFF), 2).when(F.trim(own) == "", F.greatest(state["wait"] - 1, F.lit(0))).otherwise(0)
            new = F.when(inline, F.regexp_replace(own, SIGNED_INLINE, "$1[PERSON]")).otherwise(own)
            return F.struct(F.concat(state["lines"], F.array(new)).alias("lines"), wait.cast("int").alias("wait"))

        return let(masked, close)

    none = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("wait"))
    return F.aggregate(F.split(text, "\n"), none, step, lambda state: F.array_join(state["lines"], "\n"))


def mask_signed(df: DataFrame, text: str) -> DataFrame:
    """`df` with the names of signatures masked in a column: after a sign-off, in its line, or as a short last line."""
    signed = F.col(text).rlike(r"(?im)^\s*(?:" + "|".join(["best", "regards", "thank", "cheers", "sincerely", "warm", "talk", "take", "love", "yours", "respect", "ciao", "later", "cordially", "kind"]) + ")")
    df = df.withColumn(text, F.when(signed, _masked_lines(F.col(text))).otherwise(F.col(text)))
    whole = F.regexp_replace(text, r"\s+\z", "")
    last = F.trim(F.element_at(F.split(whole, "\n"), -1))
    named = _few_words(last) & last.rlike(LAST_NAME) & ~F.lower(last).isin(*NO_LAST_NAMES)
    return df.withColumn(text, F.when(named, F.regexp_replace(whole, r"[^\n]+\z", "[PERSON]")).otherwise(F.col(text)))


def mask_pairs(text: Column) -> Column:
    """Pairs of capitalised words, read from left to right, that hold no word of business or the calendar."""
    between, pairs = F.split(text, NAME_PAIR, -1), F.regexp_extract_all(text, F.lit(NAME_PAIR), F.lit(0))
    spared = F.array(*[F.lit(w) for w in NOT_NAMES])
    parts = lambda pair: F.transform(F.split(F.lower(pair), r"\s+"), lambda w: F.rtrim(w, F.lit(".")))
    masked = F.transform(pairs, lambda pair: F.when(F.arrays_overlap(parts(pair), spared), pair).otherwise(F.lit("[PERSON]")))
    return F.array_join(F.zip_with(between, masked, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")


def collapse(text: Column) -> Column:
    """One placeholder for a run of them: the first's kind."""
    one = r"\[(?:" + "|".join(PLACEHOLDERS) + r")\]"
    bare = F.regexp_replace(text, f"({one}){PLACEHOLDER_TAIL}", "$1")
    return F.regexp_replace(bare, f"({one})(?:{PLACEHOLDER_GAP}{one})+", "$1")


def mask_own(text: Column, names: Column) -> Column:
    """An author's own names (an array of lower-case words) as whole words, longest first."""
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\b\Q"), n, F.lit(r"\E\b")), F.lit("[PERSON]")))


def address_names(address: Column) -> Column:
    """The name words in an address's local part, and the first with the last."""
    local = F.lower(F.split(F.coalesce(F.nullif(F.regexp_extract(address, EMAIL, 0), F.lit("")), address), "@")[0])
    parts = F.filter(F.split(F.regexp_replace(local, "[^a-z.]+", "."), r"\."), lambda p: F.length(p) >= 2)
    joined = F.when(F.size(parts) >= 2, F.array(F.array_join(parts, " "), F.concat_ws(" ", parts[0], F.element_at(parts, -1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parts, joined))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def scrub(df: DataFrame, text: str, out: str = "scrubbed", names: Column | None = None, entities: list[str] | None = None) -> DataFrame:
    """`df` with the whole cascade's result, its steps in their fixed order.

    Each step is a column of its own: a step reads the one before more than once, and as one nested
    expression the text would be rewritten anew for each of these reads.
    """
    df = df.withColumn(out, F.col(text))
    for step in (own_lines, cut_footer, lambda t: mask_contacts(t, entities)):
        df = df.withColumn(out, step(F.col(out)))
    df = mask_signed(df, out)
    rest = [mask_pairs] + ([lambda t: mask_own(t, names)] if names is not None else [])
    for step in [*rest, lambda t: tidy(collapse(t))]:
        df = df.withColumn(out, step(F.col(out)))
    return df

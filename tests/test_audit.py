"""The sanitizer's audit against a version that goes line by line."""

import difflib
import re

from corvane.plans import sanitize

PAIRS = [
    ("Ask Bob about Kafka and the C++ build", "Ask somebody about Kafka", "edited"), ("Only", "Other", "edited"), ("  Lead Words stay Here ", "Lead stay", "edited"), ("no capitals at all", "no capitals at all", "verbatim"),
    ("Then Ann-Marie went", None, "dropped"), ("Use SQL.Server or Node.js now", "Use Node.js now or SQL", "relaxed"), ("", "", "verbatim"), ("A Big Cat", "A Bigger Cat", "edited"),
]


def test_audit(spark):
    lines = spark.createDataFrame([("g", k, a) for k, (a, _, _) in enumerate(PAIRS)], "author string, k int, line string")
    out = spark.createDataFrame([(k, t, b) for k, (_, b, t) in enumerate(PAIRS)], "k int, tier string, text string")
    r = sanitize.audit(lines, out, ["k"], "author").first()
    changed, lost = [], 0
    for a, b, _ in PAIRS:
        if b is None:
            continue
        changed.append(round(1 - difflib.SequenceMatcher(None, a.split(), b.split()).ratio(), 3))
        caps = set(re.findall(sanitize.CAPITALS, " ".join(a.split()[1:])))
        lost += any(t not in b for t in caps)
    assert (r.n_lines, r.n_verbatim, r.n_dropped, r.caps_missing_lines) == (8, 2, 1, lost) and lost == 3
    assert abs(r.changed - sum(changed) / len(changed)) < 1e-6

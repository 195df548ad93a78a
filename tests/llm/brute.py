"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reachable(ids, linked):
    """Smallest id that `linked` pairs of positions reach, by position."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[find(a)] = find(b)
    best = {}
    for i, d in enumerate(ids):
        r = find(i)
        best[r] = min((x for x in (best.get(r), d) if x is not None), default=None)
    return [best[find(i)] for i in range(len(ids))]


def simhash(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(docs, threshold=4):
    ids, fps = [d[0] for d in docs], [simhash(d[1]) for d in docs]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= threshold]
    return sorted((d, f"{f:016x}", c) for d, f, c in zip(ids, fps, smallest_reachable(ids, pairs)))


def window_dedup(docs, n=50):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def line_dedup(docs, distance=2, least=20):
    """Lines of documents that stay; equal lines and long ones within the distance are one group, whose first occurrence stays."""
    lines, at = {}, []
    for d, t in sorted(docs):
        for i, raw in enumerate(t.split("\n") if t is not None else []):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if line:
                lines.setdefault(line, []).append((d, i))
    texts = list(lines)
    bags = [[x.count(c) for c in "aeinorst ."] for x in texts]
    near = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if min(len(texts[i]), len(texts[j])) >= least and abs(len(texts[i]) - len(texts[j])) <= distance and sum(abs(a - b) for a, b in zip(bags[i], bags[j])) <= 2 * distance and edit_distance(texts[i], texts[j]) <= distance
    ]
    first = smallest_reachable([min(lines[t]) for t in texts], near)
    gone = {o for t, f in zip(texts, first) for o in lines[t] if o != f}
    out = []
    for d, t in docs:
        own = t.split("\n") if t is not None else []
        kept = "\n".join(x for i, x in enumerate(own) if (d, i) not in gone)
        out.append((d, len(own), sum((d, i) in gone for i in range(len(own))), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar_first(docs, least=0.8):
    """Smallest doc_id that pairs of at least the Jaccard similarity reach, by position; texts without words are alike."""
    sets = [shingles(d[1]) for d in docs]
    alike = lambda a, b: 5 * len(a & b) >= 5 * least * len(a | b) if a and b else a == b
    return smallest_reachable([d[0] for d in docs], [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])

"""Conversation repair against plain versions: all edit sequences for short ones, a recursion for tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby, product

import corvane.llm.conversation_repair as m
import pytest
from corvane.llm.conversation_repair import ENDS, START, Costs, Solver, damaged, repaired, repaired_turns, report

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, kind string, here string, sid int"


def every_edit(codes, costs):
    """Least (cost, audit) over all edits of each row and up to two insertions at each place."""
    rows = []
    for code in codes:
        initial, fault = "sua-"[code % 4], code // 4
        left = costs.truncated if fault == 3 else 0
        options = [("D", "", costs.delete)]
        if fault not in (1, 2):
            options += [("K", initial, costs.keep + left), ("R", "u", costs.rerole + left), ("R", "a", costs.rerole + left)]
        rows.append(options)
    gaps = [("I" * n, "".join(r), n * costs.insert) for n in range(3) for r in product("ua", repeat=n)]
    parts = [gaps]
    for options in rows:
        parts += [options, gaps]
    return min((sum(x[2] for x in some), "".join(x[0] for x in some)) for some in product(*parts) if LEGAL.fullmatch("".join(x[1] for x in some)))


@pytest.mark.parametrize("costs", [Costs(), Costs(0, 2, 6, 1, 1), Costs(1, 1, 3, 2, 0)])
def test_solver_finds_the_cheapest_and_least_edits(costs):
    rng, solver = random.Random(1), Solver(costs)
    for n, times in ((0, 1), (1, 16), (2, 60), (3, 12)):
        for k in range(times):
            codes = bytes([k]) if n == 1 else bytes(rng.choice([0, 1, 2, 3, 1, 2, 13, 14, 5, 10, 12]) for _ in range(n))
            audit, cost = solver.whole(codes)
            assert (cost, audit) == every_edit(codes, costs), list(codes)


@pytest.mark.parametrize("costs", [Costs(), Costs(0, 2, 6, 1, 1)])
def test_matrices_and_walks_join(costs):
    rng, solver = random.Random(2), Solver(costs)
    for _ in range(60):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(1, 30)))
        cut = rng.randrange(len(codes) + 1)
        ends = solver.distances(codes[cut:], ENDS, True)[:4]
        matrix = solver.matrix(codes[:cut])
        far = solver.distances(codes, ENDS, True)[:4]
        assert [min(matrix[4 * q + x] + ends[x] for x in range(4)) for q in range(4)] == far
        first, state, cost = solver.walk(codes[:cut], tuple(ends), False, START)
        second, _, more = solver.walk(codes[cut:], ENDS, True, state)
        assert (first + second, cost + more) == solver.whole(codes)


def plain(rows):
    """The report by a recursion over each conversation's rows."""
    out = {}
    for conv, own in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        left = []
        for _, turn, role, text in own:
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in left:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in left if t is not None}
        initials = [r[:1] for _, r, _ in left]
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        @lru_cache(None)
        def best(i, q, inserted=0):
            found = [(0, "", ())] if i == len(left) and q in ("", "a") else []
            if inserted < 2:
                to = {"u": "a"}.get(q, "u")
                c, a, r = best(i, to, inserted + 1)
                found.append((c + 5, "I" + a, ((to, ""), *r)))
            if i < len(left):
                _, role, text = left[i]
                c, a, r = best(i + 1, q)
                found.append((c + 2, "D" + a, r))
                if faults[i] not in ("b", "d"):
                    more = 5 * (faults[i] == "t")
                    if to := step[q].get(role[:1]):
                        c, a, r = best(i + 1, to)
                        found.append((c + more, "K" + a, ((role, text), *r)))
                    to = {"u": "a"}.get(q, "u")
                    c, a, r = best(i + 1, to)
                    found.append((c + 1 + more, "R" + a, ((to, text), *r)))
            return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

        cost, audit, kept = best(0, "")
        kept = "\n".join({"u": "user", "a": "assistant"}.get(r, r) + ":" + t for r, t in kept)
        legal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), legal, cost, audit, hashlib.sha256(kept.encode()).hexdigest())
    return out


def conversations(seed, convs=40, most=12):
    rng, rows = random.Random(seed), []
    texts = ["Hi.", "Hi there", "Why?", "", " \t", "No!  \n", "ünï.", "a.b", "."]
    for conv in range(convs):
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 2]), role, rng.choice([*texts, f"t{conv} {turn}.", None])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (7, 3, "user", "x" * 100_000 + "."), (7, 4, "assistant", "y" * 100_000)]
    return rows + rng.sample(rows, 10)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "k", "h", 1) for r in rows], SCHEMA).repartition(parts)
    out = report(repaired(damaged(df), present="here")).collect()
    want = plain(rows)
    assert len(out) == len(want)
    for r in out:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_tables(spark):
    check(spark, conversations(1))


@pytest.mark.parametrize("size", [1, 3])
def test_conversations_over_many_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(m, "ROWS", size)
    check(spark, conversations(2))


def test_one_long_conversation_with_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(m, "ROWS", 11)
    rng = random.Random(5)
    rows = [(1, k // 2, rng.choice(["user", "assistant"]), rng.choice(["Hi.", f"n{k}.", f"n{k}", ""])) for k in range(110)]
    check(spark, rows + [(1, 9, "user", "same.")] * 40 + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")])


def test_turns_that_are_left(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "tool", "Three."), (1, 3, "assistant", "Four."), (2, 0, "user", "")]
    found = repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = sorted(map(tuple, repaired_turns(found).select("conv_id", "place", "role", "text").collect()))
    assert turns == [(1, 0, "user", "One."), (1, 1, "assistant", "Two."), (1, 2, "user", "Three."), (1, 3, "assistant", "Four.")]


def test_nothing(spark):
    assert report(repaired(damaged(spark.createDataFrame([], SCHEMA)), present="here")).count() == 0
    with pytest.raises(ValueError):
        Solver(Costs(insert=0))

"""Repair of conversations: the cheapest edits that make the turns alternate as they should.

Every turn is kept (K), given the role user or assistant (R) or deleted (D), and turns without text may be inserted (I),
so that the initials of the roles read ``(s?(ua)+)?``. The edits of a conversation are a path through a graph of four
states per row (nothing yet, after s, after u, after a). Costs are small integers, so Dial's buckets give all
distances to the end without a heap; from the start a walk over tight arcs, the least letter first, then spells the audit.

Rows are dealt out by ranges of (conversation, turn) and cut into pieces of bounded size. A conversation within a piece
is solved there. Of one that spans pieces (two at most for each range, and the long ones) each piece makes a four by
four matrix of distances between its ends; one pass over the matrices from the last piece to the first gives each piece
the distances after it, one over the pieces' walks in order gives the state before it, and then all pieces spell their part
of the audit side by side. First occurrences, which tell duplicates, are the least place by key over all pieces.

Defined results: null roles and texts count as one space; null turns come first, turns of one number by role and text; a null
conversation id is an id like others; repeated rows are duplicates; texts of any length are worked on whole; other
columns are ignored; an empty table gives an empty result. A conversation of which all rows are marked absent has an
empty audit and no cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, lean, small_batches, written

#: Rows and bytes of text of a piece at most (a longer text is a piece of its own).
ROWS = 20_000
BYTES = 4 << 20
FAR = 1 << 60
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States and what a user or assistant turn leads to from each; those in which a conversation may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ENDS = (0, FAR, FAR, 0)
#: Solved pieces of few rows that a worker remembers.
KEPT = 50_000
PIECE = "conv_id {id}, sid long, whole boolean, lo long, hi long, n_turns long, codes binary, keys array<binary>, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


class Costs(NamedTuple):
    """Of each edit, and of leaving a truncated turn; inserting must cost something."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def code_of(role: str, fault: int) -> int:
    """A row in a byte: the initial of its role (s, u, a, any other) and its fault."""
    return "sua".find(role[:1] or "-") % 4 + 4 * fault


class Solver:
    """Distances and walks over rows' codes; arcs of a row are (letter, state after it, cost) by code and state."""

    def __init__(self, costs: Costs):
        if costs.insert <= 0 or min(costs) < 0:
            raise ValueError("costs are not negative, and inserting costs something")
        self.insert, self.known = costs.insert, {}
        self.arcs = [[self._arcs(code, q, costs) for q in range(4)] for code in range(16)]
        self.back = [[[(q, c) for q in range(4) for _, to, c in arcs[q] if to == x] for x in range(4)] for arcs in self.arcs]
        self.widest = max(costs.insert, *(c for code in self.arcs for q in code for _, _, c in q))

    @staticmethod
    def _arcs(code: int, q: int, costs: Costs) -> list[tuple[str, int, int]]:
        initial, fault = code % 4, code // 4
        out = [("D", q, costs.delete)]
        if fault not in (BLANK, DUPLICATE):
            left = costs.truncated if fault == TRUNCATED else 0
            if initial == 0 and q == START:
                out.append(("K", AFTER_S, costs.keep + left))
            elif initial in (1, 2) and initial + 1 == NEXT[q]:
                out.append(("K", NEXT[q], costs.keep + left))
            out.append(("R", NEXT[q], costs.rerole + left))
        return out

    def distances(self, codes: bytes, ends: tuple[int, ...], last: bool) -> list[int]:
        """From state q before row i, at 4 i + q, to the end, from whose states it takes `ends`; `last`: turns may be inserted there."""
        n = len(codes)
        least = min(ends)
        near = [x - least for x in ends if x < FAR]
        size = max(self.widest, *near) + 1
        out, buckets, held, d = [FAR] * (4 * n + 4), [[] for _ in range(size)], 0, 0
        for q, x in enumerate(ends):
            if x < FAR:
                out[4 * n + q] = x - least
                buckets[x - least].append(4 * n + q)
                held += 1
        while held:
            bucket = buckets[d % size]
            while bucket:
                node = bucket.pop()
                held -= 1
                if out[node] != d:
                    continue
                i, q = divmod(node, 4)
                arcs = [(4 * i - 4 + p, c) for p, c in self.back[codes[i - 1]][q]] if i else []
                if i < n or last:
                    arcs += [(4 * i + p, self.insert) for p in range(4) if NEXT[p] == q]
                for to, c in arcs:
                    if d + c < out[to]:
                        out[to] = d + c
                        buckets[(d + c) % size].append(to)
                        held += 1
            d += 1
        return [x if x == FAR else x + least for x in out]

    def walk(self, codes: bytes, ends: tuple[int, ...], last: bool, q: int, found: list[int] | None = None) -> tuple[str, int, int]:
        """The audit from state q, the state after it, and its cost: the least letter of the tight arcs each time."""
        far = found or self.distances(codes, ends, last)
        out, i, n, begin = [], 0, len(codes), far[q]
        while i < n or last and far[4 * i + q] != ENDS[q]:
            here = far[4 * i + q]
            best = ("Z", q, 0)
            if i < n:
                best = min(((a, to, 1) for a, to, c in self.arcs[codes[i]][q] if here == c + far[4 * i + 4 + to]), default=best)
            if (i < n or last) and here == self.insert + far[4 * i + NEXT[q]]:
                best = min(best, ("I", NEXT[q], 0))
            out.append(best[0])
            q, i = best[1], i + best[2]
        return "".join(out), q, begin - far[4 * n + q]

    def whole(self, codes: bytes) -> tuple[str, int]:
        """Audit and cost of a conversation."""
        found = self.known.get(codes)
        if found is None:
            audit, _, cost = self.walk(codes, ENDS, True, START)
            found = audit, cost
            if len(codes) <= 64 and len(self.known) < KEPT:
                self.known[codes] = found
        return found

    def matrix(self, codes: bytes) -> list[int]:
        """Distances from each state before the rows to each after them, by state before."""
        columns = [self.distances(codes, tuple(0 if q == x else FAR for q in range(4)), False)[:4] for x in range(4)]
        return [columns[x][q] for q in range(4) for x in range(4)]


def applied(audit: str, q: int, codes: bytes, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The turns that the edits leave, from state q on."""
    kept_roles, kept_texts, i = [], [], 0
    for letter in audit:
        if letter == "K":
            kept_roles.append(roles[i])
            q = codes[i] % 4 + 1
        elif letter in "RI":
            q = NEXT[q]
            kept_roles.append("user" if q == AFTER_U else "assistant")
        if letter in "KR":
            kept_texts.append(texts[i])
        elif letter == "I":
            kept_texts.append("")
        i += letter != "I"
    return kept_roles, kept_texts


def illegal_pairs(codes: bytes) -> int:
    """Neighbours whose initials are not su, ua or au."""
    return sum((a % 4, b % 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))


def fault_of(text: str) -> int:
    bare = text.rstrip(SPACES)
    return BLANK if not bare else TRUNCATED if bare[-1] not in ".!?" else 0


def with_duplicates(codes: bytes, first: set[int]) -> bytes:
    """The codes with the fault of a row not in `first`, unless it is blank."""
    return bytes(c if k in first or c // 4 == BLANK else c % 4 + 4 * DUPLICATE for k, c in enumerate(codes))


def faults(codes: bytes) -> list[int]:
    return [sum(c // 4 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]


def pieces(rows: DataFrame, costs: Costs, present: str | None = None) -> DataFrame:
    """Pieces of conversations in order of sid; those of a whole conversation are solved, others hold their rows as they are."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, base = Solver(costs), TaskContext.get().partitionId() << 33
        count = 0
        schema = None

        def piece(conv: object, rows: list[tuple], open_: bool) -> tuple:
            nonlocal count
            here = [r for r in rows if r[3]]
            roles, texts = [r[1] for r in here], [r[2] for r in here]
            codes = bytes(code_of(r, fault_of(t)) for r, t in zip(roles, texts))
            turns = [r[0] for r in here if r[0] is not None]
            count += 1
            head = (conv, base + count, not open_, min(turns, default=None), max(turns, default=None), len(set(turns)))
            if open_:
                keys = [hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(roles, texts)]
                return *head, codes, keys, None, None, None, None, None, None, roles, texts
            firsts: dict[tuple, int] = {}
            for k, key in enumerate(zip(roles, texts)):
                firsts.setdefault(key, k)
            codes = with_duplicates(codes, set(firsts.values()))
            audit, cost = solver.whole(codes)
            return *head, None, None, *faults(codes), illegal_pairs(codes), cost, audit, *applied(audit, START, codes, roles, texts)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        conv, held, size, begun, cut, out, weight = None, [], 0, False, True, [], 0
        for batch in batches:
            schema = schema or piece_schema(batch.schema.field("conv_id").type)
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                fresh_conv = begun and own != conv
                if fresh_conv or len(held) >= ROWS or size >= BYTES:
                    # the range's first conversation may have begun before it; a cut one goes on
                    out.append(piece(conv, held, cut or not fresh_conv))
                    weight += size
                    cut, held, size = not fresh_conv, [], 0
                    if weight >= BYTES or len(out) >= 2_000:
                        yield batch_of(out)
                        out, weight = [], 0
                conv, begun = own, True
                held.append(tuple(row))
                size += len(row[2])
        if begun:
            out.append(piece(conv, held, True))  # it may go on in the next range
            yield batch_of(out)

    small_batches(rows.sparkSession)
    here = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.when(here, F.coalesce(F.col(c), F.lit(" "))).otherwise(F.lit("")).alias(c) for c in ("role", "text")], here.alias("here"), F.monotonically_increasing_id().alias("salt"))
    order = ["conv_id", "turn", "role", "text", "salt"]  # nulls first; the salt parts very many rows that are alike
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    return dealt.mapInArrow(lean(scan), PIECE.format(id=kind))


def piece_schema(id_type: pa.DataType) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    kinds = [id_type, long, pa.bool_(), long, long, long, pa.binary(), pa.list_(pa.binary()), long, long, long, long, long, text, pa.list_(text), pa.list_(text)]
    names = ["conv_id", "sid", "whole", "lo", "hi", "n_turns", "codes", "keys", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts"]
    return pa.schema(list(zip(names, kinds)))


def by_row(rows: DataFrame, make, kind: str) -> DataFrame:
    """A row of `kind` for each row, by a function of its values; rows stream through the task."""
    names = [f.split()[0] for f in kind.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            for k in range(0, batch.num_rows, 50):
                some = batch.slice(k, 50)
                found = [own(*row) for row in zip(*(c.to_pylist() for c in some.columns))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], kind).schema)
    return rows.mapInArrow(lean(scan), kind)


def joined_pieces(spread: DataFrame, costs: Costs) -> DataFrame:
    """Solve the conversations that span pieces; the same columns as solved pieces have."""
    kind = spread.schema["conv_id"].dataType.simpleString()
    places = spread.select("conv_id", "sid", F.posexplode("keys").alias("pos", "key"))
    firsts = places.groupBy("conv_id", "key").agg(F.min(F.struct("sid", "pos")).alias("at")).groupBy("at.sid").agg(F.collect_list("at.pos").alias("firsts"))
    bare = spread.select("conv_id", "sid", "lo", "hi", "codes").join(firsts, "sid", "left").select("conv_id", "sid", "lo", "hi", "codes", "firsts")

    def weigh():
        solver = Solver(costs)

        def one(conv, sid, lo, hi, codes, firsts):
            codes = with_duplicates(codes, set(firsts or []))
            return conv, sid, lo, hi, codes, solver.matrix(codes)

        return one

    weighed = written(by_row(bare, weigh, f"conv_id {kind}, sid long, lo long, hi long, codes binary, matrix array<long>"))

    def backwards():
        now: dict = {"conv": None, "begun": False}

        def one(conv, sid, matrix):
            last = not now["begun"] or conv != now["conv"]
            ends = now.get("ends")
            if last:
                ends = Solver(costs).distances(b"", ENDS, True)
            now.update(conv=conv, begun=True, ends=[min(matrix[4 * q + x] + ends[x] for x in range(4)) for q in range(4)])
            return sid, list(ENDS) if last else ends, last

        return one

    def walks():
        solver = Solver(costs)

        def one(conv, sid, lo, hi, codes, ends, last):
            found = solver.distances(codes, tuple(ends), last)
            edge = (codes[0], codes[-1]) if codes else (None, None)
            return conv, sid, lo, hi, *edge, [solver.walk(codes, tuple(ends), last, q, found)[1] for q in range(4)]

        return one

    def forwards():
        now: dict = {"conv": None, "begun": False}

        def one(conv, sid, lo, hi, begin, end, after):
            if not now["begun"] or conv != now["conv"]:
                now.update(conv=conv, begun=True, state=START, hi=None, code=None)
            state = now["state"]
            met = int(lo is not None and lo == now["hi"])
            clash = 0 if begin is None or now["code"] is None else illegal_pairs(bytes([now["code"], begin]))
            now.update(state=after[state], hi=now["hi"] if hi is None else hi, code=now["code"] if end is None else end)
            return sid, state, met, clash

        return one

    in_order = lambda df, *by: df.repartition("conv_id").sortWithinPartitions("conv_id", *by)
    after = by_row(in_order(weighed.select("conv_id", "sid", "matrix"), F.desc("sid")), backwards, "sid long, ends array<long>, last boolean")
    ahead = written(weighed.drop("matrix").join(after, "sid").select("conv_id", "sid", "lo", "hi", "codes", "ends", "last"))
    paths = by_row(ahead, walks, f"conv_id {kind}, sid long, lo long, hi long, begin int, end int, after array<int>")
    states = by_row(in_order(paths, "sid"), forwards, "sid long, state int, met int, clash int")

    def spell():
        solver = Solver(costs)

        def one(conv, sid, lo, hi, n_turns, roles, texts, codes, ends, last, state, met, clash):
            audit, _, cost = solver.walk(codes, tuple(ends), last, state)
            roles, texts = applied(audit, state, codes, roles, texts)
            return conv, sid, False, lo, hi, n_turns - met, None, None, *faults(codes), illegal_pairs(codes) + clash, cost, audit, roles, texts

        return one

    both = spread.select("conv_id", "sid", "lo", "hi", "n_turns", "roles", "texts").join(ahead.select("sid", "codes", "ends", "last").join(states, "sid"), "sid")
    return by_row(both.select("conv_id", "sid", "lo", "hi", "n_turns", "roles", "texts", "codes", "ends", "last", "state", "met", "clash"), spell, PIECE.format(id=kind))


def repaired(rows: DataFrame, costs: Costs = Costs(), present: str | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text) repaired, in pieces by order of sid.

    conv_id, sid, whole (no other piece has the conversation), lo, hi, n_turns (least and greatest turn, distinct turns that no
    earlier piece has), blank, duplicate, truncated, illegal (counts before the repair), cost, audit, roles, texts (after it).
    `present`: a column that is false in rows that only say that their conversation is there.
    """
    cut = written(pieces(rows, costs, present))
    return cut.filter("whole").unionByName(joined_pieces(cut.filter("not whole"), costs)).drop("codes", "keys")


def repaired_turns(found: DataFrame) -> DataFrame:
    """conv_id, sid, place, role, text of each turn that is left, in order of (sid, place)."""
    turns = found.select("conv_id", "sid", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
    return turns.select("conv_id", "sid", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def report(found: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text` lines).

    The lines of a conversation in several pieces go through one running hash, in order, a piece at a time.
    """
    kind = found.schema["conv_id"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = lambda lo, hi, n: F.coalesce(hi - lo + 1 - n, F.lit(0))
    whole = found.filter("whole").select("conv_id", gaps(F.col("lo"), F.col("hi"), F.col("n_turns")).alias("gaps"), *counts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, digest, empty, audits, sums, turns = None, False, None, True, [], [], []

        def done() -> pa.RecordBatch:
            lo, hi, n = min((x[0] for x in turns), default=None), max((x[1] for x in turns), default=None), sum(x[2] for x in turns)
            values = [conv, 0 if lo is None else hi - lo + 1 - n, *sums, "".join(audits), digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in ("gaps", *counts)], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for k in range(batch.num_rows):
                own, audit, text, some, lo, hi, n, *more = (c[k].as_py() for c in batch.columns)
                if not begun or own != conv:
                    if begun:
                        yield done()
                    conv, begun, digest, empty, audits, sums, turns = own, True, hashlib.sha256(), True, [], [0] * len(counts), []
                audits.append(audit)
                sums = [a + b for a, b in zip(sums, more)]
                if lo is not None:
                    turns.append((lo, hi, n))
                if some:
                    digest.update((text if empty else "\n" + text).encode())
                    empty = False
        if begun:
            yield done()

    parts = found.filter("not whole").select("conv_id", "sid", "audit", lines.alias("lines"), (F.size("roles") > 0).alias("some"), "lo", "hi", "n_turns", *counts)
    in_order = parts.repartition("conv_id").sortWithinPartitions("conv_id", "sid").drop("sid")
    return whole.unionByName(in_order.mapInArrow(lean(scan), f"conv_id {kind}, gaps long, {', '.join(c + ' long' for c in counts)}, audit string, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32(`conv_id:turn`) % 20, and `here`, false in a row that is dropped.

    0 drops the row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes it the user's. Nulls count as one space.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(named("role"))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("here"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return marked.drop("copy")

"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids with a closing id; a document over the capacity is cut into full pieces and
a rest. Full pieces are sequences of their own. The other pieces are dealt by hash into problems of
about `PIECES` each, so memory and time per task do not depend on the corpus's size. Each problem is
held by several islands, rows of a DataFrame: an island evolves a few packings of its own (the first by
best-fit decreasing, the others by best-fit in disturbed orders and by best subsets). Crossover injects
well-filled bins of one parent whole into the other, removes the bins that then hold a piece twice, and
best-fits the displaced pieces; mutation opens the emptiest bins. After an epoch the islands' best packings (elites) go to all islands of the problem
for the next epoch; the fullest packing wins. Bins of the winner that are left with much room are
opened, and their pieces of all problems form new, fewer problems for a second round.

Only lengths and row numbers move; token ids do not leave the scan unless asked for.

Defined results: null and empty texts are one closing id; repeated rows are separate documents (their
pieces share doc_id and piece, not row); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import string
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, lean, slices, utf8, written
from corvane.llm.words import SECOND, run_hashes

CAPACITY = 2048
PIECES = 4000
ISLANDS = 2
EPOCHS = 2
#: An island's packings, its generations at most, and those without gain after which it stops.
POPULATION = 6
GENERATIONS = 40
PATIENCE = 8
#: A bin of the first round with at least this part of it empty is opened for the second.
ROOM = 0.02
#: Chunks whose ids a Python worker keeps, at some 40 bytes each.
KEPT = 400_000
#: Bytes of text that are split at a time, and chunks that one call of the tokenizer gets.
BYTES = 1 << 19
CHUNKS = 200
#: Kinds of bytes: white space, ASCII letters, marks next to which a letter run always ends, all others.
_KIND = np.full(256, 3, np.uint8)
_KIND[np.frombuffer(SPACES.encode(), np.uint8)] = 0
_KIND[np.frombuffer(string.ascii_letters.encode(), np.uint8)] = 1
_KIND[np.frombuffer(b'!"#$%&()*+,-./:;=?@[]^_`{}~', np.uint8)] = 2

#: How a tokenizer must prepare texts for its ids to be those of the chunks between white space (fixed values).
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's ids of a text are, in order, those of the text's chunks between ASCII white space.

    True for one way of normalising and splitting, which drops white space and never merges across it.
    """
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [None])[0]
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", []))
    return normal.get("normalizers") == NORMALISERS and first == SPLITTER and plain and not spec.get("truncation") and not spec.get("padding")


class Encoder:
    """Token ids of texts. Where the tokenizer allows it, each chunk is encoded once and then looked up.

    Chunks are cut at white space and between an ASCII letter and a mark, where the tokenizer cuts as well.
    They are known by two 64-bit hashes; the table is sorted by the first, and only the chunks of the slice
    at hand outlive a table that is full.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_chunk = Tokenizer.from_str(spec), splits_at_spaces(json.loads(spec))
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after the other, and each chunk's number of them; many chunks make one call."""
        ids, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(chunks), CHUNKS):
            own = chunks[k : k + CHUNKS]
            found = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            of = np.searchsorted(np.cumsum([len(c) + 1 for c in own]), [a for a, _ in found.offsets], side="right")
            ids.append(np.array(found.ids, "<u4"))
            size.append(np.bincount(of, minlength=len(own)))
        return np.concatenate(ids), np.concatenate(size)

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the table each key is, or would be, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        return at, (self.keys[near] == keys) & (self.checks[near] == checks) if len(self.keys) else np.zeros(len(keys), bool)

    def _keep(self, keys: np.ndarray, checks: np.ndarray, chunks: list[str]) -> None:
        """Add chunks, ascending by key, that are not in the table."""
        ids, size = self._encode(chunks)
        at, start = np.searchsorted(self.keys, keys), len(self.ids) + np.cumsum(size) - size
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, ids])

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a range of texts, and each text's offsets in them; null texts have none."""
        if not self.by_chunk:
            found = self.tokenizer.encode_batch(column.fill_null("").to_pylist(), add_special_tokens=False)
            each = [np.array(e.ids, "<u4") for e in found]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        data, offsets = utf8(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if b"<|" not in data.tobytes():  # the tokenizer's special strings must keep their case
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        kind = np.concatenate([[0], _KIND[data], [0]]).astype(np.uint8)
        cut = kind[1:] * kind[:-1] == 2
        cut[offsets] = True
        inside = kind > 0
        begin = np.flatnonzero(inside[1:-1] & (cut[:-1] | ~inside[:-2]))
        end = np.flatnonzero(inside[1:-1] & (cut[1:] | ~inside[2:])) + 1
        keys, checks = run_hashes(data, begin, end), run_hashes(data, begin, end, SECOND)
        some, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._find(some, checks[first])
        if len(self.keys) > KEPT:
            own = at[known]
            self.ids = self.ids[np.repeat(self.start[own] - (np.cumsum(self.size[own]) - self.size[own]), self.size[own]) + np.arange(self.size[own].sum())]
            self.keys, self.checks, self.size = self.keys[own], self.checks[own], self.size[own]
            self.start = np.cumsum(self.size) - self.size
        if not known.all():
            new, raw = first[~known], data.tobytes()
            self._keep(some[~known], checks[new], [raw[b:e].decode() for b, e in zip(begin[new].tolist(), end[new].tolist())])
        at, _ = self._find(some, checks[first])
        start, size = self.start[at][which], self.size[at][which]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends[np.searchsorted(begin, offsets)]


def encoder(spec: str) -> Encoder:
    """The worker process's Encoder of a tokenizer; it outlives a task."""
    kept = sys.modules.setdefault("_corvane_worker", types.ModuleType("_corvane_worker")).__dict__
    key = f"encoder-{zlib.crc32(spec.encode())}-{len(spec)}"
    if key not in kept:
        kept[key] = Encoder(spec)
    return kept[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, if asked for) of every piece of every document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(spec)
        for batch in batches:
            for begin, end in slices(utf8(batch.column("text"))[1], BYTES):
                yield cut(batch.column("doc_id").slice(begin, end - begin), *tokens.texts(batch.column("text").slice(begin, end - begin)))

    def cut(doc_id: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        flat = np.insert(ids, offsets[1:], closing).astype("<u4", copy=False)
        offsets = offsets + np.arange(len(offsets))
        total = np.diff(offsets)
        many = -(-total // capacity)
        row = np.repeat(np.arange(len(total)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(total[row] - start, capacity)
        at = offsets[row] + start
        raw = memoryview(flat).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
        columns = [doc_id.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.view(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(scan), kind)


class Bins:
    """A packing in the making: pieces in bins, and the bins by the room they have left."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, {}, capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms, self.next = 0, 0  # bit r of rooms: there is a bin with room r

    def add(self, items: list[int], room: int) -> None:
        self.bins[self.next] = items
        self._put(self.next, room)
        self.next += 1

    def _put(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.rooms |= 1 << room

    def best_fit(self, items: list[int]) -> None:
        """Put each item into the bin with the least room that it fits."""
        for i in items:
            size = self.sizes[i]
            fits = self.rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                own = self.by_room[room]
                b = own.pop()
                if not own:
                    self.rooms ^= 1 << room
                self.bins[b].append(i)
                self._put(b, room - size)
            else:
                self.add([i], self.capacity - size)

    def packing(self) -> list[list[int]]:
        return list(self.bins.values())


Packing = list[list[int]]


def _fills(packing: Packing, sizes: list[int]) -> list[int]:
    return [sum(map(sizes.__getitem__, x)) for x in packing]


def _fitness(packing: Packing, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean square of their filling."""
    return len(packing), -sum((f / capacity) ** 2 for f in _fills(packing, sizes))


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound of the number of bins: for each limit, pieces too large to share a bin with one of that size
    stand alone, and pieces from the limit to half a bin must fit into what the larger ones leave."""
    x = np.sort(np.array(sizes, np.int64))
    sums = np.concatenate([[0], np.cumsum(x)])
    limit = np.concatenate([[0], np.unique(x[2 * x <= capacity])])
    low, half, high = np.searchsorted(x, limit), np.searchsorted(x, capacity // 2, side="right"), np.searchsorted(x, capacity - limit, side="right")
    rest = sums[half] - sums[low] - ((high - half) * capacity - (sums[high] - sums[half]))
    return int((len(x) - half + np.maximum(0, -(-rest // capacity))).max())


def best_subset(items: list[int], room: int, sizes: list[int]) -> list[int]:
    """Items whose sizes sum up to as much of the room as any of their subsets can (sums are bits of a number)."""
    sums, mask = [1], (1 << room + 1) - 1
    for i in items:
        sums.append((sums[-1] | sums[-1] << sizes[i]) & mask)
    at, out = sums[-1].bit_length() - 1, []
    for i, before in zip(reversed(items), reversed(sums[:-1])):
        if not before >> at & 1:
            out.append(i)
            at -= sizes[i]
    return out


def subset_fill(items: list[int], sizes: list[int], capacity: int, rng: random.Random, tries: int = 24) -> Packing:
    """Bins that take the largest piece left and then the best subset of some random others."""
    left = sorted(items, key=lambda i: (sizes[i], rng.random()))
    out = []
    while left:
        first = left.pop()
        some = sorted(rng.sample(range(len(left)), min(tries, len(left))))
        chosen = set(best_subset([left[k] for k in some], capacity - sizes[first], sizes))
        out.append([first, *chosen])
        for k in reversed(some):
            if left[k] in chosen:
                del left[k]
    return out


def best_fit_packing(order: list[int], sizes: list[int], capacity: int) -> Packing:
    out = Bins(sizes, capacity)
    out.best_fit(order)
    return out.packing()


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject half of the better filled half of `b`'s bins whole into `a`, remove the bins with duplicates, best-fit what they leave."""
    fills = _fills(b, sizes)
    middle = sorted(fills)[len(b) // 2]
    full = [k for k, f in enumerate(fills) if f >= middle]
    chosen = rng.sample(full, (len(full) + 1) // 2)
    inside = {i for k in chosen for i in b[k]}
    out, displaced = Bins(sizes, capacity), []
    for x, f in zip(a, _fills(a, sizes)):
        if inside.isdisjoint(x):
            out.add(list(x), capacity - f)
        else:
            displaced += [i for i in x if i not in inside]
    for k in chosen:
        out.add(list(b[k]), capacity - fills[k])
    displaced.sort(key=sizes.__getitem__, reverse=True)
    out.best_fit(displaced)
    return out.packing()


def mutated(packing: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Open the emptiest bins and some others, and fill bins anew with their pieces by best subsets."""
    fills = _fills(packing, sizes)
    order = sorted(range(len(packing)), key=lambda k: (fills[k], rng.random()))
    some = max(2, len(order) // 20)
    opened = set(order[:some]) | set(rng.sample(order, some))
    return [x for k, x in enumerate(packing) if k not in opened] + subset_fill([i for k in opened for i in packing[k]], sizes, capacity, rng)


def evolve(sizes: list[int], capacity: int, elites: list[list[int]], seed: int, generations: int = GENERATIONS, population: int = POPULATION, patience: int = PATIENCE) -> list[int]:
    """The best packing, as each item's bin, that an island finds.

    The first packing is by best-fit decreasing; the others, by best-fit in disturbed orders and by best
    subsets, differ much. It ends at `generations`, after `patience` of them without gain, or when no packing
    can have fewer bins; it is never worse than best-fit decreasing.
    """
    rng, least = random.Random(seed), least_bins(sizes, capacity)
    people: list[tuple[tuple[int, float], int, Packing]] = []

    def join(packing: Packing) -> None:
        people.append((_fitness(packing, sizes, capacity), len(people) if not people else max(p[1] for p in people) + 1, packing))

    for elite in elites:
        packing: dict[int, list[int]] = {}
        for i, b in enumerate(elite):
            packing.setdefault(b, []).append(i)
        join(list(packing.values()))
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    if not people:
        join(best_fit_packing(order, sizes, capacity))
    while len(people) < population and min(people)[0][0] > least:
        if len(people) % 2:
            join(subset_fill(order, sizes, capacity, rng))
        else:
            join(best_fit_packing(sorted(order, key=lambda i: -sizes[i] * (1 + 0.3 * rng.random())), sizes, capacity))
    people.sort(key=lambda x: x[:2])
    idle = 0
    for _ in range(generations):
        if people[0][0][0] <= least or len(people) < 2 or idle >= patience:
            break
        a, b = (min(rng.sample(people, 2), key=lambda x: x[:2]) for _ in "ab")  # tournaments of two
        best = people[0][0]
        child = crossover(a[2], b[2], sizes, capacity, rng) if a is not b else a[2]
        if a is b or rng.random() < 0.5:
            child = mutated(child, sizes, capacity, rng)
        join(child)
        people = sorted(people, key=lambda x: x[:2])[:population]
        idle = 0 if people[0][0] < best else idle + 1
    out = [0] * len(sizes)
    for b, items in enumerate(people[0][2]):
        for i in items:
            out[i] = b
    return out


def _round(items: DataFrame, number: int, capacity: int, per_problem: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """row, length, problem, bin, offset and fill (of its bin) of items (row, length)."""
    problems = max(1, -(-items.count() // per_problem))
    keyed = items.groupBy(F.pmod(F.xxhash64("row", F.lit(number)), F.lit(problems)).alias("problem")).agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("items"))
    state = written(keyed.select("problem", F.col("items.row").alias("rows"), F.col("items.length").alias("sizes")))

    def island(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [
                evolve(r["sizes"], capacity, r["elites"], hash((seed, number, r["problem"], r["island"], len(r["elites"]))))
                for r in batch.select(["problem", "island", "sizes", "elites"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("problem"), batch.column("island"), pa.array(best, pa.list_(pa.int32()))], names=["problem", "island", "bins"])

    elites = state.select("problem", F.array().cast("array<array<int>>").alias("elites"))
    for _ in range(epochs):
        met = state.join(elites, "problem").select("problem", "sizes", "elites", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
        met = met.repartition(max(1, problems * islands // 4), "problem", "island").mapInArrow(lean(island), "problem long, island int, bins array<int>")
        elites = written(met.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("island", "bins"))).alias("x")).select("problem", F.col("x.bins").alias("elites")))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                winner = min((np.array(e) for e in r["elites"]), key=lambda e: (e.max(), -(np.bincount(e, sizes) ** 2).sum()))
                order = np.argsort(winner, kind="stable")
                ends = np.cumsum(sizes[order])
                fill = np.bincount(winner, sizes).astype(np.int64)
                offset = np.empty(len(sizes), np.int64)
                offset[order] = ends - sizes[order] - (np.cumsum(fill) - fill)[winner[order]]
                yield pa.RecordBatch.from_arrays([pa.array(r["rows"], pa.int64()), pa.array(sizes), pa.array(np.full(len(sizes), r["problem"])), pa.array(winner.astype(np.int64)), pa.array(offset), pa.array(fill[winner])], names=["row", "length", "problem", "bin", "offset", "fill"])

    return state.join(elites, "problem").mapInArrow(lean(settle), "row long, length long, problem long, bin long, offset long, fill long")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = 0, per_problem: int = PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces with row (the piece's number), sequence_id and offset."""
    cut = written(pieces(docs, tokenizer_path, capacity, closing, with_ids).withColumn("row", F.monotonically_increasing_id()))
    items = cut.filter(F.col("length") < capacity).select("row", "length")
    first = written(_round(items, 1, capacity, per_problem, islands, epochs, seed))
    opened = F.col("fill") < (1 - ROOM) * capacity
    second = _round(first.filter(opened).select("row", "length"), 2, capacity, per_problem, islands, epochs, seed)
    place = lambda n: ((F.col("problem") * 2 + n) * (1 << 20) + F.col("bin")).alias("sequence_id")
    placed = first.filter(~opened).select("row", place(0), "offset").unionByName(second.select("row", place(1), "offset"))
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    return cut.filter(F.col("length") < capacity).join(placed, "row").unionByName(full)

"""Line deduplication by a segment-partition edit join.

Lines, without white space at their ends, are linked if their edit distance in code points is at most
`distance` and both have `min_chars` or more; shorter lines are linked to equal ones only, for which a
hash is enough. Of the lines that links connect, and of equal lines, the first occurrence (smallest
doc_id, then line number) stays and the others go.

The join: two lines within the distance share one of distance + 1 segments of the shorter one, which the
longer holds at a place that the lengths and the segment's number confine. Each line is indexed by its
own segments and probes the substrings that segments of lines as long as itself, or shorter by up to
the distance, could be. Keys are hashes of the substring, the length and the segment's number. Only
keys that an index row and a probe of different lines share get the lines' texts, each from one
document, and those groups are verified: common prefix and suffix off, then a banded bit-parallel edit
distance. A breadth-first search emits a spanning forest of each group and not its pairs; groups with
very many lines are split into pairs of blocks.

A line is known by 128 bits of hash everywhere; lines' places and hashes are written once. Equal lines
are counted and not joined; joins on keys that very many rows have take the partner by a broadcast.

Defined results: a null text has no lines; an empty line always stays; a null doc_id counts as larger
than all others; rows that share doc_id and text are one document; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import CELLS, SPACES, block_pairs, cell_batch, cell_counts, hot_blocks, is_space, join_split, lean, mixed, parts_of, slices, utf8, written
from corvane.llm.components import connected_components
from corvane.llm.exact_bloom import Repeated
from corvane.llm.words import SECOND, Sums, run_hashes

DISTANCE = 2
MIN_CHARS = 20
BLOCK = 2_000
BYTES = 1 << 18
#: Keys in a bucket and in a row of it, about; lines of a key above which it is passed on as it comes.
BUCKET = 500_000
PACKED = 512
HOT = 50_000
LAST_ID = (1 << 63) - 1


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two arrays of code points, or most + 1 if it is more.

    Bit k of a row of the table stands for the diagonal k - most; a set bit of level e means that this
    diagonal's cell can be reached with e edits (the bit-parallel form of the banded recurrence).
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    odd = np.flatnonzero(a[:n] != b[:n])
    head = int(odd[0]) if len(odd) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    odd = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(odd[0]) if len(odd) else n
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not x or not y:
        return min(len(x) + len(y), most + 1)
    width, all_bits = 2 * most + 1, (1 << 2 * most + 1) - 1
    # equal[i]: bit k is set if x[i] equals y[i + k - most]
    at: dict[int, int] = {}
    for j in range(min(most, len(y))):
        at[y[j]] = at.get(y[j], 0) | 1 << (j + most + 1)
    reach = [((1 << e + 1) - 1) << most & all_bits for e in range(most + 1)]  # cells of row 0 at e insertions
    for i, c in enumerate(x):
        at = {k: v >> 1 for k, v in at.items() if v > 1}
        if i + most < len(y):
            at[y[i + most]] = at.get(y[i + most], 0) | 1 << (width - 1)
        equal, before = at.get(c, 0), None
        new = []
        for e in range(most + 1):
            bits = reach[e] & equal
            if e:
                bits |= reach[e - 1] | reach[e - 1] >> 1 | before << 1  # substitute, delete from x, insert from y
                bits |= before
            # an insertion may be followed by another at the next level only; a cell of y that does not exist is cut
            low, high = max(0, most - i - 1), min(width - 1, len(y) - i - 1 + most)
            bits &= ((1 << high + 1) - 1) & ~((1 << low) - 1) if high >= 0 else 0
            new.append(bits)
            before = bits
        if not new[-1]:
            return most + 1
        reach = new
    goal = len(y) - len(x) + most
    return next((e for e in range(most + 1) if reach[e] >> goal & 1), most + 1)


def segments(length: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each of `parts` segments of lines of the given lengths (columns)."""
    base, more = length // parts, length % parts
    k = np.arange(parts)
    size = base[:, None] + (k >= parts - more[:, None])
    return np.cumsum(size, axis=1) - size, size


def _keys(data: np.ndarray, start: np.ndarray, length: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(line, key, index) of lines given as code points: a line's segments, for the index and for probing lines as long as
    it, and the substrings that may be another line's segments, for probing only."""
    parts = distance + 1

    def key(rows: np.ndarray, begin: np.ndarray, size: np.ndarray, whole: np.ndarray, part: int) -> np.ndarray:
        p = start[rows] + begin
        return mixed(sums.of(p, p + size) + mixed(whole.astype(np.uint64) * np.uint64(64) + np.uint64(part)))

    sums = Sums(data)
    for less in range(distance + 1):
        whole = length - less
        begin, size = segments(whole, parts)
        for i in range(parts):
            for move in range(max(-i, less - (distance - i)), min(i, less + distance - i) + 1):
                at = begin[:, i] + move
                ok = np.flatnonzero((at >= 0) & (at + size[:, i] <= length) & (whole > 0))
                yield ok, key(ok, at[ok], size[ok, i], whole[ok], i), not less and not move


class Lines:
    """The lines of a range of texts without white space at their ends; those of white space alone are left out.

    row, at: the text and the line's number in it; begin, end: its bytes; points: its code points; h, g: two hashes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        first = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(breaks, offsets)) + 1)
        last = np.sort(np.concatenate([breaks, offsets[1:]]))
        solid = np.flatnonzero(~is_space(data))
        a, b = np.searchsorted(solid, first), np.searchsorted(solid, last)
        some = a < b
        number = np.arange(len(first)) - np.searchsorted(row, row)
        self.row, self.at = row[some], number[some].astype(np.int32)
        self.begin, self.end = solid[a[some]], solid[b[some] - 1] + 1
        self.count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        self.points = self.count[self.end] - self.count[self.begin]
        self.h = run_hashes(data, self.begin, self.end).view(np.int64)
        self.g = run_hashes(data, self.begin, self.end, SECOND).view(np.int64)


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Lines]]:
    """Ranges of rows of a batch: the first row, the bytes and the lines."""
    data, offsets = utf8(batch.column("text"))
    for b, e in slices(offsets, BYTES):
        own = data[offsets[b] : offsets[e]]
        yield b, own, Lines(own, offsets[b : e + 1] - offsets[b])


def _spanning(lines: list[np.ndarray], distance: int) -> list[tuple[int, int]]:
    """Links that connect the lines of a group that are linked."""
    bags = np.array([np.bincount(x % 61, minlength=61) for x in lines], np.int32)
    size = np.array([len(x) for x in lines])
    left, out = np.arange(len(lines)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            # an edit changes the counts of letters by 2 at most, and the length by 1
            may = left[(np.abs(size[left] - size[x]) <= distance) & (np.abs(bags[left] - bags[x]).sum(axis=1) <= 2 * distance)]
            near = np.array([y for y in may if edit_distance(lines[x], lines[y], distance) <= distance], np.int64)
            if len(near):
                out += [(x, y) for y in near]
                left = left[~np.isin(left, near)]
                queue.extend(near.tolist())
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """did, tag (of the text) and text of every row that has a text."""
    return docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), F.xxhash64("text").alias("tag"), "text")


def line_digests(docs: DataFrame) -> DataFrame:
    """did, tag, at, h, g: the place and the 128-bit hash of every line that is not empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _, lines in _ranges(batch):
                take = pa.array(lines.row + b)
                yield pa.RecordBatch.from_arrays([batch.column("did").take(take), batch.column("tag").take(take), pa.array(lines.at), pa.array(lines.h), pa.array(lines.g)], names=["did", "tag", "at", "h", "g"])

    return _texts(docs).mapInArrow(lean(scan), "did long, tag long, at int, h long, g long")


def shared_keys(docs: DataFrame, lines: int, distance: int, min_chars: int, per_bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """key, h: the keys that an index row and a probe of different lines share, with those lines. `lines`: about their number.

    Keys travel packed, up to PACKED of a bucket in a row, and are sorted bucket by bucket by numpy. A bucket holds
    about `per_bucket` keys; a key with more than `hot` lines is not gathered but passed on as it comes.
    """
    buckets = max(1, -(-lines * (distance + 1) * (distance + 2) // per_bucket))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of, held = [], [], 0
        for batch in batches:
            for _, data, lines in _ranges(batch):
                long = np.flatnonzero(lines.points >= min_chars)
                long = long[np.unique(lines.h[long], return_index=True)[1]]  # equal lines of a range go once
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                for row, key, index in _keys(points, lines.count[lines.begin[long]], lines.points[long], distance):
                    keys.append(key & ~np.uint64(1) | np.uint64(index))
                    of.append(lines.h[long[row]])
                    held += len(row)
                if held >= per_bucket:
                    yield packed(np.concatenate(keys), np.concatenate(of))
                    keys, of, held = [], [], 0
        if held:
            yield packed(np.concatenate(keys), np.concatenate(of))

    def packed(keys: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int64)
        place = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        first = np.flatnonzero(place % PACKED == 0)
        cut = np.append(first, len(bucket))
        blob = lambda x, size: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((cut * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[order]))])
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), blob(keys.astype(np.uint32), 4), blob(of, 8)], names=["bucket", "keys", "lines"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered = None, None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            for a, b in zip(cut, [*cut[1:], len(bucket)]):
                if bucket[a] != now:
                    if gathered is not None:
                        yield gathered.end()
                    now, gathered = bucket[a], Gathered(int(bucket[a]), hot, 2 * per_bucket)
                parts = [utf8(batch.column(k).slice(a, b - a)) for k in ("keys", "lines")]
                out = gathered.add(*[data[o[0] : o[-1]].copy().view(t) for (data, o), t in zip(parts, (np.uint32, np.int64))])
                if out is not None:
                    yield out
        if gathered is not None:
            yield gathered.end()

    keyed = _texts(docs).select("text").mapInArrow(lean(emit), "bucket long, keys binary, lines binary")
    return keyed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "key long, h long")


class Gathered:
    """The keys of one bucket that were read so far; keys are 31 bits and a mark of the index in the lowest bit."""

    def __init__(self, bucket: int, hot: int, most: int):
        self.bucket, self.hot, self.most = bucket, hot, most
        self.keys, self.lines, self.held = [], [], 0
        self.passed = np.zeros(0, np.uint32)  # hot keys

    def add(self, keys: np.ndarray, lines: np.ndarray) -> pa.RecordBatch | None:
        at_once = np.isin(keys >> 1, self.passed) if len(self.passed) else np.zeros(len(keys), bool)
        self.keys.append(keys[~at_once])
        self.lines.append(lines[~at_once])
        self.held += len(self.keys[-1])
        out = [(keys[at_once] >> 1, lines[at_once])]
        if self.held > self.most:
            key, line, index, group = self._sorted()
            large = (np.bincount(group) > self.hot) & (np.bincount(group, index) > 0)
            go = large[group]
            out.append((key[go], line[go]))
            self.passed = np.unique(np.concatenate([self.passed, key[go]]))
            self.keys, self.lines = [key[~go] << 1 | index[~go]], [line[~go]]
            self.held = len(self.keys[0])
            self.most = max(self.most, 2 * self.held)
        key, line = (np.concatenate(x) for x in zip(*out))
        return self._batch(key, line) if len(key) else None

    def end(self) -> pa.RecordBatch:
        key, line, index, group = self._sorted()
        some = (np.bincount(group) > 1) & (np.bincount(group, index) > 0)
        return self._batch(key[some[group]], line[some[group]])

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different (key, line), sorted, whether one of them is of the index, and the keys' numbers."""
        keys, lines = np.concatenate(self.keys), np.concatenate(self.lines)
        order = np.argsort((keys >> 1).astype(np.uint64) << np.uint64(33) | lines.view(np.uint64) >> np.uint64(31))
        keys, lines = keys[order], lines[order]
        key = keys >> 1
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lines[1:] != lines[:-1])][: len(key)])
        index = np.maximum.reduceat(keys & 1, first) if len(first) else keys & 1
        key, lines = key[first], lines[first]
        return key, lines, index, np.cumsum(np.r_[False, key[1:] != key[:-1]][: len(key)])

    def _batch(self, key: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64) + (self.bucket << 31)), pa.array(line)], names=["key", "h"])


def line_links(docs: DataFrame, each: DataFrame, lines: int, distance: int = DISTANCE, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different lines, as structs of h and g, that connect all that are linked.

    `each`: h, g and first (did, at, tag: an occurrence) of every different line; `lines`: about their number.
    """
    met = written(shared_keys(docs, lines, distance, min_chars))
    places = written(each.join(met.select("h").distinct(), "h").groupBy("first.did", "first.tag").agg(F.collect_list(F.struct("first.at", "h", "g")).alias("lines")))
    texts = Repeated.every(places.select("did"), "did").mark(_texts(docs), "did").filter("_maybe").groupBy("did", "tag").agg(F.any_value("text").alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text"), batch.column("lines")):
                raw = text.as_py().split("\n")
                out += [(x["h"], x["g"], raw[x["at"]].strip(SPACES)) for x in own.as_py()]
            h, g, line = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(line, pa.string())], names=["h", "g", "line"])

    named = places.join(texts, ["did", "tag"]).select("text", "lines").mapInArrow(lean(pick), "h long, g long, line string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            cell_counts(batch.column("key").to_numpy(), total)
        yield cell_batch(total)

    hot = hot_blocks(met.select("key").mapInArrow(lean(count), "cell long, n long"), block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 500):
            rep, low, high, _ = block_pairs(batch.column("key").to_numpy(), batch.column("h").to_numpy(), hot)
            take = pa.array(rep)
            moved = {k: batch.column(k).take(take) for k in ("key", "h", "g", "line")}
            yield pa.RecordBatch.from_pydict({"key": moved["key"], "low": pa.array(low), "high": pa.array(high), "h": moved["h"], "g": moved["g"], "line": moved["line"]})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            key, low, high = (rows[0].column(k).to_numpy() for k in ("key", "low", "high"))
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            yield groups(rows[0], first)
            rest = rows[0].slice(first[-1])
        if rest is not None:
            yield groups(rest, np.array([0, rest.num_rows]))

    def groups(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        for x, y in zip(first[:-1], first[1:]):
            if y - x > 1:
                lines = [np.frombuffer(t.as_py().encode("utf-32-le"), np.uint32) for t in rows.column("line").slice(x, y - x)]
                for i, j in _spanning(lines, distance):
                    a.append(x + i)
                    b.append(x + j)
        node = pa.StructArray.from_arrays([rows.column("h"), rows.column("g")], names=["h", "g"])
        return pa.RecordBatch.from_arrays([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], names=["a", "b"])

    dealt = met.join(named, "h").select("key", "h", "g", "line").mapInArrow(lean(deal), "key long, low long, high long, h long, g long, line string")
    link = "a struct<h: long, g: long>, b struct<h: long, g: long>"
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(lean(verify), link)


def removed_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """did, tag, gone (numbers of the lines that go) and n (rows with this did and tag) of the texts that lose lines."""
    lines = written(line_digests(docs))
    total = lines.count()
    each = written(lines.groupBy("h", "g").agg(F.min(F.struct("did", "at", "tag")).alias("first"), F.count("*").alias("n")))
    named = written(connected_components(line_links(docs, each, total, distance, min_chars, block)))
    named = named.unionByName(named.select(F.col("component").alias("node"), "component").distinct()).select("node.h", "node.g", "component")
    # a line that occurs once and is linked to none stays
    linked = written(each.join(named, ["h", "g"], "left").filter("n > 1 OR component IS NOT NULL").select("h", "g", "first", "n", F.coalesce("component", F.struct("h", "g")).alias("component")))
    best = linked.groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("members"))
    odd = join_split(linked.drop("first"), best, ["component"], "members", linked.count()).select("h", "g", "n", F.col("best.did").alias("did0"), F.col("best.at").alias("at0"))
    met = join_split(lines, written(odd), ["h", "g"], "n", total)
    gone = met.filter((F.col("did") != F.col("did0")) | (F.col("at") != F.col("at0"))).groupBy("did", "tag").agg(F.collect_set("at").alias("gone"), F.count("*").alias("n"))
    return gone.select("did", "tag", "gone", (F.col("n") / F.size("gone")).cast("long").alias("n"))


def without_near_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the lines that stay) of every row."""
    gone = written(removed_lines(docs, distance, min_chars, block))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), "text")
    marked = Repeated.every(gone.select("did"), "did").mark(ids, "did")
    keyed = marked.filter("_maybe").select("doc_id", "text", "did", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("tag"))
    met = join_split(keyed, gone, ["did", "tag"], "n", gone.agg(F.sum("n")).first()[0] or 0, "left").select("doc_id", "text", "gone")
    text = F.coalesce("text", F.lit(""))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    whole = lambda df: df.select("doc_id", n_lines, F.lit(0).cast("long").alias("n_removed"), text.alias("kept"))
    left = lambda x: F.array_except(F.sequence(F.lit(1), F.size(x)), F.transform("gone", lambda i: i + 1))
    # the split text is bound once, as the only element of an array
    kept = F.transform(F.array(F.split(text, "\n")), lambda x: F.array_join(F.transform(F.when(F.size(x) > F.size("gone"), left(x)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(x, i)), "\n"))[0]
    cut = met.filter("gone IS NOT NULL").select("doc_id", n_lines, F.size("gone").cast("long").alias("n_removed"), kept.alias("kept"))
    return whole(marked.filter("NOT _maybe")).unionByName(whole(met.filter("gone IS NULL"))).unionByName(cut)

"""Byte-level BPE by speculation: propose tokens by longest match, verify their neighbours, merge only what fails.

A text is cut into words as the tokenizer cuts it. The longest known token at each place of a word is the
proposal. It is the true encoding exactly if no merge can happen across any border between two of its tokens, and
whether one can depends on those two tokens alone: the pieces at the border, while either token grows from its
bytes by merges of rising rank, meet in a merge that comes before the next merge of each side. That is
tested for all new pairs of neighbours at once, over the tokens' right and left spines. Words that
fail are merged exactly, by rank and from the left.

Each distinct word of a task is encoded once and then looked up, so the cost grows with the text but hardly with the
vocabulary. Texts are worked on in slices of bytes, long ones in runs of words, so a task's memory is bounded.

Where the tokenizer's classes of characters are older than the `regex` library's, texts with such characters are
cut by the tokenizer's own splitter.

Defined results: null and empty texts have no tokens and decode to the empty text; an added token's string in a text
is that token, as in the library; ids outside the vocabulary decode to nothing; repeated rows are encoded alike;
columns of the input stay (a clashing name gets an underscore before it); an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, lean, quoted, slices, small_batches, utf8

#: How byte-level tokenizers of this kind cut a text (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker process remembers, bytes of text and words that it works on at a time.
KEPT = 400_000
BYTES = 1 << 20
WORDS = 500_000
_NEVER = np.int64(1) << 40


def alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def check_form(spec: dict) -> None:
    """Refuse tokenizers that work in other ways than this module's."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cut = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = not any(t["normalized"] and spec["normalizer"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    if not (model["type"] == "BPE" and plain and cut and added) or spec["normalizer"] or spec.get("truncation") or spec.get("padding"):
        raise ValueError("only plain byte-level BPE without normaliser, truncation and padding is encoded here")


def unlike_characters(spec: str) -> str:
    """The characters that `regex` and the tokenizer see as different kinds.

    Each character stands behind one of its own kind; the tokenizer must see no border between the two.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd = []
    for guard, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]")):
        own = regex.findall(kind, every)
        text = guard + guard.join(own)
        borders = {b for _, span in cut(text) for b in span}
        odd += [c for k, c in enumerate(own) if borders & {2 * k + 1, 2 * k + 2} - {0, len(text)}]
    odd += [c for c in regex.findall(r"\s", every) if len(cut("!" + c + "!")) == 1 or len(cut("a" + c + "a")) == 1 or len(cut("1" + c + "1")) == 1]
    return "".join(odd)


class Vocabulary:
    """Tokens and merges of a tokenizer as arrays.

    made: the rank of the merge that makes a token; left, right: what it merges (-1 for bytes and added tokens);
    left_spine, right_spine: a token, its left (right) part, that part's left (right) part and so on, padded by -1;
    sound: tokens whose own text encodes to just them, the only ones to be proposed.
    """

    def __init__(self, spec: dict):
        check_form(spec)
        symbols, vocab = alphabet(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.text: list[bytes | None] = [None] * self.size
        for token, i in vocab.items():
            self.text[i] = bytes(symbols[c] for c in token)
        of = {t: i for i, t in enumerate(self.text) if t is not None}
        for token, i in self.added.items():
            self.text[i] = token.encode()
        self.byte = [of[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.merge = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        self.made, self.left, self.right = np.full(self.size, _NEVER), np.full(self.size, -1), np.full(self.size, -1)
        twice = set()
        for rank, (a, b, c) in enumerate(merges):
            if self.left[c] >= 0:
                twice.add(c)
            else:
                self.made[c], self.left[c], self.right[c] = rank, a, b
        keys = np.array([a * self.size + b for a, b, _ in merges], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.left_spine, self.right_spine = self._spine(self.left), self._spine(self.right)
        some = np.flatnonzero(self.left >= 0)
        own = np.zeros(self.size, bool)
        own[self.byte] = True
        own[some] = ~self.crossed(self.left[some], self.right[some], whole=False)
        own[list(twice)] = False
        for i in some[np.argsort(self.made[some])].tolist():
            own[i] = own[i] and own[self.left[i]] and own[self.right[i]]
        self.sound = own
        self.known = {self.text[i]: i for i in np.flatnonzero(own).tolist()}
        self.longest: dict[bytes, int] = {}
        for t in self.known:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 0), len(t))

    def _spine(self, part: np.ndarray) -> np.ndarray:
        columns = [np.arange(self.size)]
        while (columns[-1] >= 0).any():
            columns.append(np.where(columns[-1] >= 0, part[columns[-1]], -1))
        return np.stack(columns, axis=1).astype(np.int32)

    def crossed(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether a merge happens across the border of each pair of tokens; `whole`: count the merge of the two themselves."""
        hit = np.zeros(len(a), bool)
        for i in range(self.right_spine.shape[1]):
            live = np.flatnonzero(~hit & (self.right_spine[a, i] >= 0))
            if not len(live):
                break
            for j in range(self.left_spine.shape[1]):
                live = live[~hit[live] & (self.left_spine[b[live], j] >= 0)]
                if not len(live):
                    break
                if i + j == 0 and not whole:
                    continue
                x, y = self.right_spine[a[live], i].astype(np.int64), self.left_spine[b[live], j]
                key = x * self.size + y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[at] == key, self.rank[at], _NEVER)
                next_x = self.made[self.right_spine[a[live], i - 1]] if i else _NEVER
                next_y = self.made[self.left_spine[b[live], j - 1]] if j else _NEVER
                # of merges of one rank the leftmost is first: the border's comes after the left side's, before the right's
                hit[live[(rank < next_x) & (rank <= next_y)]] = True
        return hit

    def propose(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            most = min(n - at, self.longest.get(word[at : at + 2], 1))
            while most > 1 and word[at : at + most] not in self.known:
                most -= 1
            out.append(self.known[word[at : at + most]])
            at += most
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, the leftmost of a rank first."""
        ids = [self.byte[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            m = after[k]
            found = self.merge.get((ids[k], ids[m])) if ids[k] >= 0 and m < len(ids) else None
            if found is None or found[0] != rank:
                continue
            ids[k], ids[m] = found[1], -1
            after[k] = after[m]
            if after[m] < len(ids):
                before[after[m]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < len(ids) and (p := (ids[x], ids[after[x]])) in self.merge:
                    heapq.heappush(queue, (self.merge[p][0], x))
        return [i for i in ids if i >= 0]


class Encoder:
    """Ids of texts; remembers words and pairs of tokens. `failed` counts the words that needed exact merging, of `seen`."""

    def __init__(self, spec: str, unlike: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(json.loads(spec))
        self.cut, self.word = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str, regex.compile(WORD)
        self.unlike = np.zeros(0x110000, bool)
        self.unlike[list(map(ord, unlike))] = True
        self.least = min(map(ord, unlike), default=0x110000)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.seen = self.failed = 0
        self.pairs, self.crossed = np.zeros(0, np.int64), np.zeros(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.at, self.ids, self.start, self.count = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _is_unlike(self, text: str) -> bool:
        if text.isascii() and self.least > 127:
            return False
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return bool(len(points)) and int(points.max()) >= self.least and bool(self.unlike[points].any())

    def words(self, text: str) -> Iterator[list]:
        """The text's words, in lists of bounded length; an added token is its id."""
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                yield [self.vocabulary.added[part]]
            elif self._is_unlike(part):
                yield [part[a:b] for _, (a, b) in self.cut(part)]
            elif len(part) <= WORDS:
                yield self.word.findall(part)
            else:
                found = (m.group() for m in self.word.finditer(part))
                while some := list(islice(found, WORDS)):
                    yield some

    def _bad(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b can not stand side by side; each pair is worked out once."""
        keys, where = np.unique(a.astype(np.int64) * self.vocabulary.size + b, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        near = np.minimum(at, max(0, len(self.pairs) - 1))
        new = self.pairs[near] != keys if len(self.pairs) else np.ones(len(keys), bool)
        if new.any():
            found = self.vocabulary.crossed(keys[new] // self.vocabulary.size, keys[new] % self.vocabulary.size)
            self.pairs, self.crossed = np.insert(self.pairs, at[new], keys[new]), np.insert(self.crossed, at[new], found)
        return self.crossed[np.searchsorted(self.pairs, keys)][where]

    def learn(self, words: list) -> None:
        v = self.vocabulary
        raw = [None if isinstance(w, int) else w.encode() for w in words]
        ids = [[w] if r is None else v.propose(r) for w, r in zip(words, raw)]
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
        inside = np.ones(max(0, len(flat) - 1), bool)
        inside[np.cumsum(count)[:-1] - 1] = False
        left = np.flatnonzero(inside)
        bad = left[self._bad(flat[left], flat[left + 1])]
        wrong = np.unique(np.searchsorted(np.cumsum(count), bad, side="right")).tolist()
        self.seen, self.failed = self.seen + len(words), self.failed + len(wrong)
        if wrong:
            for k in wrong:
                ids[k] = v.exact(raw[k])
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, flat])
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        if len(self.pairs) > 4 * KEPT:
            self.pairs, self.crossed = self.pairs[:0], self.crossed[:0]

    def ids_of(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and each word's number of them."""
        if len(self.at) > KEPT:
            self._forget()
        if new := sorted(set(words) - self.at.keys(), key=str):
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        upto = np.cumsum(count)
        return self.ids[np.repeat(self.start[at] - upto + count, count) + np.arange(upto[-1] if len(upto) else 0)], count

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and each text's offsets in them."""
        parts, held, owners, sizes = [], [], [], np.zeros(len(texts), np.int64)

        def flush() -> None:
            ids, count = self.ids_of(held)
            parts.append(ids)
            begin = 0
            for k, n in owners:
                sizes[k] += count[begin : begin + n].sum()
                begin += n
            held.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for some in self.words(text):
                held += some
                owners.append((k, len(some)))
                if len(held) >= WORDS:
                    flush()
        if held:
            flush()
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum(sizes)])


class Decoder:
    """Texts of ids: the tokens' bytes, of which what is no UTF-8 becomes U+FFFD."""

    def __init__(self, spec: str):
        texts = [t or b"" for t in Vocabulary(json.loads(spec)).text]
        self.size, self.data = np.array([len(t) for t in texts] + [0], np.int64), np.frombuffer(b"".join(texts), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        some = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        size = self.size[some]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.data[np.repeat(self.start[some] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        ends = upto[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _kept(kind: type, spec: str, *more: str):
    """The worker process's Encoder or Decoder of a tokenizer; it outlives a task."""
    kept = sys.modules.setdefault("_corvane_worker", types.ModuleType("_corvane_worker")).__dict__
    key = f"bpe-{kind.__name__}-{zlib.crc32(spec.encode())}-{len(spec)}"
    if key not in kept:
        kept[key] = kind(spec, *more)
    return kept[key]


def encoded(docs: DataFrame, tokenizer_path: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """The rows with `ids`, the tokens of `text`; `drop_text` leaves the text itself out."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    check_form(json.loads(spec))
    small_batches(docs.sparkSession)
    unlike = unlike_characters(spec)
    (name,) = fresh(docs, "ids")
    stay = [c for c in docs.columns if not (drop_text and c == text)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _kept(Encoder, spec, unlike)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for begin, end in slices(utf8(column)[1], BYTES):
                ids, offsets = coder.texts(column.slice(begin, end - begin).fill_null("").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns[:-1]), lists], names=[*batch.schema.names[:-1], name])

    (copy,) = fresh(docs, "_text")
    source = docs.select(*quoted(stay), F.col(f"`{text}`").alias(copy))
    out = docs.select(*quoted(stay)).withColumn(name, F.array().cast("array<int>")).schema
    return source.mapInArrow(lean(scan), out)


def decoded(rows: DataFrame, tokenizer_path: str, ids: str = "ids", drop_ids: bool = False) -> DataFrame:
    """The rows with `decoded`, the text of the ids, added tokens' strings included; null ids give the empty text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    small_batches(rows.sparkSession)
    (name,) = fresh(rows, "decoded")
    stay = [c for c in rows.columns if not (drop_ids and c == ids)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _kept(Decoder, spec)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            bounds = column.offsets.to_numpy().astype(np.int64)
            for begin, end in slices(bounds * 4, BYTES):
                own = bounds[begin : end + 1]
                values = column.values.slice(own[0], own[-1] - own[0]).fill_null(-1).to_numpy(zero_copy_only=False)
                texts = pa.array(coder.texts(values, own - own[0]), pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, end - begin) for c in batch.columns[:-1]), texts], names=[*batch.schema.names[:-1], name])

    (copy,) = fresh(rows, "_ids")
    source = rows.select(*quoted(stay), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias(copy))
    out = rows.select(*quoted(stay)).withColumn(name, F.lit("")).schema
    return source.mapInArrow(lean(scan), out)

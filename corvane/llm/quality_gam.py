"""Quality classifier: a generalised additive model with pairwise interactions of boosted shallow trees.

Each text becomes a few numbers (shares of kinds of bytes and words, repetition, length), computed over
all of it. Numbers are put into bins. Boosting goes round the features in cycles: each step fits a
tree of a few leaves over one feature's bins to the log-loss gradients and adds it to that feature's
lookup table; then the pairs that reduce the loss most get tables over two features' bins in the same way.
A score is the logistic function of the sum of table entries.

The model is fitted on the driver from at most `MOST_ROWS` labelled rows (those whose doc_id has the
smallest hashes, a documented bound; whatever the corpus, 14 numbers each); features and scores of all
documents are computed on the executors, from the text alone.

Defined results: null and empty texts get the score of their features (zeros); labels that are null or of
no document are not used, of several labels of a doc_id the largest counts; without labels of both kinds
all scores are the smoothed share of label 1; a null doc_id is never held out and never trained on;
rows that repeat score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lean, mixed, release, slices, small_batches, utf8
from corvane.llm.words import Words

MOST_ROWS = 20_000
THRESHOLD = 0.3
BYTES = 1 << 18
FEATURES = ["words", "word_bytes", "upper", "digits", "marks", "stops", "bangs", "bars", "wide", "lines", "upper_words", "marked_words", "again", "distinct"]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text (its UTF-8 bytes between two offsets)."""
    words = Words.read(data, offsets)
    hashes = words.hashes(data)
    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(words.first), 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, wide = (data >= 48) & (data <= 57), data >= 128
    stop = np.isin(data, np.frombuffer(b".,;:?'\"-()", np.uint8))
    mark = (data > 32) & (data < 127) & ~(upper | lower | digit | stop) & (data != 33) & (data != 124)
    in_words = lambda x: (s := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[words.end] - s[words.begin]
    loud = (in_words(upper) > 1) & (in_words(lower) == 0)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.of[1:] == words.of[:-1])
    own = mixed(hashes + words.of.astype(np.uint64))  # a word of a text is one number
    distinct = np.bincount(words.of[np.unique(own, return_index=True)[1]], minlength=len(n_words))
    part = lambda x: _sums(x, offsets) / n_bytes
    share = lambda x: _sums(x, words.first) / n_words
    columns = [np.log1p(np.diff(words.first)), share(words.end - words.begin), part(upper), part(digit), part(mark), part(stop), part(data == 33), part(data == 124), part(wide), part(data == 10), share(loud), share(in_words(mark) > 0), share(again), distinct / n_words]
    return np.column_stack(columns)


def text_features(column: pa.Array) -> np.ndarray:
    """`features` of an Arrow column of texts."""
    data, offsets = utf8(column)
    found = [features(data[offsets[b] : offsets[e]], offsets[b : e + 1] - offsets[b]) for b, e in slices(offsets, BYTES)]
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Values per bin of a tree over ordered bins, grown by the split that gains most."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            k = np.arange(a + 1, b)
            if len(k):
                left, right = (g[k] - g[a]) ** 2 / (h[k] - h[a] + l2), (g[b] - g[k]) ** 2 / (h[b] - h[k] + l2)
                gain = left + right - (g[b] - g[a]) ** 2 / (h[b] - h[a] + l2)
                best = max(best, (float(gain.max()), int(k[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + l2)
    return out


def _cross(gradient: np.ndarray, hessian: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut of each of two features, over a grid of bins: gain and values."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = pad(gradient), pad(hessian)
    n, m = gradient.shape
    corner = lambda s: [s[1:n, 1:m], s[1:n, -1:] - s[1:n, 1:m], s[-1:, 1:m] - s[1:n, 1:m], s[-1, -1] - s[1:n, -1:] - s[-1:, 1:m] + s[1:n, 1:m]]
    gs, hs = corner(g), corner(h)
    if n < 2 or m < 2:
        return 0.0, np.zeros((n, m))
    gain = sum(a**2 / (b + l2) for a, b in zip(gs, hs)) - g[-1, -1] ** 2 / (h[-1, -1] + l2)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty((n, m))
    for at, a, b in zip([(slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))], gs, hs):
        out[at] = a[i, j] / (b[i, j] + l2)
    return float(gain[i, j]), out


class AdditiveModel:
    """Lookup tables of single features and of pairs, over bins."""

    def __init__(self, bias: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray], coarse: list[np.ndarray]):
        self.bias, self.edges, self.tables, self.pairs, self.coarse = bias, edges, tables, pairs, coarse

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        z = np.full(len(x), self.bias)
        for table, b in zip(self.tables, bins):
            z += table[b]
        for (i, j), table in self.pairs.items():
            z += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-z))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 64, grid: int = 12, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, leaves: int = 3, l2: float = 2.0) -> AdditiveModel:
        edges = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) if len(x) else np.zeros(0) for k in range(x.shape[1])]
        coarse = [(np.arange(len(e) + 1) * grid) // (len(e) + 1) for e in edges]
        tables = [np.zeros(len(e) + 1) for e in edges]
        share = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(float(np.log(share / (1 - share))), edges, tables, {}, coarse)
        if not 0 < y.sum() < len(y):
            return model
        b = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
        z = np.full(len(y), model.bias)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(rounds):
            for k, table in enumerate(tables):
                g, h = slope()
                step = rate * _tree(np.bincount(b[k], g, len(table)), np.bincount(b[k], h, len(table)), leaves, l2)
                table += step
                z += step[b[k]]
        c = [coarse[k][b[k]] for k in range(len(b))]
        sizes = [int(q[-1]) + 1 for q in coarse]
        over = lambda i, j, v: np.bincount(c[i] * sizes[j] + c[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
        g, h = slope()
        gains = sorted(((_cross(over(i, j, g), over(i, j, h), l2)[0], i, j) for i, j in combinations(range(len(b)), 2)), reverse=True)
        model.pairs.update({(i, j): np.zeros((sizes[i], sizes[j])) for _, i, j in gains[:n_pairs]})
        for _ in range(pair_rounds):
            for (i, j), table in model.pairs.items():
                g, h = slope()
                step = rate * _cross(over(i, j, g), over(i, j, h), l2)[1]
                table += step
                z += step[c[i], c[j]]
        return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> AdditiveModel:
    """The model of the labelled rows outside the held-out fifth, one row per doc_id (of repeats, the text with the least hash)."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), batch.column("_text"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "_label", "_text", "x"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = ids.join(F.broadcast(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_label").cast("int").alias("_label"))), "doc_id").select("doc_id", "text", "_label", F.xxhash64("text").alias("_text"))
    each = joined.mapInArrow(lean(scan), "doc_id long, _label int, _text long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("_text", "_label", "x")).alias("_row"))
    rows = each.select("doc_id", "_row._label", "_row.x").toArrow().sort_by("doc_id").combine_chunks()  # one per doc_id of the sample: most_rows at most
    x = pc.list_flatten(rows["x"]).to_numpy().astype(float).reshape(-1, len(FEATURES))
    model = AdditiveModel.fit(x, rows["_label"].to_numpy().astype(float))
    del rows, x
    release()
    return model


def _scan(model: AdditiveModel, then: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield then(batch, model.scores(text_features(batch.column("text"))))

    return scan


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every row."""
    out = lambda batch, score: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scan(model, out)), "doc_id long, score double")


def good_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns; no row moves."""
    return docs.mapInArrow(lean(_scan(model, lambda batch, score: batch.filter(pa.array(score >= threshold)))), docs.schema)

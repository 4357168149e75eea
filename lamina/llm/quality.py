"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in flat numpy passes. The trees are complete
and flattened into three arrays (feature, threshold, leaf value), so scoring a
batch is ``depth`` vectorised steps for every tree. Only a bounded sample of
labelled rows reaches the driver for fitting; scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import spread, texts, tune

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digits", "symbols", "marks", "exclaim", "pipes", "other_ascii", "non_ascii",
    "newlines", "short_words", "marked_words", "distinct_words", "top_word", "repeat_3", "repeat_lines", "entropy", "capitalised",
)
#: Labelled rows used for fitting at most (those of smallest hash of the key).
MAX_TRAIN = 8000
KEEP_FROM = 0.3


def _class_table() -> np.ndarray:
    """Columns: upper, lower, digit, symbol, mark, exclamation, pipe, other printable ASCII, non-ASCII, newline."""
    table = np.zeros((256, 10), np.int8)
    table[65:91, 0] = 1
    table[97:123, 1] = 1
    table[48:58, 2] = 1
    table[list(b"#$%&*<>@^~+=\\_{}[]`"), 3] = 1
    table[list(b".,;:?\"'()-/"), 4] = 1
    table[ord("!"), 5] = 1
    table[ord("|"), 6] = 1
    table[33:127, 7] = 1 - table[33:127, :7].sum(axis=1)
    table[128:, 8] = 1
    table[10, 9] = 1
    return table


CLASSES = _class_table()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a slice; zeros for an empty text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets).astype(float)
    nonzero = np.maximum(size, 1)
    rows_of = np.repeat(np.arange(n), np.diff(offsets))
    hist = np.bincount(rows_of * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = hist @ CLASSES.astype(float)
    upper, lower, digit, symbol, mark, exclaim, pipe, other, high, newline = kinds.T
    starts, ends, rows, counts = K.word_spans(data, offsets)
    words = np.maximum(counts, 1).astype(float)
    length = ends - starts
    ranges = np.concatenate(([0], np.cumsum(counts)))
    hashes = K.span_hashes(data, starts, ends)
    share = hist / nonzero[:, None]
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(counts)
    out[:, 2] = K.segment_sum(length, ranges) / words
    out[:, 3] = upper / np.maximum(upper + lower, 1)
    for i, kind in enumerate((digit, symbol, mark, exclaim, pipe, other, high), start=4):
        out[:, i] = kind / nonzero
    out[:, 11] = newline / words
    out[:, 12] = K.segment_sum((length <= 3).astype(np.int64), ranges) / words
    if len(starts):
        last = data[ends - 1]
        ends_marked = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | ((last >= 48) & (last <= 57)))
        first = data[starts]
        out[:, 13] = K.segment_sum(ends_marked.astype(np.int64), ranges) / words
        out[:, 19] = K.segment_sum(((first >= 65) & (first <= 90)).astype(np.int64), ranges) / words
    for i, (a, b) in enumerate(zip(ranges[:-1], ranges[1:])):
        if b > a:
            own = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            out[i, 14], out[i, 15] = (len(edge) - 1) / (b - a), np.diff(edge).max() / (b - a)
    three, owner = K.shingle_hashes(hashes, rows, counts, 3)
    spans = K.row_ranges(owner, n)
    for i, own in enumerate(K.distinct_sorted(three, spans)):
        out[i, 16] = 1 - len(own) / max(1, spans[i + 1] - spans[i])
    line_rows, line_hashes = worded_lines(data, offsets)
    spans = K.row_ranges(line_rows, n)
    for i in np.flatnonzero(np.diff(spans) > 1):
        own = line_hashes[spans[i] : spans[i + 1]]
        out[i, 17] = 1 - len(np.unique(own)) / len(own)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 18] = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    return out


def worded_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and content hashes of the newline-split lines that hold a word, in order."""
    breaks = data == 10
    starts, ends, _, _ = K.word_spans(data, offsets, separators=_NEWLINE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    has_word = np.concatenate(([0], np.cumsum(~K.SPACE[data] & ~breaks)))
    keep = has_word[ends] > has_word[starts]
    starts, ends = starts[keep], ends[keep]
    return np.searchsorted(offsets, starts, "right") - 1, K.span_hashes(data, starts, ends)


_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


@dataclass
class Boosted:
    """Trees in arrays: inner nodes of tree t are ``feature[t]``/``threshold[t]``, leaves ``value[t]``."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, margin = len(x), np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        at_row = np.arange(n)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(n, np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[at_row, feature[node]] > threshold[node])
            margin += value[node - (value.shape[0] - 1)]
        return 1 / (1 + np.exp(-margin))


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0) -> Boosted:
    """Newton boosting on quantile histograms with the logistic loss."""
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_ones = (y.sum() + 1) / (n + 2)
    model = Boosted(float(np.log(rate_of_ones / (1 - rate_of_ones))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if n < 10 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p) + 1e-6
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, choice = np.zeros(width), [(0, np.inf)] * width
            for j in range(m):
                key = local * bins + coded[:, j]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain = np.where((h > 1) & (ht - h > 1), gain, 0)[:, : len(edges[j])]
                if gain.shape[1]:
                    cut = gain.argmax(axis=1)
                    for k in np.flatnonzero(gain[np.arange(width), cut] > best + 1e-9):
                        best[k], choice[k] = gain[k, cut[k]], (j, edges[j][cut[k]])
            for k, (j, threshold) in enumerate(choice):
                model.feature[t, first + k], model.threshold[t, first + k] = j, threshold
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.threshold[t][node])
        leaf = node - inner
        model.value[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        margin += model.value[t][leaf]
    return model


def is_held_out(key):
    """Rows that never lend their label: crc32 of the key as text is a multiple of 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Texts and labels of at most ``bound`` labelled rows outside the held-out fifth.

    Rows are the first by a hash of the key, so the choice is the same in every run. The chosen keys
    are at most ``bound`` and so are broadcast. A key with two labels counts as labelled 1 only if all are.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Boosted:
    """Fit on the statistics of the labelled sample (``bound`` rows of 20 numbers reach the driver)."""
    tune(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column(1))
            for i, j, part, own in K.slices(data, offsets):
                x = statistics(part, own)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(list(x), pa.list_(pa.float64())), batch.column(2)[i:j]], names=["doc_id", "x", "label"])

    rows = labelled_rows(docs, labels, bound).mapInArrow(measure, "doc_id long, x array<double>, label int").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if rows.empty:
        return fit_boosted(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit_boosted(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(float))


def text_scores(model: Boosted, column: pa.Array) -> np.ndarray:
    """The score of each text of a column."""
    data, offsets = K.string_buffers(column)
    return np.concatenate([np.zeros(0), *(model.scores(statistics(part, own)) for _, _, part, own in K.slices(data, offsets))])


def classify(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, keep_from: float = KEEP_FROM) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    ``score`` is the probability of label 1 from the text alone; an empty or null text has the score of its
    (zero) statistics. Without labels every row has the score 0.5. Repeated rows repeat; other columns are ignored.
    """
    tune(docs.sparkSession)
    model = train(docs, labels, bound)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = text_scores(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= keep_from).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = spread(texts(docs)).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is predicted to be of label 1; a null text counts as empty, repeated rows repeat."""
    tune(docs.sparkSession)
    model = train(docs, labels, bound)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(text_scores(model, batch.column(at)) >= keep_from))

    return docs.mapInArrow(keep, docs.schema)

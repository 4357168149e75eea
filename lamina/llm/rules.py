"""Quality rules: fixed repetition and length rules plus a hashed n-gram classifier.

The classifier is a logistic regression over hashed word and character n-gram
frequencies, fitted on a bounded sample of labelled rows, with its margin
turned into a probability on rows kept out of the fit (Platt scaling). Scoring
needs no feature matrix: the margin is a mean of hashed weights, so an Arrow
batch is scored with a table look-up per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm import kernels as K
from lamina.llm.common import spread, texts, tune
from lamina.llm.quality import labelled_rows, worded_lines

#: Buckets of each of the two n-gram families (words and word pairs; runs of 3 and of 5 bytes).
BUCKETS = 1024
MAX_TRAIN = 4000
#: Calibrated probability below which a document is rejected.
KEEP_FROM = 0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_GRAM = (np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)) | np.uint32(1)
_SHIFT = 32 - BUCKETS.bit_length() + 1


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, code points in words, symbols, repeated lines and words in repeated 5-word windows of each text."""
    n = len(offsets) - 1
    starts, ends, rows, counts = K.word_spans(data, offsets)
    lead = ((data & 0xC0) != 0x80) & ~K.SPACE[data]
    line_rows, line_hashes = worded_lines(data, offsets)
    dup = np.zeros(n, np.int64)
    if len(line_rows):
        with np.errstate(over="ignore"):
            keyed = K.splitmix(line_hashes + line_rows.astype(np.uint64) * K.WORD_COEFF[9])
        first = np.unique(keyed, return_index=True)[1]
        dup = np.bincount(line_rows, minlength=n) - np.bincount(line_rows[first], minlength=n)
    hashes = K.span_hashes(data, starts, ends)
    return {
        "n_words": counts,
        "word_chars": K.segment_sum(lead.astype(np.int64), offsets),
        "n_symbols": K.segment_sum(SYMBOLS[data].astype(np.int64), offsets),
        "n_dup_lines": dup,
        "n_repeat_words": _repeat_words(hashes, rows, counts),
        "_hashes": hashes,
        "_rows": rows,
    }


def _repeat_words(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, k: int = 5) -> np.ndarray:
    n = len(counts)
    if len(hashes) < k:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        at = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
        window = rows[at].astype(np.uint64) * K.WORD_COEFF[9]
        for j in range(k):
            window = window + hashes[at + j] * K.WORD_COEFF[j]
        window = K.splitmix(window)
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(mark, at[twice], 1)
    np.add.at(mark, at[twice] + k, -1)
    covered = np.cumsum(mark[:-1]) > 0
    return np.bincount(rows[covered], minlength=n)


def grams(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram, one pair of arrays for each family part."""
    out = []
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    out.append(((hashes >> top).astype(np.int64), rows))
    pairs, owner = K.shingle_hashes(hashes, rows, counts, 2)
    out.append(((pairs >> top).astype(np.int64), owner))
    byte_rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = data.astype(np.uint32)
    for k in (3, 5):
        if len(data) < k:
            continue
        with np.errstate(over="ignore"):
            h = wide[: len(data) - k + 1] * _GRAM[0]
            for j in range(1, k):
                h = (h ^ (h >> np.uint32(15))) * _GRAM[j] + wide[j : len(data) - k + 1 + j] * _GRAM[(j + 2) % 5]
        inside = byte_rows[: len(h)] == byte_rows[k - 1 :]
        out.append((BUCKETS + (h[inside] >> np.uint32(_SHIFT)).astype(np.int64), byte_rows[: len(h)][inside]))
    return out


@dataclass
class Linear:
    """Weights by bucket and the calibration ``sigmoid(slope * margin + shift)``."""

    weights: np.ndarray
    slope: float
    shift: float

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def margins(weights: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sum over families of the mean weight of a text's n-grams."""
    total, held = np.zeros((2, n)), np.zeros((2, n))
    for bucket, owner in parts:
        family = int(len(bucket) > 0 and bucket[0] >= BUCKETS)
        total[family] += np.bincount(owner, weights[bucket], n)
        held[family] += np.bincount(owner, minlength=n)
    return (total / np.maximum(held, 1)).sum(axis=0)


def frequencies(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Dense frequency rows, for the bounded training sample only."""
    x = np.zeros((n, 2 * BUCKETS))
    for bucket, owner in parts:
        x += np.bincount(owner * 2 * BUCKETS + bucket, minlength=n * 2 * BUCKETS).reshape(n, 2 * BUCKETS)
    for half in (x[:, :BUCKETS], x[:, BUCKETS:]):
        half /= np.maximum(half.sum(axis=1, keepdims=True), 1)
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> Linear:
    """Logistic regression by accelerated gradient steps on scaled columns, then Platt scaling on ``calibrate`` rows."""
    if len(y) < 10 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Linear(np.zeros(2 * BUCKETS), 1.0, float(np.log(rate / (1 - rate))))
    scale = 1 / (x.std(axis=0) + 1e-5)
    mean = x.mean(axis=0)
    fit = ~calibrate
    z, t = ((x - mean) * scale)[fit], y[fit]
    z /= np.sqrt(z.shape[1])
    w, momentum, bias, bias_momentum = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0
    rate = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w + bias, -40, 40)))
        momentum = 0.9 * momentum - rate * (z.T @ (p - t) / len(t) + ridge * w)
        bias_momentum = 0.9 * bias_momentum - rate * float((p - t).mean())
        w, bias = w + momentum, bias + bias_momentum
    weights = w * scale / np.sqrt(z.shape[1])
    on = calibrate if 0 < y[calibrate].sum() < calibrate.sum() else fit
    margin, t = x[on] @ weights, y[on]
    centre, spread = margin.mean(), margin.std() + 1e-9
    a, b, u = 1.0, 0.0, (margin - margin.mean()) / spread
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -40, 40)))
        g = np.array([((p - t) * u).sum() + 0.1 * a, (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * u * u).sum() + 0.1, (q * u).sum()], [(q * u).sum(), q.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return Linear(weights, float(a / spread), float(b - a * centre / spread))


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Linear:
    """Fit on at most ``bound`` labelled rows (2 x ``BUCKETS`` frequencies each reach the driver)."""
    tune(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column(1))
            for i, j, part, own in K.slices(data, offsets):
                starts, ends, rows, counts = K.word_spans(part, own)
                x = frequencies(grams(part, own, K.span_hashes(part, starts, ends), rows, counts), j - i).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2)[i:j]], names=["doc_id", "x", "label"])

    rows = labelled_rows(docs, labels, bound).mapInArrow(measure, "doc_id long, x binary, label int").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if rows.empty:
        return fit_linear(np.zeros((0, 2 * BUCKETS)), np.zeros(0), np.zeros(0, bool))
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]]).astype(float)
    calibrate = np.arange(len(rows)) % 4 == 0
    return fit_linear(x, rows["label"].to_numpy(float), calibrate)


def verdicts(model: Linear, column: pa.Array, keep_from: float) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of a column's texts: first and last row, base counts, whether a base rule fails, score, and verdict."""
    data, offsets = K.string_buffers(column)
    for i, j, part, own in K.slices(data, offsets):
        base = base_counts(part, own)
        failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
        value = model.scores(margins(model.weights, grams(part, own, base["_hashes"], base["_rows"], base["n_words"]), j - i))
        yield i, j, base, failed, value, ~failed & (value >= keep_from)


def judge(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts and verdict for every whole text.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``. A null text
    has no words and fails the base rules; repeated rows repeat; other columns are ignored. Without labels the
    score is 0.5 and only the base rules reject.
    """
    tune(docs.sparkSession)
    model = train(docs, labels, bound)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, base, failed, value, kept in verdicts(model, batch.column(1), keep_from):
                arrays = [pa.array(base[k].astype(np.int64)) for k in names]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *arrays, pa.array(failed), pa.array(value), pa.array(kept)], names=["doc_id", *names, "base_failed", "score", "kept"])

    return spread(texts(docs)).mapInArrow(score, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, score double, kept boolean")


def keep_passing(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` (all columns) that pass the base rules and the classifier; a null text has no words, repeated rows repeat."""
    tune(docs.sparkSession)
    model = train(docs, labels, bound)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.zeros(0, bool), *(own for *_, own in verdicts(model, batch.column(place), keep_from))]
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, docs.schema)

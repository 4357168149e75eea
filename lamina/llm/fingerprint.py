"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint is the ``k`` least distinct 48-bit shingle hashes, base64 of six
bytes each in rising order. Sketches of parts merge by keeping the least of
their union, and estimate resemblance, containment and the distinct count.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import even_borders, partitions, sampled, texts, tune
from lamina.llm.neardup import shingle_sets

SIZE = 128
WIDTH = 6
SPAN = float(1 << 48)
#: Rows without a key stand behind all others.
NO_KEY = -(2**63)
#: Rows drawn for the borders of ranges; they steer balance only.
BORDER_SAMPLE = 5000


def least(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of sorted distinct 64-bit hashes: the least ``size`` of their top 48 bits."""
    top = hashes >> np.uint64(16)
    if len(top) > 1:
        top = top[np.concatenate(([True], top[1:] != top[:-1]))]
    return top[:size]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, WIDTH)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the union of two parts."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of the union that is common; 1 for two empty sets."""
    union = merge(a, b, size)
    if not len(union):
        return 1.0
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def distinct_count(sketch: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    return float(len(sketch)) if len(sketch) < size else (size - 1) * SPAN / float(sketch[-1])


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of ``a`` that is also in ``b``; 1 for an empty ``a``."""
    own = distinct_count(a, size)
    return 1.0 if not own else min(1.0, resemblance(a, b, size) * distinct_count(merge(a, b, size), size) / own)


def sketches(values: list[str], k: int, size: int) -> list[np.ndarray]:
    data, offsets = K.string_buffers(pa.array(values, pa.large_string()))
    return [least(s, size) for _, _, part, own in K.slices(data, offsets) for s in shingle_sets(part, own, k)]


def fingerprints(docs: DataFrame, k: int = 5, size: int = SIZE) -> DataFrame:
    """``doc_id, fingerprint, n_distinct`` (estimated distinct shingles) of every whole text; null reads as empty."""
    tune(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.string_buffers(batch.column(1))
            for i, j, part, own in K.slices(data, offsets):
                found = [least(s, size) for s in shingle_sets(part, own, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([encode(s) for s in found], pa.string()), pa.array([distinct_count(s, size) for s in found], pa.float64())], names=["doc_id", "fingerprint", "n_distinct"])

    return texts(docs).mapInArrow(sketch, "doc_id long, fingerprint string, n_distinct double")


def merged(parts: DataFrame, by: list[str], fingerprint: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """One fingerprint for each group of part fingerprints; a null part counts as empty.

    Only the least ``size`` hashes of a group survive the partial rank before the shuffle, so a hot group stays small.
    """
    raw = F.unbase64(F.coalesce(F.col(fingerprint), F.lit("")))
    n = (F.length(raw) / WIDTH).cast("int")
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.hex(F.substring(raw, i * WIDTH + 1, F.lit(WIDTH)))))
    each = parts.select(*by, F.explode_outer(hashes).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last()))
    kept = each.withColumn("_r", rank).where(F.col("_r") <= size)
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("_h")), lambda h: h))
    return kept.groupBy(*by).agg(F.base64(F.unhex(joined)).alias("_f")).select(*by, F.regexp_replace("_f", r"\s", "").alias("fingerprint"))


NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with its last half (in code points, rounded down) replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def against_next(docs: DataFrame, k: int = 5, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are to each other and to the next text's.

    "Next" is the following row in descending key order; after the last comes the first. Rows of one key are
    ordered by text, rows with a null key come last. A single row is its own next. The rows are cut into ranges of
    the key; the first row of each range is also sent to the range before it, so texts are shuffled once.
    """
    spark = docs.sparkSession
    tune(spark)
    source = texts(docs)
    n_ranges = partitions(spark)
    order = F.coalesce(F.col("doc_id"), F.lit(NO_KEY)).alias("o")
    borders = even_borders(sampled(source.select(order), BORDER_SAMPLE, "o"), "o", n_ranges)
    keyed = source.select("doc_id", "text", order)
    heads = keyed.select("o").mapInArrow(lambda b: _heads(b, borders), "part int, head long").groupBy("part").agg(F.max("head").alias("head"))
    opening = {r["part"]: r["head"] for r in heads.collect()}  # one row for each range
    placed = keyed.mapInArrow(lambda b: _placed(b, borders, opening), "doc_id long, text string, part int, ghost boolean")
    ordered = placed.repartitionById(n_ranges, F.col("part")).sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(lambda b: _compare(b, k, size), NEXT)


def _part(keys: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Range 0 holds the largest keys; a key equal to a border opens the range after it."""
    return (len(borders) - np.searchsorted(borders, keys, "left")).astype(np.int32)


def _heads(batches: Iterator[pa.RecordBatch], borders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The largest key of each range in a task's rows."""
    most = np.full(len(borders) + 1, np.iinfo(np.int64).min)
    seen = np.zeros(len(borders) + 1, bool)
    for batch in batches:
        keys = batch.column(0).to_numpy()
        part = _part(keys, borders)
        np.maximum.at(most, part, keys)
        seen[part] = True
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(most[at])], names=["part", "head"])


def _placed(batches: Iterator[pa.RecordBatch], borders: np.ndarray, opening: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows with their range, and once more, as ghosts, the rows that open a range for the range before it."""
    used = sorted(opening)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    for batch in batches:
        keys = batch.column(2).to_numpy()
        part = _part(keys, borders)
        ghosts = [i for i, p in enumerate(part.tolist()) if keys[i] == opening[p]]
        take = pa.array(np.concatenate((np.arange(len(keys)), np.array(ghosts, np.int64))))
        parts = np.concatenate((part, np.array([before[int(part[i])] for i in ghosts], np.int32)))
        ghost = np.arange(len(parts)) >= len(keys)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(parts), pa.array(ghost)], names=["doc_id", "text", "part", "ghost"])


def _compare(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows come by range, ghosts (the opening row of the next range) after the range's own rows."""
    waiting: tuple | None = None
    rows: list[tuple] = []
    held = 0

    def emit() -> pa.RecordBatch:
        changed = [edited(r[1], r[3]) for r in rows]
        found = sketches(changed, k, size)
        out = []
        for (doc_id, text, mine, _, other), new, new_sketch in zip(rows, changed, found):
            out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), encode(mine), encode(new_sketch), resemblance(mine, new_sketch, size), resemblance(mine, other, size)))
        rows.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in NEXT.split(", ")])

    for batch in batches:
        data, offsets = K.string_buffers(batch.column(1))
        found = [least(s, size) for _, _, part, own in K.slices(data, offsets) for s in shingle_sets(part, own, k)]
        for doc_id, text, part, ghost, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), found):
            if waiting is not None and waiting[3] == part:
                rows.append((*waiting[:3], text, sketch))
                held += len(waiting[1]) + len(text)
            waiting = None if ghost else (doc_id, text, sketch, part)
            if held > 1 << 20:
                yield emit()
                held = 0
    if rows:
        yield emit()

"""Packing token sequences along a Hilbert curve.

Every document gets a low-dimensional vector by signed hashing of its words;
its cell on a Hilbert curve is the sort key, so documents of like vocabulary
end up side by side. Documents are range-partitioned by that key, sorted, and
their token ids are laid end to end and cut every 1,024 ids. The last, partly
filled sequence of a range is cut into power-of-two lengths, which need no
padding. One pass over the text plus one shuffle of it; memory holds one
document and one open sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import even_borders, partitions, sampled, texts, tune
from lamina.llm.tokens import id_encoder, tokenizer_path

DIMENSIONS = 4
BITS = 12
#: Rows sampled for the range borders; they steer balance only, never the result's completeness.
BORDER_SAMPLE = 5000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows), in ``bits`` bits a dimension.

    Works on the transposed bit planes: undo the excess rotations from the top plane down, Gray-decode, interleave.
    """
    x = points.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for i in range(d):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flips ^= np.where((x[d - 1] & bit) != 0, bit - one, np.uint64(0))
    x ^= flips
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of the hashed document vectors of a slice; an empty text sits at the middle of the cube."""
    starts, ends, _, counts = K.word_spans(data, offsets)
    hashes = K.span_hashes(data, starts, ends)
    ranges = np.concatenate(([0], np.cumsum(counts)))
    span = 1 << BITS
    points = np.empty((len(counts), DIMENSIONS), np.int64)
    for i in range(DIMENSIONS):
        sign = ((hashes >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * 2 - 1
        mean = K.segment_sum(sign, ranges) / np.maximum(counts, 1)
        points[:, i] = np.clip((np.tanh(3 * mean) + 1) / 2 * span, 0, span - 1).astype(np.int64)
    return hilbert_index(points)


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Lays documents end to end in sequences of ``size`` ids; sequence ids count up from ``first``."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence, self.filled = size, first, 0
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at, total = 0, len(ids)
        while at < total:
            take = min(total - at, self.size - self.filled)
            self.open.append((doc_id, at, ids[at : at + take], total))
            at, self.filled = at + take, self.filled + take
            if self.filled == self.size:
                yield from self._close([self.size])

    def finish(self) -> Iterator[tuple]:
        if self.filled:
            yield from self._close(powers_of_two(self.filled))

    def _close(self, lengths: list[int]) -> Iterator[tuple]:
        lengths = iter(lengths)
        room, offset = next(lengths), 0
        for doc_id, start, ids, total in self.open:
            at = 0
            while at < len(ids):
                if offset == room:
                    room, offset = next(lengths), 0
                    self.sequence += 1
                part = ids[at : at + room - offset]
                yield doc_id, start + at, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, offset
                at, offset = at + len(part), offset + len(part)
        self.sequence += 1
        self.open, self.filled = [], 0


def _keyed(batches: Iterator[pa.RecordBatch], borders: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column(1))
        keys = [curve_keys(part, own) for _, _, part, own in K.slices(data, offsets)]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
        # equal keys (copies, hot vocabularies) are split between ranges by the hash of their row key
        place = (key << 12) | (K.splitmix(ids) & np.uint64(4095)).astype(np.int64)
        if borders is None:
            yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])
        else:
            part = np.searchsorted(borders, place, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place), pa.array(part)], names=["doc_id", "text", "place", "part"])


def pack(docs: DataFrame, size: int = 1024, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", end_id: int = 0, locate: Callable[[str], str] = tokenizer_path) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document is its ids followed by ``end_id``; a null or empty text is that one id. Repeated rows are packed
    as often as they occur; a null key is kept; other columns are ignored. An empty table gives no piece.
    Sequence ids are ``range << 40 | position``; they and the pieces depend on the rows and the number of ranges alone.
    """
    spark = docs.sparkSession
    tune(spark)
    source = texts(docs)
    n_ranges = partitions(spark)
    drawn = sampled(source, BORDER_SAMPLE, "doc_id", "text").mapInArrow(lambda b: _keyed(b, None), "place long")
    borders = even_borders(drawn, "place", n_ranges)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(locate(tokenizer), locate(ranks))
        packer, part, rows = None, None, []
        last = np.array([end_id], np.uint32)
        for batch in batches:
            parts = batch.column(2).to_pylist()
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), parts):
                if own != part:
                    rows += packer.finish() if packer else ()
                    packer, part = Packer(size, own << 40), own
                rows += packer.add(doc_id, np.concatenate((encoder.ids(text.as_py()), last)))
            if len(rows) >= 2000:
                yield _piece_batch(rows)
                rows = []
        rows += packer.finish() if packer else ()
        if rows:
            yield _piece_batch(rows)

    keyed = source.mapInArrow(lambda b: _keyed(b, borders), "doc_id long, text string, place long, part int")
    ordered = keyed.repartitionById(n_ranges, F.col("part")).sortWithinPartitions("part", "place", "doc_id", F.xxhash64("text"))
    return ordered.select("doc_id", "text", "part").mapInArrow(lay, PIECES)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

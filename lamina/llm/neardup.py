"""Near-duplicate grouping with an LSH forest over MinHash signatures.

Texts with equal shingle sets collapse into one class first (an aggregation, so
thousands of copies cost one row each). Every class has 16 signature orders; the
table of all (order, signature) rows is range-sorted, and rows with an equal
prefix of three minima form a *run*.

Groups are united first: each row is paired with the first row of its run, or
the row before it, and each document's best and least partner are confirmed.
Then only runs in which several components are left go on, and only pairs of
different components are looked at, so no group is expanded into its pairs.
In a short run all such pairs are looked at, and those that sizes and parity maps
do not rule out (a map differs in no more bits than the sets in shingles) are
candidates. A run longer than the reach is *crowded*: neighbours by longest common
prefix are looked at, and its rows go one level deeper, into four runs of the same rows that share four
minima more. So the depth adapts to the region: a pair at the threshold meets in
a deeper run with probability 0.88 a level, rows that are less alike thin out.
Runs that are still crowded at the last level are compared pair by pair.

Candidates are confirmed on full shingle sets recomputed from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import fresh, materialise, membership, partitions, passes, release, slot, spread, texts, tune
from lamina.llm.components import components, extend

TREES = 16
#: Levels of one order, each 16 bits of one MinHash value.
LEVELS = 6
#: Shortest common prefix (levels) of a candidate: at similarity 0.8 an order shows it with probability 0.51.
MIN_LEVELS = 3
#: Rows looked at on either side in an order; longer runs are crowded.
REACH = 1024
HASHES = TREES * LEVELS
#: Equal 2-bit minima of 96 below which a pair is 5 standard deviations under similarity 0.8.
MIN_EQUAL = 64
#: Times that groups are united by one pair a row before all candidates are looked at.
LEAD_ROUNDS = 2
#: Runs that a crowded run splits into, minima that each shares beyond it, and minima that sort within.
BRANCHES, DEEPER, FURTHER = 4, 4, 3
CHILD_PREFIX = 8 + 2 * DEEPER
CHILD_KEY = CHILD_PREFIX + 2 * FURTHER
#: The level that is compared pair by pair; rows of one of its runs share 15 minima.
MAX_LEVEL = 3
KEY = 1 + 2 * LEVELS
SKETCH = HASHES // 4
#: Bits of the parity map: each shingle turns one over, so two maps differ in no more bits than the sets in shingles.
PARITY = 1024
_SEED = K.stream(41, HASHES).astype(np.uint32)
_MULT = K.stream(43, HASHES).astype(np.uint32) | np.uint32(1)
_PAIRS_SET = np.array([sum((v >> (2 * i)) & 1 for i in range(4)) for v in range(256)], np.uint8)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 96 MinHash values of a set of shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        y = (x[i : i + 1024, None] ^ _SEED) * _MULT
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(axis=0), out=out)
    return out


def signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """Keys of all orders (order number, then levels, big-endian) and the sketch of 2 bits a minimum."""
    mixed = K.splitmix(minima(shingles).astype(np.uint64) + K.stream(47, HASHES))
    keys = np.zeros((TREES, KEY), np.uint8)
    keys[:, 0] = np.arange(TREES)
    keys[:, 1:] = (mixed >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(TREES, 2 * LEVELS)
    two = (mixed & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return keys.tobytes(), (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def parity(shingles: np.ndarray) -> bytes:
    """The parity map of a set of shingle hashes."""
    turned = np.bincount(((shingles >> np.uint64(20)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(turned.astype(np.uint8)).tobytes()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice, A-Z lower-cased."""
    lower = K.ascii_lower(data)
    starts, ends, rows, counts = K.word_spans(lower, offsets)
    values, owner = K.shingle_hashes(K.span_hashes(lower, starts, ends), rows, counts, k)
    return K.distinct_sorted(values, K.row_ranges(owner, len(counts)))


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column(1))
        for i, j, part, own in K.slices(data, offsets):
            n, one, two, keys, sketches, maps = [], [], [], [], [], []
            for values in shingle_sets(part, own, k):
                n.append(len(values))
                one.append(int(np.sum(K.splitmix(values)).astype(np.int64)) if len(values) else None)
                two.append(int(np.sum(K.splitmix(values ^ K.WORD_COEFF[7])).astype(np.int64)) if len(values) else None)
                key, sketch = signature(values) if len(values) else (None, None)
                keys.append(key)
                sketches.append(sketch)
                maps.append(parity(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(maps, pa.binary())],
                names=["doc_id", "n_shingles", "set1", "set2", "keys", "sketch", "parity"],
            )


SIGNED = "doc_id long, n_shingles long, set1 long, set2 long, keys binary, sketch binary, parity binary"
FOUND = "kind int, a long, b long, equal int, key binary, n long, sketch binary, c long"
PAIR, ROW, EDGE = 0, 1, 2
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(rows: Rows, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the row pairs (x, y) are of different components and seem to reach the similarity, and their equal minima (by sketches)."""
    _, ids, n, sketch, c = rows
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    differ = sketch[x] ^ sketch[y]
    equal = HASHES - _PAIRS_SET[(differ | differ >> 1) & 0x55].sum(axis=1, dtype=np.int64)
    return (100 * small >= percent * large) & (ids[x] != ids[y]) & (c[x] != c[y]) & (equal >= MIN_EQUAL), equal


def _possible(rows: Rows, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the row pairs (x, y) are of different components and can reach the similarity: by sizes and parity maps, none too few."""
    _, ids, n, maps, c = rows
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    good = np.flatnonzero((100 * small >= percent * large) & (c[x] != c[y]) & (ids[x] != ids[y]))
    words = maps.view(np.uint64)
    differ = np.bitwise_count(words[x[good]] ^ words[y[good]]).sum(axis=1, dtype=np.int64)
    return good[(100 + percent) * differ <= (100 - percent) * (n[x[good]] + n[y[good]])]


def _pairs(rows: Rows, x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
    ids = rows[1]
    return np.stack((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), equal))


def _found(pairs: list[np.ndarray], rows: Rows | None = None, kind: int = ROW) -> pa.RecordBatch:
    p = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int64)
    m, r = p.shape[1], 0 if rows is None else len(rows[1])
    blank = [None] * m
    long = lambda own, more: pa.array([*own, *more], pa.int64())
    key, ids, n, sketch, c = rows or ((), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([PAIR] * m + [kind] * r, pa.int32()), long(p[0].tolist(), ids), long(p[1].tolist(), [None] * r), pa.array([*p[2].tolist(), *[None] * r], pa.int32()),
            pa.array([*blank, *(k.tobytes() for k in key)], pa.binary()), long(blank, n), pa.array([*blank, *(s.tobytes() for s in sketch)], pa.binary()), long(blank, c),
        ],
        names=[x.split()[0] for x in FOUND.split(", ")],
    )


def _blocks(batches: Iterator[pa.RecordBatch], width: int, marks: int) -> Iterator[Rows]:
    """Sorted rows in blocks of some 16,000: key, id, size, sketch or parity map of ``marks`` bytes, component."""
    waiting: list[pa.RecordBatch] = []

    def rows() -> Rows:
        table = pa.Table.from_batches(waiting)
        waiting.clear()
        return _fixed(table.column(0), width), table.column(1).to_numpy(), table.column(2).to_numpy(), _fixed(table.column(3), marks), table.column(4).to_numpy()

    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= 16384:
            yield rows()
            size = 0
    if size:
        yield rows()


def _lead(batches: Iterator[pa.RecordBatch], width: int, prefix: int, percent: int) -> Iterator[pa.RecordBatch]:
    """One pair a row: with the first row of its run (equal prefixes), else with the row before it; and all rows of runs of two and more."""
    held: Rows | None = None  # the first row of the open run and the last row
    for new in _blocks(batches, width, SKETCH):
        rows = new if held is None else tuple(np.concatenate((h, x)) for h, x in zip(held, new))
        old = 0 if held is None else len(held[1])
        m = len(rows[1])
        same = np.zeros(m, bool)
        same[1:] = (rows[0][1:, :prefix] == rows[0][:-1, :prefix]).all(axis=1)
        at = np.arange(m)
        start = np.maximum.accumulate(np.where(same, 0, at))
        later = at[old:][same[old:]]
        good, equal = _alike(rows, later, start[later], percent)
        pairs = [_pairs(rows, later[good], start[later[good]], equal[good])]
        rest = later[~good & (start[later] != later - 1)]
        good, equal = _alike(rows, rest, rest - 1, percent)
        pairs.append(_pairs(rows, rest[good], rest[good] - 1, equal[good]))
        # the last row waits for the next block; the first of a range may continue a run of the range before
        joined = same.copy()
        joined[:-1] |= same[1:]
        joined[0] |= held is None
        if old == 2:
            joined[0] = False  # the open run's first row went out before
        keep = np.flatnonzero(joined[:-1])
        yield _found(pairs, tuple(x[keep] for x in rows))
        first = start[-1]
        held = tuple(x[[first, m - 1]] if first < m - 1 else x[-1:] for x in rows)
    if held is not None:
        yield _found([], tuple(x[-1:] for x in held))


def _adjacent(rows: Rows, prefix: int, fresh_from: int, percent: int, reach: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pairs within ``reach`` of each other in a run whose later row is at or after ``fresh_from``; rows whose run goes on beyond; where each row's run begins."""
    key, found, m = rows[0], [], len(rows[1])
    same = np.zeros(m, bool)
    same[1:] = (key[1:, :prefix] == key[:-1, :prefix]).all(axis=1)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(m)))
    crowded = np.zeros(m, bool)
    later = np.arange(fresh_from, m)
    for step in range(1, reach + 2):
        later = later[later - start[later] >= step]
        if not len(later):
            break
        if step > reach:
            crowded[later] = crowded[later - step] = True
            break
        at = later[_possible(rows, later, later - step, percent)]
        if len(at):
            found.append(_pairs(rows, at, at - step, np.zeros(len(at), np.int64)))
    return found, np.flatnonzero(crowded), start


def _scan(batches: Iterator[pa.RecordBatch], width: int, prefix: int, percent: int, reach: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different components near each other in one sorted range, and rows of crowded runs.

    With ``edges`` also the rows at the range's ends whose run may go on in the range before or after, ``reach`` + 1 at most.
    """
    held: Rows | None = None
    head: list[Rows] = []
    first_run_open = True
    for new in _blocks(batches, width, PARITY // 8):
        rows = new if held is None else tuple(np.concatenate((h, x)) for h, x in zip(held, new))
        old = 0 if held is None else len(held[1])
        pairs, crowded, start = _adjacent(rows, prefix, old, percent, reach)
        if edges and first_run_open and sum(len(h[1]) for h in head) <= reach:
            opening = new[0][:, :prefix]
            stays = (opening == (head[0][0][0, :prefix] if head else opening[0])).all(axis=1)
            n = int(np.argmin(stays)) if not stays.all() else len(stays)
            first_run_open = n == len(stays)
            if n:
                head.append(tuple(x[:n][: reach + 1] for x in new))
        held = tuple(x[max(int(start[-1]), len(x) - reach - 1) :] for x in rows)
        yield _found(pairs, tuple(x[crowded] for x in rows))
    if edges and held is not None:
        for part in head:
            yield _found([], part, EDGE)
        if not first_run_open or sum(len(h[1]) for h in head) > reach:  # else all rows are of one short run and are out
            yield _found([], held, EDGE)


ENTRY = "key", "doc_id", "n", "sketch", "c"


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select(*ENTRY).repartitionByRange(partitions(rows.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id")


def _entries(found: DataFrame) -> DataFrame:
    return found.select("key", F.col("a").alias("doc_id"), "n", "sketch", "c")


def forest(classes: DataFrame) -> DataFrame:
    """A row for each class and signature order."""
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda i: F.substring(F.col("keys"), i * KEY + 1, F.lit(KEY))))
    return classes.select(each.alias("key"), F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n"), "sketch", F.col("rep").alias("c"))


def candidates(rows: DataFrame, width: int, prefix: int, percent: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a < b`` of different components in short runs or near each other in long ones, and the rows of the long runs."""
    raw = materialise(_sorted(rows).mapInArrow(lambda b: _scan(b, width, prefix, percent, reach, True), FOUND))
    # the seams: the runs that reach a range's ends, in one sorted run; mostly a few rows a range
    seams = _entries(raw.where(F.col("kind") == EDGE)).distinct()
    ends = materialise(seams.repartition(1).sortWithinPartitions("key", "doc_id").mapInArrow(lambda b: _scan(b, width, prefix, percent, reach, False), FOUND))
    both = raw.union(ends)
    pairs = materialise(both.where(F.col("kind") == PAIR).select("a", "b").distinct())
    crowded = materialise(_entries(both.where(F.col("kind") == ROW)).distinct())
    release(raw, ends)
    return pairs, crowded


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the component that their document has by now."""
    now = found.select(F.col("v").alias("doc_id"), F.col("c").alias("_c"))
    return rows.join(now, "doc_id", "left").select("key", "doc_id", "n", "sketch", F.coalesce("_c", "c").alias("c"))


def mixed(rows: DataFrame, prefix: int) -> DataFrame:
    """The rows of runs in which more than one component is left."""
    run = F.substring("key", 1, prefix)
    several = rows.groupBy(run.alias("_run")).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("_run")
    return rows.withColumn("_run", run).join(several, "_run", "left_semi").drop("_run")


def _children(batches: Iterator[pa.RecordBatch], level: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Rows of crowded runs, each under ``BRANCHES`` keys of that run with further minima."""
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        runs = np.frombuffer(b"".join(k[:prefix] for k in batch.column(0).to_pylist()), np.uint8)
        at = np.arange(m) * prefix
        run = K.span_hashes(runs, at, at + prefix)
        levels = _fixed(batch.column(5), TREES * KEY).reshape(m, TREES, KEY)[:, :, 1:].reshape(m, HASHES, 2)
        out = np.zeros((BRANCHES, m, CHILD_KEY), np.uint8)
        for branch in range(BRANCHES):
            own = K.splitmix(run ^ K.WORD_COEFF[branch])
            out[branch, :, :8] = own.astype(">u8").view(np.uint8).reshape(m, 8)
            chosen = K.stream(101 + level * BRANCHES + branch, HASHES).argsort()[: (CHILD_KEY - 8) // 2]
            out[branch, :, 8:] = levels[:, chosen].reshape(m, -1)
        take = pa.array(np.tile(np.arange(m), BRANCHES))
        keys = pa.array([k.tobytes() for k in out.reshape(-1, CHILD_KEY)], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, *(batch.column(i).take(take) for i in range(1, 5))], names=list(ENTRY))


def deeper(rows: DataFrame, classes: DataFrame, level: int, prefix: int) -> DataFrame:
    """The next level below crowded runs: a run splits into several, each sharing ``DEEPER`` minima more."""
    minima_of = classes.select(F.col("rep").alias("doc_id"), "keys")
    wide = rows.join(minima_of, "doc_id").select(*ENTRY, "keys")
    return wide.mapInArrow(lambda b: _children(b, level, prefix), "key binary, doc_id long, n long, sketch binary, c long")


def _packed(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The texts whose key's bit is set, compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        hit = np.flatnonzero(passes(words, batch.column(2).to_numpy()))
        if len(hit):
            take = pa.array(hit)
            texts_ = batch.column(1).take(take).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([press.compress(t.encode()) for t in texts_], pa.binary())], names=["doc_id", "packed"])


def confirm(pairs: DataFrame, source: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach ``percent`` of similarity.

    A filter of fixed size keeps most texts that no pair needs out of the shuffle; the others travel compressed.
    """
    words = membership(pairs.select(F.explode(F.array("a", "b")).alias("d")), "d")
    needed = source.select("doc_id", "text", slot(F.col("doc_id")).alias("at")).mapInArrow(lambda b: _packed(b, words), "doc_id long, packed binary")
    needed = materialise(needed)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            left, left_at = K.string_buffers(pa.array([unpress.decompress(x) for x in batch.column(2).to_pylist()], pa.large_binary()).cast(pa.large_string()))
            right, right_at = K.string_buffers(pa.array([unpress.decompress(x) for x in batch.column(3).to_pylist()], pa.large_binary()).cast(pa.large_string()))
            keep = []
            for i, j, part, own in K.slices(left, left_at):
                first = shingle_sets(part, own, k)
                for m, n, part_2, own_2 in K.slices(right[right_at[i] : right_at[j]], right_at[i : j + 1] - right_at[i]):
                    for at, other in zip(range(i + m, i + n), shingle_sets(part_2, own_2, k)):
                        mine = first[at - i]
                        both = len(mine) + len(other)
                        merged = np.sort(np.concatenate((mine, other)))
                        shared = int((merged[1:] == merged[:-1]).sum())
                        if both and 100 * shared >= percent * (both - shared):
                            keep.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    with_a = pairs.select("a", "b").join(needed.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a")), "a")
    with_b = with_a.join(needed.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b")), "b")
    links = materialise(with_b.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))
    release(needed)
    return links


def _chosen(pairs: DataFrame) -> DataFrame:
    """For each component its most alike partner, and its partner of least id: enough to unite most of a group."""
    sides = pairs.select(F.col("ca").alias("d"), F.col("a"), F.col("b"), "equal", F.col("b").alias("o")).union(pairs.select("cb", "a", "b", "equal", "a"))
    best = sides.groupBy("d").agg(F.max(F.struct("equal", -F.col("o"), "a", "b")).alias("x"), F.min(F.struct("o", "a", "b")).alias("y"))
    return best.select(F.inline(F.array(F.struct("x.a", "x.b"), F.struct("y.a", "y.b")))).distinct()


def linked(classes: DataFrame, source: DataFrame, k: int, percent: int, reach: int) -> DataFrame:
    """``v, c`` of the classes that have a link: the least representative that each reaches."""
    prefix = 1 + 2 * MIN_LEVELS
    rows, found = forest(classes), None
    for _ in range(LEAD_ROUNDS):
        given = rows if found is None else mixed(labelled(rows, found), prefix)
        raw = materialise(_sorted(given).mapInArrow(lambda b: _lead(b, KEY, prefix, percent), FOUND))
        survivors = materialise(_entries(raw.where(F.col("kind") == ROW)))
        pairs = raw.where(F.col("kind") == PAIR).select("a", "b", "equal", F.col("a").alias("ca"), F.col("b").alias("cb"))
        if found is not None:
            at_a, at_b = (found.select(F.col("v").alias(x), F.col("c").alias(f"_{x}")) for x in "ab")
            pairs = pairs.drop("ca", "cb").join(at_a, "a", "left").join(at_b, "b", "left").select("a", "b", "equal", F.coalesce("_a", "a").alias("ca"), F.coalesce("_b", "b").alias("cb"))
        chosen = materialise(_chosen(pairs))
        links = confirm(chosen, source, k, percent)
        found = components(links) if found is None else extend(found, links)
        release(raw, chosen, links, rows)
        rows = survivors
    width = KEY
    level = 0
    while True:
        open_rows = mixed(labelled(rows, found), prefix)
        if not level:  # from here on rows bear the parity map in place of the sketch
            maps = classes.select(F.col("rep").alias("doc_id"), "parity")
            open_rows = open_rows.drop("sketch").join(maps, "doc_id").withColumnRenamed("parity", "sketch").select(*ENTRY)
        open_rows = materialise(open_rows)
        release(rows)
        if open_rows.isEmpty():
            release(open_rows)
            return found
        if level == MAX_LEVEL:
            pairs, rows = within(open_rows, prefix, percent), None
        else:
            pairs, rows = candidates(open_rows, width, prefix, percent, reach)
        links = confirm(pairs, source, k, percent)
        if not links.isEmpty():
            found = extend(found, links)
        release(open_rows, pairs, links)
        if rows is None or rows.isEmpty():
            return found
        crowded = materialise(mixed(labelled(rows, found), prefix))
        release(rows)
        rows = materialise(deeper(crowded, classes, level, prefix))
        release(crowded)
        width, prefix, level = CHILD_KEY, CHILD_PREFIX, level + 1


def within(rows: DataFrame, prefix: int, percent: int) -> DataFrame:
    """All pairs ``a < b`` of different components in a run: what is left where runs stay long at the last level."""
    bare = rows.select(F.substring("key", 1, prefix).alias("run"), "doc_id", "n", "c")
    x, y = bare.alias("x"), bare.alias("y")
    close = (F.col("x.run") == F.col("y.run")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.c") != F.col("y.c")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    return materialise(x.join(y, close).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, reach: int = REACH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Links have ``100 * |A and B| >= percent * |A or B|`` over distinct ``k``-word shingles (fewer words: the whole
    sequence). A text without words, or null, has no shingle and stands alone. A row with a null key is kept with
    a null component. Repeated rows share their component; of several texts under one key the least stands for
    the key where links are confirmed. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    source = texts(docs)
    signed = materialise(spread(source).mapInArrow(lambda b: _sign(b, k), SIGNED))
    sets = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # equal sets have equal signatures, so any row's stand for the class
    classes = materialise(sets.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")))
    keyed = source.where("doc_id is not null")
    if _repeats(signed):
        keyed = keyed.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = linked(classes, keyed, k, percent, reach)
    members = classes.select("set1", "set2", "n_shingles", "rep").join(found, F.col("rep") == F.col("v"), "left").select("set1", "set2", "n_shingles", F.coalesce("c", "rep").alias("c"))
    joined = signed.select("doc_id", "n_shingles", "set1", "set2").join(members, ["set1", "set2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _repeats(signed: DataFrame) -> bool:
    """Whether a key occurs twice; only then the texts need a dedup by key before confirmation."""
    return not signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their group.

    Of rows that repeat a key the one with the least text is kept (then the one whose row has the least hash). Rows
    with a null key all stay, and so does one row of each text without words.
    """
    verdicts = materialise(near_duplicates(docs, k, percent).where("doc_id is not null"))
    (own,) = fresh(docs, "_own")
    key = docs["doc_id"].cast("long")
    standing = verdicts.groupBy(F.col("doc_id").alias(own)).agg(F.bool_or("kept").alias("kept"))
    dropped = materialise(standing.where("not kept").select(own))
    words = membership(dropped, own)

    @F.pandas_udf("boolean")
    def in_question(at: pd.Series) -> pd.Series:
        return pd.Series(passes(words, at.to_numpy()))

    # most rows are not in question and stay where they are
    test = in_question(slot(key))
    keyed = docs.where(docs["doc_id"].isNotNull())
    named = keyed.where(~test).unionByName(keyed.where(test).join(dropped, key == F.col(own), "left_anti"))
    if not verdicts.groupBy("doc_id").count().where("count > 1").isEmpty():
        whole = F.struct(*[named[c] for c in named.columns])
        named = named.groupBy(named["doc_id"].cast("long").alias(own)).agg(F.min_by(whole, F.struct(named["text"], F.xxhash64(F.to_json(whole)))).alias("row")).select("row.*")
    return named.unionByName(docs.where("doc_id is null"))

"""Substring deduplication with content-defined chunks.

A gear rolling hash over the last 16 bytes is taken at every word start; a word
begins a chunk where its hash is the least among the words near it, so borders
depend on the text around them alone, come back in step a few words after an
insertion, and chunks are of about seven words. Where no ASCII white space is
near, characters chosen by the hash stand in for word starts, and no chunk is
longer than ``LONGEST``, so texts without such spaces have chunks too.

Short stock phrases repeat by chance, so no chunk is compared by itself: windows
of whole chunks of at least ``MIN_RUN`` bytes are, the shortest from each chunk on
and the shortest up to each. The first holder of a window (least key, then place)
keeps it. Windows of one text that follow one earlier place in step are one span;
it is compared with that place byte by byte, and grows to both sides as far as
the bytes agree. The spans are cut. So every byte cut is part of a copy of at
least that length of one earlier place.

Digests reach the driver only as a filter of fixed size, which keeps windows and
texts without a partner out of the joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import FILTER_BITS, bits, fresh, materialise, membership, passes, release, slot, texts, tune

GEAR = (K.stream(61, 256) & np.uint64(0xFFFF)).astype(np.uint16)
#: A word start is a border when its hash is the least of those of so many words before and after it.
NEAR = 3
#: Without ASCII white space in the last FAR bytes, a character counts as a word start when so many top bits are 0: one in four.
FAR, FAR_BITS = 32, 2
#: Bytes after which a chunk ends at the next character, border or not.
LONGEST = 512
#: Bytes that one earlier place must hold in a row to make a passage.
MIN_RUN = 100
#: Digests with more than 1/HOT_SHARE of all repeated windows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 4096
NO_KEY = 2**63 - 1
WINDOWS = "d long, key long, at int, size int, digest long"


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk starts of a slice, each row's start included; every start is at a character's first byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint16(step)
        h = wider
    starts = offsets[:-1]
    space = K.SPACE[data]
    lead = (data & 0xC0) != 0x80
    word = np.zeros(n, bool)
    word[1:] = space[:-1] & ~space[1:]
    spaces = np.zeros(n + 1, np.int32)
    np.cumsum(space, out=spaces[1:])
    far = np.zeros(n, bool)
    if n > FAR:
        far[FAR:] = (spaces[FAR:n] == spaces[: n - FAR]) & lead[FAR:] & (h[FAR - 1 : -1] >> np.uint16(16 - FAR_BITS) == 0)
        early = (starts[:, None] + np.arange(1, FAR)).ravel()
        far[early[early < n]] = False
    # hashes that reach back over a row's start would depend on the row before it
    early = (starts[:, None] + np.arange(1, 16)).ravel()
    word[early[early < n]] = False
    at = np.flatnonzero(word | far)
    rows = np.searchsorted(offsets, at, "right") - 1
    own = h[at - 1]
    least = np.ones(len(at), bool)
    for step in range(1, NEAR + 1):
        same = rows[step:] == rows[:-step]
        least[:-step] &= ~same | (own[:-step] <= own[step:])
        least[step:] &= ~same | (own[step:] < own[:-step])
    chosen = np.zeros(n, bool)
    chosen[at[least]] = True
    chosen[starts[starts < offsets[1:]]] = True
    found = np.flatnonzero(chosen)
    ends = np.append(found[1:], n)
    for i in np.flatnonzero(ends - found > LONGEST):
        cuts = np.arange(found[i] + LONGEST, ends[i], LONGEST)
        for _ in range(3):
            cuts = cuts + ~lead[np.minimum(cuts, n - 1)]
        chosen[cuts[cuts < ends[i]]] = True
    return np.flatnonzero(chosen)


def windows(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of the shortest windows of ``least`` bytes from each chunk on and up to each, none twice."""
    chunk = np.arange(len(starts))
    last = np.searchsorted(ends, starts + least)
    known = last < len(ends)
    known[known] = rows[last[known]] == rows[known]
    first = np.searchsorted(starts, ends - least, "right") - 1
    other = first >= 0
    other[other] = (rows[first[other]] == rows[other]) & (last[first[other]] != chunk[other])
    return np.concatenate((chunk[known], first[other])), np.concatenate((last[known], chunk[other]))


def _windows(least: int, words: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of all texts; with a filter only those whose digest may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            data, offsets = K.string_buffers(batch.column(1))
            for i, _, part, own in K.slices(data, offsets):
                starts = borders(part, own)
                ends = np.append(starts[1:], len(part))[: len(starts)]
                rows = np.searchsorted(own, starts, "right") - 1
                first, last = windows(starts, ends, rows, least)
                starts, ends, rows = starts[first], ends[last], rows[first]
                digest = K.span_hashes(part, starts, ends).view(np.int64)
                if words is not None:
                    kept = np.flatnonzero(passes(words, _slots(digest)))
                    starts, ends, rows, digest = starts[kept], ends[kept], rows[kept], digest[kept]
                at, take = (starts - own[rows]).astype(np.int32), pa.array(i + rows)
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(at), pa.array((ends - starts).astype(np.int32)), pa.array(digest)], names=["d", "key", "at", "size", "digest"])

    return run


def _slots(digest: np.ndarray) -> np.ndarray:
    """A digest's bit in the filter of digests: its own top bits."""
    return (digest.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares spans with the bytes of their earlier places and moves their ends as far as both agree."""

    def agree(x: np.ndarray, y: np.ndarray) -> int:
        """Length of the common beginning."""
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return int(differ[0]) if len(differ) else m

    for batch in batches:
        out = []
        for d, key, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            mine = np.frombuffer(raw, np.uint8)
            for s in spans:
                start, end, before = s["start"], s["end"], s["before"]
                theirs = np.frombuffer(s["slice"], np.uint8)
                if agree(mine[start:end], theirs[before:]) < end - start:
                    continue  # equal digests of different bytes
                after = before + end - start
                start -= agree(mine[max(0, start - before) : start][::-1], theirs[:before][::-1])
                end += agree(mine[end:], theirs[after:])
                while start < end and mine[start] & 0xC0 == 0x80:
                    start += 1
                while end < len(mine) and mine[end] & 0xC0 == 0x80:
                    end -= 1
                out.append((d, key, start, end, s["fd"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, names=["d", "key", "start", "end", "fd"])


def _joined(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``spans`` (``start``, ``end``) with ``run``, the number of each group of spans of a key that touch."""
    own = Window.partitionBy(*keys).orderBy(*order)
    opens = F.when(F.col("start") <= F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    return spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))


def _needed(source: DataFrame, words: np.ndarray) -> DataFrame:
    """The texts whose key's bit is set, each distinct pair of key and text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(np.flatnonzero(passes(words, batch.column(3).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(hit) for i in range(3)], names=["d", "text", "key"])

    return source.withColumn("at", slot("d", "key")).mapInArrow(run, "d long, text string, key long")


def _spans(docs: DataFrame, min_run: int) -> DataFrame:
    """``d, key, start, end, fd`` of repeated passages; ``d`` is the key or, without one, ``NO_KEY``."""
    source = texts(docs).select(F.coalesce("doc_id", F.lit(NO_KEY)).alias("d"), "text", F.xxhash64("text").alias("key"))
    least = max(min_run, 1)
    # windows are made twice: a table of them would take more disk than their making takes time
    held = source.mapInArrow(_windows(least), WINDOWS)
    place = F.struct("d", "key", "at")
    first = materialise(held.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    words = bits(first.select(F.shiftrightunsigned("digest", 64 - FILTER_BITS).alias("at")))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = first.where(F.col("n") > total / HOT_SHARE)
    rest = first.where(F.col("n") <= total / HOT_SHARE)
    again = source.mapInArrow(_windows(least, words), WINDOWS)
    at_hot = again.join(F.broadcast(hot), "digest")
    at_rest = again.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest")
    later = at_hot.unionByName(at_rest).where(place > F.col("first"))
    follows = ["d", "key", "fd", "fk", "shift"]
    later = later.select("d", "key", F.col("first.d").alias("fd"), F.col("first.key").alias("fk"), (F.col("at") - F.col("first.at")).alias("shift"), F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")).distinct()
    runs = _joined(later, follows, ["start", "end"])
    spans = materialise(runs.groupBy(*follows, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run"))

    origins = _needed(source, membership(spans, "fd", "fk")).select(F.col("d").alias("fd"), F.col("key").alias("fk"), F.encode("text", "UTF-8").alias("raw")).distinct()
    place_ = F.col("start") - F.col("shift")
    before = F.least(place_, F.lit(LONGEST))
    sliced = spans.join(origins, ["fd", "fk"]).select(
        "d", "key", F.struct("start", "end", "fd", before.alias("before"), F.substring("raw", place_ - before + 1, before + F.col("end") - F.col("start") + LONGEST).alias("slice")).alias("s")
    )
    grouped = sliced.groupBy("d", "key").agg(F.collect_list("s").alias("spans"))
    own = _needed(source, membership(spans, "d", "key")).select("d", "key", F.encode("text", "UTF-8").alias("raw")).distinct()
    grown = materialise(own.join(grouped, ["d", "key"]).select("d", "key", "raw", "spans").mapInArrow(_grow, "d long, key long, start long, end long, fd long"))
    release(first, spans)
    return grown


def repeated_passages(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Passages that an earlier place already holds: ``doc_id, key, start, length, first_doc_id`` (bytes).

    ``key`` is the hash of the text, so rows that repeat a key with other texts stay apart; rows that repeat both
    are one document. A null text has no passages. A null key counts as larger than all others. A passage joins
    spans that touch; ``first_doc_id`` is the least of the documents that hold a part of it first (null: only
    documents without a key do). An empty table gives no rows.
    """
    tune(docs.sparkSession)
    runs = _joined(_spans(docs, min_run), ["d", "key"], ["start", "end", "fd"])
    spans = runs.groupBy("d", "key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("fd").alias("fd"))
    known = lambda c: F.when(F.col(c) < NO_KEY, F.col(c))
    return spans.select(known("d").alias("doc_id"), "key", "start", (F.col("end") - F.col("start")).alias("length"), known("fd").alias("first_doc_id"))


def _cuts(spans: DataFrame) -> DataFrame:
    """The sorted spans of each text, under the key that ``_key_of`` gives."""
    each = F.sort_array(F.collect_list(F.struct("start", "length", "first_doc_id")))
    return spans.groupBy(F.coalesce("doc_id", F.lit(NO_KEY)).alias("d"), "key").agg(each.alias("cuts"))


def _has_cuts(cuts: DataFrame) -> Callable[[Column], Column]:
    """Tests a slot against the filter of the texts that have cuts."""
    words = membership(cuts, "d", "key")

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        return pd.Series(passes(words, at.to_numpy()))

    return test


def passages(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row for each passage that would be cut: ``doc_id, first_doc_id, start, length`` (bytes), ``passage``.

    Repeated rows repeat their passages; see ``repeated_passages`` for nulls. An empty table gives no rows.
    """
    cuts = materialise(_cuts(repeated_passages(docs, min_run)))
    source = texts(docs).select(F.coalesce("doc_id", F.lit(NO_KEY)).alias("d"), "text", F.xxhash64("text").alias("key"))
    held = source.where(_has_cuts(cuts)(slot("d", "key"))).join(cuts, ["d", "key"]).select(F.when(F.col("d") < NO_KEY, F.col("d")).alias("doc_id"), F.encode("text", "UTF-8").alias("raw"), F.explode("cuts").alias("c"))
    passage = F.decode(F.substring("raw", F.col("c.start") + 1, F.col("c.length")), "UTF-8")
    return held.select("doc_id", "c.first_doc_id", "c.start", "c.length", passage.alias("passage"))


def cut_repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text`` (and ``n_chars`` set anew where the column exists).

    Every row stays; a text that only repeats others becomes empty, a null text stays null. Other columns, whatever
    their names, are as before. An empty table stays empty.
    """
    cuts = materialise(_cuts(repeated_passages(docs, min_run)))
    whole, d, key, places = fresh(docs, "_whole", "_d", "_key", "_places")
    keyed = docs.withColumns({whole: F.coalesce(F.col("text").cast("string"), F.lit("")), d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY))}).withColumn(key, F.xxhash64(whole))
    test = _has_cuts(cuts)(slot(d, key))
    named = cuts.select(F.col("d").alias(d), F.col("key").alias(key), F.col("cuts").alias(places))
    raw = F.encode(whole, "UTF-8")
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(places, lambda c: c["start"] + c["length"]))
    tos = F.concat(F.transform(places, lambda c: c["start"]), F.array(F.octet_length(whole).cast("long")))
    kept = F.zip_with(froms, tos, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    out = keyed.where(test).join(named, [d, key], "left")
    out = out.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(kept, "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns).unionByName(keyed.where(~test).select(*docs.columns))

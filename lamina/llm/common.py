"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import re
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import ship

#: Rows and bytes of one Arrow batch at most. Long texts make rows large, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
FALLBACK_CHECKPOINTS = "/tmp/checkpoints"
#: Bits of a membership filter: 4 MB, whatever the input.
FILTER_BITS = 25


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts, and send the package to the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local default only on a local master, where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return FALLBACK_CHECKPOINTS


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, readable by any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lamina-{uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lamina_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_lamina_path", None):
            jvm = table.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``docs`` has, without regard to case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slot(*key: Column) -> Column:
    """The bit of a membership filter that stands for a key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - FILTER_BITS)


def passes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bits are set in a membership filter."""
    return (words[at >> 6] >> (at & 63) & 1).astype(bool)


def bits(places: DataFrame) -> np.ndarray:
    """64-bit words with the bits in column ``at`` set: fixed in size, whatever the input."""
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def membership(keys: DataFrame, *names: str) -> np.ndarray:
    """A filter of fixed size over the keys in some columns, with the bit of each key's ``slot`` set.

    Rows that it lets pass need not hold a key: it spares shuffling rows before a join and does not replace the join.
    """
    return bits(keys.select(slot(*names).alias("at")))


def sampled(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """About ``size`` of the rows (all of fewer), the same ones however they are dealt out: those whose keys have the least hashes."""
    total = rows.count()
    share = min(1.0, size / max(total, 1))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(share * (1 << 40)))


def even_borders(values: DataFrame, column: str, ranges: int) -> np.ndarray:
    """At most ``ranges - 1`` distinct values that cut the rows into ranges of like size; repeated rows count as often as they occur."""
    counted = values.groupBy(column).count().orderBy(column).toArrow()
    at, total = counted.column(0).to_numpy(), np.cumsum(counted.column(1).to_numpy())
    if not len(at):
        return np.zeros(0, np.int64)
    places = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return np.unique(at[places].astype(np.int64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, where the input has fewer splits (few row groups); else unchanged."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the key and the text, under fixed names; a null text reads as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

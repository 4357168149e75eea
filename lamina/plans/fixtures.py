"""Files made from the verification tables with the library's own writers, for queries that read them back.

Every task writes the files of its rows, so nothing is gathered on the driver but paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.layers import shared_tables
from lamina.sources import archives, codecs


def shared_folder(spark: SparkSession) -> Path:
    """A new folder that all executors see."""
    folder = Path(shared_tables(spark).removeprefix("file:").replace("//", "/")) / f"lamina-files-{uuid4().hex}"
    folder.mkdir(parents=True)
    return folder


def write_archives(files: DataFrame, folder: Path, number: int, version: int = 13, method: int = codecs.LZ4, prefix: str = "Data", priority: int = 0) -> list[str]:
    """``files`` (``ord, name, content``) as so many archives, in order of ``ord``; their paths in load order."""
    where = str(folder)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        if first := next(rows, None):
            path = f"{where}/{prefix}_{first[0]:012d}.pak"
            archives.write_archive(path, ((name, bytes(data)) for _, name, data in chain([first], rows)), version, method, priority)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    ordered = files.select(F.col("ord").cast("long"), "name", F.col("content").cast("binary")).repartitionByRange(number, "ord").sortWithinPartitions("ord")
    return sorted(r["path"] for r in ordered.mapInArrow(put, "path string").collect())


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows over all cores: a small table is one split, but its documents take long to make."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def encoded(rows: DataFrame, make: Callable[[dict], bytes]) -> DataFrame:
    """``doc, content``: a document of each row, written by ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["doc"] for r in held], pa.string()), pa.array([make(r) for r in held], pa.binary())], names=["doc", "content"])

    return rows.mapInArrow(run, "doc string, content binary")

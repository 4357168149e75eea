"""Extraction as a stream over a folder of archives: new and changed archives are read once, changed files written.

The checkpoint keeps which archives have been seen, the manifest table which files have been written with which digest; a
run that was stopped goes on where it stood. Files are read by Spark, so the folder may be in any store.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sinks.exports import extract_changed
from lamina.sources import archives

FILES = "archive string, time timestamp, name string, content binary"


def unpacked(held: DataFrame) -> DataFrame:
    """``archive, time, name, content`` of the files in archives given as ``path, modificationTime, content``; foreign files give none.

    An archive is put on the task's own disk while it is read, since its parts are read by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, time, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                with tempfile.NamedTemporaryFile(suffix=".pak") as own:
                    own.write(data.as_py())
                    own.flush()
                    if not archives.is_archive(own.name):
                        continue
                    archive = archives.open_archive(own.name)
                    for entry, content in archives.read_files(archive, [e for e in archive.entries if not e.archive_part]):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([time.as_py()], batch.schema.field(1).type), pa.array([entry.name]), pa.array([content], pa.binary())], names=["archive", "time", "name", "content"])

    return held.select("path", "modificationTime", "content").mapInArrow(run, FILES)


def extract_new(spark: SparkSession, folder: str, target: str, state: str) -> int:
    """Extracts what is new in ``folder`` to ``target`` and returns the number of files written. ``state`` holds checkpoint and manifest."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pak").load(folder)
    manifest, written = f"{state.rstrip('/')}/manifest", []

    def known() -> DataFrame:
        if not Path(manifest.removeprefix("file://")).exists():
            return spark.createDataFrame([], "name string, sha256 string, batch long")
        rows = spark.read.schema("name string, sha256 string, batch long").parquet(manifest)
        return rows.groupBy("name").agg(F.max_by("sha256", "batch").alias("sha256"), F.max("batch").alias("batch"))

    def put(batch: DataFrame, number: int) -> None:
        files = unpacked(batch).groupBy("name").agg(F.max_by("content", F.struct("time", "archive")).alias("content"))
        done = extract_changed(files, target, known().select("name", "sha256"))
        done.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{manifest}-log/{number:09d}")
        rows = spark.read.parquet(f"{manifest}-log/{number:09d}").where("written")
        rows.select("name", "sha256", "batch").write.mode("append").parquet(manifest)
        written.append(rows.count())

    query = source.writeStream.foreachBatch(put).option("checkpointLocation", f"{state.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(written)

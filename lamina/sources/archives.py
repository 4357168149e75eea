"""Archives of game data: header, entry table, stored files; read as DataFrames, written one file at a time.

``spark.read.format("lamina_archives")`` lists entries or, with ``content=true``, returns the files' bytes. A task reads a
run of entries of about ``TASK_BYTES``, ``TASK_ENTRIES`` at most, so one large archive is read by many tasks; a solid archive
is one task, since its files lie in one compressed frame. Name filters are applied before any file is read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from lamina.sources import codecs

MAGIC = b"LSPK"
TASK_BYTES, TASK_ENTRIES = 64 << 20, 1 << 16
# Record layouts of the archive versions (little-endian).
START = {10: "<4sIIIHBBI", 15: "<4sIQIBB16s", 16: "<4sIQIBB16sH", 18: "<4sIQIBB16sH"}
START_FIELDS = {
    10: "magic version data_offset file_list_size num_parts flags priority num_files",
    15: "magic version file_list_offset file_list_size flags priority md5",
    16: "magic version file_list_offset file_list_size flags priority md5 num_parts",
    18: "magic version file_list_offset file_list_size flags priority md5 num_parts",
}
TAIL = "<IIIHBB16s"
TAIL_FIELDS = "version file_list_offset file_list_size num_parts flags priority md5"
RECORD_OLD = np.dtype([("name", "S256"), ("offset", "<u4"), ("size_on_disk", "<u4"), ("uncompressed_size", "<u4"), ("archive_part", "<u4"), ("flags", "<u4"), ("crc", "<u4")])
RECORD_WIDE = np.dtype([("name", "S256"), ("offset", "<u8"), ("size_on_disk", "<u8"), ("uncompressed_size", "<u8"), ("archive_part", "<u4"), ("flags", "<u4"), ("crc", "<u4"), ("spare", "<u4")])
RECORD_NEW = np.dtype([("name", "S256"), ("low", "<u4"), ("high", "<u2"), ("archive_part", "u1"), ("flags", "u1"), ("size_on_disk", "<u4"), ("uncompressed_size", "<u4")])
SOLID, METHOD = 0x04, 0x0F
#: Where the first entry of a solid archive lies: behind the frame's header.
SOLID_BEGIN = 7

ENTRIES = "archive string, load_order long, entry_ord long, name string, offset long, archive_part long, flags long, size_on_disk long, uncompressed_size long, crc long, size long, method int"
FILES = "archive string, load_order long, entry_ord long, name string, content binary"


class ArchiveError(ValueError):
    pass


@dataclass
class Entry:
    entry_ord: int
    name: str
    offset: int
    archive_part: int
    flags: int
    size_on_disk: int
    uncompressed_size: int
    crc: int = 0

    @property
    def size(self) -> int:
        """Bytes of the file itself; stored files declare none."""
        return self.uncompressed_size or self.size_on_disk

    @property
    def method(self) -> int:
        return self.flags & METHOD


@dataclass
class Archive:
    path: str
    header: dict
    #: The entry table's records, as they are stored.
    table: np.ndarray

    @cached_property
    def entries(self) -> list[Entry]:
        return self.some(0, len(self.table))

    def some(self, first: int, last: int) -> list[Entry]:
        """The entries from ``first`` up to ``last``, with absolute offsets."""
        rows, version = self.table[first:last], self.header["version"]
        offset = rows["low"].astype(np.int64) | rows["high"].astype(np.int64) << 32 if version == 18 else rows["offset"].astype(np.int64)
        if version == 10:
            offset = offset + np.where(rows["archive_part"] == 0, self.header["data_offset"], 0)
        crc = rows["crc"].tolist() if "crc" in rows.dtype.names else [0] * len(rows)
        columns = (rows["name"].tolist(), offset.tolist(), rows["archive_part"].tolist(), rows["flags"].tolist(), rows["size_on_disk"].tolist(), rows["uncompressed_size"].tolist(), crc)
        return [Entry(i, name.decode("utf-8", "replace"), *rest) for i, (name, *rest) in enumerate(zip(*columns), first)]

    @property
    def solid(self) -> bool:
        return bool(self.header["flags"] & SOLID)


def is_archive(path: str | Path) -> bool:
    """Whether a file bears the signature at its head or tail; a file that cannot be read does not."""
    try:
        with open(path, "rb") as held:
            if held.read(4) == MAGIC:
                return True
            size = held.seek(0, 2)
            if size < 8:
                return False
            held.seek(-4, 2)
            return held.read(4) == MAGIC
    except OSError:
        return False


def read_header(held) -> dict:
    """The header of an open archive, from its start or (version 13) from its end."""
    size = held.seek(0, 2)
    held.seek(0)
    head = held.read(64)
    found = {"data_offset": 0, "num_files": 0, "md5": b"\0" * 16, "num_parts": 1, "file_size": size}
    if head[:4] == MAGIC:
        version = int.from_bytes(head[4:8], "little") if len(head) >= 8 else None
        if version not in START:
            raise ArchiveError(f"unsupported archive version {version}")
        if len(head) < struct.calcsize(START[version]):
            raise ArchiveError("too small for its header")
        found |= dict(zip(START_FIELDS[version].split(), struct.unpack_from(START[version], head)))
        if version == 10:
            found["file_list_offset"] = struct.calcsize(START[10])
    else:
        held.seek(max(0, size - 8))
        tail = held.read(8)
        if tail[4:] != MAGIC:
            raise ArchiveError("no signature at either end")
        length = int.from_bytes(tail[:4], "little", signed=True)
        if not struct.calcsize(TAIL) + 8 <= length <= size:
            raise ArchiveError(f"implausible header size {length}")
        held.seek(size - length)
        found |= dict(zip(TAIL_FIELDS.split(), struct.unpack(TAIL, held.read(struct.calcsize(TAIL)))))
        if found["version"] != 13:
            raise ArchiveError(f"unsupported version {found['version']} at the end")
    found["num_parts"] = max(found["num_parts"], 1)
    return found


def _record(version: int) -> np.dtype:
    return RECORD_OLD if version <= 13 else RECORD_WIDE if version < 18 else RECORD_NEW


def _exactly(held, size: int, what: str) -> bytes:
    data = held.read(size)
    if len(data) != size:
        raise ArchiveError(f"truncated {what}")
    return data


def read_table(held, header: dict) -> np.ndarray:
    """The entry table."""
    version, record = header["version"], _record(header["version"])
    held.seek(header["file_list_offset"])
    if version == 10:
        size = header["num_files"] * record.itemsize
        if size > header["data_offset"]:
            raise ArchiveError(f"implausible number of files {header['num_files']}")
        table = _exactly(held, size, "file list")
    else:
        number = int.from_bytes(_exactly(held, 4, "file list header"), "little")
        packed = header["file_list_size"] - 4 if version == 13 else int.from_bytes(_exactly(held, 4, "file list header"), "little")
        if packed < 0 or number * record.itemsize > packed * 256 + codecs.SLACK:
            raise ArchiveError(f"implausible number of files {number}")
        try:
            table = codecs.block(_exactly(held, packed, "file list"), number * record.itemsize)
        except codecs.CodecError as problem:
            raise ArchiveError(f"corrupt file list: {problem}") from problem
    return np.frombuffer(table, record)


def open_archive(path: str | Path) -> Archive:
    """Header and entries; any damage is an ``ArchiveError``."""
    try:
        with open(path, "rb") as held:
            header = read_header(held)
            archive = Archive(str(path), header, read_table(held, header))
            if archive.solid and len(archive.table):
                solid_places(archive)
            return archive
    except OSError as problem:
        raise ArchiveError(str(problem)) from problem


def solid_places(archive: Archive) -> dict[int, int]:
    """Where each entry of a solid archive begins in the unpacked frame; entries must lie one behind the other from its header on."""
    places, due, begin = {}, SOLID_BEGIN, 0
    for entry in sorted(archive.entries, key=lambda e: e.offset):
        if entry.offset != due:
            raise ArchiveError("the entries of a solid archive are not contiguous")
        places[entry.entry_ord] = begin
        due, begin = due + entry.size_on_disk, begin + entry.uncompressed_size
    return places


def _solid_frame(archive: Archive) -> bytes:
    reach = SOLID_BEGIN + sum(e.size_on_disk for e in archive.entries)
    end = archive.header["file_list_offset"] if archive.header["version"] == 13 else reach
    if end < reach:
        raise ArchiveError("the frame of a solid archive is shorter than its entries")
    due = sum(e.uncompressed_size for e in archive.entries)
    try:
        with open(archive.path, "rb") as held:
            whole = codecs.frame(_exactly(held, end, "solid archive"), due, open_end=True)
    except codecs.CodecError as problem:
        raise ArchiveError(f"corrupt solid archive: {problem}") from problem
    if len(whole) != due:
        raise ArchiveError(f"a solid archive holds {len(whole)} bytes in place of {due}")
    return whole


def part_path(path: str, part: int) -> Path:
    """The file of an archive's part: ``name_1.pak`` beside ``name.pak``."""
    own = Path(path)
    return own.with_name(f"{own.stem}_{part}{own.suffix}") if part else own


def read_files(archive: Archive, entries: list[Entry]) -> Iterator[tuple[Entry, bytes]]:
    """The bytes of some entries, in the order given."""
    if archive.solid and archive.entries:
        places, whole = solid_places(archive), _solid_frame(archive)
        for entry in entries:
            begin = places[entry.entry_ord]
            yield entry, whole[begin : begin + entry.uncompressed_size]
        return
    open_parts: dict[int, object] = {}
    try:
        for entry in entries:
            if entry.archive_part not in open_parts:
                own = part_path(archive.path, entry.archive_part)
                if not own.exists():
                    raise ArchiveError(f"missing part {own.name}")
                open_parts[entry.archive_part] = open(own, "rb")
            held = open_parts[entry.archive_part]
            held.seek(entry.offset)
            try:
                yield entry, codecs.unpack(_exactly(held, entry.size_on_disk, f"data of {entry.name!r}"), entry.method, entry.uncompressed_size)
            except codecs.CodecError as problem:
                raise ArchiveError(f"{entry.name!r}: {problem}") from problem
    finally:
        for held in open_parts.values():
            held.close()


def read_file(path: str | Path, name: str) -> bytes:
    """One file of an archive; of several under one name the last."""
    archive = open_archive(path)
    named = [e for e in archive.entries if e.name == name]
    if not named:
        raise ArchiveError(f"{name!r} is not in {Path(path).name}")
    return next(read_files(archive, named[-1:]))[1]


def write_archive(path: str | Path, files: Iterable[tuple[str, bytes]], version: int = 13, method: int = codecs.LZ4, priority: int = 0) -> Path:
    """Writes a single-part archive (version 10 or 13)."""
    if version not in (10, 13):
        raise ArchiveError("archives are written in version 10 or 13")
    rows, blobs, at = [], [], 0
    for name, data in files:
        raw = name.replace("\\", "/").encode()
        if len(raw) > 256:
            raise ArchiveError(f"name too long: {name!r}")
        blob, used = codecs.pack(data, method)
        rows.append((raw, at, len(blob), 0 if used == codecs.STORED else len(data), 0, used, 0))
        blobs.append(blob)
        at += len(blob)
    table = np.array(rows, RECORD_OLD).tobytes()
    if version == 10:
        begin = struct.calcsize(START[10])
        parts = [struct.pack(START[10], MAGIC, 10, begin + len(table), len(table), 1, 0, priority, len(rows)), table, *blobs]
    else:
        listing = len(rows).to_bytes(4, "little") + codecs.pack_block(table)
        tail = struct.pack(TAIL, 13, at, len(listing), 1, 0, priority, hashlib.md5(table).digest())
        parts = [*blobs, listing, tail, struct.pack("<i4s", len(tail) + 8, MAGIC)]
    with open(path, "wb") as held:
        held.writelines(parts)
    return Path(path)


def load_key(path: str | Path, priority: int) -> tuple:
    """Archives load by priority, then patches after the rest by their number, then by name."""
    stem = Path(path).stem
    patch = re.match(r"patch(\d+)", stem, re.IGNORECASE)
    return priority, bool(patch), int(patch[1]) if patch else 0, stem.lower()


@dataclass
class Run(InputPartition):
    """Some entries of one archive."""

    path: str
    load_order: int
    first: int
    last: int

    def __hash__(self) -> int:
        return hash((self.path, self.first))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n") if options.get("paths") else [options["path"]]
        self.content = options.get("content", "false").lower() == "true"
        self.suffixes = tuple(x for x in options.get("suffixes", "").lower().split("\n") if x)
        self.markers = [x for x in options.get("markers", "").lower().split("\n") if x]
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("name",):
                kind = {EqualTo: "is", In: "in", StringStartsWith: "begins", StringEndsWith: "ends", StringContains: "holds"}.get(type(f))
                if kind:
                    self.tests.append((kind, f.value))
                    continue
            yield f

    def keeps(self, name: str) -> bool:
        checks = {"is": lambda v: name == v, "in": lambda v: name in v, "begins": name.startswith, "ends": name.endswith, "holds": lambda v: v in name}
        low = name.lower()
        wanted = (not self.suffixes or low.endswith(self.suffixes)) and (not self.markers or any(m in low for m in self.markers))
        return wanted and all(checks[kind](value) for kind, value in self.tests)

    def partitions(self):
        runs = []
        for order, path in enumerate(self.paths):
            archive = open_archive(path)
            begin, size = 0, 0
            for i, own in enumerate(() if archive.solid else archive.table["size_on_disk"].tolist(), 1):
                size += own * self.content
                if size >= TASK_BYTES or i - begin >= TASK_ENTRIES:
                    runs.append(Run(path, order, begin, i))
                    begin, size = i, 0
            runs.append(Run(path, order, begin, len(archive.table)))
        return runs

    def read(self, run: Run):
        archive = open_archive(run.path)
        wanted = [e for e in archive.some(run.first, run.last) if self.keeps(e.name)]
        if self.content:
            rows, held = [], 0
            for entry, data in read_files(archive, wanted):
                rows.append((run.path, run.load_order, entry.entry_ord, entry.name, data))
                held += len(data)
                if held > 16 << 20:
                    yield _batch(rows, FILES)
                    rows, held = [], 0
        else:
            rows = [(run.path, run.load_order, e.entry_ord, e.name, e.offset, e.archive_part, e.flags, e.size_on_disk, e.uncompressed_size, e.crc, e.size, e.method) for e in wanted]
        if rows:
            yield _batch(rows, FILES if self.content else ENTRIES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lamina_archives"

    def schema(self) -> str:
        return FILES if self.options.get("content", "false").lower() == "true" else ENTRIES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def listing(spark: SparkSession, paths: list[str], *, content: bool = False, suffixes: tuple[str, ...] = (), markers: tuple[str, ...] = ()) -> DataFrame:
    """Entries (or, with ``content``, files) of archives in load order.

    A name passes if it ends with one of ``suffixes`` and holds one of ``markers``, both without regard to case.
    """
    schema = FILES if content else ENTRIES
    if not paths:
        return spark.createDataFrame([], schema)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
    options = {"paths": "\n".join(paths), "content": str(content).lower(), "suffixes": "\n".join(suffixes), "markers": "\n".join(markers)}
    return spark.read.format("lamina_archives").options(**options).load()

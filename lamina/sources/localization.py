"""Localization tables: handles with versions and texts, as XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.sources.definitions import text_of
from lamina.sources.trees import gathered

ROWS = "doc string, ord long, handle string, version long, text string, error string"


class LocalizationError(ValueError):
    pass


def read(data: bytes | str) -> list[tuple[str, int, str]]:
    """Handle, version and text of each entry that has a handle; a version that is no number is 1."""
    try:
        root = ET.fromstring(text_of(data))
    except ET.ParseError as problem:
        raise LocalizationError(f"malformed XML: {problem}") from problem
    if root.tag != "contentList":
        raise LocalizationError(f"the root is <{root.tag}>, not <contentList>")

    def number(spelt: str) -> int:
        try:
            return int(spelt)
        except ValueError:
            return 1

    return [(c.get("contentuid"), number(c.get("version", "1")), c.text or "") for c in root.findall("content") if c.get("contentuid")]


def write(entries: Iterable[tuple[str, int, str]]) -> bytes:
    """The entries as XML, their texts unchanged, the same bytes for the same entries."""
    rows = [f'  <content contentuid={quoteattr(handle)} version="{version}">{escape(text)}</content>' for handle, version, text in entries]
    return "\n".join(['<?xml version="1.0" encoding="utf-8"?>', "<contentList>", *rows, "</contentList>", ""]).encode()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows_of(doc: str, data: bytes) -> list[tuple]:
        try:
            return [(doc, i, *entry, None) for i, entry in enumerate(read(data))]
        except LocalizationError as problem:
            return [(doc, 0, None, None, None, str(problem))]

    return gathered(batches, rows_of, ROWS)


def entries(files: DataFrame) -> DataFrame:
    """``ROWS`` of documents given as ``doc, content``; a document that cannot be read gives one row with its error."""
    return files.select("doc", "content").mapInArrow(_read, ROWS)

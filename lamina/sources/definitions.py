"""Definition text: blocks of quoted directives, read into one row a definition, and written back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.sources.trees import gathered

# The grammar of a line, and the directives that must not be malformed.
DIRECTIVE = re.compile(r'([A-Za-z ]+?)\s+"(.*)"\s*$')
BETWEEN = re.compile(r'"\s*,\s*"|"\s+"')
BINDING = re.compile(r"(?:new entry|data|type|using|key)\b")
FORBIDDEN = re.compile(r'["\r\n]')

#: ``kind`` is ``definition`` (name, type, using, data), ``global`` (name, value) or ``issue`` (value: what is wrong).
ROWS = "doc string, ord long, kind string, name string, type string, using string, value string, data map<string,string>"


class DefinitionError(ValueError):
    pass


def text_of(data: bytes | str) -> str:
    return data.decode("utf-8-sig", "replace") if isinstance(data, bytes) else data


def uncommented(line: str) -> str:
    """The line without a ``//`` comment that stands outside quotes."""
    parts = line.split('"')
    for i in range(0, len(parts), 2):  # even parts lie outside quotes
        if "//" in parts[i]:
            parts[i] = parts[i].split("//", 1)[0]
            return '"'.join(parts[: i + 1]).rstrip()
    return line


def directives(text: str, comments: bool = True) -> Iterator[tuple[int, str, list[str]]]:
    """Line number, keyword and arguments of each directive.

    A value may go on over several lines; a line is taken by itself if it can be. With ``comments`` trailing comments
    are cut and malformed binding lines are errors, else such lines are passed over.
    """
    lines = [line.strip() for line in text.splitlines()]
    at = 0
    while at < len(lines):
        number, line = at + 1, lines[at]
        at += 1
        if not line or line.startswith("//"):
            continue
        if not comments:
            found = DIRECTIVE.match(line)
        else:
            line = uncommented(line)
            found = DIRECTIVE.match(line)
            binding = BINDING.match(line)
            if not found and binding and line.count('"') % 2:
                while not found and at < len(lines) and not BINDING.match(lines[at]):
                    line = uncommented(line + lines[at])
                    at += 1
                    found = DIRECTIVE.match(line)
            if not found and binding:
                raise DefinitionError(f"line {number}: malformed: {line!r}")
        if found:
            yield number, found[1], BETWEEN.split(found[2])


def read(text: str) -> tuple[list[dict], dict[str, str]]:
    """Definitions in order (name, type, using, data) and globals of one document."""
    entries: list[dict] = []
    constants: dict[str, str] = {}
    current: dict | None = None
    for number, keyword, given in directives(text):
        if keyword.startswith("new "):
            current = {"name": given[0], "type": "", "using": None, "data": {}}
            if keyword == "new entry":
                entries.append(current)  # blocks of other kinds are read and left out
        elif keyword == "key":
            if len(given) > 1:
                constants[given[0]] = given[1]
        elif keyword in ("type", "using", "data"):
            if current is None:
                raise DefinitionError(f"line {number}: {keyword!r} outside any block")
            if keyword != "data":
                current[keyword] = given[0]
            elif len(given) < 2:
                raise DefinitionError(f"line {number}: 'data' needs a key and a value")
            else:
                current["data"][given[0]] = given[1]
    return entries, constants


def _quoted(value: str) -> str:
    if FORBIDDEN.search(value):
        raise DefinitionError(f"{value!r} holds a quote or line end, which the format cannot")
    return f'"{value}"'


def write(entries: list[dict], constants: dict[str, str] | None = None) -> str:
    """Definition text; reading it gives the same definitions and globals."""
    blocks = ["\n".join(f"key {_quoted(k)},{_quoted(v)}" for k, v in constants.items())] if constants else []
    for e in entries:
        lines = [f"new entry {_quoted(e['name'])}"]
        lines += [f"{word} {_quoted(e[word])}" for word in ("type",) if e.get(word)] + [f"using {_quoted(e['using'])}" for _ in (1,) if e.get("using") is not None]
        blocks.append("\n".join(lines + [f"data {_quoted(k)} {_quoted(v)}" for k, v in (e.get("data") or {}).items()]))
    return "\n\n".join(blocks) + "\n" if blocks else ""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows_of(doc: str, data: bytes) -> list[tuple]:
        try:
            entries, constants = read(text_of(data))
        except DefinitionError as problem:
            return [(doc, 0, "issue", None, None, None, str(problem), None)]
        rows = [(doc, i, "definition", e["name"], e["type"], e["using"], None, list(e["data"].items())) for i, e in enumerate(entries)]
        return rows + [(doc, i, "global", k, None, None, v, None) for i, (k, v) in enumerate(constants.items())]

    return gathered(batches, rows_of, ROWS)


def definitions(files: DataFrame) -> DataFrame:
    """``ROWS`` of documents given as ``doc, content``; a document that cannot be read gives one issue and nothing else."""
    return files.select("doc", "content").mapInArrow(_read, ROWS)

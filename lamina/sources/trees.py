"""Node trees: read from binary, XML or JSON resources into two flat tables, and written back.

A tree is flat from the start: nodes in depth-first order with their parent's number, and attributes with their node's
number. These are the rows of the ``nodes`` and ``attributes`` DataFrames; nothing recursive leaves this module.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.sources import codecs

# Attribute types by number.
TYPES = (
    "None uint8 int16 uint16 int32 uint32 float double ivec2 ivec3 ivec4 fvec2 fvec3 fvec4 mat2x2 mat3x3 mat3x4 mat4x3 mat4x4 bool string path "
    "FixedString LSString uint64 ScratchBuffer old_int64 int8 TranslatedString WString LSWString guid int64 TranslatedFSString"
).split()
NUMBERS = {name: i for i, name in enumerate(TYPES)}
# How each type is stored.
SCALARS = {"uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float": "f", "double": "d", "uint64": "Q", "old_int64": "q", "int8": "b", "int64": "q"}
VECTORS = {"ivec2": "2i", "ivec3": "3i", "ivec4": "4i", "fvec2": "2f", "fvec3": "3f", "fvec4": "4f", "mat2x2": "4f", "mat3x3": "9f", "mat3x4": "12f", "mat4x3": "12f", "mat4x4": "16f"}
STRINGS = {"string", "path", "FixedString", "LSString", "WString", "LSWString"}
BINARY_MAGIC = b"LSOF"
BUCKETS = 0x200
#: Deepest nesting of a translated string's arguments.
MOST_NESTED = 32
SHORT_NODE = np.dtype([("name", "<u4"), ("first", "<i4"), ("parent", "<i4")])
LONG_NODE = np.dtype([("name", "<u4"), ("parent", "<i4"), ("next", "<i4"), ("first", "<i4")])
SHORT_ATTRIBUTE = np.dtype([("name", "<u4"), ("kind", "<u4"), ("node", "<i4")])
LONG_ATTRIBUTE = np.dtype([("name", "<u4"), ("kind", "<u4"), ("next", "<i4"), ("offset", "<u4")])
KEY = np.dtype([("node", "<u4"), ("name", "<u4")])
UNWRITABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")

NODES = "doc string, region string, node_idx int, parent_idx int, depth int, id string, key string"
ATTRIBUTES = "doc string, node_idx int, attr_ord int, id string, type string, value string, handle string, version int"
#: Rows, or bytes of documents read, from which on a batch is passed on.
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20


class TreeError(ValueError):
    pass


@dataclass
class Node:
    id: str
    parent: int = -1
    region: str = ""
    key: str | None = None


@dataclass
class Attribute:
    id: str
    type: str
    value: str | None
    handle: str | None = None
    version: int | None = None


@dataclass
class Tree:
    """Nodes in depth-first order; ``attributes[i]`` are those of node ``i`` by id (a repeated id keeps its place and takes the last value)."""

    nodes: list[Node] = field(default_factory=list)
    attributes: list[dict[str, Attribute]] = field(default_factory=list)

    def add(self, node: Node, attributes: list[Attribute]) -> int:
        self.nodes.append(node)
        self.attributes.append({a.id: a for a in attributes})
        return len(self.nodes) - 1

    def ordered(self) -> Tree:
        """The same tree depth first, with only the last of several roots of one region, in the place of the first."""
        below: dict[int, list[int]] = {}
        roots: dict[str, int] = {}
        for i, node in enumerate(self.nodes):
            if node.parent < 0:
                roots[node.region] = i
            else:
                below.setdefault(node.parent, []).append(i)
        out = Tree()
        waiting = [(i, -1, region) for region, i in reversed(roots.items())]
        while waiting:
            i, parent, region = waiting.pop()
            own = self.nodes[i]
            at = out.add(Node(own.id, parent, region, own.key), list(self.attributes[i].values()))
            waiting += [(c, at, region) for c in reversed(below.get(i, ()))]
        return out

    def text(self, node: int, name: str, default: str | None = None) -> str | None:
        """An attribute's value, else its handle, else the default."""
        held = self.attributes[node].get(name)
        if held is None:
            return default
        found = held.value if held.value is not None else held.handle
        return default if found is None else found

    def find(self, name: str) -> Iterator[int]:
        """Nodes of an id, depth first."""
        return (i for i, node in enumerate(self.nodes) if node.id == name)

    def depths(self) -> list[int]:
        out: list[int] = []
        for node in self.nodes:
            out.append(0 if node.parent < 0 else out[node.parent] + 1)
        return out


def type_name(raw: str | int | None) -> str:
    """Canonical name of a type given by number, digits or name."""
    if raw is None:
        return "None"
    spelt = str(raw)
    if isinstance(raw, int) or spelt.isdigit():
        number = int(spelt)
        return TYPES[number] if 0 <= number < len(TYPES) else f"unknown_{spelt}"
    return spelt


def _decoded(data: bytes | str) -> str:
    return data.decode("utf-8-sig", "replace") if isinstance(data, bytes) else data


# XML


def read_xml(data: bytes | str) -> Tree:
    """``<save>`` documents; of each region the first node counts."""
    try:
        root = ET.fromstring(_decoded(data))
    except ET.ParseError as problem:
        raise TreeError(f"malformed XML: {problem}") from problem
    if root.tag != "save":
        raise TreeError(f"the root is <{root.tag}>, not <save>")
    tree = Tree()
    waiting = [(top, -1, region.get("id", "")) for region in root.findall("region") if (top := region.find("node")) is not None]
    waiting.reverse()
    while waiting:
        element, parent, region = waiting.pop()
        own = [Attribute(a.get("id", ""), type_name(a.get("type")), a.get("value"), a.get("handle"), int(a.get("version")) if a.get("version") else None) for a in element.findall("attribute")]
        at = tree.add(Node(element.get("id", ""), parent, region, element.get("key")), own)
        waiting += [(c, at, region) for group in reversed(element.findall("children")) for c in reversed(group.findall("node"))]
    return tree.ordered()


def _quoted(value: str, what: str) -> str:
    if found := UNWRITABLE.search(value):
        raise TreeError(f"{what} holds {found[0]!r}, which XML cannot")
    # line ends in an attribute survive only as references
    return quoteattr(value, {"\n": "&#10;", "\r": "&#13;", "\t": "&#09;"})


def write_xml(tree: Tree, numbers: bool = True) -> str:
    """The tree as XML, types by number (unknown ones by name) or all by name."""
    lines = ['<?xml version="1.0" encoding="utf-8"?>', "<save>", '  <version major="3" minor="6" revision="4" build="0" />']
    closing: list[tuple[int, list[str]]] = []  # node that has to end first, its closing lines
    children = {n.parent for n in tree.nodes}
    levels = tree.depths()
    for i, node in enumerate(tree.nodes):
        while closing and closing[-1][0] != node.parent:
            lines += closing.pop()[1]
        if node.parent < 0:
            lines.append(f"  <region id={_quoted(node.region, 'region')}>")
        pad = "  " * (2 + 2 * levels[i])
        key = f" key={_quoted(node.key, 'key')}" if node.key else ""
        own = list(tree.attributes[i].values())
        empty = not own and i not in children
        lines.append(f"{pad}<node id={_quoted(node.id, 'node')}{key}{' /' if empty else ''}>")
        for a in own:
            spelt = str(NUMBERS[a.type]) if numbers and a.type in NUMBERS else a.type
            more = "" if a.handle is None else f" handle={_quoted(a.handle, f'handle of {a.id!r}')}" + (f' version="{a.version}"' if a.version is not None else "")
            more += "" if a.value is None else f" value={_quoted(a.value, f'value of {a.id!r}')}"
            lines.append(f"{pad}  <attribute id={_quoted(a.id, 'attribute')} type={_quoted(spelt, 'type')}{more} />")
        ending = [] if empty else [f"{pad}</node>"]
        if i in children:
            lines.append(f"{pad}  <children>")
            ending.insert(0, f"{pad}  </children>")
        closing.append((i, ending + ["  </region>"] * (node.parent < 0)))
    while closing:
        lines += closing.pop()[1]
    return "\n".join([*lines, "</save>"]) + "\n"


# JSON


def json_text(value) -> str:
    """A JSON value as the XML form spells it."""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, list):
        return " ".join(map(json_text, value))
    return repr(value) if isinstance(value, float) else str(value)


def read_json(data: bytes | str) -> Tree:
    """Objects are attributes, arrays hold child nodes."""
    try:
        root = json.loads(_decoded(data))
    except json.JSONDecodeError as problem:
        raise TreeError(f"malformed JSON: {problem}") from problem
    if not isinstance(root, dict) or not isinstance(root.get("save"), dict):
        raise TreeError("no 'save' object")
    regions = root["save"].get("regions", {})
    if not isinstance(regions, dict):
        raise TreeError("'regions' is no object")
    tree = Tree()
    waiting = [(name, held, -1, name) for name, held in regions.items() if isinstance(held, dict)][::-1]
    while waiting:
        name, held, parent, region = waiting.pop()
        own = []
        for key, value in held.items():
            if isinstance(value, dict):
                inner, handle, version = value.get("value"), value.get("handle"), value.get("version")
                own.append(Attribute(key, type_name(value.get("type")), None if inner is None else json_text(inner), None if handle is None else str(handle), None if version is None else int(version)))
        at = tree.add(Node(name, parent, region), own)
        waiting += [(key, child, at, region) for key, value in held.items() if isinstance(value, list) for child in value if isinstance(child, dict)][::-1]
    return tree.ordered()


# Binary


def version_parts(value: int, bits: tuple[int, ...]) -> tuple[int, ...]:
    """A packed version's fields, the first in the highest bits."""
    out = []
    for width in reversed(bits):
        out.append(value & (1 << width) - 1)
        value >>= width
    return tuple(reversed(out))


def pack_version(parts: tuple[int, ...], bits: tuple[int, ...]) -> int:
    value = 0
    for part, width in zip(parts, bits, strict=True):
        if not 0 <= part < 1 << width:
            raise ValueError(f"{part} does not fit in {width} bits")
        value = value << width | part
    return value


# Bits of major, minor, revision, build, and of major, minor, build, revision.
VERSION_32, VERSION_64 = (4, 4, 8, 16), (9, 8, 16, 31)


def later_engine(major: int, revision: int, build: int) -> bool:
    """Whether strings are stored as the later engine does."""
    return major > 4 or major == 4 and (revision > 0 or build >= 0x1A)


def guid_text(raw: bytes) -> str:
    """Three little-endian groups and then four swapped pairs."""
    return str(uuid.UUID(bytes_le=raw[:8] + np.frombuffer(raw[8:], "<u2").byteswap().tobytes()))


def guid_bytes(spelt: str) -> bytes:
    raw = uuid.UUID(spelt).bytes_le
    return raw[:8] + np.frombuffer(raw[8:], "<u2").byteswap().tobytes()


class _Cursor:
    """Reads numbers and strings of a value one behind the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, form: str) -> int:
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def string(self) -> str:
        size = self.number("<i")
        if size < 0:
            raise TreeError("negative length in a translated string")
        held = self.data[self.at : self.at + size]
        self.at += size
        return held.rstrip(b"\0").decode("utf-8", "replace")

    def translated(self, later: bool) -> tuple[str | None, str, int]:
        """Inline text, handle, version: one of text and version is stored."""
        version, value = (self.number("<H"), None) if later else (0, self.string())
        return value, self.string(), version

    def arguments(self, later: bool, depth: int = 0) -> None:
        if depth > MOST_NESTED:
            raise TreeError("translated strings nest too deep")
        number = self.number("<i")
        if not 0 <= number <= len(self.data):
            raise TreeError("implausible number of arguments")
        for _ in range(number):
            self.string()
            self.translated(later)
            self.arguments(later, depth + 1)
            self.string()


def _value(kind: str, raw: bytes, later: bool, name: str) -> Attribute:
    if kind in STRINGS:
        return Attribute(name, kind, raw.rstrip(b"\0").decode("utf-8", "replace"))
    if kind in ("TranslatedString", "TranslatedFSString"):
        cursor = _Cursor(raw)
        value, handle, version = cursor.translated(later)
        if kind == "TranslatedFSString":
            cursor.arguments(later)
        return Attribute(name, kind, value, handle, version)
    form = "<" + (SCALARS.get(kind) or VECTORS.get(kind) or "")
    if form != "<":
        if len(raw) != struct.calcsize(form):
            raise TreeError(f"{name!r}: {len(raw)} bytes for {kind}")
        return Attribute(name, kind, " ".join(repr(x) if isinstance(x, float) else str(x) for x in struct.unpack(form, raw)))
    if kind == "bool":
        if not raw:
            raise TreeError(f"{name!r}: empty bool")
        return Attribute(name, kind, "True" if raw[0] else "False")
    if kind == "guid":
        if len(raw) != 16:
            raise TreeError(f"{name!r}: {len(raw)} bytes for guid")
        return Attribute(name, kind, guid_text(raw))
    if kind == "None":
        return Attribute(name, kind, "")
    return Attribute(name, kind, base64.b64encode(raw).decode() if kind == "ScratchBuffer" else raw.hex())


def _section(data: bytes, at: int, full: int, disk: int, method: int, framed: bool) -> tuple[bytes, int]:
    stored = full if not disk or method == codecs.STORED else disk
    if not disk and not full:
        return b"", at
    raw = data[at : at + stored]
    if len(raw) != stored:
        raise TreeError("truncated section")
    if disk and method != codecs.STORED:
        held = codecs.frame(raw, full) if method == codecs.LZ4 and framed else codecs.unpack(raw, method, full)
    else:
        held = raw
    if len(held) != full:
        raise TreeError(f"a section of {len(held)} bytes in place of {full}")
    return held, at + stored


def _names(raw: bytes) -> list[list[str]]:
    if not raw:
        return []
    at, buckets = 4, []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        if raw[at : at + 2] == b"\0\0":  # as most are
            buckets.append([])
            at += 2
            continue
        (count,) = struct.unpack_from("<H", raw, at)
        at += 2
        held = []
        for _ in range(count):
            (size,) = struct.unpack_from("<H", raw, at)
            held.append(raw[at + 2 : at + 2 + size].decode("utf-8", "replace"))
            at += 2 + size
        buckets.append(held)
    return buckets


def _table(raw: bytes, record: np.dtype, what: str) -> np.ndarray:
    if len(raw) % record.itemsize:
        raise TreeError(f"the {what} table is not whole")
    return np.frombuffer(raw, record)


def read_binary(data: bytes) -> Tree:
    """Binary resources, versions 1 to 7; any damage is a ``TreeError``."""
    try:
        return _read_binary(data)
    except TreeError:
        raise
    except (struct.error, IndexError, OverflowError, codecs.CodecError) as problem:
        raise TreeError(f"malformed binary resource: {problem}") from problem


def _read_binary(data: bytes) -> Tree:
    if data[:4] != BINARY_MAGIC or len(data) < 8:
        raise TreeError("no binary resource")
    version = int.from_bytes(data[4:8], "little")
    if not 1 <= version <= 7:
        raise TreeError(f"unsupported version {version}")
    if version >= 5:
        major, _, build, revision = version_parts(struct.unpack_from("<q", data, 8)[0] & 2**64 - 1, VERSION_64)
        later, at = later_engine(major, build, revision), 16
    else:
        major, _, revision, build = version_parts(struct.unpack_from("<i", data, 8)[0] & 2**32 - 1, VERSION_32)
        later, at = later_engine(major, revision, build), 12
    later = later or version >= 4
    order = ["strings", "keys", "nodes", "attributes", "values"] if version >= 6 else ["strings", "nodes", "attributes", "values"]
    form = f"<{2 * len(order)}IBBHI"
    *sizes, flags, _, _, layout = struct.unpack_from(form, data, at)
    at += struct.calcsize(form)
    size_of = dict(zip(order, zip(sizes[::2], sizes[1::2])))
    method, linked = flags & 0x0F, layout == 1
    if method > codecs.ZSTD:
        raise TreeError(f"unknown compression method {method}")
    held = {}
    for name in ["strings", "nodes", "attributes", "values", *["keys"] * linked]:
        held[name], at = _section(data, at, *size_of.get(name, (0, 0)), method, version >= 2 and name != "strings")
    names = _names(held["strings"])
    long = linked and version >= 3
    nodes = _table(held["nodes"], LONG_NODE if long else SHORT_NODE, "node")
    rows = _table(held["attributes"], LONG_ATTRIBUTE if long else SHORT_ATTRIBUTE, "attribute")

    def named(ref: int) -> str:
        bucket, place = ref >> 16, ref & 0xFFFF
        if bucket >= len(names) or place >= len(names[bucket]):
            raise TreeError(f"dangling name {ref:#x}")
        return names[bucket][place]

    length = (rows["kind"] >> 6).astype(np.int64)
    offset = rows["offset"].astype(np.int64) if long else np.cumsum(length) - length
    owned: dict[int, list[int]] = {}
    if not long:
        for i, node in enumerate(rows["node"].tolist()):
            owned.setdefault(node, []).append(i)

    def chain(node: int) -> Iterator[int]:
        if not long:
            yield from owned.get(node, ())
            return
        i, steps = int(nodes["first"][node]), 0
        while i != -1:
            steps += 1
            if not 0 <= i < len(rows) or steps > len(rows):
                raise TreeError(f"node {node}: the chain of attributes is broken")
            yield i
            i = int(rows["next"][i])

    def attribute(i: int) -> Attribute:
        number = int(rows["kind"][i]) & 0x3F
        name, raw = named(int(rows["name"][i])), held["values"][offset[i] : offset[i] + length[i]]
        if len(raw) != length[i]:
            raise TreeError(f"{name!r}: value out of bounds")
        return _value(type_name(number), raw, later, name)

    keys = {}
    for node, name in _table(held.get("keys", b""), KEY, "key").tolist():
        if node >= len(nodes):
            raise TreeError(f"a key of missing node {node}")
        keys[node] = named(name)
    tree = Tree()
    for i, (name, parent) in enumerate(zip(nodes["name"].tolist(), nodes["parent"].tolist())):
        if parent < -1 or parent >= i:
            raise TreeError(f"node {i}: invalid parent {parent}")
        own = named(name)
        tree.add(Node(own, parent, own if parent < 0 else "", keys.get(i)), [attribute(a) for a in chain(i)])
    return tree.ordered()


def _raw(a: Attribute, later: bool) -> bytes:
    kind, value = a.type, a.value or ""
    closed = lambda s: s.encode() + b"\0"
    sized = lambda s: struct.pack("<i", len(closed(s))) + closed(s)
    if kind in STRINGS:
        return closed(value)
    if kind in ("TranslatedString", "TranslatedFSString"):
        head = struct.pack("<H", a.version or 1) if later else sized(value)
        return head + sized(a.handle or "") + struct.pack("<i", 0) * (kind == "TranslatedFSString")
    if kind in SCALARS:
        form = SCALARS[kind]
        return struct.pack("<" + form, float(value or 0) if form in "fd" else int(value or 0))
    if kind in VECTORS:
        form, parts = VECTORS[kind], value.split()
        if len(parts) != int(form[:-1]):
            raise TreeError(f"{a.id!r}: {len(parts)} components for {kind}")
        return struct.pack("<" + form, *map(float if form[-1] == "f" else int, parts))
    if kind == "bool":
        return b"\1" if value.lower() in ("true", "1") else b"\0"
    if kind == "guid":
        return guid_bytes(value or str(uuid.UUID(int=0)))
    if kind == "ScratchBuffer":
        return base64.b64decode(value)
    if kind == "None":
        return b""
    raise TreeError(f"cannot write attribute type {kind!r}")


def write_binary(tree: Tree, version: int = 3, method: int = codecs.STORED) -> bytes:
    """The tree in versions 1 to 3 (short tables, text inline) or 5 to 7 (from 6 on linked tables with keys)."""
    if version not in (1, 2, 3, 5, 6, 7):
        raise TreeError(f"cannot write version {version}")
    long, later = version >= 6, version >= 4
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    refs: dict[str, int] = {}

    def ref(name: str) -> int:
        if name not in refs:
            bucket = zlib.crc32(name.encode()) % BUCKETS
            refs[name] = bucket << 16 | len(buckets[bucket])
            buckets[bucket].append(name)
            if len(buckets[bucket]) > 0x10000:
                raise TreeError("too many names in a bucket")
        return refs[name]

    following = {}  # next sibling
    last: dict[int, int] = {}
    for i, node in enumerate(tree.nodes):
        if node.parent in last:
            following[last[node.parent]] = i
        last[node.parent] = i
    nodes, rows, keys, values = [], [], [], bytearray()
    for i, node in enumerate(tree.nodes):
        own = list(tree.attributes[i].values())
        first = len(rows) if own else -1
        for place, a in enumerate(own):
            if a.type not in NUMBERS:
                raise TreeError(f"cannot write attribute type {a.type!r}")
            raw = _raw(a, later)
            kind = NUMBERS[a.type] | len(raw) << 6
            rows.append((ref(a.id), kind, len(rows) + 1 if place + 1 < len(own) else -1, len(values)) if long else (ref(a.id), kind, i))
            values += raw
        nodes.append((ref(node.id), node.parent, following.get(i, -1), first) if long else (ref(node.id), first, node.parent))
        if long and node.key:
            keys.append((i, ref(node.key)))
    strings = struct.pack("<I", BUCKETS) + b"".join(b and struct.pack("<H", len(b)) + b"".join(struct.pack("<H", len(n.encode())) + n.encode() for n in b) or b"\0\0" for b in buckets)
    full = {
        "strings": strings,
        "nodes": np.array(nodes, LONG_NODE if long else SHORT_NODE).tobytes(),
        "attributes": np.array(rows, LONG_ATTRIBUTE if long else SHORT_ATTRIBUTE).tobytes(),
        "values": bytes(values),
        "keys": np.array(keys, KEY).tobytes(),
    }
    packed = {}
    for name, raw in full.items():
        if not raw or method == codecs.STORED:
            packed[name] = (raw, 0)
        else:
            held = codecs.pack_frame(raw) if method == codecs.LZ4 and version >= 2 and name != "strings" else codecs.pack(raw, method)[0]
            packed[name] = (held, len(held))
    engine = struct.pack("<q", pack_version((4, 1, 1, 100), VERSION_64)) if version >= 5 else struct.pack("<i", pack_version((3, 6, 4, 0), VERSION_32))
    order = ["strings", *["keys"] * long, "nodes", "attributes", "values"]
    sizes = [n for name in order for n in (len(full[name]), packed[name][1])]
    head = BINARY_MAGIC + struct.pack("<I", version) + engine + struct.pack(f"<{len(sizes)}IBBHI", *sizes, method, 0, 0, int(long))
    return head + b"".join(packed[name][0] for name in ["strings", "nodes", "attributes", "values", *["keys"] * long])


# Any of them


def kind_of(data: bytes) -> str:
    """``binary`` by its magic number, ``json`` if the first character that shows is a brace, else ``xml``."""
    if data[:4] == BINARY_MAGIC:
        return "binary"
    return "json" if data.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")[:1] == b"{" else "xml"


def read_tree(data: bytes) -> Tree:
    return {"binary": read_binary, "json": read_json, "xml": read_xml}[kind_of(data)](data)


def convert(data: bytes, suffix: str) -> bytes:
    """A resource of any kind as ``.lsx`` (XML) or ``.lsf`` (binary)."""
    if suffix.lower() not in (".lsx", ".lsf"):
        raise TreeError(f"cannot write {suffix!r}")
    tree = read_tree(data)
    return write_xml(tree).encode() if suffix.lower() == ".lsx" else write_binary(tree)


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """``doc, content`` one by one; a null content is empty."""
    for batch in batches:
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield doc, data.as_py() or b""


def gathered(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str, bytes], list[tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """The rows of each document, those of many small documents in one batch."""
    rows: list[tuple] = []
    size = 0
    for doc, data in documents(batches):
        rows += rows_of(doc, data)
        size += len(data)
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            if rows:
                yield as_batch(rows, schema)
            rows, size = [], 0
    if rows:
        yield as_batch(rows, schema)


def _rows(batches: Iterator[pa.RecordBatch], what: str) -> Iterator[pa.RecordBatch]:
    def rows_of(doc: str, data: bytes) -> list[tuple]:
        try:
            tree = read_tree(data)
        except ValueError as problem:
            return [(doc, str(problem))] if what == "issues" else []
        if what == "nodes":
            return [(doc, n.region, i, n.parent, d, n.id, n.key) for i, (n, d) in enumerate(zip(tree.nodes, tree.depths()))]
        if what == "attributes":
            return [(doc, i, j, a.id, a.type, a.value, a.handle, a.version) for i, own in enumerate(tree.attributes) for j, a in enumerate(own.values())]
        return []

    return gathered(batches, rows_of, {"nodes": NODES, "attributes": ATTRIBUTES, "issues": "file string, error string"}[what])


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of a flat schema."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def nodes(files: DataFrame) -> DataFrame:
    """``NODES`` of resources given as ``doc, content``; resources that cannot be read give none (see ``issues``)."""
    return files.select("doc", "content").mapInArrow(lambda b: _rows(b, "nodes"), NODES)


def attributes(files: DataFrame) -> DataFrame:
    return files.select("doc", "content").mapInArrow(lambda b: _rows(b, "attributes"), ATTRIBUTES)


def objects(files: DataFrame, id: str, texts: dict[str, str], spoken: str) -> DataFrame:
    """``doc, node_idx``, a column for each attribute in ``texts``, and ``handle, inline``: a row for each node of an id.

    A text is the attribute's value, else its handle, else empty; ``handle`` and ``inline`` are those of the attribute
    ``spoken``, empty where it has none.
    """
    schema = ", ".join(["doc string, node_idx int", *(f"{c} string" for c in texts), "handle string, inline string"])
    wanted, none = list(texts.values()), Attribute(spoken, "None", None)

    def rows_of(doc: str, data: bytes) -> list[tuple]:
        try:
            tree = read_tree(data)
        except ValueError:
            return []
        shown = [(i, tree.attributes[i].get(spoken, none)) for i in tree.find(id)]
        return [(doc, i, *(tree.text(i, a, "") for a in wanted), s.handle or "", s.value or "") for i, s in shown]

    return files.select("doc", "content").mapInArrow(lambda b: gathered(b, rows_of, schema), schema)


def issues(files: DataFrame) -> DataFrame:
    """``file, error`` of the resources that cannot be read."""
    return files.select("doc", "content").mapInArrow(lambda b: _rows(b, "issues"), "file string, error string")

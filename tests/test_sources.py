"""Archives, trees, definitions, recipes and texts: round trips and damaged input."""

import os
import struct

import pytest

from lamina.sinks.paths import UnsafePath, safe_path
from lamina.sources import archives, codecs, definitions, localization, trees

FILES = [("Public/a/Stats.txt", b'new entry "x"\n' * 200), ("Mods/meta.lsx", os.urandom(500)), ("empty", b"")]


@pytest.mark.parametrize("version", [10, 13])
@pytest.mark.parametrize("method", [codecs.STORED, codecs.ZLIB, codecs.LZ4])
def test_archive_round_trip(tmp_path, version, method):
    path = archives.write_archive(tmp_path / "x.pak", [(n.replace("/", "\\"), d) for n, d in FILES], version, method, 7)
    held = archives.open_archive(path)
    assert [(e.name, d) for e, d in archives.read_files(held, held.entries)] == FILES
    assert held.header["priority"] == 7 and held.header["version"] == version and not held.solid
    assert [e.size for e in held.entries] == [len(d) for _, d in FILES] and archives.is_archive(path)
    assert archives.read_file(path, "empty") == b""
    with pytest.raises(archives.ArchiveError):
        archives.read_file(path, "none")


def later_archive(version, files):
    """An archive of the later layouts, by hand."""
    blobs, rows, at = b"", b"", 64
    for name, data in files:
        packed = codecs.pack_block(data)
        raw = name.encode().ljust(256, b"\0")
        if version == 18:
            rows += raw + struct.pack("<IHBBII", at, 0, 0, codecs.LZ4, len(packed), len(data))
        else:
            rows += raw + struct.pack("<QQQIIII", at, len(packed), len(data), 0, codecs.LZ4, 5, 0)
        blobs, at = blobs + packed, at + len(packed)
    table = codecs.pack_block(rows)
    head = b"LSPK" + struct.pack("<IQIBB16s", version, at, len(table) + 8, 0, 3, b"") + (struct.pack("<H", 1) if version > 15 else b"")
    return head.ljust(64, b"\0") + blobs + struct.pack("<II", len(files), len(table)) + table


@pytest.mark.parametrize("version", [15, 16, 18])
def test_later_archives(tmp_path, version):
    (tmp_path / "x.pak").write_bytes(later_archive(version, FILES[:2]))
    held = archives.open_archive(tmp_path / "x.pak")
    assert [(e.name, d) for e, d in archives.read_files(held, held.entries)] == FILES[:2] and held.header["priority"] == 3


def solid_archive(first=7, end_mark=False):
    data = [b"a" * 600, b"bc" * 150]
    packed = [codecs.pack_block(d) for d in data]
    blocks = b"".join(struct.pack("<I", len(p)) + p for p in packed)
    frame = b"\x04\x22\x4d\x18\x40\x40\xc0" + blocks + b"\0\0\0\0" * end_mark
    sizes = [4 + len(p) for p in packed]
    rows = b"".join(n.ljust(256, b"\0") + struct.pack("<IIIIII", o, s, len(d), 0, 0, 0) for n, o, s, d in zip((b"one", b"two"), (first, first + sizes[0]), sizes, data))
    table = codecs.pack_block(rows)
    listing = struct.pack("<I", 2) + table
    tail = struct.pack("<IIIHBB16s", 13, len(frame), len(listing), 1, 4, 0, b"")
    return frame + listing + tail + struct.pack("<i4s", len(tail) + 8, b"LSPK")


@pytest.mark.parametrize("end_mark", [False, True])
def test_solid_archive(tmp_path, end_mark):
    (tmp_path / "s.pak").write_bytes(solid_archive(end_mark=end_mark))
    held = archives.open_archive(tmp_path / "s.pak")
    assert held.solid and [(e.name, d) for e, d in archives.read_files(held, held.entries)] == [("one", b"a" * 600), ("two", b"bc" * 150)]
    assert [e.size for e in held.entries] == [600, 300]


def test_solid_archive_with_a_gap(tmp_path):
    (tmp_path / "s.pak").write_bytes(solid_archive(first=8))
    with pytest.raises(archives.ArchiveError, match="contiguous"):
        archives.open_archive(tmp_path / "s.pak")


def test_parts(tmp_path):
    path = archives.write_archive(tmp_path / "t.pak", [("a", b"here"), ("b", b"x" * 9)], 10, codecs.STORED)
    raw = bytearray(path.read_bytes())
    record = struct.calcsize(archives.START[10]) + 280
    struct.pack_into("<IIII", raw, record + 256, 2, 5, 0, 1)  # the second lies in part 1, from its byte 2 on
    path.write_bytes(raw)
    with pytest.raises(archives.ArchiveError, match="missing part"):
        held = archives.open_archive(path)
        list(archives.read_files(held, held.entries))
    (tmp_path / "t_1.pak").write_bytes(b"..there..")
    held = archives.open_archive(path)
    assert [d for _, d in archives.read_files(held, held.entries)] == [b"here", b"there"]


def test_damaged_archives(tmp_path):
    path = archives.write_archive(tmp_path / "x.pak", FILES)
    raw = path.read_bytes()
    listing = struct.unpack_from("<I", raw, len(raw) - 8 - 32 + 4)[0]
    many = bytearray(raw)
    struct.pack_into("<I", many, listing, 10**8)
    for bad in (many, raw[:300] + raw[400:], b"nothing", b"", b"LSPK", b"LSPK\x63\0\0\0" + b"\0" * 90, raw[:-8] + struct.pack("<i4s", 9, b"LSPK")):
        (tmp_path / "bad.pak").write_bytes(bad)
        with pytest.raises(archives.ArchiveError):
            held = archives.open_archive(tmp_path / "bad.pak")
            list(archives.read_files(held, held.entries))
    assert not archives.is_archive(tmp_path / "none.pak")


def test_bombs():
    with pytest.raises(codecs.CodecError):
        codecs.block(codecs.pack_block(b"x" * 100), 10**9)
    with pytest.raises(codecs.CodecError):
        codecs.unpack(b"x", codecs.ZSTD, 5)
    data = os.urandom(300) + b"ab" * 70000
    assert codecs.frame(codecs.pack_frame(data), len(data)) == data
    with pytest.raises(codecs.CodecError):
        codecs.frame(codecs.pack_frame(data), len(data) - 1)


@pytest.mark.parametrize("name", ["", ".", "a/../b", "/etc/x", "C:\\x", "a\0b", "x/con.txt", "LPT1", "a:b", "..\\x", "\\\\host\\x"])
def test_unsafe_paths(tmp_path, name):
    with pytest.raises(UnsafePath):
        safe_path(tmp_path, name)


def test_safe_paths(tmp_path):
    assert safe_path(tmp_path, "a\\b/c.txt") == tmp_path.resolve() / "a/b/c.txt"
    (tmp_path / "out").symlink_to("/")
    with pytest.raises(UnsafePath):
        safe_path(tmp_path, "out/etc/x")


def test_load_order():
    named = [("Textures.pak", 0), ("Patch10.pak", 0), ("patch2_hotfix.pak", 0), ("Shared.pak", 0), ("Late.pak", 1), ("Patch1.pak", 0)]
    assert [p for p, _ in sorted(named, key=lambda x: archives.load_key(*x))] == ["Shared.pak", "Textures.pak", "Patch1.pak", "patch2_hotfix.pak", "Patch10.pak", "Late.pak"]


VALUES = [("S", "FixedString", "text"), ("L", "LSString", "ünï <&>"), ("I", "int32", "-5"), ("F", "float", "1.5"), ("B", "bool", "True"), ("V", "fvec3", "1.0 2.0 3.5"), ("G", "guid", "00112233-4455-6677-8899-aabbccddeeff"), ("U", "uint64", "9007199254740993"), ("X", "ScratchBuffer", "AAEC"), ("N", "None", ""), ("M", "mat2x2", "1.0 0.0 0.0 1.0")]


def sample_tree():
    tree = trees.Tree()
    top = tree.add(trees.Node("Templates", -1, "Templates"), [])
    own = tree.add(trees.Node("GameObjects", top, "", "key1"), [trees.Attribute(*v) for v in VALUES] + [trees.Attribute("T", "TranslatedString", 'inline\n"x"', "h1g2", 3), trees.Attribute("FS", "TranslatedFSString", "y", "h3g4")])
    tree.add(trees.Node("Child", own), [trees.Attribute("a", "path", "p")])
    tree.add(trees.Node("Child", top), [])
    tree.add(trees.Node("Other", -1, "Other"), [trees.Attribute("z", "string", "")])
    return tree.ordered()


def flat(tree, key=True, inline=True):
    nodes = [(n.region, n.parent, n.id, n.key if key else None) for n in tree.nodes]
    return nodes, [[(a.id, a.type, a.value if inline or not a.handle else None, a.handle) for a in own.values()] for own in tree.attributes]


@pytest.mark.parametrize("version", [1, 2, 3, 5, 6, 7])
@pytest.mark.parametrize("method", [0, 1, 2])
def test_binary_trees(version, method):
    key, inline = version >= 6, version < 4
    read = trees.read_tree(trees.write_binary(sample_tree(), version, method))
    assert flat(read, key, inline) == flat(sample_tree(), key, inline)


@pytest.mark.parametrize("numbers", [True, False])
def test_xml_trees(numbers):
    written = trees.write_xml(sample_tree(), numbers)
    assert flat(trees.read_tree(written.encode())) == flat(sample_tree()) and ('type="22"' in written) == numbers
    assert trees.convert(trees.convert(written.encode(), ".lsf"), ".lsx").decode().count("<node") == written.count("<node")


def test_json_tree():
    data = b'\xef\xbb\xbf \n{"save": {"regions": {"R": {"A": {"type": 22, "value": "v"}, "B": {"type": "bool", "value": true}, "V": {"value": [1, 2.5, false]}, "H": {"type": "28", "handle": "h1", "version": 2}, "C": [{"D": {"type": 99, "value": 1}}]}, "skip": 3}}}'
    tree = trees.read_tree(data)
    assert [(n.id, n.parent, n.region) for n in tree.nodes] == [("R", -1, "R"), ("C", 0, "R")]
    assert [(a.id, a.type, a.value, a.handle, a.version) for a in tree.attributes[0].values()] == [("A", "FixedString", "v", None, None), ("B", "bool", "True", None, None), ("V", "None", "1 2.5 False", None, None), ("H", "TranslatedString", None, "h1", 2)]
    assert tree.attributes[1]["D"].type == "unknown_99" and tree.text(0, "H") == "h1" and tree.text(0, "none", "d") == "d"


@pytest.mark.parametrize("data", [b"<other/>", b"<save>", b"{", b"{}", b"LSOF\x09\0\0\0", b"LSOF", b""])
def test_bad_trees(data):
    with pytest.raises(trees.TreeError):
        trees.read_tree(data)


def test_damaged_binary_tree_never_fails_otherwise():
    raw = trees.write_binary(sample_tree(), 7)
    for i in range(8, len(raw), 3):
        for change in (0xFF, 0x00, 0x7F):
            bad = raw[:i] + bytes([change]) + raw[i + 1 :]
            try:
                trees.read_tree(bad)
            except trees.TreeError:
                pass
        with pytest.raises(trees.TreeError):
            trees.read_binary(raw[:i])


def test_xml_refuses_control_characters():
    tree = trees.Tree()
    tree.add(trees.Node("a", -1, "r"), [trees.Attribute("x", "string", "\x01")])
    with pytest.raises(trees.TreeError):
        trees.write_xml(tree)


def test_versions():
    packed = trees.pack_version((3, 6, 4, 0), trees.VERSION_32)
    assert packed == 0x36040000 and trees.version_parts(packed, trees.VERSION_32) == (3, 6, 4, 0)
    with pytest.raises(ValueError):
        trees.pack_version((16, 0, 0, 0), trees.VERSION_32)
    assert not trees.later_engine(3, 9, 9) and trees.later_engine(4, 0, 0x1A) and not trees.later_engine(4, 0, 0x19) and trees.later_engine(4, 1, 0)


def test_definitions():
    text = """
// comment
key "Base","10"
new itemcolor "x"
data "lost" "1"
new entry "A" // trailing
type "Weapon"
data "Range" "4 // kept"
data "Long" "one
  two" // end
new CraftingStationsItemComboPreviewData "y"
data "also" "lost"
new entry "B"
using "A"
data "Odd" "x)""
something else entirely
"""
    entries, constants = definitions.read(text)
    assert constants == {"Base": "10"} and [e["name"] for e in entries] == ["A", "B"]
    assert entries[0] == {"name": "A", "type": "Weapon", "using": None, "data": {"Range": "4 // kept", "Long": "onetwo"}}
    assert entries[1]["using"] == "A" and entries[1]["data"] == {"Odd": 'x)"'}
    again = definitions.read(definitions.write(entries[:1], constants))
    assert again == (entries[:1], constants) and definitions.write([]) == ""
    for bad in ('data "k"', 'new entry "A"\ndata "k"', 'new entry "A"\ndata "k" "v" x', 'type "x"', 'new entry "A\nnew entry "B"'):
        with pytest.raises(definitions.DefinitionError):
            definitions.read(bad)
    for value in ('a"b', "a\nb"):
        with pytest.raises(definitions.DefinitionError):
            definitions.write([{"name": "A", "type": "", "using": None, "data": {"k": value}}])


def test_localization():
    entries = [("h1", 2, "a & b"), ("h2", 1, "  spaced\n text ")]
    raw = localization.write(entries)
    assert localization.read(raw) == entries and localization.write(localization.read(raw)) == raw
    assert localization.read('<contentList><content contentuid="h" version="x"/><content version="3">no</content></contentList>') == [("h", 1, "")]
    for bad in (b"<other/>", b"<contentList>"):
        with pytest.raises(localization.LocalizationError):
            localization.read(bad)


def test_many_small_files_are_read_by_several_tasks_in_few_batches(tmp_path):
    import pyarrow as pa

    names = [f"Stats/{i}.txt" for i in range(70_000)]
    path = archives.write_archive(tmp_path / "many.pak", ((n, n.encode()) for n in names))
    reader = archives.ArchiveReader({"path": str(path), "content": "true"})
    runs = reader.partitions()
    assert len(runs) == 2
    read = pa.Table.from_batches([b for run in runs for b in reader.read(run)])
    assert read.column("name").to_pylist() == names and read.column("entry_ord").to_pylist() == list(range(70_000))
    assert read.column("content").to_pylist() == [n.encode() for n in names]
    docs = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)]), pa.array([f'new entry "P_{i}"\n'.encode() if i else None for i in range(1000)], pa.binary())], names=["doc", "content"])
    (batch,) = definitions._read(iter([docs]))
    assert batch.column("name").to_pylist() == [f"P_{i}" for i in range(1, 1000)]

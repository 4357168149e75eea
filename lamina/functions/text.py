"""Column functions over names, identifiers and markup; all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of identifiers; a handle's groups may have fewer digits than written in full.
UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
UUID_INSIDE = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
HANDLE = r"(?i)\Ah[0-9a-f]{1,8}(?:g[0-9a-f]{1,12}){4}\z"
# Typographic apostrophes that a search takes for the plain one.
APOSTROPHES = "\u2018\u2019\u02bc"
#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def id_kind(column: Column) -> Column:
    """``uuid``, ``handle`` or ``none``; null stays null."""
    return F.when(column.rlike(UUID), "uuid").when(column.rlike(HANDLE), "handle").when(column.isNotNull(), "none")


def stem(column: Column) -> Column:
    """The name without its last ``_`` and what follows; unchanged without one."""
    return F.regexp_replace(column, "_[^_]*$", "")


def numbered(column: Column) -> tuple[Column, Column]:
    """Name and number of ``Name 12`` or ``Name12``: letters and blanks, then digits; else the whole text and null."""
    pattern = r"\A([A-Za-z ]+?)\s*([0-9]+)\z"
    found = column.rlike(pattern)
    number = F.when(found, F.regexp_extract(column, pattern, 2)).try_cast("bigint")
    return F.when(found, F.regexp_extract(column, pattern, 1)).otherwise(column), number


def folded(column: Column) -> Column:
    """Lower case, with typographic apostrophes as plain ones."""
    return F.translate(F.lower(column), APOSTROPHES, "'" * len(APOSTROPHES))


def uuids(column: Column) -> Column:
    """All UUIDs in a text, in order."""
    return F.regexp_extract_all(column, F.lit(UUID_INSIDE), F.lit(0))


def handle_part(column: Column) -> Column:
    """The handle before the first ``;``, as it stands."""
    return F.substring_index(column, ";", 1)


def handle_key(column: Column) -> Column:
    """The handle before the first ``;`` without surrounding white space: the key of a text."""
    return F.regexp_replace(handle_part(column), r"\A\s+|\s+\z", "")


def integer_or(column: Column, default: int) -> Column:
    """The whole number that a text spells, else the default (also for null)."""
    return F.coalesce(F.trim(column).try_cast("bigint"), F.lit(default).cast("bigint"))


def version_fields(packed: Column, widths: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """The fields of a packed version as a struct, the first in the highest bits."""
    out, shift = [], sum(widths)
    for name, width in zip(names, widths, strict=True):
        shift -= width
        out.append(F.shiftrightunsigned(packed.cast("bigint"), shift).bitwiseAND(F.lit((1 << width) - 1)).alias(name))
    return F.struct(*out)


def version_packed(fields: list[Column], widths: tuple[int, ...]) -> Column:
    """The packed version of fields; null if one does not fit its bits."""
    value, fits = F.lit(0).cast("bigint"), F.lit(True)
    for part, width in zip(fields, widths, strict=True):
        value = F.shiftleft(value, width).bitwiseOR(part.cast("bigint"))
        fits = fits & (part >= 0) & (part < (1 << width))
    return F.when(fits, value)


def level_of(path: Column) -> Column:
    """The path part behind the first ``Levels``, else behind the first ``Globals``, else empty; case counts."""
    parts = F.split(path, "/")

    def behind(anchor: str) -> Column:
        at = F.array_position(parts, anchor)
        return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))

    return F.coalesce(behind("Levels"), behind("Globals"), F.lit(""))


def instance_kind(path: Column) -> Column:
    """What a level file holds: items before characters, null for anything else."""
    low = F.lower(path)
    return F.when(low.contains("/items/"), "item instance").when(low.contains("/characters/"), "character instance")


def path_matches(path: Column, suffixes: tuple[str, ...], markers: tuple[str, ...]) -> Column:
    """Whether a path ends with one of the suffixes and holds one of the markers, without regard to case."""
    low, no = F.lower(path), F.lit(False)
    ends, holds = no, no
    for s in suffixes:
        ends = ends | low.endswith(s)
    for m in markers:
        holds = holds | low.contains(m)
    return ends & holds


def true_size(uncompressed: Column, on_disk: Column) -> Column:
    """A stored file's size: what it unpacks to or, where none is declared, what is stored."""
    return F.when(uncompressed != 0, uncompressed).otherwise(on_disk)


def compression_method(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(0x0F))


def is_solid(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(0x04)) != 0


def bucket(column: Column, buckets: int = 0x200) -> Column:
    """The bucket of a name in a string table."""
    return F.crc32(F.encode(column, "UTF-8")).bitwiseAND(F.lit(buckets - 1))


def hrefs(column: Column) -> Column:
    """The double-quoted ``href`` values of a page, in order."""
    return F.regexp_extract_all(column, F.lit('href="([^"]*)"'), F.lit(1))


def tag_balance(column: Column) -> Column:
    """``depth, lowest``: open minus closed elements at the end, and the least such count on the way (0 at most)."""
    tags = F.regexp_extract_all(column, F.lit("</?[a-zA-Z][^<>]*>"), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, "^</?([a-zA-Z0-9]+)", 1))
    step = lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>") | name(t).isin(*VOID), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def merge(state: Column, tag: Column) -> Column:
        depth = state["depth"] + step(tag)
        return F.struct(depth.alias("depth"), F.least(state["lowest"], depth).alias("lowest"))

    return F.aggregate(tags, start, merge)

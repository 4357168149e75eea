"""Tiered look-ups: the first tier with a hit answers a query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import handle_key, numbered, stem


def best_tier(hits: DataFrame, query: str, tier: str) -> DataFrame:
    """The hits of each query's lowest tier, by an aggregate and a join, so that a query with many hits is not sorted."""
    best = hits.groupBy(F.col(query).alias("_q")).agg(F.min(tier).alias("_t"))
    return hits.join(best, (F.col(query) == F.col("_q")) & (F.col(tier) == F.col("_t")), "left_semi")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` any run, ``?`` one character, ``[seq]`` and ``[!seq]`` one of or none of.

    A bracket without an end stands for itself; the whole text has to match.
    """
    out, at = [], 0
    while at < len(glob):
        c, at = glob[at], at + 1
        end = glob.find("]", at + 1 + (glob[at : at + 1] == "!")) if c == "[" else -1
        if c in "*?":
            out.append({"*": ".*", "?": "."}[c])
        elif end > 0:
            inner = glob[at:end]
            negated, inner = inner.startswith("!"), inner.removeprefix("!")
            # a range that runs backwards holds nothing
            parts = re.findall(r"(?s)(.)-(.)|(.)", inner)
            held = "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" if a and a <= b else "" if a else f"\\x{{{ord(one):x}}}" for a, b, one in parts)
            out.append(f"[{'^' * negated}{held}]" if held else "." if negated else "(?!)")
            at = end + 1
        else:
            out.append(c if c.isalnum() else "\\" + c)
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_match(name: str, pattern: str) -> bool:
    """The same match for one name on the driver."""
    java = glob_pattern(pattern.lower()).replace("\\z", "\\Z")
    return re.search(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), java), name.lower()) is not None


def like_glob(column: Column, pattern: str) -> Column:
    """Whether the whole text matches a glob; case does not count."""
    return F.lower(column).rlike(glob_pattern(pattern.lower()))


def name_matches(column: Column, pattern: str) -> Column:
    """A glob if the pattern has one of ``*?[``, else a part of the name; case does not count."""
    return like_glob(column, pattern) if any(c in pattern for c in "*?[") else F.contains(F.lower(column), F.lit(pattern.lower()))


def any_glob(column: Column, patterns: list[str] | None) -> Column:
    """Whether one of several globs matches; no globs match all."""
    out = F.lit(not patterns)
    for p in patterns or ():
        out = out | like_glob(column, p)
    return out


def existence(names: DataFrame, known: DataFrame, name: str, other: str) -> DataFrame:
    """``name, found``: exact, case (only the case differs, in any part of the path) or missing."""
    exact = known.select(F.col(other).alias("_e")).distinct()
    lower = known.select(F.lower(other).alias("_l")).distinct()
    joined = names.join(exact, F.col(name) == F.col("_e"), "left").join(lower, F.lower(name) == F.col("_l"), "left")
    return joined.select(name, F.when(F.col("_e").isNotNull(), "exact").when(F.col("_l").isNotNull(), "case").otherwise("missing").alias("found"))


def suggestions(df: DataFrame, column: str, part: str, cap: int = 25) -> DataFrame:
    """The distinct values that hold ``part`` without regard to case, ``cap`` at most, in order."""
    return df.where(F.contains(F.lower(column), F.lit(part.lower()))).select(column).distinct().orderBy(column).limit(cap)


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` within each key."""
    span = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(span))


def exact_else_stem(names: DataFrame, known: DataFrame, name: str, other: str, found: str) -> DataFrame:
    """``names`` with ``found``: the known row of the exact name, else of the name without its last ``_`` part, else null.

    ``known`` has one row a name. Two equi-joins instead of one with OR, which would become a nested loop.
    """
    exact = known.select(F.col(other).alias("_e"), F.col(found).alias("_by_name"))
    cut = known.select(F.col(other).alias("_s"), F.col(found).alias("_by_stem"))
    joined = names.join(exact, F.col(name) == F.col("_e"), "left").join(cut, stem(F.col(name)) == F.col("_s"), "left")
    return joined.withColumn(found, F.coalesce("_by_name", "_by_stem")).drop("_e", "_s", "_by_name", "_by_stem")


def first_with_total(df: DataFrame, column: str, cap: int) -> DataFrame:
    """The first ``cap`` values and, with each, how many there are in all; the count is one scalar, not a window."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.select(column).orderBy(column).limit(cap).withColumn("total", total)


def resolve_text(df: DataFrame, handle: str, texts: DataFrame, key: str, text: str, name: str, default: Column) -> DataFrame:
    """``df`` with ``name``, the text of a handle (up to the first ``;``, without white space around it), else the default."""
    spoken = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    joined = df.join(spoken, handle_key(F.nullif(F.col(handle), F.lit(""))) == F.col("_key"), "left")
    return joined.withColumn(name, F.coalesce("_text", default)).drop("_key", "_text")


def with_base(instances: DataFrame, templates: DataFrame) -> DataFrame:
    """Instances with ``base_name`` of the template they are made from; one without ``stats`` has its template's."""
    base = templates.select(F.col("map_key").alias("_key"), F.col("stats").alias("_stats"), F.coalesce("name", F.lit("")).alias("_name"))
    joined = instances.join(base, F.col("parent_template") == F.col("_key"), "left")
    own = F.coalesce(F.nullif("stats", F.lit("")), "_stats", F.lit(""))
    return joined.withColumns({"stats": own, "base_name": F.coalesce("_name", F.lit(""))}).drop("_key", "_stats", "_name")


def solid_places(df: DataFrame, keys: list[str], order: list[str], offset: str, on_disk: str, unpacked: str, begin: int = 7) -> DataFrame:
    """``df`` with ``place``, where an entry begins in the unpacked frame, and ``due``, whether its offset follows the entry before.

    A window in each archive: an archive's entries are one task's, as they are one frame's.
    """
    span = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(span), F.lit(0))
    return df.withColumns({"place": before(unpacked), "due": F.col(offset) == begin + before(on_disk)})


def numbered_slots(df: DataFrame, keys: list[str], name: str, value: str, names: dict[str, str]) -> DataFrame:
    """``keys, slots``: fields like ``Object 2`` as an array of structs by number (10 after 9, gaps allowed).

    Of several values of one field the greatest counts; fields without a number or of another name are left out.
    """
    label, number = numbered(F.col(name))
    split = df.select(*keys, label.alias("_label"), number.alias("_number"), F.col(value).alias("_value")).where(F.col("_number").isNotNull() & F.col("_label").isin(*names))
    slots = split.groupBy(*keys, "_number").agg(*[F.max(F.when(F.col("_label") == n, F.col("_value"))).alias(c) for n, c in names.items()])
    ordered = F.array_sort(F.collect_list(F.struct("_number", *names.values())))
    return slots.groupBy(*keys).agg(F.transform(ordered, lambda x: F.struct(*[x[c].alias(c) for c in names.values()])).alias("slots"))

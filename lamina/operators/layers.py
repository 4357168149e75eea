"""Layered definitions: later layers win, earlier ones stay reachable.

All operators take any DataFrame with explicit order columns, since Spark rows have no order of their own.
Winners come from ``max_by`` over the order columns, so they are combined on the map side: a hot key shuffles
one row a task, and no key's rows are gathered or sorted.

Parent chains are followed to their ends, however deep: each round joins the steps found so far to themselves
and so doubles their length, and writes the outcome as a table, so a plan stays as small as one round.
"""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK_TABLES = "/tmp/checkpoints"


def shared_tables(spark) -> str:
    """The folder that driver and executors share; a default only on a local master, where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or FALLBACK_TABLES).rstrip("/")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in ``order``; keys may be null. Columns keep their names and order."""
    rest = [c for c in df.columns if c not in keys]
    won = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return won.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_place_last_value(df: DataFrame, key: str, place: str, value: str, order: list[str]) -> DataFrame:
    """``key, first_place, last_value``: a replaced key keeps its first place and takes the last value."""
    return df.groupBy(key).agg(F.min(place).alias("first_place"), F.max_by(value, F.struct(*order)).alias("last_value"))


def highest_version(df: DataFrame, key: str, version: Column, order: str, value: str) -> DataFrame:
    """``key, version, value`` of the highest version; among equal versions the later row wins, a null version loses.

    Versions below -1 never enter.
    """
    known = df.withColumn("_v", version).where(F.col("_v").isNull() | (F.col("_v") >= -1))
    best = known.groupBy(key).agg(F.max_by(F.struct("_v", value), F.struct("_v", order)).alias("_b"))
    return best.select(key, F.col("_b._v").alias("version"), F.col(f"_b.{value}").alias("value"))


def fill_missing(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """``primary`` and those rows of ``fallback`` whose key it lacks; a null key counts as lacking."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def previous_layer(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``previous``, the value of the layer below."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def changed(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``new`` that are absent from ``old`` or have another digest there (incremental export)."""
    before = old.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    return new.join(before, (F.col(key) == F.col("_k")) & F.col(digest).eqNullSafe(F.col("_d")), "left_anti")


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that driver and executors share."""
    spark = df.sparkSession
    path = f"{shared_tables(spark)}/lamina-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _nodes(df: DataFrame, key: str, parent: str, *more: Column) -> tuple[DataFrame, int]:
    """``k, p`` and more, written, and the number of distinct keys. A parent that is no key becomes null."""
    rows = _written(df.select(F.col(key).alias("k"), F.col(parent).alias("p"), *more))
    keys = rows.where("k IS NOT NULL").select(F.col("k").alias("_k")).distinct()
    known = rows.join(keys, F.col("p") == F.col("_k"), "left")
    return _written(known.withColumn("p", F.col("_k")).drop("_k")), keys.count()


def _nearest(rows: DataFrame, keys: int) -> DataFrame:
    """``k, v, depth`` (one row a path) of ``k, p, v``: the nearest value along the parents and the steps to it.

    After a round every row has looked at twice as many nodes; those still open once that is all keys are in a cycle.
    """
    state = _written(rows.select("k", F.when(F.col("v").isNull(), F.col("p")).alias("a"), "v", F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("seen")))
    reach = 1
    while reach < keys and not state.where("a IS NOT NULL").isEmpty():
        ahead = state.select(F.col("k").alias("_k"), F.col("a").alias("_a"), F.col("v").alias("_v"), F.col("depth").alias("_depth"), F.col("seen").alias("_seen"))
        moved = state.where("a IS NOT NULL").join(ahead, F.col("a") == F.col("_k"))
        moved = moved.select("k", F.col("_a").alias("a"), F.col("_v").alias("v"), (F.col("seen") + F.col("_depth")).alias("depth"), (F.col("seen") + F.col("_seen")).alias("seen"))
        state = _written(state.where("a IS NULL").unionByName(moved).distinct())
        reach *= 2
    return state.select("k", "v", "depth")


def resolve_chain(df: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """``key, value, depth``: the nearest value that is not null along the parent chain, and the steps to it.

    A chain that ends without a value, or is a cycle without one, gives null and a null depth.
    """
    rows, keys = _nodes(df, key, parent, F.col(value).alias("v"))
    found = F.col("v").isNotNull()
    won = _nearest(rows, keys).groupBy("k").agg(F.min_by("v", F.when(found, F.col("depth"))).alias(value), F.min(F.when(found, F.col("depth"))).cast("int").alias("depth"))
    return won.select(F.col("k").alias(key), value, "depth")


def layer_list(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``key, layers``: all values of a key in order, the last one being the one that counts."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(key).agg(F.transform(ordered, lambda x: x["_value"]).alias("layers"))


def ambiguous_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """``name, n``: the names that stand for several keys, and for how many."""
    return df.groupBy(name).agg(F.count_distinct(key).alias("n")).where("n > 1")


def unique_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """``name, key`` of the names that stand for exactly one key; ambiguous names are left out."""
    once = df.groupBy(name).agg(F.min(key).alias(key), F.max(key).alias("_top"))
    return once.where(F.col(key) == F.col("_top")).drop("_top")


def fold_entries(df: DataFrame, key: str, parent: str, entries: DataFrame, name: str, value: str, place: str | None = None) -> DataFrame:
    """``key, name, value, depth``: every entry that a key holds or inherits; the nearest ancestor's entry wins.

    ``entries`` has ``key, name, value``. After a round each key holds the entries of twice as many nodes, and of each
    name only the nearest, so what is written stays below the outcome in size. With ``place``, a number in ``entries``,
    the outcome also has ``first`` (steps to the farthest holder, negative, and the place there): names in that order
    stand as if the farthest ancestor's entries were overwritten in their places by each nearer one's.
    """
    rows, keys = _nodes(df, key, parent)
    at = F.col(place).cast("long") if place else F.lit(0).cast("long")
    far = F.struct(F.lit(0).cast("long").alias("steps"), at.alias("place"))
    own = entries.select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(value).alias("v"), F.lit(0).alias("depth"), far.alias("first"))
    held = _written(own.join(rows.select("k").distinct(), "k", "left_semi"))
    hops, reach = rows.where("k IS NOT NULL AND p IS NOT NULL").distinct(), 1

    def nearest(found: DataFrame) -> DataFrame:
        return found.groupBy("k", "n").agg(F.min_by("v", "depth").alias("v"), F.min("depth").alias("depth"), F.min("first").alias("first"))

    while reach < keys and not hops.isEmpty():
        above = hops.join(held.withColumnRenamed("k", "p"), "p")
        above = above.select("k", "n", "v", (F.col("depth") + reach).alias("depth"), F.struct((F.col("first.steps") - reach).alias("steps"), F.col("first.place").alias("place")).alias("first"))
        held = _written(nearest(held.unionByName(above)))
        hops = _written(hops.join(hops.select(F.col("k").alias("p"), F.col("p").alias("_p")), "p").select("k", F.col("_p").alias("p")).distinct())
        reach *= 2
    won = nearest(held).select(F.col("k").alias(key), F.col("n").alias(name), F.col("v").alias(value), "depth", "first")
    return won if place else won.drop("first")


def flag_cycles(df: DataFrame, key: str, parent: str) -> DataFrame:
    """``key, steps, cyclic``: whether the parent chain from a key comes back to a node it has passed.

    ``steps`` counts the parents followed; a parent that is null or no key of ``df`` ends a chain. A key has one parent.
    """
    rows, keys = _nodes(df, key, parent)
    if rows.where("k IS NOT NULL").groupBy("k").agg(F.count_distinct(F.struct("p")).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("flag_cycles: a key has several parents")
    rows = rows.distinct()
    state, reach = _written(rows.select("k", F.col("p").alias("a"), F.col("p").isNotNull().cast("long").alias("steps"), F.col("k").alias("least"))), 1
    while reach < keys and not state.where("a IS NOT NULL").isEmpty():
        ahead = state.select(F.col("k").alias("_k"), F.col("a").alias("_a"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
        moved = state.where("a IS NOT NULL").join(ahead, F.col("a") == F.col("_k"))
        moved = moved.select("k", F.col("_a").alias("a"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"))
        state = _written(state.where("a IS NULL").unionByName(moved))
        reach *= 2
    # as many steps as there are keys end on a cycle, and all of a cycle's nodes are reached so
    ring = state.where("a IS NOT NULL").select(F.col("a").alias("k")).distinct().join(state.select("k", "least"), "k")
    around = ring.join(ring.groupBy("least").agg(F.count(F.lit(1)).alias("v")), "least").select("k", "v")
    tails = _nearest(_written(rows.join(around, "k", "left")), keys).where("v IS NOT NULL").select("k", (F.col("depth") + F.col("v")).alias("_round"))
    steps = F.coalesce("_round", "steps").cast("int")
    return state.join(tails, "k", "left").groupBy("k").agg(F.max(steps).alias("steps"), F.bool_or(F.col("a").isNotNull()).alias("cyclic")).select(F.col("k").alias(key), "steps", "cyclic")

"""Layered definitions that build on each other: previous layers, other names, resolved data and types.

A definition is one layer of a name. It builds on the layer below if it names itself, else on the latest layer of
another name; a missing target ends the chain. Chains are followed by pointer doubling (see ``layers``), to any depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import layers


def definition_graph(defs: DataFrame, order: list[str]) -> DataFrame:
    """``defs`` (``name, type, using, data`` and ``order``) with ``layer``, ``latest``, ``id`` and ``parent``.

    ``id`` names a definition, ``parent`` the one it builds on (null: none). ``first_order`` is the order of the name's
    first layer: replaced names keep their place.
    """
    own = Window.partitionBy("name").orderBy(*order)
    numbered = defs.withColumn("layer", F.row_number().over(own) - 1)
    last = numbered.groupBy("name").agg(F.max("layer").alias("last"), F.min(F.struct(*order)).alias("first_order"))
    made = lambda name, layer: F.concat(F.col(layer).cast("string"), F.lit("/"), F.col(name))
    joined = numbered.join(last, "name").withColumn("id", made("name", "layer")).withColumn("latest", F.col("layer") == F.col("last"))
    target = last.select(F.col("name").alias("_target"), F.col("last").alias("_last"))
    linked = joined.join(target, (F.col("using") == F.col("_target")) & (F.col("using") != F.col("name")), "left")
    below = F.when(F.col("layer") > 0, F.concat((F.col("layer") - 1).cast("string"), F.lit("/"), F.col("name")))
    parent = F.when(F.col("using") == F.col("name"), below).otherwise(made("_target", "_last"))
    return linked.withColumn("parent", parent).drop("_target", "_last", "last")


def resolved_types(graph: DataFrame) -> DataFrame:
    """``name, type`` of each name: the first type that is not empty along its chain, else empty (also on a cycle)."""
    typed = graph.select("id", "parent", F.nullif(F.col("type"), F.lit("")).alias("type"))
    found = layers.resolve_chain(typed, "id", "parent", "type").select("id", F.coalesce("type", F.lit("")).alias("type"))
    return graph.where("latest").select("id", "name").join(found, "id").select("name", "type")


def resolved_entries(graph: DataFrame) -> DataFrame:
    """``name, key, value, place``: a name's own and inherited entries; ``place`` orders them, the oldest ancestor's first."""
    entries = graph.select("id", F.posexplode("data").alias("place", "key", "value"))
    folded = layers.fold_entries(graph.select("id", "parent"), "id", "parent", entries, "key", "value", place="place")
    return graph.where("latest").select("id", "name").join(folded, "id").select("name", "key", "value", F.col("first").alias("place"))


def cyclic_names(graph: DataFrame) -> DataFrame:
    """``name`` of those whose chain comes back to a definition it has passed: their data cannot be resolved."""
    found = layers.flag_cycles(graph.select("id", "parent"), "id", "parent").where("cyclic").select("id")
    return graph.where("latest").join(found, "id", "left_semi").select("name")


def resolved(graph: DataFrame) -> DataFrame:
    """``name, entries, data, error``: all entries of a name in order, as structs and as a map; an error in their place where its chain is a cycle."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", "key", "value"))), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    held = resolved_entries(graph).groupBy("name").agg(each.alias("entries"))
    cyclic = cyclic_names(graph).select("name", F.lit("inheritance cycle").alias("error"))
    out = graph.where("latest").select("name").join(held, "name", "left").join(cyclic, "name", "left")
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    out = out.withColumn("entries", F.when(F.col("error").isNull(), F.coalesce("entries", none)))
    return out.select("name", "entries", F.map_from_entries("entries").alias("data"), "error")

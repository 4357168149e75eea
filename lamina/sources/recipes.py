"""Recipes: blocks of numbered fields. The reader gives plain lines; numbering, pivot and linking are DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import numbered, stem
from lamina.sources.definitions import directives, text_of
from lamina.sources.trees import gathered

# Fields of ingredients and results, by their name in lower case without blanks.
INGREDIENT = {"type": "type", "object": "object", "combine": "combine", "transform": "transform", "ingredienttype": "type", "ingredient": "object"}
RESULT = {"result": "object", "resultamount": "amount", "boost": "boost"}
LINES = "doc string, block int, kind string, name string, line int, key string, value string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"new ItemCombination": "recipe", "new ItemCombinationResult": "result"}

    def rows_of(doc: str, data: bytes) -> list[tuple]:
        rows, block, kind, name = [], -1, None, None
        for line, keyword, given in directives(text_of(data), comments=False):
            if keyword.startswith("new "):
                block, kind, name = block + 1, kinds.get(keyword), given[0]
                if kind:
                    rows.append((doc, block, kind, name, line, None, None))
            elif keyword == "data" and len(given) > 1 and kind:
                rows.append((doc, block, kind, name, line, given[0], given[1]))
        return rows

    return gathered(batches, rows_of, LINES)


def lines(files: DataFrame) -> DataFrame:
    """``LINES`` of documents given as ``doc, content``: a row for each block (null key) and each of its fields."""
    return files.select("doc", "content").mapInArrow(_lines, LINES)


def _items(fields: DataFrame, keys: list[str], names: dict[str, str], defaults: dict[str, str], order: str) -> DataFrame:
    """Numbered fields as an array of structs by number; of several values of a field the last one counts."""
    values = [F.coalesce(F.max_by("value", F.when(F.col("attribute") == a, F.col(order))), F.lit(d)).alias(a) for a, d in defaults.items()]
    slots = fields.where(F.col("attribute").isin(*set(names.values()))).groupBy(*keys, "number").agg(*values)
    sorted_ = F.array_sort(F.collect_list(F.struct("number", *defaults)))
    return slots.groupBy(*keys).agg(F.transform(sorted_, lambda x: F.struct(*[x[a].alias(a) for a in defaults])).alias("items"))


def _attribute(name: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(known, F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("")))


def recipes(read: DataFrame) -> DataFrame:
    """``doc, first_block, name, ingredients, results, data`` of the documents' lines.

    Of several blocks of a name in one document the last gives the ingredients, later fields replace earlier ones, and
    all linked results follow each other. A result belongs to the recipe of its document that has its name or, without
    one, its name up to the last ``_``; results without a recipe are left out.
    """
    name, number = numbered(F.col("key"))
    split = read.withColumn("number", number)
    heads = read.where("kind = 'recipe'").groupBy("doc", "name").agg(F.min("block").alias("first_block"), F.max("block").alias("block"))
    own = split.where("kind = 'recipe' AND key IS NOT NULL").withColumn("attribute", F.when(F.col("number").isNotNull(), _attribute(name, INGREDIENT)))
    made = _items(own, ["doc", "block"], INGREDIENT, {"object": "", "type": "", "combine": "", "transform": ""}, "line").withColumnRenamed("items", "ingredients")
    plain = own.where("attribute IS NULL").groupBy("doc", "name", "key").agg(F.max_by("value", "line").alias("value"), F.min("line").alias("line"))
    data = plain.groupBy("doc", "name").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("line", "key", "value"))), lambda x: F.struct(x["key"], x["value"]))).alias("data"))

    parts = split.where("kind = 'result' AND key IS NOT NULL AND number IS NOT NULL").withColumn("attribute", _attribute(name, RESULT))
    items = _items(parts, ["doc", "block", "name"], RESULT, {"object": "", "amount": "1", "boost": ""}, "line")
    known = heads.select("doc", F.col("name").alias("recipe"))
    exact = items.join(known, (items["doc"] == known["doc"]) & (items["name"] == known["recipe"]), "left").select(items["*"], "recipe")
    by_stem = known.select(F.col("doc").alias("_d"), F.col("recipe").alias("_s"))
    owned = exact.join(by_stem, exact["recipe"].isNull() & (exact["doc"] == F.col("_d")) & (stem(exact["name"]) == F.col("_s")), "left")
    owned = owned.select("doc", F.coalesce("recipe", "_s").alias("name"), "block", F.filter("items", lambda x: x["object"] != "").alias("items")).where("name IS NOT NULL")
    gained = owned.groupBy("doc", "name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "items"))), lambda x: x["items"])).alias("results"))

    joined = heads.join(made, ["doc", "block"], "left").join(gained, ["doc", "name"], "left").join(data, ["doc", "name"], "left")
    empty = lambda c, like: F.coalesce(F.col(c), F.expr(like))
    return joined.select(
        "doc", "first_block", "name",
        empty("ingredients", "cast(array() as array<struct<object:string,type:string,combine:string,transform:string>>)").alias("ingredients"),
        empty("results", "cast(array() as array<struct<object:string,amount:string,boost:string>>)").alias("results"),
        empty("data", "cast(map() as map<string,string>)").alias("data"),
    )

"""Queries that write the verification tables with the library's writers, read them back, and layer and search them."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import find, inherit, layers
from lamina.operators.collection import Collection
from lamina.plans.catalogue import register, table
from lamina.plans.fixtures import dealt, encoded, shared_folder, write_archives
from lamina.sources import archives, codecs, definitions, localization, recipes, trees


def _padded(column: str):
    return F.lpad(F.col(column).cast("string"), 9, "0")


@register("""with k as (select p_partkey, '00' || p_partkey as name from part)
 select p_partkey % 3 as method, 'Public/' || lpad(cast(p_partkey as varchar), 9, '0') || '.txt' as name, p_name || ' ' || p_brand as content, length(p_name || ' ' || p_brand) as size from k join part using (p_partkey)""")
def q41_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of both written versions and all written methods, read back with their entries' sizes."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("Public/"), _padded("p_partkey"), F.lit(".txt")).alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("content"))
    out = None
    for method in (codecs.STORED, codecs.ZLIB, codecs.LZ4):
        paths = write_archives(part.where(F.col("ord") % 3 == method), shared_folder(spark), 3, 10 if method == codecs.ZLIB else 13, method)
        files = archives.listing(spark, paths, content=True).join(archives.listing(spark, paths).select("name", "size"), "name")
        read = files.select(F.lit(method).alias("method"), "name", F.decode("content", "UTF-8").alias("content"), "size")
        out = read if out is None else out.union(read)
    return out


def _tree(row: dict) -> trees.Tree:
    """A customer as a tree: an object with attributes of several types, and a child."""
    tree = trees.Tree()
    top = tree.add(trees.Node("Templates", -1, "Templates"), [])
    own = tree.add(
        trees.Node("GameObjects", top, "Templates"),
        [
            trees.Attribute("MapKey", "FixedString", row["doc"]), trees.Attribute("Name", "LSString", row["c_name"]), trees.Attribute("Nation", "int32", str(row["c_nationkey"])),
            trees.Attribute("Balance", "double", repr(row["c_acctbal"])), trees.Attribute("Rich", "bool", str(row["c_acctbal"] > 5000)), trees.Attribute("DisplayName", "TranslatedString", row["c_mktsegment"], f"h{row['doc']}"),
        ],
    )
    tree.add(trees.Node("Child", own, "Templates"), [trees.Attribute("Big", "uint64", str(9007199254740993 + row["c_nationkey"]))])
    return tree


def _json(row: dict) -> bytes:
    import json

    own = {"MapKey": {"type": "FixedString", "value": row["doc"]}, "Name": {"type": 23, "value": row["c_name"]}, "Nation": {"type": "int32", "value": row["c_nationkey"]}, "Balance": {"type": "double", "value": row["c_acctbal"]}}
    own |= {"Rich": {"type": "bool", "value": row["c_acctbal"] > 5000}, "DisplayName": {"type": "TranslatedString", "handle": f"h{row['doc']}", "value": row["c_mktsegment"]}}
    own["Child"] = [{"Big": {"type": "24", "value": 9007199254740993 + row["c_nationkey"]}}]
    return b"\xef\xbb\xbf" + json.dumps({"save": {"regions": {"Templates": {"GameObjects": [own]}}}}).encode()


@register("""with c as (select c_custkey, cast(c_custkey as varchar) as doc, c_name, c_nationkey, c_mktsegment from customer)
 select doc, 1 as depth, 'MapKey' as id, 'FixedString' as type, doc as value, cast(null as varchar) as handle from c
 union all select doc, 1, 'Name', 'LSString', c_name, null from c union all select doc, 1, 'Nation', 'int32', cast(c_nationkey as varchar), null from c
 union all select doc, 1, 'DisplayName', 'TranslatedString', case when c_custkey % 11 in (6, 7) then null else c_mktsegment end, 'h' || doc from c
 union all select doc, 2, 'Big', 'uint64', cast(9007199254740993 + c_nationkey as varchar), null from c""")
def q42_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Trees in XML, JSON and every written binary version and method; the kind is told from the bytes."""

    def make(row: dict) -> bytes:
        way = row["c_custkey"] % 11
        if way < 2:
            return trees.write_xml(_tree(row), numbers=bool(way)).encode()
        if way == 2:
            return _json(row)
        version = {3: 1, 4: 2, 5: 3, 6: 6, 7: 7}.get(way, 3)
        return trees.write_binary(_tree(row), version, way % 3)

    rows = table(spark, sf, "customer").withColumn("doc", F.col("c_custkey").cast("string"))
    files = layers._written(encoded(rows, make))
    depth = trees.nodes(files).select("doc", "node_idx", "depth")
    read = trees.attributes(files).where("id NOT IN ('Balance', 'Rich')").join(depth, ["doc", "node_idx"])
    return read.select("doc", "depth", "id", "type", "value", "handle")


def _definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Layered definitions of parts: a base, one on another name, one on its own earlier layer; ``doc, ord`` give the order."""
    key = F.col("p_partkey")
    part = table(spark, sf, "part")
    name = lambda c: F.concat(F.lit("P_"), c.cast("string"))
    entries = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v, c in pairs]), lambda x: x.isNotNull()))
    always = F.lit(True)
    first = part.select(
        key.alias("p"), F.lit("0").alias("layer"), name(key).alias("name"), F.when(key % 7 == 0, F.col("p_type")).otherwise("").alias("type"), F.when(key > 0, name(F.floor(key / 2))).alias("using"),
        entries(("Brand", F.col("p_brand"), key % 3 == 0), ("Size", F.col("p_size"), always), (" Name", F.col("p_name"), key % 5 == 0)).alias("data"),
    )
    second = part.where(key % 4 == 1).select(key.alias("p"), F.lit("1").alias("layer"), name(key).alias("name"), F.lit("").alias("type"), name(key).alias("using"), entries(("Size", F.concat(F.lit("+"), F.col("p_size")), always), ("Patch", key, always)).alias("data"))
    return first.union(second)


def _definition_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same as text, written by the library; a file for each ten definitions."""
    rows = _definitions(spark, sf).withColumn("doc", F.concat("layer", F.lit("/"), F.lpad(F.floor(F.col("p") / 10).cast("string"), 9, "0")))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("p", "name", "type", "using", F.map_entries("data").alias("data")))), lambda x: x)
    grouped = rows.groupBy("doc").agg(packed.alias("entries"))

    def make(row: dict) -> bytes:
        held = [{"name": e["name"], "type": e["type"], "using": e["using"], "data": {d["key"]: d["value"] for d in e["data"]}} for e in row["entries"]]
        written = definitions.write(held, {f"G{row['doc'][-1]}": row["doc"]})
        # what the reader has to see through: comments, blocks of other kinds, a value over two lines
        return ("// written for a query\nnew itemcolor \"x\",\"y\"\n" + written.replace('data "Patch"', '  data   "Patch"') + '\nnew entry "W"\ndata "Long" "one\n two" // end\n').encode()

    return encoded(grouped, make)


DEFINED = """d as (select p_partkey as p, 0 as layer, 'P_' || p_partkey as name, case when p_partkey % 7 = 0 then p_type else '' end as type, case when p_partkey > 0 then 'P_' || (p_partkey // 2) end as using from part
 union all select p_partkey, 1, 'P_' || p_partkey, '', 'P_' || p_partkey from part where p_partkey % 4 = 1),
 e as (select p_partkey as p, 0 as layer, 'Brand' as key, p_brand as value, 0 as place from part where p_partkey % 3 = 0 union all select p_partkey, 0, 'Size', cast(p_size as varchar), 1 from part
 union all select p_partkey, 0, ' Name', p_name, 2 from part where p_partkey % 5 = 0 union all select p_partkey, 1, 'Size', '+' || p_size, 0 from part where p_partkey % 4 = 1
 union all select p_partkey, 1, 'Patch', cast(p_partkey as varchar), 1 from part where p_partkey % 4 = 1)"""


@register(f"with {DEFINED} select cast(d.layer as varchar) as layer, d.name, d.type, d.using, e.key, e.value from d join e on d.p = e.p and d.layer = e.layer")
def q43_definition_text(spark: SparkSession, sf: str) -> DataFrame:
    read = definitions.definitions(_definition_files(spark, sf)).where("kind = 'definition' AND name <> 'W'")
    return read.select(F.substring("doc", 1, 1).alias("layer"), "name", "type", "using", F.explode("data").alias("key", "value"))


@register("select 'G' || (k % 10) as key, max(doc) as value from (select p_partkey // 10 as k, '0/' || lpad(cast(p_partkey // 10 as varchar), 9, '0') as doc from part union all select p_partkey // 10, '1/' || lpad(cast(p_partkey // 10 as varchar), 9, '0') from part where p_partkey % 4 = 1) group by 1 union all select 'W', 'onetwo'")
def q44_globals_and_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    read = layers._written(definitions.definitions(_definition_files(spark, sf)))
    constants = layers.last_wins(read.where("kind = 'global'").select(F.col("name").alias("key"), "value", "doc"), ["key"], ["doc"]).select("key", "value")
    wrapped = read.where("name = 'W'").select(F.col("name").alias("key"), F.element_at("data", F.lit("Long")).alias("value")).distinct()
    return constants.union(wrapped)


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    read = definitions.definitions(_definition_files(spark, sf)).where("kind = 'definition' AND name <> 'W'")
    return layers._written(inherit.definition_graph(read.select("doc", "ord", "name", "type", "using", "data"), ["doc", "ord"]))


CHAIN = f"""with recursive {DEFINED},
 last as (select name, max(layer) as layer from d group by 1),
 up as (select d.name as root, d.p, d.layer, d.using, d.name, d.type, 0 as depth from d join last using (name, layer)
 union all select up.root, d.p, d.layer, d.using, d.name, d.type, up.depth + 1 from up join d on (up.using = up.name and d.name = up.name and d.layer = up.layer - 1) or (up.using <> up.name and d.name = up.using and d.layer = (select l.layer from last l where l.name = up.using)))"""


@register(f"""{CHAIN} select root as name, string_agg(key || '=' || value, ';' order by far, first_place) as data from
 (select root, key, arg_min(value, depth) as value, -max(depth) as far, arg_max(place, depth) as first_place from up join e on up.p = e.p and up.layer = e.layer group by 1, 2) group by 1""")
def q45_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Own and inherited entries of each definition's latest layer, the oldest ancestor's first."""
    data = inherit.resolved(_graph(spark, sf))
    return data.select("name", F.array_join(F.transform(F.map_entries("data"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("data"))


@register(f"{CHAIN} select root as name, coalesce(arg_min(type, depth) filter (where type <> ''), '') as type from up group by 1")
def q46_resolved_types(spark: SparkSession, sf: str) -> DataFrame:
    return inherit.resolved_types(_graph(spark, sf))


@register("""with l as (select doc_id, 'h' || (doc_id // 3) as handle, case when doc_id % 5 = 0 then 1 else doc_id % 4 - 2 end as version, replace(replace(text, chr(13), ''), chr(0), '') as text from documents where not regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))
 select handle, version, text from l where version >= -1 qualify row_number() over (partition by handle order by version desc, doc_id desc) = 1""")
def q47_localization(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all documents as localization files, read back; of each handle the highest version, of equal ones the last."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").where(~F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    version = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(F.col("doc_id") % 4 - 2)
    rows = docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("doc"), F.floor(F.col("doc_id") / 3).cast("string").alias("h"), version.alias("version"), F.replace("text", F.lit("\r"), F.lit("")).alias("text"))

    def make(row: dict) -> bytes:
        shown = "x" if row["version"] == 1 and row["doc"].endswith("5") else row["version"]
        return localization.write([(f" h{row['h']} ;7", shown, row["text"])]).replace(b"<contentList>", b'<contentList><content version="9">no handle</content>')

    read = localization.entries(encoded(rows, make)).where("error IS NULL")
    return layers.highest_version(read.withColumn("handle", text.handle_key(F.col("handle"))), "handle", F.col("version"), "doc", "text").withColumnRenamed("value", "text")


@register("""with l as (select l_orderkey as o, l_linenumber as n, l_partkey as p, l_quantity as q from lineitem),
 r as (select o_orderkey as o, 'R_' || o_orderkey as name from orders where o_orderkey in (select o from l))
 select r.name, (select string_agg('O_' || p || '/' || case when n % 2 = 0 then 'Base' else '' end, ',' order by n) from (select n, arg_max(p, p) as p from l where l.o = r.o group by n)) as ingredients,
 'C_' || r.o || ' x' || case when r.o % 3 = 0 then '2' else '1' end as results, case when r.o % 2 = 0 then 'yes' else '' end as kept from r where r.o % 5 <> 0
 union all select r.name, (select string_agg('O_' || p || '/' || case when n % 2 = 0 then 'Base' else '' end, ',' order by n) from (select n, arg_max(p, p) as p from l where l.o = r.o group by n)), '', case when r.o % 2 = 0 then 'yes' else '' end from r where r.o % 5 = 0""")
def q48_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recipes: numbered fields in any order, results before or behind their recipe, by name or stem, or of no recipe."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("p"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    rows = rows.select(F.col("l_orderkey").cast("string").alias("doc"), F.col("l_orderkey").alias("o"), "lines")

    def make(row: dict) -> bytes:
        o, lines = row["o"], [f'new ItemCombination "R_{row["o"]}"']
        if o % 2 == 0:
            lines.append('data "Kept" "yes"')
        for item in row["lines"]:  # several of one number: the last one counts
            n = item["l_linenumber"]
            lines += [f'data "Object{" " * (n % 2)}{n}" "O_{item["p"]}"'] + [f'data "Combine {n}" "Base"'] * (n % 2 == 0)
        owner = f"R_{o}" if o % 2 else f"R_{o}_a1"
        result = [f'new ItemCombinationResult "{owner if o % 5 else "Nothing_1"}"', f'data "Result 10" "C_{o}"', 'data "Result 2" ""', *[f'data "ResultAmount 10" "2"'] * (o % 3 == 0)]
        other = ["new CraftingStationsItemComboPreviewData \"x\"", 'data "Object 1" "not this"']
        return "\n".join([*result, *other, *lines] if o % 7 else [*lines, *other, *result]).encode()

    read = recipes.recipes(layers._written(recipes.lines(encoded(rows, make))))
    takes = F.array_join(F.transform("ingredients", lambda x: F.concat(x["object"], F.lit("/"), x["combine"])), ",")
    makes = F.array_join(F.transform("results", lambda x: F.concat(x["object"], F.lit(" x"), x["amount"])), ",")
    return read.select("name", takes.alias("ingredients"), makes.alias("results"), F.coalesce(F.try_element_at("data", F.lit("Kept")), F.lit("")).alias("kept"))


def sample_collection(spark: SparkSession, sf: str) -> Collection:
    """An installation of parts (templates), suppliers (instances), definitions, texts and recipes, in a base and a patch archive."""
    folder = shared_folder(spark)
    (folder / "Localization").mkdir()
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")

    def uuid_of(kind: str, key: int) -> str:
        return f"{kind}0000000-0000-0000-0000-{key:012d}"

    def objects(rows: list[dict]) -> trees.Tree:
        tree = trees.Tree()
        top = tree.add(trees.Node("Templates", -1, "Templates"), [])
        for r in rows:
            tree.add(trees.Node("GameObjects", top, "Templates"), [trees.Attribute(k, "TranslatedString", None, v) if k == "DisplayName" else trees.Attribute(k, "FixedString", v) for k, v in r.items() if v is not None])
        return tree

    def template(row: dict) -> bytes:
        p = row["k"]
        own = {"MapKey": uuid_of("a", p), "Name": f"T_{p}", "Type": "item", "Stats": f"P_{p}" if p % 2 else None, "DisplayName": f"h{p:x}g1g2g3g4;1"}
        return trees.write_binary(objects([own])) if p % 2 else trees.write_xml(objects([own])).encode()

    def instance(row: dict) -> bytes:
        return trees.write_xml(objects([{"MapKey": uuid_of("b", row["k"]), "Name": f"S_{row['k']}", "TemplateName": uuid_of("a", row["k"])}])).encode()

    def stats(row: dict) -> bytes:
        p = row["k"]
        return definitions.write([{"name": f"P_{p}", "type": "Weapon" if p % 2 else "", "using": None, "data": {"Size": str(p)} | ({"DisplayName": f"hffffg{p:x}g1g1g1;2"} if p % 3 == 0 else {})}]).encode()

    def spoken(row: dict) -> bytes:
        p = row["k"]
        return localization.write([(f"h{p:x}g1g2g3g4", 1, f"{row['name']}’s {p}"), (f"hffffg{p:x}g1g1g1", 1, f"Unique {row['name']} {p}")])

    def combos(row: dict) -> bytes:
        p = row["k"]
        return f'new ItemCombination "Rec_{p}"\ndata "Object 1" "Only_{p}"\ndata "Object 2" "P_{p}"\nnew ItemCombinationResult "Rec_{p}_1"\ndata "Result 1" "Made_{p}"\n'.encode()

    keyed = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    placed = supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    made = [(keyed, "Public/Base/RootTemplates/", ".lsx", template), (keyed, "Public/Base/Stats/Generated/Data/", ".txt", stats), (keyed, "Public/Base/Stats/Generated/ItemCombos/", ".txt", combos), (placed, "Mods/Base/Levels/Town/Items/", ".lsx", instance)]
    # the patch gives every ninth template another name; its definitions are layered, not replaced
    patched = lambda r: trees.write_xml(objects([{"MapKey": uuid_of("a", r["k"]), "Name": f"New_{r['k']}", "Stats": f"P_{r['k']}", "DisplayName": f"h{r['k']:x}g1g2g3g4"}])).encode()

    def put(rows: DataFrame, make, where: str, suffix: str, target: Path, number: int, prefix: str) -> None:
        # written first: placing the files by range would make each of them twice
        files = layers._written(encoded(dealt(rows.withColumn("doc", F.col("k").cast("string"))), make))
        files = files.select(F.col("doc").cast("long").alias("ord"), F.concat(F.lit(where), "doc", F.lit(suffix)).alias("name"), "content")
        write_archives(files, target, number, prefix=prefix)

    jobs = [(rows, make, where, suffix, folder, 2, f"Base{i}") for i, (rows, where, suffix, make) in enumerate(made)]
    jobs += [(keyed, spoken, "text/", ".xml", folder / "Localization", 1, "English"), (keyed.where("k % 9 = 0"), patched, "Public/Base/RootTemplates/", ".lsx", folder, 1, "Patch2")]
    with ThreadPool(len(jobs)) as pool:  # an archive is one task's, so several are written at once
        pool.starmap(put, jobs)
    return Collection(spark, folder)


SAMPLE = """t as (select p_partkey as k, p_name, 'a0000000-0000-0000-0000-' || lpad(cast(p_partkey as varchar), 12, '0') as map_key, case when p_partkey % 9 = 0 then 'New_' || p_partkey else 'T_' || p_partkey end as name, p_name || chr(8217) || 's ' || p_partkey as display_name,
 case when p_partkey % 9 = 0 or p_partkey % 2 = 1 then 'P_' || p_partkey else '' end as stats from part),
 i as (select s_suppkey as k, 'b0000000-0000-0000-0000-' || lpad(cast(s_suppkey as varchar), 12, '0') as map_key, 'S_' || s_suppkey as name from supplier)"""


@register(f"""with {SAMPLE} select map_key, name, display_name, case when k % 9 = 0 then '' else 'item' end as type, stats, '' as level, '' as parent_template from t
 union all select map_key, name, '', 'item instance', '', 'Town', 'a0000000-0000-0000-0000-' || lpad(cast(k as varchar), 12, '0') from i""")
def q49_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Templates and instances of layered archives."""
    return find.objects(sample_collection(spark, sf)).select("map_key", "name", "display_name", "type", "stats", "level", "parent_template")


@register(f"""with {SAMPLE} select 'A0000000-0000-0000-0000-' || lpad(cast(k as varchar), 12, '0') as query, 1 as tier, 0 as rank, map_key as key from t where k < 20
 union all select 'h' || printf('%x', k) || 'g1g2g3g4', 2, -1, 'h' || printf('%x', k) || 'g1g2g3g4' from t where k < 20 union all select 'h' || printf('%x', k) || 'g1g2g3g4', 2, 0, map_key from t where k < 20
 union all select 'P_' || k, 3, 2, 'P_' || k from t where k < 20 union all select lower(name), 4, 0, map_key from t where k < 20 union all select upper(name), 4, 1, map_key from i where k < 20
 union all select upper(p_name) || '''S ' || k, 5, 0, map_key from t where k < 20 union all select 'unique ' || p_name || ' ' || k, 6, 2, 'P_' || k from t where k < 20 and k % 3 = 0
 union all select 'Only_' || k, 7, 3, 'Rec_' || k from t where k < 20 union all select 'Made_' || k, 7, 3, 'Rec_' || k from t where k < 20""")
def q50_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """One query for each tier of the search and each of twenty keys, among them spellings that only folding matches."""
    held = sample_collection(spark, sf)
    part, supplier = table(spark, sf, "part").where("p_partkey < 20"), table(spark, sf, "supplier").where("s_suppkey < 20")
    k = F.col("p_partkey")
    asked = [
        F.concat(F.lit("A0000000-0000-0000-0000-"), F.lpad(k.cast("string"), 12, "0")), F.concat(F.lit("h"), F.lower(F.hex(k)), F.lit("g1g2g3g4")), F.concat(F.lit(" P_"), k.cast("string")),
        F.concat(F.when(k % 9 == 0, "new_").otherwise("t_"), k.cast("string")), F.concat(F.upper("p_name"), F.lit("'S "), k.cast("string")), F.when(k % 3 == 0, F.concat(F.lit("unique "), "p_name", F.lit(" "), k.cast("string"))),
        F.concat(F.lit("Only_"), k.cast("string")), F.concat(F.lit("Made_"), k.cast("string")),
    ]
    queries = part.select(F.explode(F.array(*asked)).alias("query")).union(supplier.select(F.concat(F.lit("S_"), F.col("s_suppkey").cast("string")))).where("query IS NOT NULL")
    return find.candidates(held, queries)

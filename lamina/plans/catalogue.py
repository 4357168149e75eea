"""The catalogue: the library's operators applied to the verification tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import layers, lint, lookup
from lamina.sinks import exports
from lamina.sources.trees import VERSION_32

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def q01_last_wins(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return layers.last_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@register("select user_id, min(event_id) as first_place, arg_max(event_type, event_id) as last_value from events group by 1")
def q02_first_place_last_value(spark, sf):
    return layers.first_place_last_value(table(spark, sf, "events"), "user_id", "event_id", "event_type", ["event_id"])


@register("select user_id, cast(trunc(value) as bigint) - 20 as version, event_type as value from events where value is null or trunc(value) - 20 >= -1 qualify row_number() over (partition by user_id order by trunc(value) desc nulls last, event_id desc) = 1")
def q03_highest_version(spark, sf):
    return layers.highest_version(table(spark, sf, "events"), "user_id", F.col("value").cast("bigint") - 20, "event_id", "event_type")


@register("select doc_id, quality from labels union all select doc_id, -1 from documents where doc_id not in (select doc_id from labels)")
def q04_fill_missing(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return layers.fill_missing(labels, table(spark, sf, "documents").select("doc_id", F.lit(-1).cast(labels.schema["quality"].dataType).alias("quality")), "doc_id")


@register("select user_id, string_agg(event_type, '>' order by event_id) as layers from events group by 1")
def q05_layer_list(spark, sf):
    return layers.layer_list(table(spark, sf, "events"), "user_id", ["event_id"], "event_type").select("user_id", F.array_join("layers", ">").alias("layers"))


@register("select event_type, cast(arg_max(json_extract_string(props, '$.k'), event_id) as bigint) as k from events group by 1")
def q06_globals_last_wins(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id")
    return layers.last_wins(rows, ["event_type"], ["event_id"]).drop("event_id")


@register("""with recursive n as (select p_partkey as k, case when p_partkey > 1 then p_partkey // 2 end as p, case when p_partkey % 3 = 0 or p_partkey = 1 then p_brand end as v from part),
 w as (select k, p, v, 0 as depth from n union all select w.k, n.p, n.v, w.depth + 1 from w join n on w.p = n.k where w.v is null)
 select k as p_partkey, arg_min(v, depth) filter (where v is not null) as brand, min(depth) filter (where v is not null) as depth from w group by k""")
def q07_inheritance(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_partkey", "case when p_partkey > 1 then p_partkey div 2 end as parent", "case when p_partkey % 3 = 0 or p_partkey = 1 then p_brand end as brand")
    return layers.resolve_chain(part, "p_partkey", "parent", "brand")


@register("select event_id, value, lag(value) over (partition by user_id, event_type order by event_id) as previous from events")
def q08_previous_layer(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return layers.previous_layer(events, ["user_id", "event_type"], ["event_id"], "value").select("event_id", "value", "previous")


@register("select d.doc_id, coalesce(b.text, d.text) as label from documents d left join benchmark b on d.doc_id = b.item_id")
def q11_text_with_default(spark, sf):
    named = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("handle"), F.col("text").alias("named"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" ;1")).alias("handle"))
    return lookup.resolve_text(docs, "handle", named, "handle", "named", "label", F.col("text")).select("doc_id", "label")


@register("""with n as (select n_nationkey as k, case when n_nationkey % 3 = 0 then '' else n_name end as own, r_name from nation left join region on n_regionkey = r_regionkey)
 select c_custkey, coalesce(nullif(case when c_custkey % 4 = 0 then c_mktsegment else '' end, ''), n.own, '') as stats, coalesce(n.r_name, '') as base from customer left join n on c_nationkey = n.k""")
def q12_base_inheritance(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nation = table(spark, sf, "nation").join(region, "n_regionkey", "left")
    base = nation.select(F.col("n_nationkey").cast("string").alias("map_key"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("stats"), F.col("r_name").alias("name"))
    own = F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("").alias("stats")
    instances = table(spark, sf, "customer").select("c_custkey", own, F.col("c_nationkey").cast("string").alias("parent_template"))
    return lookup.with_base(instances, base).select("c_custkey", "stats", F.col("base_name").alias("base"))


@register("select l_orderkey, string_agg(cast(l_partkey as varchar), '+' order by l_linenumber, l_partkey, l_suppkey) as parts from lineitem group by 1")
def q14_ordered_arrays(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_partkey"].cast("string")), "+").alias("parts"))


@register("select p_name || '#' || p_size || '#' || p_brand as name, min(p_partkey) as p_partkey from part group by 1 having count(distinct p_partkey) = 1")
def q16_unique_names(spark, sf):
    return layers.unique_names(table(spark, sf, "part").select(F.concat_ws("#", "p_name", "p_size", "p_brand").alias("name"), "p_partkey"), "name", "p_partkey")


@register("select p_name || '#' || p_size || '#' || p_brand as name, count(distinct p_partkey) as n from part group by 1 having count(distinct p_partkey) > 1")
def q16_ambiguous_names(spark, sf):
    return layers.ambiguous_names(table(spark, sf, "part").select(F.concat_ws("#", "p_name", "p_size", "p_brand").alias("name"), "p_partkey"), "name", "p_partkey")


@register("""select l_orderkey as line, 'uuid' as kind, cast(l_suppkey as varchar) as value from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)
 union all select l_orderkey, 'skill', cast(l_partkey as varchar) from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)""")
def q17_unknown_ids(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns({"mod": F.lit("m"), "file": F.lit("f"), "call": F.lit("c")}).withColumn("line", F.col("l_orderkey"))
    refs = [lines.select("mod", "file", "line", F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"), "call") for k, c in (("uuid", "l_suppkey"), ("skill", "l_partkey"))]
    known = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.lit("uuid").alias("kind"), F.col("s_suppkey").cast("string").alias("value"))
    known = known.union(table(spark, sf, "part").where("p_size > 25").select(F.lit("skill"), F.col("p_partkey").cast("string")))
    return lint.lost_references(refs[0].union(refs[1]), known).select("line", "kind", "value")


@register("select event_type, count(*) as n, count(*) filter (where value > 50) as n_high, bool_or(value > 99) as any_top, bool_and(value >= 0) as all_positive from events group by 1")
def q18_conditional_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.bool_or(F.col("value") > 99).alias("any_top"), F.bool_and(F.col("value") >= 0).alias("all_positive")
    )


@register("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(sum(cast(l_quantity as bigint)) over w, 0) as place, 7 + coalesce(sum(cast(l_quantity as bigint)) over w, 0) = 7 + (l_linenumber - 1) * 25 as due
 from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding)""")
def q19_running_offsets(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"))
    rows = rows.withColumn("offset", 7 + (F.col("l_linenumber") - 1) * 25)
    return lookup.solid_places(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "offset", "size", "size").drop("offset", "size")


@register("select event_id, lead(event_id) over w as following, row_number() over w as place from events window w as (partition by user_id order by event_id)")
def q20_load_order(spark, sf):
    own = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.lead("event_id").over(own).alias("following"), F.row_number().over(own).cast("long").alias("place"))


@register("select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 5")
def q21_top_counts(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@register("select distinct p_name from part where contains(lower(p_name), 'ring') order by 1 limit 25")
def q22_suggestions(spark, sf):
    return lookup.suggestions(table(spark, sf, "part"), "p_name", "Ring")


@register("""select page_id, regexp_full_match(lower(url), 'https?://.*/en/.*') as one, regexp_full_match(lower(url), '.*[ae-g]..example.*') as many, regexp_full_match(lower(url), 'http[^s].*') as none_of, contains(lower(url), '/en/') as part,
 regexp_full_match(lower(url), '.*/fr/.*') or regexp_full_match(lower(url), '.*/de/.*') as any_of from pages""")
def q23_glob(spark, sf):
    url = F.col("url")
    tests = {"one": lookup.name_matches(url, "HTTP*://*/EN/*") & ~lookup.like_glob(url, "http??*://*") | lookup.like_glob(url, "http?://*/en/*"), "many": lookup.like_glob(url, "*[ae-g]??Example*")}
    tests |= {"none_of": lookup.like_glob(url, "http[!s]*"), "part": lookup.name_matches(url, "/EN/"), "any_of": lookup.any_glob(url, ["*/fr/*", "*/de/*"])}
    return table(spark, sf, "pages").select("page_id", *[t.alias(n) for n, t in tests.items()])


@register("""with q(q) as (values ('ring'), ('steel'), ('brass')), h as (select q, 1 as tier, p_partkey from q join part on contains(lower(p_name), q) union all select q, 2, p_partkey from q join part on contains(lower(p_type), q))
 select q, tier, p_partkey from h where tier = (select min(tier) from h g where g.q = h.q)""")
def q24_tiered_lookup(spark, sf):
    asked = F.explode(F.array(*[F.lit(x) for x in ("ring", "steel", "brass")]))
    each = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", asked.alias("q"))
    tier = F.explode(F.filter(F.array(F.when(F.contains(F.lower("p_name"), F.col("q")), 1), F.when(F.contains(F.lower("p_type"), F.col("q")), 2)), lambda x: x.isNotNull()))
    return lookup.best_tier(each.select("q", tier.alias("tier"), "p_partkey"), "q", "tier")


@register("select doc_id, sha256(text) as sha, md5(text) as md from documents")
def q25_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@register("""with v as (select p_partkey, (p_partkey % 20)::bigint as a, (p_size % 16)::bigint as b, (p_partkey % 256)::bigint as c, (p_partkey % 65536)::bigint as d from part),
 k as (select *, case when a < 16 then (a << 28) | (b << 24) | (c << 16) | d end as packed from v)
 select p_partkey, packed, (packed >> 28) & 15 as major, (packed >> 24) & 15 as minor, (packed >> 16) & 255 as revision, packed & 65535 as build from k""")
def q26_version_packing(spark, sf):
    part = table(spark, sf, "part")
    fields = [F.col("p_partkey") % 20, F.col("p_size") % 16, F.col("p_partkey") % 256, F.col("p_partkey") % 65536]
    packed = part.select("p_partkey", text.version_packed(fields, VERSION_32).alias("packed"))
    return packed.select("p_partkey", "packed", text.version_fields(F.col("packed"), VERSION_32, ("major", "minor", "revision", "build")).alias("v")).select("p_partkey", "packed", "v.*")


@register("select event_id, coalesce(try_cast(trim(case when event_id % 5 = 0 then 'x' else '' end || json_extract_string(props, '$.k') || ' ') as bigint), 1) as k from events")
def q27_json_attribute(spark, sf):
    spelt = F.concat(F.when(F.col("event_id") % 5 == 0, "x").otherwise(""), F.get_json_object("props", "$.k"), F.lit(" "))
    return table(spark, sf, "events").select("event_id", text.integer_or(spelt, 1).alias("k"))


@register("select doc_id, cast(i as bigint) as line_no, string_split(text, chr(10))[i] as line from documents, lateral (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as i)")
def q29_line_numbers(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@register("""with u as (select page_id, case page_id % 4 when 0 then 'Mods/x/Levels/' when 1 then 'Mods/Globals/' when 2 then 'levels/' else 'Globals/a/Levels/' end || split_part(url, '/', 3) || case when page_id % 3 = 0 then '/Items/' when page_id % 3 = 1 then '/Characters/' else '/' end || 'f' as path from pages)
 select page_id, case when path like '%Levels/%' then split_part(split_part(path, 'Levels/', 2), '/', 1) when path like '%Globals/%' then split_part(split_part(path, 'Globals/', 2), '/', 1) else '' end as level,
 case when page_id % 3 = 0 then 'item instance' when page_id % 3 = 1 then 'character instance' end as kind from u""")
def q32_path_segment(spark, sf):
    head = F.element_at(F.array(F.lit("Mods/x/Levels/"), F.lit("Mods/Globals/"), F.lit("levels/"), F.lit("Globals/a/Levels/")), (F.col("page_id") % 4 + 1).cast("int"))
    tail = F.element_at(F.array(F.lit("/Items/"), F.lit("/Characters/"), F.lit("/")), (F.col("page_id") % 3 + 1).cast("int"))
    paths = table(spark, sf, "pages").select("page_id", F.concat(head, F.split_part("url", F.lit("/"), F.lit(3)), tail, F.lit("f")).alias("path"))
    return paths.select("page_id", text.level_of(F.col("path")).alias("level"), text.instance_kind(F.col("path")).alias("kind"))


@register("(select l_partkey as k from lineitem union select p_partkey from part) except select l_partkey from lineitem where l_quantity > 40")
def q33_set_operations(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = lines.select(F.col("l_partkey").alias("k")).union(table(spark, sf, "part").select("p_partkey"))
    return keys.subtract(lines.where("l_quantity > 40").select("l_partkey"))


@register("""with s as (select conv_id, turn, role from conversations)
 select conv_id, string_agg(role, '>' order by turn) as roles, count(*) as turns from (select conv_id, turn, max(role) as role from s group by 1, 2) group by 1""")
def q37_pivot(spark, sf):
    named = table(spark, sf, "conversations").select("conv_id", F.concat(F.lit("Role "), F.col("turn").cast("string")).alias("key"), F.col("role").alias("value"))
    slots = lookup.numbered_slots(named, ["conv_id"], "key", "value", {"Role": "role"})
    return slots.select("conv_id", F.array_join(F.transform("slots", lambda x: x["role"]), ">").alias("roles"), F.size("slots").cast("long").alias("turns"))


@register("select doc_id, coalesce(nullif(n_chars, 0), length(text)) as size, doc_id & 15 as method, (doc_id & 4) <> 0 as solid from documents")
def q38_derived_size(spark, sf):
    flags, disk = F.col("doc_id"), F.length("text").cast("long")
    return table(spark, sf, "documents").select("doc_id", text.true_size(F.col("n_chars"), disk).alias("size"), text.compression_method(flags).alias("method"), text.is_solid(flags).alias("solid"))


@register("""with n as (select distinct case p_partkey % 3 when 0 then upper(p_name) else p_name end as name from part), k as (select distinct p_name as k from part where p_size > 47)
 select name, case when name in (select k from k) then 'exact' when lower(name) in (select lower(k) from k) then 'case' else 'missing' end as found from n""")
def q39_existence(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")).distinct()
    return lookup.existence(names, part.where("p_size > 47").select(F.col("p_name").alias("k")), "name", "k")


@register("select doc_id, md5(text) as digest from documents d where not exists (select 1 from documents o where o.doc_id = d.doc_id and o.doc_id % 3 <> 0 and md5(o.text) = md5(d.text))")
def q40_incremental(spark, sf):
    new = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return layers.changed(new.where("doc_id % 3 <> 0"), new, "doc_id", "digest")


@register("""with recursive up as (select p_partkey as k, p_partkey as a, 0 as depth from part union all select k, a // 2, depth + 1 from up where a > 1),
 e as (select p_partkey as a, 'brand' as name, p_brand as value from part where p_partkey % 3 = 0 union all select p_partkey, 'type', p_type from part where p_partkey % 5 = 0 union all select p_partkey, 'name', p_name from part)
 select k as p_partkey, name, arg_min(value, depth) as value, min(depth) as depth from up join e using (a) group by 1, 2""")
def q09_map_fold(spark, sf):
    part = table(spark, sf, "part")
    tree = part.selectExpr("p_partkey", "case when p_partkey > 1 then p_partkey div 2 end as parent")
    pairs = F.array(
        F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit("brand").alias("name"), F.col("p_brand").alias("value"))),
        F.when(F.col("p_partkey") % 5 == 0, F.struct(F.lit("type").alias("name"), F.col("p_type").alias("value"))),
        F.struct(F.lit("name").alias("name"), F.col("p_name").alias("value")),
    )
    entries = part.select("p_partkey", F.inline(F.filter(pairs, lambda x: x.isNotNull())))
    return layers.fold_entries(tree, "p_partkey", "parent", entries, "name", "value")


@register("""with recursive e as (select c_custkey as k, case when c_custkey % 11 = 0 then null when c_custkey % 10 < 9 then c_custkey + 1 else c_custkey - 9 + c_custkey % 3 end as p from customer),
 w as (select k, k as a, '/' || k || '/' as seen, 0 as steps, false as cyclic from e
 union all select w.k, n.k, w.seen || n.k || '/', w.steps + 1, instr(w.seen, '/' || n.k || '/') > 0 from w join e on w.a = e.k join e n on e.p = n.k where not w.cyclic)
 select k as c_custkey, max(steps) as steps, bool_or(cyclic) as cyclic from w group by 1""")
def q10_cycle_guard(spark, sf):
    parent = "case when c_custkey % 11 = 0 then null when c_custkey % 10 < 9 then c_custkey + 1 else c_custkey - 9 + c_custkey % 3 end as parent"
    return layers.flag_cycles(table(spark, sf, "customer").selectExpr("c_custkey", parent), "c_custkey", "parent")


@register("""with n as (select p_partkey, replace(p_name, ' ', '_') || case when p_partkey % 2 = 0 then '_' || p_size else '' end as name from part),
 k as (select replace(p_name, ' ', '_') as known, min(p_partkey) as hit from part where p_size > 20 group by 1)
 select p_partkey, name, coalesce(x.hit, y.hit) as hit from n left join k x on name = x.known left join k y on regexp_replace(name, '_[^_]*$', '') = y.known""")
def q13_exact_else_stem(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("_")).alias("known"))
    names = part.select("p_partkey", F.concat("known", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), "p_size")).otherwise("")).alias("name"))
    known = part.where("p_size > 20").groupBy("known").agg(F.min("p_partkey").alias("hit"))
    return lookup.exact_else_stem(names, known, "name", "known", "hit")


@register("select l_orderkey, len(list(distinct l_partkey)) as n_parts from lineitem group by 1 having list_contains(list(l_partkey), 77)")
def q15_array_containment(spark, sf):
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return parts.where(F.exists("parts", lambda x: x == 77)).select("l_orderkey", F.size("parts").cast("long").alias("n_parts"))


@register("""with h as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as found from pages)
 select page_id, cast(i as bigint) as place, found[i] as href from h, lateral (select unnest(range(1, len(found) + 1)) as i)""")
def q28_hrefs(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.posexplode(text.hrefs(F.col("html"))).alias("i", "href"))
    return found.select("page_id", (F.col("i") + 1).cast("long").alias("place"), "href")


@register("""with s as (select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_name || ' ' || p_size when 2 then p_name || p_size else p_name || p_size || 'x' end as s from part)
 select p_partkey, case when regexp_full_match(s, '[A-Za-z ]+?\\s*[0-9]+') then regexp_extract(s, '^([A-Za-z ]+?)\\s*([0-9]+)$', 1) else s end as stem, try_cast(regexp_extract(s, '^([A-Za-z ]+?)\\s*([0-9]+)$', 2) as bigint) as number from s""")
def q30_numbered_names(spark, sf):
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    given = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat_ws(" ", "p_name", size)).when(kind == 2, F.concat("p_name", size)).otherwise(F.concat("p_name", size, F.lit("x")))
    name, number = text.numbered(given)
    return table(spark, sf, "part").select("p_partkey", name.alias("stem"), number.alias("number"))


@register("""select p_name as name, cast(p_partkey as varchar) as map_key, case when p_size > 9 then p_type else 'template' end as type, 'S_' || p_brand as stats from part
 union all select case when s_suppkey % 2 = 0 then 'S_' || s_name else s_name end, 's' || s_suppkey, 'instance', '' from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0""")
def q31_export_row(spark, sf):
    none = F.lit("")
    templates = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("map_key"), F.col("p_name").alias("name"), none.alias("display_name"), F.when(F.col("p_size") > 9, F.col("p_type")).otherwise("").alias("type"), none.alias("level"), F.concat(F.lit("S_"), "p_brand").alias("stats"))
    key = F.col("s_suppkey")
    instances = table(spark, sf, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("map_key"), F.when(key % 2 == 0, F.concat(F.lit("S_"), "s_name")).otherwise(F.col("s_name")).alias("name"), F.when(key % 3 == 0, "shown").otherwise("").alias("display_name"), none.alias("type"), none.alias("level"), none.alias("stats"))
    return exports.page_rows(templates, instances).select("name", "map_key", "type", "stats")


@register("""with m as (select p_partkey, md5(cast(p_partkey as varchar)) as m, p_partkey % 5 as s from part),
 i as (select p_partkey, case s when 0 then substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)
  when 1 then 'h' || substr(m, 1, 8) || 'g' || substr(m, 9, 4) || 'g' || substr(m, 13, 4) || 'g' || substr(m, 17, 4) || 'g' || substr(m, 21, 12)
  when 2 then upper('h' || substr(m, 1, 1) || 'g' || substr(m, 2, 3) || 'g4gag' || substr(m, 9, 12)) when 3 then 'h' || m else m || chr(10) end as id from m)
 select p_partkey, id, case when p_partkey % 5 = 0 then 'uuid' when p_partkey % 5 in (1, 2) then 'handle' else 'none' end as kind from i""")
def q34_id_kinds(spark, sf):
    made = table(spark, sf, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("m"), (F.col("p_partkey") % 5).alias("s"))
    cut = lambda *spans: [F.substring("m", at, n) for at, n in spans]
    five = cut((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    one, three, twelve = cut((1, 1), (2, 3), (9, 12))
    short = F.upper(F.concat(F.lit("h"), one, F.lit("g"), three, F.lit("g4gag"), twelve))
    ids = F.when(F.col("s") == 0, F.concat_ws("-", *five)).when(F.col("s") == 1, F.concat(F.lit("h"), F.concat_ws("g", *five))).when(F.col("s") == 2, short).when(F.col("s") == 3, F.concat(F.lit("h"), "m")).otherwise(F.concat("m", F.lit("\n")))
    return made.select("p_partkey", ids.alias("id")).withColumn("kind", text.id_kind(F.col("id")))


@register("with n as (select distinct p_name from part where contains(lower(p_name), 'ring')) select p_name, (select count(*) from n) as total from n order by 1 limit 10")
def q35_first_with_total(spark, sf):
    return lookup.first_with_total(table(spark, sf, "part").where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_name").distinct(), "p_name", 10)


@register("""with t as (select page_id, regexp_extract_all(html, '</?[a-zA-Z][^<>]*>') as tags from pages),
 u as (select page_id, i, tags[i] as tag from t, lateral (select unnest(range(1, len(tags) + 1)) as i)),
 s as (select page_id, i, case when tag like '</%' then -1 when tag like '%/>' or lower(regexp_extract(tag, '^</?([a-zA-Z0-9]+)', 1)) in ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') then 0 else 1 end as step from u),
 r as (select page_id, step, sum(step) over (partition by page_id order by i) as depth from s),
 a as (select page_id, sum(step) as depth, min(depth) as lowest from r group by 1)
 select page_id, cast(coalesce(depth, 0) as int) as depth, cast(least(coalesce(lowest, 0), 0) as int) as lowest from pages left join a using (page_id)""")
def q36_block_balance(spark, sf):
    balance = text.tag_balance(F.coalesce("html", F.lit("")))
    return table(spark, sf, "pages").select("page_id", balance.alias("b")).select("page_id", "b.depth", "b.lowest")

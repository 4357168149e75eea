"""The tiered search: what a UUID, handle, name or text stands for.

The first tier that yields anything answers. Each tier is one or a few equi-joins or filters over the collection's data
sets; only the sections of the winning tier, a few dozen rows, are brought together. ``candidates`` has the first seven
tiers for a whole table of queries at once.

tier 1: UUID · 2: handle · 3: definition · 4: object name · 5: display name · 6: a definition's display name ·
7: recipe id · 8: suggestions
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators.collection import TEMPLATE, Collection

MOST_SUGGESTIONS, MOST_FIELDS, MOST_HITS, MOST_RECIPES = 25, 24, 10, 10


@dataclass
class Found:
    query: str
    tier: int = 0
    sections: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)

    @property
    def found(self) -> bool:
        return bool(self.sections)

    def report(self) -> str:
        if self.sections:
            return "\n\n".join(self.sections)
        if self.suggestions:
            return "\n".join([f"no exact match for {self.query!r}; close matches:", *(f"  {s}" for s in self.suggestions)])
        return f"no match for {self.query!r}"


def objects(held: Collection) -> DataFrame:
    """Templates and then instances: ``rank`` 0 and 1."""
    return held.templates.withColumn("rank", F.lit(0)).unionByName(held.instances.withColumn("rank", F.lit(1)))


def display_names(held: Collection) -> DataFrame:
    """``name, text, first_order``: the text of each definition's own display name."""
    own = held.definitions.where("latest").select("name", "first_order", F.try_element_at("data", F.lit("DisplayName")).alias("_h"))
    return held.with_text(own, "_h", "text").where("text <> ''").select("name", "text", "first_order")


def used_by(held: Collection) -> DataFrame:
    """``object, role, name``: recipes by what they take and what they make."""
    takes = held.recipes.select(F.explode("ingredients").alias("x"), F.lit("ingredient in").alias("role"), "name", "first_order")
    makes = held.recipes.select(F.explode("results").alias("x"), F.lit("crafted by").alias("role"), "name", "first_order")
    return takes.select("x.object", "role", "name", "first_order").union(makes.select("x.object", "role", "name", "first_order")).distinct()


def candidates(held: Collection, queries: DataFrame) -> DataFrame:
    """``query, tier, rank, key`` of tiers 1 to 7 for a table of queries (column ``query``), the lowest tier of each."""
    q = queries.select(F.trim("query").alias("query")).distinct()
    every = objects(held)
    is_uuid, is_handle = F.col("query").rlike(text.UUID), F.col("query").rlike(text.HANDLE)
    lower, raw = (q.where(is_uuid).select("query", k.alias("map_key"), F.lit(o).alias("o")) for o, k in enumerate((F.lower("query"), F.col("query"))))
    keyed = lower.union(raw).join(every.select("map_key", "rank"), "map_key").groupBy("query", "rank").agg(F.min_by("map_key", "o").alias("key")).select("query", F.lit(1).alias("tier"), "rank", "key")
    handles = q.where(is_handle)
    spoken = handles.join(held.texts.select(F.col("handle").alias("query"), "text"), "query").where("text <> ''").select("query", F.lit(2).alias("tier"), F.lit(-1).alias("rank"), F.col("query").alias("key"))
    by_handle = handles.join(every.select(text.handle_part(F.col("handle")).alias("query"), "rank", "map_key"), "query").select("query", F.lit(2), "rank", "map_key")
    named = held.definitions.where("latest").select("name", F.explode(F.array(*[F.try_element_at("data", F.lit(k)) for k in ("DisplayName", "Description")])).alias("h"))
    by_text = handles.join(named.select(text.handle_part(F.col("h")).alias("query"), "name").distinct(), "query").select("query", F.lit(2), F.lit(2), "name")
    rest = q.where(~is_uuid & ~is_handle)
    defined = rest.join(held.definitions.where("latest").select(F.col("name").alias("query")), "query").select("query", F.lit(3), F.lit(2), "query")
    by_name = rest.withColumn("low", F.lower("query")).join(every.where("name <> ''").select(F.lower("name").alias("low"), "rank", "map_key"), "low").select("query", F.lit(4), "rank", "map_key")
    fold = rest.withColumn("fold", text.folded(F.col("query")))
    shown = fold.join(every.where("display_name <> ''").select(text.folded(F.col("display_name")).alias("fold"), "rank", "map_key"), "fold").select("query", F.lit(5), "rank", "map_key")
    spelt = fold.join(display_names(held).select(text.folded(F.col("text")).alias("fold"), "name"), "fold").select("query", F.lit(6), F.lit(2), "name")
    made = rest.join(used_by(held).select(F.col("object").alias("query"), "name"), "query").select("query", F.lit(7), F.lit(3), "name").distinct()
    hits = keyed
    for more in (spoken, by_handle, by_text, defined, by_name, shown, spelt, made):
        hits = hits.union(more)
    best = hits.groupBy(F.col("query").alias("_q")).agg(F.min("tier").alias("_t"))
    return hits.join(best, (F.col("query") == F.col("_q")) & (F.col("tier") == F.col("_t")), "left_semi")


class _Sections:
    """Renders the sections of a few hits."""

    def __init__(self, held: Collection):
        self.held = held
        self.latest = held.definitions.where("latest")

    def definition(self, name: str, pad: str = "") -> str | None:
        own = self.latest.where(F.col("name") == name).select("type", "using").first()
        if own is None:
            return None
        entries = self.held.resolved.where(F.col("name") == name).first()
        if entries["error"]:
            raise ValueError(f"{name!r}: {entries['error']}")
        lines = [f"{pad}stats entry {name}"] + [f"{pad}  {label}: {value}" for label, value in (("type", own["type"]), ("using", own["using"])) if value]
        data = [(e["key"], e["value"]) for e in entries["entries"]]
        lines += [f"{pad}  {k}: {v}" for k, v in data[:MOST_FIELDS]]
        return "\n".join(lines + [f"{pad}  … {len(data) - MOST_FIELDS} more fields"] * (len(data) > MOST_FIELDS))

    def template(self, row, with_definition: bool = True) -> str:
        base = self.held.templates.where(F.col("map_key") == row["parent_template"]).first() if row["parent_template"] else None
        lines = [f"{'instance' if 'instance' in row['type'] else 'template'} {row['map_key']}"]
        shown = [(c.replace("_", " "), row[c]) for c in ("name", "display_name", "handle", "type", "level", "stats", "icon")]
        shown += [("base template", row["parent_template"]), ("base name", base["name"] if base else ""), ("source", row["source"])]
        lines += [f"  {label}: {value}" for label, value in shown if value]
        # an instance without definition has its base template's
        stats = row["stats"] or (base["stats"] if base else "")
        if with_definition and stats and (block := self.definition(stats, "  ")):
            lines += ["", block]
        return "\n".join(lines)

    def spawned(self, name: str) -> list[str]:
        """A definition, the objects that use it, and its own root template if that is not among them."""
        rows = objects(self.held).where(F.col("stats") == name).orderBy("rank", "last_order").collect()
        sections = [self.definition(name)] + [self.template(r, False) for r in rows]
        entries = self.held.resolved.where(F.col("name") == name).first()
        root = (entries["data"] or {}).get("RootTemplate", "")
        if root and root.lower() not in {r["map_key"].lower() for r in rows}:
            held = {r["map_key"]: r for r in self.held.templates.where(F.col("map_key").isin(root.lower(), root)).collect()}
            if own := held.get(root.lower()) or held.get(root):
                sections.append(self.template(own, False))
        return sections

    def recipes(self, name: str) -> list[str]:
        own = Window.partitionBy("role").orderBy("first_order")
        hits = used_by(self.held).where(F.col("object") == name).withColumn("n", F.row_number().over(own)).where(F.col("n") <= MOST_RECIPES)
        rows = hits.join(self.held.recipes.select("name", "ingredients", "results"), "name").orderBy(F.desc("role"), "n").collect()
        return [f"{r['role']}: {recipe_text(r)}" for r in rows]


def recipe_text(row) -> str:
    takes = " + ".join(x["object"] for x in row["ingredients"] if x["object"]) or "?"
    makes = ", ".join(f"{x['object']} x{x['amount']}" for x in row["results"] if x["object"]) or "?"
    return f"{row['name']}: {takes} -> {makes}"


def suggestions(held: Collection, query: str, cap: int = MOST_SUGGESTIONS) -> list[str]:
    """Distinct labels of what holds the query: objects, then definitions, then texts, each in the order first seen."""
    needle = F.lit(query).cast("string")
    inside = lambda c: F.contains(text.folded(F.col(c)), text.folded(needle))
    own = objects(held).where(inside("name") | inside("display_name"))
    parts = [own.where(F.col("rank") == r).select(F.format_string("%s  (%s)  %s", "name", "display_name", "map_key").alias("label"), "first_order") for r in (0, 1)]
    latest = held.definitions.where("latest").where(inside("name"))
    parts.append(latest.select(F.format_string("%s  (stats: %s)", "name", F.coalesce(F.nullif("type", F.lit("")), F.lit("entry"))).alias("label"), "first_order"))
    parts.append(held.texts.where(inside("text")).select(F.format_string("%s  (text: %s)", "handle", "text").alias("label"), "first_order"))
    out: dict[str, None] = {}
    for part in parts:  # at most ``cap`` labels of each
        if len(out) < cap:
            firsts = part.groupBy("label").agg(F.min("first_order").alias("o")).orderBy("o").limit(cap)
            out |= dict.fromkeys(r["label"] for r in firsts.collect())
    return list(out)[:cap]


def find(held: Collection, query: str) -> Found:
    """What one query stands for, as text sections or suggestions."""
    query = query.strip()
    out, show, every = Found(query), _Sections(held), objects(held)
    if re.search(text.UUID.replace(r"\A", "^").replace(r"\z", r"\Z"), query):
        out.tier = 1
        rows = {(r["rank"], r["map_key"]): r for r in every.where(F.col("map_key").isin(query.lower(), query)).collect()}
        out.sections = [show.template(r) for rank in (0, 1) if (r := rows.get((rank, query.lower())) or rows.get((rank, query)))]
        return out
    if re.search(text.HANDLE.replace(r"\A", "^").replace(r"\z", r"\Z"), query):
        out.tier = 2
        spoken = held.texts.where((F.col("handle") == query) & (F.col("text") != "")).first()
        out.sections = [f"localization {query}\n  text: {spoken['text']}"] if spoken else []
        out.sections += [show.template(r) for r in every.where(text.handle_part(F.col("handle")) == query).orderBy("rank", "first_order").collect()]
        hit = [text.handle_part(F.try_element_at("data", F.lit(k))) == query for k in ("DisplayName", "Description")]
        for r in show.latest.where(F.coalesce(hit[0], F.lit(False)) | F.coalesce(hit[1], F.lit(False))).orderBy("first_order").select("name").collect():
            out.sections += show.spawned(r["name"])
        return out
    if block := show.definition(query):
        out.tier = 3
        out.sections = [block, *(show.template(r, False) for r in every.where(F.col("stats") == query).orderBy("rank", "last_order").collect()), *show.recipes(query)] if query else [block]
        return out
    named = every.where((F.lower("name") == F.lower(F.lit(query))) & (F.col("name") != "")).orderBy("rank", "last_order").collect()
    if named:
        out.tier, out.sections = 4, [*map(show.template, named), *show.recipes(query)]
        return out
    same = lambda c: (text.folded(F.col(c)) == text.folded(F.lit(query))) & (F.col(c) != "")
    for rank in (0, 1):  # the cap is tested after each hit and ends only its own rank
        room = max(1, MOST_HITS - len(out.sections))
        out.sections += [show.template(r) for r in every.where((F.col("rank") == rank) & same("display_name")).orderBy("first_order").limit(room).collect()]
    if out.sections:
        out.tier = 5
        return out
    for r in display_names(held).where(same("text")).orderBy("first_order").limit(MOST_HITS).collect():
        out.sections += show.spawned(r["name"])
        if len(out.sections) >= MOST_HITS:
            break
    if out.sections:
        out.tier = 6
        return out
    out.sections = show.recipes(query)
    out.tier = 7 if out.sections else 8
    if not out.sections:
        out.suggestions = suggestions(held, query)
    return out


__all__ = ["TEMPLATE", "Found", "candidates", "find", "suggestions"]

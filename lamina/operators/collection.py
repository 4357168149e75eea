"""The data sets of an installation: archives in load order, and what their layered files define.

Every data set is a DataFrame over the archives' files; nothing is kept on the driver but the list of archives. A patch
ships only what it changes, so definitions are layered across all archives and whole files are not shadowed.
"""

from __future__ import annotations

import hashlib
import os
import sys
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import inherit, layers, lookup
from lamina.sources import archives, definitions, localization, recipes, trees

# Where the game keeps its data.
DATA_FOLDERS = ("DefEd/Data", "Data")
GAME_FOLDERS = ("Divinity Original Sin 2", "Divinity - Original Sin 2")
PLACES = {
    "win32": [f"{d}/{rest}" for d in ("C:", "D:", "E:") for rest in ("Program Files (x86)/Steam/steamapps/common", "Program Files/Steam/steamapps/common", "SteamLibrary/steamapps/common", "GOG Games")],
    "darwin": ["~/Library/Application Support/Steam/steamapps/common"],
    "linux": ["~/.steam/steam/steamapps/common", "~/.local/share/Steam/steamapps/common"],
}
INSTALL_VARIABLE = "LAMINA_INSTALL"
# Types that make up each typed data set.
TYPED = {"skills": ("SkillData",), "statuses": ("StatusData",), "weapons": ("Weapon",), "armor": ("Armor", "Shield"), "potions": ("Potion",), "objects": ("Object",)}
TEMPLATE = ("map_key", "name", "display_name", "handle", "type", "stats", "icon", "parent_template", "source", "level")


def data_folder(root: str | Path) -> Path | None:
    """The folder of an installation that holds archives; the newer edition's comes first."""
    return next((f for d in DATA_FOLDERS if (f := Path(root) / d).is_dir() and any(f.glob("*.pak"))), None)


def find_install(path: str | Path | None = None) -> Path | None:
    """An installation: the given path or none, else the one that the environment names, else a usual place."""
    if path is not None:
        return Path(path) if data_folder(path) else None
    places = [os.environ.get(INSTALL_VARIABLE)] + [f"{p}/{g}" for p in PLACES.get(sys.platform, PLACES["linux"]) for g in GAME_FOLDERS]
    return next((Path(p).expanduser() for p in places if p and data_folder(Path(p).expanduser())), None)


class Collection:
    """Layered data sets of one data folder."""

    def __init__(self, spark: SparkSession, data_dir: str | Path | None = None, *, path: str | Path | None = None, language: str = "English"):
        if data_dir is None:
            root = find_install(path)
            if root is None:
                raise FileNotFoundError("no installation found; name a path or data folder")
            data_dir = data_folder(root)
        self.spark, self.data_dir, self.language = spark, Path(data_dir), language
        self._broken: list[tuple[str, str]] = []
        spoken = self.data_dir / "Localization"
        main = self._headers(sorted(self.data_dir.glob("*.pak")))
        self.paths = [p for p, _ in sorted(main, key=lambda x: archives.load_key(x[0], x[1]["priority"]))]
        self.language_paths = [p for p, _ in self._headers(sorted(spoken.rglob("*.pak")))] if spoken.is_dir() else []

    def _headers(self, paths: list[Path]) -> list[tuple[str, dict]]:
        """Paths and headers of archives that can be opened; files without a signature are parts or foreign, damaged archives are issues."""
        out = []
        for path in paths:
            if archives.is_archive(path):
                try:
                    out.append((str(path), archives.open_archive(path).header))
                except archives.ArchiveError as problem:
                    self._broken.append((path.name, str(problem)))
        return out

    def fingerprint(self) -> str:
        """Changes whenever an archive, its size or time, or the language does."""
        digest = hashlib.sha256(self.language.lower().encode())
        for path in [*sorted(self.data_dir.glob("*.pak")), *sorted((self.data_dir / "Localization").rglob("*.pak"))]:
            held = path.stat()
            digest.update(f"|{path.name}|{held.st_size}|{held.st_mtime_ns}".encode())
        return digest.hexdigest()[:24]

    # files

    @cached_property
    def entries(self) -> DataFrame:
        """Every archive's entries, in load order."""
        return archives.listing(self.spark, self.paths)

    @cached_property
    def names(self) -> DataFrame:
        """The newest archive's entry of each name, with the place where the name was first seen."""
        newest = layers.last_wins(self.entries, ["name"], ["load_order", "entry_ord"])
        seen = self.entries.groupBy("name").agg(F.min(F.struct("load_order", "entry_ord")).alias("first_order"))
        return newest.join(seen, "name")

    def find_files(self, pattern: str) -> DataFrame:
        """Names that match a glob or hold a text, in the order in which they were first seen."""
        return self.names.where(lookup.name_matches(F.col("name"), pattern)).orderBy("first_order").select("name")

    def search(self, pattern: str) -> DataFrame:
        """``archive, name`` of the same match over all archives, those of the language too, shadowed or not."""
        every = archives.listing(self.spark, [str(p) for p in sorted(self.data_dir.rglob("*.pak")) if archives.is_archive(p) and p.name not in {n for n, _ in self._broken}])
        return every.where(lookup.name_matches(F.col("name"), pattern)).orderBy("load_order", "entry_ord").select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "name")

    def read(self, name: str) -> bytes:
        """The newest archive's copy of a file."""
        held = self.names.where(F.col("name") == name).select("archive").first()
        if held is None:
            raise FileNotFoundError(f"{name!r} is in no archive")
        return archives.read_file(held["archive"], name)

    def layered(self, suffixes: tuple[str, ...], markers: tuple[str, ...], paths: list[str] | None = None) -> DataFrame:
        """``doc, content`` of every archive's own copy; ``doc`` sorts in load order and ends with the name."""
        files = archives.listing(self.spark, self.paths if paths is None else paths, content=True, suffixes=suffixes, markers=markers)
        return files.select(F.format_string("%06d/%09d/%s", "load_order", "entry_ord", "name").alias("doc"), "content")

    @staticmethod
    def name_of(doc: Column) -> Column:
        return F.substring(doc, 18, 2**31 - 1)

    # definitions

    @cached_property
    def _definition_rows(self) -> DataFrame:
        return layers._written(definitions.definitions(self.layered((".txt",), ("/stats/generated/data/",))))

    @cached_property
    def definitions(self) -> DataFrame:
        """Every layer of every definition: ``name, type, using, data, source`` and the graph's columns."""
        rows = self._definition_rows.where("kind = 'definition'").select("doc", "ord", "name", "type", "using", "data", self.name_of(F.col("doc")).alias("source"))
        return layers._written(inherit.definition_graph(rows, ["doc", "ord"]))

    @cached_property
    def globals(self) -> DataFrame:
        rows = self._definition_rows.where("kind = 'global'")
        return layers.last_wins(rows.select(F.col("name").alias("key"), "value", "doc", "ord"), ["key"], ["doc", "ord"]).select("key", "value")

    @cached_property
    def resolved(self) -> DataFrame:
        return layers._written(inherit.resolved(self.definitions))

    @cached_property
    def resolved_types(self) -> DataFrame:
        return layers._written(inherit.resolved_types(self.definitions))

    # texts

    @cached_property
    def _text_rows(self) -> DataFrame:
        language = self.language.lower()
        whole = [p for p in self.language_paths if language in p.lower()]
        others = [p for p in self.language_paths if language not in p.lower()]
        own = self.layered((".xml",), ("",), whole).select(F.lit(0).alias("rank"), "doc", "content")
        named = self.layered((".xml",), (language,), others).select(F.lit(0).alias("rank"), "doc", "content")
        shipped = self.layered((".xml",), (f"localization/{language}",)).select(F.lit(1).alias("rank"), "doc", "content")
        # archives of the language come in path order, whether they are whole or in part the language's
        order = {p: i for i, p in enumerate(self.language_paths)}
        renumber = lambda df, paths: df if not paths else df.withColumn("doc", F.concat(F.element_at(F.array(*[F.lit(f"{order[p]:06d}") for p in paths]), F.substring("doc", 1, 6).cast("int") + 1), F.substring("doc", 7, 2**31 - 1)))
        files = renumber(own, whole).union(renumber(named, others)).union(shipped)
        return layers._written(localization.entries(files.select(F.concat(F.col("rank").cast("string"), F.col("doc")).alias("doc"), "content")))

    @cached_property
    def texts(self) -> DataFrame:
        """``handle, version, text``: of each handle the text with the highest version, of equal ones the last."""
        rows = self._text_rows.where("error IS NULL").select(text.handle_key(F.col("handle")).alias("handle"), "version", "text", F.struct("doc", "ord").alias("seq"))
        best = layers.highest_version(rows, "handle", F.col("version"), "seq", "text").withColumnRenamed("value", "text")
        seen = rows.where("version >= -1").groupBy("handle").agg(F.min("seq").alias("first_order"))
        return layers._written(best.join(seen, "handle"))

    def with_text(self, df: DataFrame, handle: str, name: str, default: Column | str = "") -> DataFrame:
        """``df`` with the text of a handle as ``name``; the default where there is no handle or no text."""
        return lookup.resolve_text(df, handle, self.texts, "handle", "text", name, F.lit(default) if isinstance(default, str) else default)

    # templates and instances

    def _objects(self, files: DataFrame) -> DataFrame:
        """A row for each game object with a key, in the order of load, file and node."""
        wanted = {"map_key": "MapKey", "name": "Name", "type": "Type", "stats": "Stats", "icon": "Icon", "_template": "TemplateName", "_parent": "ParentTemplateId", "_level": "LevelName"}
        rows = trees.objects(files, "GameObjects", wanted, "DisplayName").withColumnRenamed("inline", "_inline").where("map_key <> ''")
        rows = rows.withColumn("parent_template", F.coalesce(F.nullif("_template", F.lit("")), "_parent")).withColumn("source", self.name_of(F.col("doc")))
        return self.with_text(rows, "handle", "display_name", F.col("_inline"))

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last definition of each key, with the order in which keys were first and last seen."""
        seq = F.struct("doc", "node_idx")
        won = rows.groupBy("map_key").agg(F.max_by(F.struct(*[c for c in TEMPLATE if c != "map_key"]), seq).alias("w"), F.min(seq).alias("first_order"), F.max(seq).alias("last_order"))
        return won.select("map_key", "w.*", "first_order", "last_order")

    @cached_property
    def _template_files(self) -> DataFrame:
        return self.layered((".lsf", ".lsx"), ("/roottemplates/",))

    @cached_property
    def templates(self) -> DataFrame:
        return layers._written(self._last(self._objects(self._template_files).withColumn("level", F.lit(""))))

    @cached_property
    def _instance_files(self) -> DataFrame:
        files = self.layered((".lsf", ".lsx"), ("/levels/", "/globals/"))
        return files.where(text.instance_kind(self.name_of(F.col("doc"))).isNotNull())

    @cached_property
    def instances(self) -> DataFrame:
        """Objects placed in levels: a kind by path where they have no type, and their level."""
        rows = self._objects(self._instance_files)
        rows = rows.withColumn("type", F.coalesce(F.nullif("type", F.lit("")), text.instance_kind(F.col("source"))))
        return layers._written(self._last(rows.withColumn("level", F.coalesce(F.nullif("_level", F.lit("")), text.level_of(F.col("source"))))))

    # recipes

    @cached_property
    def recipes(self) -> DataFrame:
        """The last recipe of each name across documents, with the place where the name was first seen."""
        files = self.layered((".txt",), ("itemcombos",)).where(F.lower(self.name_of(F.col("doc"))).contains("/stats/generated/"))
        rows = recipes.recipes(layers._written(recipes.lines(files))).withColumn("source", self.name_of(F.col("doc")))
        rows = rows.withColumn("seq", F.struct("doc", "first_block"))
        # maps cannot be compared, so the winner is picked by order alone
        won = rows.groupBy("name").agg(F.max_by(F.struct("ingredients", "results", "data", "source"), "seq").alias("w"), F.min("seq").alias("first_order"))
        return layers._written(won.select("name", "w.*", "first_order"))

    def typed(self, name: str) -> DataFrame:
        """One typed data set: resolved type and data, texts of name and description, sorted by lower-case name."""
        kinds = self.resolved_types.where(F.col("type").isin(*TYPED[name]))
        latest = self.definitions.where("latest").select("name", F.coalesce("using", F.lit("")).alias("using"), "first_order")
        rows = latest.join(kinds, "name").join(self.resolved.select("name", "data"), "name")
        for column, key in (("display_name", "DisplayName"), ("description", "Description")):
            rows = self.with_text(rows.withColumn("_h", F.try_element_at("data", F.lit(key))), "_h", column).drop("_h")
        return rows.orderBy(F.lower("name"), "first_order").select("name", "type", "using", "display_name", "description", "data")

    # what could not be read

    @cached_property
    def issues(self) -> DataFrame:
        """``file, error`` of archives, definition text, localization and trees that could not be read."""
        own = self.spark.createDataFrame(self._broken, "file string, error string")
        bad = self._definition_rows.where("kind = 'issue'").select(self.name_of(F.col("doc")).alias("file"), F.col("value").alias("error"))
        spoken = self._text_rows.where("error IS NOT NULL").select(self.name_of(F.substring("doc", 2, 2**31 - 1)).alias("file"), "error")
        grown = trees.issues(self._template_files.union(self._instance_files)).select(self.name_of(F.col("file")).alias("file"), "error")
        return own.union(bad).union(spoken).union(grown)

    def inventory(self) -> DataFrame:
        """``archive, version, entries, solid, error`` of every archive."""
        rows = []
        for path in [*sorted(self.data_dir.glob("*.pak")), *sorted((self.data_dir / "Localization").rglob("*.pak"))]:
            if archives.is_archive(path):
                name = str(path.relative_to(self.data_dir))
                try:
                    held = archives.open_archive(path)
                    rows.append((name, held.header["version"], len(held.entries), held.solid, None))
                except archives.ArchiveError as problem:
                    rows.append((name, 0, 0, False, str(problem)))
        return self.spark.createDataFrame(rows, "archive string, version int, entries int, solid boolean, error string")

"""Checks of script mods: setup files, required files, script blocks, and ids that name nothing.

Every file is scanned once, by many tasks, into issues and references; what references stand for is found by joins with
the ids of the game and of the mod itself.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import inherit, layers
from lamina.operators.collection import Collection
from lamina.sources import definitions, trees
from lamina.sources.trees import as_batch

# Names that the script extender knows.
CONFIG = "OsiToolsConfig.json"
CONFIG_KEYS = {"RequiredExtensionVersion", "ModTable", "FeatureFlags"}
FEATURES = {"Lua", "OsirisExtensions", "Preprocessor", "DisableFolding", "CustomStats", "CustomStatsPane"}
BOOTSTRAPS = {"BootstrapServer.lua", "BootstrapClient.lua"}
SCRIPTS = "Story/RawFiles/Lua"
# Calls whose argument of that number names game data.
CALLS = {
    "CharacterAddSkill": (2, "skill"), "CharacterRemoveSkill": (2, "skill"), "CharacterHasSkill": (2, "skill"), "CharacterUseSkill": (2, "skill"),
    "ApplyStatus": (2, "status"), "RemoveStatus": (2, "status"), "HasActiveStatus": (2, "status"),
    "Ext.GetStat": (1, "stat"), "Ext.StatGetAttribute": (1, "stat"), "Ext.StatSetAttribute": (1, "stat"),
}
UUIDS = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
LITERAL = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'")
REQUIRE = re.compile(r"\bExt\.Require\s*\(\s*([\"'])(.+?)\1")
OPENING = re.compile(r"--\[(=*)\[|--|\[(=*)\[|[\"']")
KEYWORD = re.compile(r"\b(function|if|while|for|do|repeat|until|end)\b")

ISSUES = "file string, line int, severity string, code string, message string"
REFERENCES = "mod string, file string, line int, kind string, value string, call string"


def _argument(call: str, place: int) -> re.Pattern:
    prefix = r"\b" if "." in call else r"\b(?:Osi\.)?"
    return re.compile(prefix + re.escape(call) + r"\s*\(\s*" + (r"[^,()\n]*,\s*" if place == 2 else "") + r"([\"'])([^\"'\n]*)\1")


PATTERNS = [(call, kind, _argument(call, place)) for call, (place, kind) in CALLS.items()]


def blanked(source: str) -> tuple[str, str, list[tuple[int, str, str]]]:
    """The source without comments, without comments and strings, and what is never closed.

    Blanks take the place of what goes, line ends stay, so places keep their lines.
    """
    clean, code, problems, at = [], [], [], 0
    blank = lambda part: re.sub(r"[^\n]", " ", part)
    while found := OPENING.search(source, at):
        begin, opening = found.start(), found[0]
        clean.append(source[at:begin])
        code.append(source[at:begin])
        comment = opening.startswith("--")
        if opening in "\"'":
            end = begin + 1
            while end < len(source) and source[end] not in (opening, "\n"):
                end += 2 if source[end] == "\\" else 1
            closed = end < len(source) and source[end] == opening
            stop = min(end + closed, len(source))
        elif opening == "--":
            stop = source.find("\n", begin)
            closed, stop = True, len(source) if stop < 0 else stop
        else:
            closing = f"]{found[1] if comment else found[2]}]"
            end = source.find(closing, found.end())
            closed, stop = end >= 0, len(source) if end < 0 else end + len(closing)
        if not closed:
            what = "comment" if comment else "string"
            long = "long " if opening[-1] == "[" else ""
            problems.append((source.count("\n", 0, begin) + 1, f"lua-{what}", f"unterminated {long}{what}"))
        code.append(blank(source[begin:stop]))
        clean.append(code[-1] if comment else source[begin:stop])
        at = stop
    rest = source[at:]
    return "".join(clean) + rest, "".join(code) + rest, problems


def unbalanced(code: str) -> list[tuple[int, str]]:
    """Lines and messages of blocks that do not close; ``while`` and ``for`` take the ``do`` that follows them."""
    opened, awaited, out = [], 0, []
    for found in KEYWORD.finditer(code):
        word, line = found[1], code.count("\n", 0, found.start()) + 1
        if word in ("end", "until"):
            if opened:
                opened.pop()
            else:
                out.append((line, f"{word!r} closes no block"))
        elif word == "do" and awaited:
            awaited -= 1
        else:
            opened.append((line, word))
            awaited += word in ("while", "for")
    return out + [(line, f"{word!r} block is never closed") for line, word in opened]


def scan_script(source: str) -> tuple[list[tuple[int, str, str, str]], list[tuple[int, str, str, str]]]:
    """Issues (line, severity, code, message) and references (line, kind, value, call) of one script."""
    clean, code, problems = blanked(source)
    line_at = lambda place: clean.count("\n", 0, place) + 1
    issues = [(line, "error", what, message) for line, what, message in problems]
    issues += [(line, "error", "lua-blocks", message) for line, message in unbalanced(code)]
    references = []
    for found in REQUIRE.finditer(clean):
        if "\\" in found[2]:
            issues.append((line_at(found.start()), "warning", "require-path", f"{found[2]!r} has backslashes; paths take forward slashes"))
        references.append((line_at(found.start()), "require", found[2].replace("\\", "/"), "Ext.Require"))
    for found in LITERAL.finditer(clean):
        references += [(line_at(found.start()), "uuid", u, "") for u in UUIDS.findall(found[1] if found[1] is not None else found[2])]
    for call, kind, pattern in PATTERNS:
        references += [(line_at(m.start()), kind, m[2], call) for m in pattern.finditer(clean) if m[2] and not UUIDS.search(m[2])]
    return issues, references


def check_meta(folder: str, data: bytes | None) -> tuple[list[tuple[str, str, str, str]], str | None]:
    """Issues (file, severity, code, message) of a mod's ``meta.lsx``, and the UUID that it declares."""
    if data is None:
        return [("", "warning", "meta-missing", "no meta.lsx: the game does not list this folder as a mod")], None
    try:
        tree = trees.read_xml(data)
    except ValueError as problem:
        return [("meta.lsx", "error", "meta-parse", str(problem))], None
    info = next(tree.find("ModuleInfo"), None)
    if info is None:
        return [("meta.lsx", "error", "meta-moduleinfo", "no ModuleInfo node")], None
    declared, named, out = tree.text(info, "UUID") or "", tree.text(info, "Folder") or "", []
    try:
        uuid.UUID(declared)
    except ValueError:
        out.append(("meta.lsx", "error", "meta-uuid", f"{declared!r} is no UUID"))
    if named and named != folder:
        out.append(("meta.lsx", "warning", "meta-folder", f"the folder is {folder!r}, not {named!r}"))
    return out, None if any(code == "meta-uuid" for _, _, code, _ in out) else declared.lower()


def check_config(data: bytes | None, has_scripts: bool) -> list[tuple[str, str, str, str]]:
    """Issues of the script extender's settings."""
    if data is None:
        return [("", "error", "config-missing", f"scripts but no {CONFIG}: they are not loaded")] if has_scripts else []
    try:
        held = json.loads(data.decode("utf-8-sig"))
    except ValueError as problem:
        return [(CONFIG, "error", "config-json", f"no JSON: {problem}")]
    if not isinstance(held, dict):
        return [(CONFIG, "error", "config-json", "no JSON object")]
    out = [(CONFIG, "warning", "config-key", f"unknown key {k!r}") for k in sorted(held.keys() - CONFIG_KEYS)]
    version = held.get("RequiredExtensionVersion")
    if version is not None and type(version) is not int:
        out.append((CONFIG, "error", "config-version", f"RequiredExtensionVersion is {version!r}, no integer"))
    flags = held.get("FeatureFlags", [])
    if not isinstance(flags, list) or not all(isinstance(f, str) for f in flags):
        out.append((CONFIG, "error", "config-flags", "FeatureFlags is no list of texts"))
        flags = []
    out += [(CONFIG, "error", "config-flag", f"unknown FeatureFlag {f!r}") for f in sorted(set(flags) - FEATURES)]
    if has_scripts and "Lua" not in flags:
        out.append((CONFIG, "error", "config-lua", 'scripts but no "Lua" in FeatureFlags'))
    if has_scripts or "Lua" in flags:
        table = held.get("ModTable")
        if table is None:
            out.append((CONFIG, "warning", "config-modtable", "no ModTable"))
        elif not isinstance(table, str) or not re.fullmatch(r"[A-Za-z_]\w*", table):
            out.append((CONFIG, "warning", "config-modtable", f"ModTable {table!r} is no identifier"))
    return out


def find_mods(path: str | Path) -> list[Path]:
    """Mod folders of a project, or the folder itself if it is one."""
    top = Path(path)
    is_mod = lambda d: (d / "meta.lsx").is_file() or (d / CONFIG).is_file() or (d / SCRIPTS).is_dir()
    if (top / "Mods").is_dir():
        return sorted(d for d in (top / "Mods").iterdir() if d.is_dir() and is_mod(d))
    return [top] if is_mod(top) else []


def known_ids(held: Collection) -> DataFrame:
    """``kind, value`` of everything that the game defines."""
    objects = held.templates.select("map_key").union(held.instances.select("map_key"))
    return objects.select(F.lit("uuid").alias("kind"), F.lower("map_key").alias("value")).union(_definition_ids(held.resolved_types, False)).distinct()


def _definition_ids(types: DataFrame, permissive: bool) -> DataFrame:
    """Every definition is a stat; with ``permissive`` one without a type may be a skill or status as well."""
    kinds = F.array(F.lit("stat"), F.when(_is(F.col("type"), "SkillData", permissive), "skill"), F.when(_is(F.col("type"), "StatusData", permissive), "status"))
    return types.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), F.col("name").alias("value"))


def _is(column, name: str, permissive: bool):
    return (column == name) | ((column == "") if permissive else F.lit(False))


def own_ids(spark: SparkSession, mod: Path) -> DataFrame:
    """``kind, value`` of what a mod of an editor project defines itself."""
    public = mod.parent.parent / "Public" / mod.name
    none = spark.createDataFrame([], "kind string, value string")
    if mod.parent.name != "Mods" or not public.is_dir():
        return none
    out = none
    texts = sorted((public / "Stats/Generated/Data").glob("*.txt"))
    if texts:
        files = _contents(spark, texts)
        rows = layers._written(definitions.definitions(files).where("kind = 'definition'").select("doc", "ord", "name", "type", "using", "data"))
        out = out.union(_definition_ids(inherit.resolved_types(layers._written(inherit.definition_graph(rows, ["doc", "ord"]))), True))
    resources = sorted(p for p in (public / "RootTemplates").glob("*") if p.suffix.lower() in (".lsf", ".lsx"))
    if resources:
        files = _contents(spark, resources)
        objects = trees.nodes(files).where("id = 'GameObjects'").select("doc", "node_idx")
        keys = trees.attributes(files).where("id = 'MapKey' AND coalesce(value, handle, '') <> ''").join(objects, ["doc", "node_idx"])
        out = out.union(keys.select(F.lit("uuid"), F.lower(F.coalesce("value", "handle"))))
    return out


def _contents(spark: SparkSession, paths: list[Path]) -> DataFrame:
    """``doc, content`` of files, in path order."""
    return spark.read.format("binaryFile").load([f"file://{p.resolve()}" for p in paths]).select(F.col("path").alias("doc"), "content")


def _scan(batches: Iterator[pa.RecordBatch], references: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for mod, file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            issues, found = scan_script(definitions.text_of(data.as_py() or b""))
            rows = [(mod, file, *r) for r in found] if references else [(file, *i) for i in issues]
            if rows:
                yield as_batch(rows, REFERENCES if references else ISSUES)


def resolve_requires(references: DataFrame, files: DataFrame) -> DataFrame:
    """Issues of required files: ``files`` has ``mod, path`` below the script folder. Exact, else but for case, else missing."""
    wanted = references.where("kind = 'require'").withColumn("path", F.regexp_replace(F.regexp_replace("value", "/+", "/"), r"(^|/)(?:\./)+", "$1"))
    exact = wanted.join(files, ["mod", "path"], "left_anti")
    loose = files.groupBy("mod", F.lower("path").alias("low")).agg(F.min("path").alias("actual"))
    joined = exact.withColumn("low", F.lower("path")).join(loose, ["mod", "low"], "left")
    found = F.col("actual").isNotNull()
    message = F.when(found, F.format_string("'%s' exists as '%s'; case counts inside archives", "value", "actual")).otherwise(F.format_string("'%s' is not below the script folder", "value"))
    return joined.select("file", "line", F.when(found, "warning").otherwise("error").alias("severity"), F.when(found, "require-case").otherwise("require-missing").alias("code"), message.alias("message"))


def lost_references(references: DataFrame, known: DataFrame) -> DataFrame:
    """References that name nothing: ``known`` has ``kind, value``; UUIDs are compared in lower case."""
    named = references.where("kind <> 'require'").withColumn("key", F.when(F.col("kind") == "uuid", F.lower("value")).otherwise(F.col("value")))
    return named.join(known.select("kind", F.col("value").alias("key")), ["kind", "key"], "left_anti")


def unknown_references(references: DataFrame, known: DataFrame) -> DataFrame:
    """Issues of references that name nothing."""
    lost = lost_references(references, known)
    what = F.when(F.col("kind") == "uuid", F.format_string("UUID %s names nothing", "value")).otherwise(F.format_string("%s: %s '%s' names nothing", "call", "kind", "value"))
    return lost.select("file", "line", F.lit("warning").alias("severity"), F.concat("kind", F.lit("-unknown")).alias("code"), what.alias("message"))


def lint(spark: SparkSession, path: str | Path, held: Collection | None = None) -> DataFrame:
    """``ISSUES`` of every mod at a path; ids are checked only with a collection."""
    mods = find_mods(path)
    if not mods:
        raise ValueError(f"no mod at {path}")
    top = Path(path)
    setup: list[tuple] = []
    out = spark.createDataFrame([], ISSUES)
    for mod in mods:
        rel = lambda p, m=mod: str((m / p if p else m).relative_to(top if m != top else top.parent))
        root = mod / SCRIPTS
        scripts = sorted(p for p in root.rglob("*.lua")) if root.is_dir() else []
        read = lambda n, m=mod: (m / n).read_bytes() if (m / n).is_file() else None
        own, declared = check_meta(mod.name, read("meta.lsx"))
        own += check_config(read(CONFIG), bool(scripts))
        if scripts and not any((root / b).is_file() for b in BOOTSTRAPS):
            own.append((SCRIPTS, "warning", "bootstrap-missing", "neither " + " nor ".join(sorted(BOOTSTRAPS)) + ": nothing is loaded"))
        setup += [(rel(file), 0, *rest) for file, *rest in own]
        if not scripts:
            continue
        names = spark.createDataFrame([(f"file:{p.resolve()}", rel(str(p.relative_to(mod)))) for p in scripts], "doc string, file string")
        files = _contents(spark, scripts).join(names, "doc").select(F.lit(mod.name).alias("mod"), "file", "content")
        references = layers._written(files.mapInArrow(lambda b: _scan(b, True), REFERENCES))
        out = out.union(files.mapInArrow(lambda b: _scan(b, False), ISSUES))
        every = [(mod.name, str(p.relative_to(root))) for p in sorted(root.rglob("*")) if p.is_file()]
        out = out.union(resolve_requires(references, spark.createDataFrame(every, "mod string, path string")))
        if held is not None:
            known = known_ids(held).union(own_ids(spark, mod))
            if declared:
                known = known.union(spark.createDataFrame([("uuid", declared)], "kind string, value string"))
            out = out.union(unknown_references(references, known))
    if setup:
        out = spark.createDataFrame(setup, ISSUES).union(out)
    return out


def report(issues: DataFrame) -> str:
    """One line an issue and the counts of errors and warnings."""
    rows = issues.orderBy("file", "line", "code", "message").collect()
    lines = [f"{r['file']}{':' + str(r['line']) if r['line'] else ''}: {r['severity']}: {r['message']} [{r['code']}]" for r in rows]
    errors = sum(r["severity"] == "error" for r in rows)
    return "\n".join([*lines, f"{errors} error(s), {len(rows) - errors} warning(s)"])

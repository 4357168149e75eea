"""A small installation with a base, a patch, level data and a language archive: data sets, search, exports, lint."""

import json

import pytest

from lamina.operators import lint
from lamina.operators.collection import Collection, data_folder, find_install
from lamina.operators.find import find
from lamina.sinks import exports, skeleton
from lamina.sources import archives, definitions, localization, trees

SWORD, SHIELD, RING = "aaaaaaaa-0000-0000-0000-000000000001", "aaaaaaaa-0000-0000-0000-000000000002", "AAAAAAAA-0000-0000-0000-00000000000B"
PLACED = "bbbbbbbb-0000-0000-0000-000000000001"


def objects(*rows):
    tree = trees.Tree()
    top = tree.add(trees.Node("Templates", -1, "Templates"), [])
    for row in rows:
        name, handle = row.pop("DisplayName", (None, None))
        own = [trees.Attribute(k, "FixedString", v) for k, v in row.items()] + ([trees.Attribute("DisplayName", "TranslatedString", name, handle)] if handle or name else [])
        tree.add(trees.Node("GameObjects", top, "Templates"), own)
    return tree


BASE_STATS = """key "Max","10"
new entry "_Base"
type "Weapon"
data "Durability" "100"
data "Value" "1"
new entry "WPN_Sword"
using "_Base"
data "Damage Type" "Slashing"
data "Damage Range" "4"
data "DisplayName" "h00000001g0001g0001g0001g000000000001;1"
new entry "Loop_A"
using "Loop_B"
new entry "Loop_B"
using "Loop_A"
new entry "ARM_Unique"
type "Armor"
data "DisplayName" "h0000000ag0001g0001g0001g00000000000a;3"
data "RootTemplate" "aaaaaaaa-0000-0000-0000-000000000002"
new entry "Skill_Fire"
type "SkillData"
new entry "BURNING"
type "StatusData"
"""
PATCH_STATS = 'key "Max","20"\nnew entry "WPN_Sword"\nusing "WPN_Sword"\ndata "Damage Range" "6"\n'
RECIPES = 'new ItemCombination "Make"\ndata "Object 1" "OBJ_Herb"\ndata "Object 2" "WPN_Sword"\nnew ItemCombinationResult "Make_1"\ndata "Result 1" "OBJ_Potion"\ndata "ResultAmount 1" "2"\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("game")
    data = top / "DefEd" / "Data"
    (data / "Localization").mkdir(parents=True)
    (top / "Data").mkdir()
    archives.write_archive(top / "Data" / "Old.pak", [("x", b"y")])
    base = objects({"MapKey": SWORD, "Name": "Sword", "Stats": "WPN_Sword", "DisplayName": (None, "h00000001g0001g0001g0001g000000000001")}, {"MapKey": SHIELD, "Name": "Twin"}, {"MapKey": RING, "Name": "Twin", "DisplayName": ("Inline ring", "hffg1g1g1g1")})
    archives.write_archive(data / "Shared.pak", [("Public/S/RootTemplates/a.lsf", trees.write_binary(base)), ("Public/S/Stats/Generated/Data/W.txt", BASE_STATS.encode()), ("Public/S/Stats/Generated/Data/Bad.txt", b'data "orphan" "1"'), ("Public/S/RootTemplates/bad.lsx", b"<save"), ("Public/S/Stats/Generated/ItemCombos.txt", RECIPES.encode()), ("Public/S/only.txt", b"old")])
    patch = objects({"MapKey": SWORD, "Name": "Great Sword", "Stats": "WPN_Sword", "DisplayName": (None, "h00000001g0001g0001g0001g000000000001")})
    archives.write_archive(data / "Patch2.pak", [("Public/S/RootTemplates/a.lsx", trees.write_xml(patch).encode()), ("Public/S/Stats/Generated/Data/W.txt", PATCH_STATS.encode()), ("Public/S/only.txt", b"new")])
    placed = objects({"MapKey": PLACED, "Name": "S_Placed", "TemplateName": SWORD})
    archives.write_archive(data / "Level.pak", [("Mods/S/Globals/Fort/Items/_merged.lsx", trees.write_xml(placed).encode()), ("Mods/S/Globals/Fort/Other/x.lsx", b"<save")])
    texts = [("h00000001g0001g0001g0001g000000000001", 2, "Hero’s Sword"), ("h00000001g0001g0001g0001g000000000001", 1, "no"), ("h0000000ag0001g0001g0001g00000000000a", 1, "Tyrant's Helm"), ("hcg1g1g1g1", 1, "Only a text")]
    archives.write_archive(data / "Localization" / "English.pak", [("a.xml", localization.write(texts)), ("bad.xml", b"<x/>")])
    archives.write_archive(data / "Localization" / "German.pak", [("b.xml", localization.write([("h00000001g0001g0001g0001g000000000001", 9, "Schwert")]))])
    (data / "Broken.pak").write_bytes((data / "Shared.pak").read_bytes()[200:])
    (data / "Textures_1.pak").write_bytes(b"a further part")
    return top


@pytest.fixture(scope="module")
def held(spark, folder):
    return Collection(spark, path=folder)


def test_folders(folder, tmp_path, monkeypatch):
    assert data_folder(folder) == folder / "DefEd" / "Data" and find_install(tmp_path) is None
    monkeypatch.setenv("LAMINA_INSTALL", str(folder))
    assert find_install() == folder


def test_archives_and_files(held):
    assert [p.rsplit("/", 1)[1] for p in held.paths] == ["Level.pak", "Shared.pak", "Patch2.pak"]
    assert held.read("Public/S/only.txt") == b"new"
    assert [r["name"] for r in held.find_files("STATS/*/w.txt").collect()] == [] and [r["name"] for r in held.find_files("*/W.TXT").collect()] == ["Public/S/Stats/Generated/Data/W.txt"]
    assert sorted((r["archive"], r["name"]) for r in held.search("only.txt").collect()) == [("Patch2.pak", "Public/S/only.txt"), ("Shared.pak", "Public/S/only.txt")]
    with pytest.raises(FileNotFoundError):
        held.read("none")
    found = {r["archive"]: (r["version"], r["entries"], bool(r["error"])) for r in held.inventory().collect()}
    assert found["Patch2.pak"] == (13, 3, False) and found["Broken.pak"][2] and "Textures_1.pak" not in found


def test_definitions(held):
    data = {r["name"]: r for r in held.resolved.collect()}
    assert data["WPN_Sword"]["data"] == {"Durability": "100", "Value": "1", "Damage Type": "Slashing", "Damage Range": "6", "DisplayName": "h00000001g0001g0001g0001g000000000001;1"}
    assert [e["key"] for e in data["WPN_Sword"]["entries"]] == ["Durability", "Value", "Damage Type", "Damage Range", "DisplayName"]
    assert data["Loop_A"]["error"] and data["Loop_A"]["data"] is None
    types = {r["name"]: r["type"] for r in held.resolved_types.collect()}
    assert types["WPN_Sword"] == "Weapon" and types["Loop_A"] == ""
    assert [(r["key"], r["value"]) for r in held.globals.collect()] == [("Max", "20")]


def test_objects_texts_recipes_issues(held):
    got = {r["map_key"]: r for r in held.templates.collect()}
    assert got[SWORD]["name"] == "Great Sword" and got[SWORD]["display_name"] == "Hero’s Sword" and got[SWORD]["source"].endswith("a.lsx")
    assert got[RING]["display_name"] == "Inline ring" and set(got) == {SWORD, SHIELD, RING}
    (placed,) = held.instances.collect()
    assert (placed["type"], placed["level"], placed["parent_template"]) == ("item instance", "Fort", SWORD)
    (recipe,) = held.recipes.collect()
    assert [x["object"] for x in recipe["ingredients"]] == ["OBJ_Herb", "WPN_Sword"] and [(x["object"], x["amount"]) for x in recipe["results"]] == [("OBJ_Potion", "2")]
    files = {r["file"] for r in held.issues.collect()}
    assert files == {"Broken.pak", "Public/S/Stats/Generated/Data/Bad.txt", "Public/S/RootTemplates/bad.lsx", "bad.xml"}
    rows = held.typed("weapons").collect()
    assert [r["name"] for r in rows] == ["_Base", "WPN_Sword"] and rows[1]["display_name"] == "Hero’s Sword"


@pytest.mark.parametrize(
    "query, tier, shown",
    [
        (SWORD.upper(), 1, ["template " + SWORD, "Damage Range: 6"]),
        (RING, 1, ["template " + RING]),
        (RING.lower(), 1, []),
        ("h00000001g0001g0001g0001g000000000001", 2, ["text: Hero’s Sword", "template " + SWORD, "stats entry WPN_Sword"]),
        ("h0000000ag0001g0001g0001g00000000000a", 2, ["text: Tyrant's Helm", "stats entry ARM_Unique", "template " + SHIELD]),
        ("WPN_Sword", 3, ["stats entry WPN_Sword", "template " + SWORD, "ingredient in: Make: OBJ_Herb + WPN_Sword -> OBJ_Potion x2"]),
        ("s_placed", 4, ["instance " + PLACED, "base name: Great Sword", "Durability: 100"]),
        ("hero's sword", 5, ["template " + SWORD]),
        ("TYRANT’S helm", 6, ["stats entry ARM_Unique", "template " + SHIELD]),
        ("OBJ_Potion", 7, ["crafted by: Make"]),
    ],
)
def test_tiers(held, query, tier, shown):
    out = find(held, f" {query} ")
    assert out.tier == tier and out.found == bool(shown)
    assert all(text in out.report() for text in shown)


def test_suggestions(held):
    out = find(held, "swor")
    assert out.tier == 8 and out.suggestions == [f"Great Sword  (Hero’s Sword)  {SWORD}", "WPN_Sword  (stats: entry)", "h00000001g0001g0001g0001g000000000001  (text: Hero’s Sword)"]
    assert "Only a text" in find(held, "only a te").report() and find(held, "nothing at all").report().startswith("no match")


def test_exports(held, tmp_path):
    assert exports.write_json(exports.object_rows(held.templates), tmp_path / "t.json") == 3
    rows = json.loads((tmp_path / "t.json").read_text("utf-8"))
    assert [r["map_key"] for r in rows] == sorted([SWORD, SHIELD, RING]) and tuple(rows[0]) == exports.EXPORTED
    assert exports.write_json(held.templates.limit(0), tmp_path / "e.json") == 0 and json.loads((tmp_path / "e.json").read_text()) == []
    modules = exports.lua_modules(held)
    assert f'["Great Sword"] = "{SWORD}",' in modules["Templates.lua"] and "-- omitted (1 ambiguous names):\n--   Twin" in modules["Templates.lua"]
    assert '["Skill_Fire"] = "Skill_Fire",' in modules["Skills.lua"] and "BURNING" in modules["Statuses.lua"]
    assert exports.write_page(held, tmp_path / "site") == 4
    assert [r[1] for r in json.loads((tmp_path / "site/data/records.json").read_text("utf-8"))] == ["Great Sword", "S_Placed", "Twin", "Twin"]


def test_cache(held, tmp_path):
    calls = []
    make = lambda: calls.append(1) or held.templates
    first, again = (exports.cached(held, tmp_path, "templates", make).count() for _ in range(2))
    assert first == again == 3 and len(calls) == 1 and exports.cache_size(tmp_path) > 0
    before = held.fingerprint()
    path = held.data_dir / "Textures_1.pak"
    path.write_bytes(path.read_bytes() + b"x")
    assert held.fingerprint() != before and exports.clear_cache(tmp_path) == 1


def test_extraction(folder, tmp_path):
    path, seen = folder / "DefEd/Data/Patch2.pak", []
    assert exports.extract(path, tmp_path, ["*/STATS/*"]) == (["Public/S/Stats/Generated/Data/W.txt"], [])
    written, passed = exports.extract(path, tmp_path, progress=lambda n, w: seen.append((n, w)))
    assert len(written) == 2 and len(passed) == 1 and len(seen) == 3
    assert exports.extract(path, tmp_path)[0] == [] and len(exports.extract(path, tmp_path, force=True)[0]) == 3
    (tmp_path / "Public/S/only.txt").unlink()
    assert exports.extract(path, tmp_path)[0] == ["Public/S/only.txt"]
    bad = archives.write_archive(tmp_path / "bad.pak", [("fine", b"1"), ("../out", b"2")])
    with pytest.raises(ValueError):
        exports.extract(bad, tmp_path / "o")
    assert list(exports.load_manifest(tmp_path / "o")) == ["fine"]
    (tmp_path / "o" / exports.MANIFEST).write_text("{")
    assert exports.load_manifest(tmp_path / "o") == {}


def test_streamed_extraction(spark, folder, tmp_path):
    from lamina.streaming.watch import extract_new

    came = tmp_path / "in"
    came.mkdir()
    archives.write_archive(came / "one.pak", [("a.txt", b"1"), ("b.txt", b"2")])
    run = lambda: extract_new(spark, str(came), str(tmp_path / "out"), str(tmp_path / "state"))
    assert run() == 2 and run() == 0
    archives.write_archive(came / "two.pak", [("a.txt", b"1"), ("b.txt", b"new"), ("c.txt", b"3")])
    (came / "foreign.pak").write_bytes(b"no archive")
    assert run() == 2 and (tmp_path / "out/b.txt").read_bytes() == b"new"


def issues_of(spark, path, held=None):
    return sorted((r["code"], r["line"]) for r in lint.lint(spark, path, held).collect())


def test_lint_of_a_new_mod(spark, tmp_path):
    top, files = skeleton.create_mod(tmp_path, "My Mod!", author="me")
    assert len(files) == 6 and issues_of(spark, tmp_path) == [] and issues_of(spark, top) == []
    with pytest.raises(ValueError):
        skeleton.create_mod(tmp_path, "!!!")
    with pytest.raises(ValueError):
        skeleton.create_mod(tmp_path, "x", features=("LUA",))


def test_lint_finds_each_fault(spark, held, tmp_path):
    top, _ = skeleton.create_mod(tmp_path, "Mod", mod_uuid="cccccccc-0000-0000-0000-000000000001")
    scripts = top / lint.SCRIPTS
    (scripts / "Server" / "Main.lua").write_text(
        'Ext.Require("server/main.lua")\nExt.Require("Server\\\\Main.lua")\nExt.Require("gone.lua")\n--[[ Ext.Require("commented.lua") ]]\n'
        f'local a = "{SWORD.upper()}" .. "Name_dddddddd-0000-0000-0000-000000000001" .. "cccccccc-0000-0000-0000-000000000001"\n'
        'CharacterAddSkill(x, "Skill_Fire") Osi.CharacterAddSkill(x, "Skill_Ice") -- ApplyStatus(x, "NONE")\nApplyStatus(x, "BURNING") HasActiveStatus(x, "WET")\n'
        'Ext.GetStat("WPN_Sword") Ext.GetStat("WPN_Swrd") Ext.GetStat("Mine")\nwhile x do if y then for i = 1, 2 do end end\n'
    )
    public = tmp_path / "Public" / top.name / "Stats/Generated/Data"
    public.mkdir(parents=True)
    (public / "own.txt").write_text(definitions.write([{"name": "Mine", "type": "", "using": None, "data": {}}]))
    (scripts / "Client" / "Main.lua").write_text("local s = 'open\nlocal l = [==[ long ]=]\n")
    (scripts / "Client" / "more.lua").write_text("end --[[ never\n")
    assert issues_of(spark, tmp_path, held) == [
        ("lua-blocks", 1), ("lua-blocks", 9), ("lua-comment", 1), ("lua-string", 1), ("lua-string", 2), ("require-case", 1), ("require-missing", 3), ("require-path", 2),
        ("skill-unknown", 6), ("stat-unknown", 8), ("status-unknown", 7), ("uuid-unknown", 5),
    ]
    (top / "meta.lsx").write_text("<save><region id='Config'><node id='root'><children><node id='ModuleInfo'><attribute id='UUID' type='22' value='x'/><attribute id='Folder' type='30' value='other'/></node></children></node></region></save>")
    (top / lint.CONFIG).write_text('{"RequiredExtensionVersion": true, "FeatureFlags": ["lua"], "ModTable": "1x", "More": 1}')
    for name in lint.BOOTSTRAPS:
        (scripts / name).unlink()
    codes = {c for c, _ in issues_of(spark, tmp_path)}
    assert {"meta-uuid", "meta-folder", "config-version", "config-flag", "config-lua", "config-modtable", "config-key", "bootstrap-missing"} <= codes
    (top / "meta.lsx").write_text("<save/>")
    (top / lint.CONFIG).write_text("[]")
    assert {"meta-moduleinfo", "config-json"} <= {c for c, _ in issues_of(spark, tmp_path)}
    (top / "meta.lsx").write_text("<")
    (top / lint.CONFIG).write_text('{"FeatureFlags": 3}')
    assert {"meta-parse", "config-flags", "config-modtable"} <= {c for c, _ in issues_of(spark, tmp_path)}
    (top / "meta.lsx").unlink()
    (top / lint.CONFIG).unlink()
    assert {"meta-missing", "config-missing"} <= {c for c, _ in issues_of(spark, tmp_path)}
    with pytest.raises(ValueError):
        lint.lint(spark, tmp_path / "Public")


def test_command_line(folder, tmp_path, capsys):
    from lamina.__main__ import main

    path = str(folder / "DefEd/Data/Patch2.pak")
    assert main(["list", path]) == 0 and "only.txt" in capsys.readouterr().out
    assert main(["--game-path", str(folder), "search", "ONLY*"]) == 0 and "0 match" in capsys.readouterr().out
    assert main(["--game-path", str(folder), "search", "only", "--limit", "1"]) == 0 and "2 match(es), first 1 shown" in capsys.readouterr().out
    assert main(["unpack", str(tmp_path / "u"), path]) == 0 and "3 written" in capsys.readouterr().out
    assert main(["convert", str(tmp_path / "u/Public/S/RootTemplates/a.lsx"), str(tmp_path / "a.lsf")]) == 0 and (tmp_path / "a.lsf").read_bytes()[:4] == b"LSOF"
    assert main(["convert", path, str(tmp_path / "a.txt")]) == 1 and main(["list", "none.pak"]) == 1
    assert main(["new", "Mod", str(tmp_path / "m")]) == 0

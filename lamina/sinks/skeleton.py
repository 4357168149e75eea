"""Skeletons of script mods."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import Path

from lamina.operators.lint import CONFIG, FEATURES, SCRIPTS
from lamina.sources.trees import VERSION_32, Attribute, Node, Tree, pack_version, write_xml

#: The extender's version that a new mod asks for.
EXTENSION_VERSION = 58
# Attributes of a mod's description, with their types.
INFO = {
    "Author": "LSWString", "CharacterCreationLevelName": "FixedString", "Description": "LSWString", "Folder": "LSWString", "GMTemplate": "FixedString", "LobbyLevelName": "FixedString",
    "MD5": "LSString", "MenuLevelName": "FixedString", "Name": "FixedString", "NumPlayers": "uint8", "PhotoBooth": "FixedString", "StartupLevelName": "FixedString", "Tags": "LSWString",
    "Type": "FixedString", "UUID": "FixedString", "Version": "int32",
}


def meta(values: dict[str, str]) -> str:
    """The description of a mod as XML; attributes without a value are empty."""
    tree = Tree()
    root = tree.add(Node("root", -1, "Config"), [])
    tree.add(Node("Dependencies", root), [])
    info = tree.add(Node("ModuleInfo", root), [Attribute(name, kind, values.get(name, "")) for name, kind in INFO.items()])
    tree.add(Node("PublishVersion", info), [Attribute("Version", "int32", values["Version"])])
    tree.add(Node("Scripts", info), [])
    modes = tree.add(Node("TargetModes", info), [])
    tree.add(Node("Target", modes), [Attribute("Object", "FixedString", "Story")])
    return write_xml(tree.ordered())


def create_mod(root: str | Path, name: str, *, author: str = "", description: str = "", mod_uuid: str | None = None, mod_table: str | None = None, features: tuple[str, ...] = ("Lua", "OsirisExtensions"), extension_version: int = EXTENSION_VERSION, version: tuple[int, int, int, int] = (1, 0, 0, 0)) -> tuple[Path, list[Path]]:
    """Writes a new mod's description, settings and scripts; its folder and the files."""
    safe = re.sub(r"\W", "", name, flags=re.ASCII)
    if not safe:
        raise ValueError(f"{name!r} has no letters or digits")
    own = str(uuid.UUID(mod_uuid) if mod_uuid else uuid.uuid4())
    if unknown := sorted(set(features) - FEATURES):
        raise ValueError(f"unknown features {unknown}")
    folder = f"{safe}_{own}"
    top = Path(root) / "Mods" / folder
    if top.exists():
        raise ValueError(f"{top} is there already")
    packed = str(pack_version(version, VERSION_32))
    table = mod_table or safe
    files = {
        "meta.lsx": meta({"Author": author, "Description": description, "Folder": folder, "Name": name, "NumPlayers": "4", "Type": "Add-on", "UUID": own, "Version": packed}),
        CONFIG: json.dumps({"RequiredExtensionVersion": extension_version, "ModTable": table, "FeatureFlags": list(features)}, indent=4) + "\n",
    }
    for side in ("Server", "Client"):
        files[f"{SCRIPTS}/Bootstrap{side}.lua"] = f'-- {name}: what the {side.lower()} loads first; require all else from here.\nExt.Require("{side}/Main.lua")\n'
        files[f"{SCRIPTS}/{side}/Main.lua"] = f'local function loaded()\n    Ext.Print("[{table}] {side.lower()} loaded")\nend\n\nExt.RegisterListener("SessionLoaded", loaded)\n'
    written = []
    for path, text in files.items():
        target = top / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, "utf-8")
        written.append(target)
    return top, written

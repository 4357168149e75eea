"""Names from archives as paths below a folder; anything that could lead elsewhere is refused."""

from __future__ import annotations

import re
from pathlib import Path

# Device names that are no files on some systems.
DEVICES = {"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))}


class UnsafePath(ValueError):
    pass


def safe_path(root: str | Path, name: str) -> Path:
    """Where a name goes below ``root``."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or "\0" in name:
        raise UnsafePath(f"{name!r} names no file")
    if re.match(r"[\\/]|[A-Za-z]:", name):
        raise UnsafePath(f"{name!r} is absolute")
    for part in parts:
        if part == ".." or ":" in part or part.split(".", 1)[0].lower() in DEVICES:
            raise UnsafePath(f"{part!r} in {name!r}")
    top = Path(root).resolve()
    target = top.joinpath(*parts).resolve()
    if not target.is_relative_to(top):
        raise UnsafePath(f"{name!r} leads out of {root}")
    return target

"""Command line: ``python -m lamina COMMAND``. Errors end with status 1."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from lamina.operators import lookup
from lamina.operators.collection import TYPED, Collection, data_folder, find_install
from lamina.sinks import exports, skeleton
from lamina.sources import archives, trees


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lamina", description=__doc__)
    out.add_argument("--game-path", type=Path, help="folder of the installation")
    out.add_argument("--data-dir", type=Path, help="folder of the archives")
    out.add_argument("--cache", type=Path, help="folder of cached tables")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options: dict) -> None:
        own = commands.add_parser(name)
        for a in arguments:
            own.add_argument(a[0], **(a[1] if len(a) > 1 else {}))
        for flag, given in options.items():
            own.add_argument(f"--{flag.replace('_', '-')}", **given)

    file = ("file", {"type": Path})
    folder = ("folder", {"type": Path})
    command("list", file)
    command("cat", file, ("name",))
    command("unpack", folder, ("file", {"type": Path, "nargs": "?"}), pattern={"action": "append"}, force={"action": "store_true"})
    command("search", ("pattern",), limit={"type": int, "default": 50})
    command("convert", file, ("output", {"type": Path}), binary_version={"type": int, "default": 3})
    command("lookup", ("query", {"nargs": "+"}))
    command("export", ("dataset", {"choices": [*TYPED, "all"]}), folder)
    command("site", folder)
    command("lua", folder)
    for name in ("templates", "instances", "recipes"):
        command(name, file)
    command("new", ("name",), folder, author={"default": ""}, description={"default": ""}, uuid={}, mod_table={}, flag={"action": "append"}, extension_version={"type": int, "default": skeleton.EXTENSION_VERSION})
    command("lint", folder, no_game={"action": "store_true"})
    command("cache", ("action", {"choices": ["info", "clear"], "nargs": "?", "default": "info"}))
    command("doctor")
    return out


def _data(args: argparse.Namespace) -> Path:
    found = args.data_dir or ((root := find_install(args.game_path)) and data_folder(root))
    if not found:
        raise FileNotFoundError("no installation found; name one with --game-path or --data-dir")
    return Path(found)


def _collection(args: argparse.Namespace) -> Collection:
    from lamina.session import local_session

    return Collection(local_session(), _data(args))


def _unpack(args: argparse.Namespace) -> int:
    failed = written = passed = 0
    for path in [args.file] if args.file else sorted(_data(args).rglob("*.pak")):
        if not archives.is_archive(path):
            continue  # a further part, or a foreign file
        try:
            new, same = exports.extract(path, args.folder, args.pattern, args.force)
        except ValueError as problem:
            failed += 1
            print(f"error: {path.name}: {problem}", file=sys.stderr)
            continue
        written, passed = written + len(new), passed + len(same)
        if new or same:
            print(f"{path.name}: {len(new)} written, {len(same)} unchanged")
    print(f"{written} written, {passed} unchanged")
    return int(failed > 0)


def _search(args: argparse.Namespace) -> int:
    hits = []
    for path in sorted(_data(args).rglob("*.pak")):
        if archives.is_archive(path):
            try:
                names = [e.name for e in archives.open_archive(path).entries]
            except archives.ArchiveError as problem:
                print(f"warning: {path.name}: {problem}", file=sys.stderr)
                continue
            glob = any(c in args.pattern for c in "*?[")
            hits += [(path.name, n) for n in names if (lookup.glob_match(n, args.pattern) if glob else args.pattern.lower() in n.lower())]
    for archive, name in hits[: args.limit]:
        print(f"{archive}  {name}")
    print(f"{len(hits)} match(es)" + (f", first {args.limit} shown" if len(hits) > args.limit else ""))
    return 0


def run(args: argparse.Namespace) -> int:
    name = args.command
    if name == "list":
        for entry in archives.open_archive(args.file).entries:
            print(f"{entry.size:>12}  {entry.name}")
    elif name == "cat":
        sys.stdout.buffer.write(archives.read_file(args.file, args.name))
    elif name == "unpack":
        return _unpack(args)
    elif name == "search":
        return _search(args)
    elif name == "convert":
        suffix, data = args.output.suffix.lower(), args.file.read_bytes()
        args.output.write_bytes(trees.write_binary(trees.read_tree(data), args.binary_version) if suffix == ".lsf" else trees.convert(data, suffix))
        print(f"{args.file} -> {args.output}")
    elif name == "new":
        top, files = skeleton.create_mod(args.folder, args.name, author=args.author, description=args.description, mod_uuid=args.uuid, mod_table=args.mod_table, features=tuple(args.flag or ("Lua", "OsirisExtensions")), extension_version=args.extension_version)
        print("\n".join(map(str, files)) + f"\n{top.name}")
    elif name == "cache":
        if args.cache is None:
            raise ValueError("name the folder with --cache")
        print(f"{exports.clear_cache(args.cache)} cleared" if args.action == "clear" else f"{args.cache}: {exports.cache_size(args.cache) / 1e6:.1f} MB")
    elif name == "lint":
        from lamina.operators import lint
        from lamina.session import local_session

        held = None if args.no_game or not (args.data_dir or find_install(args.game_path)) else _collection(args)
        issues = lint.lint(local_session(), args.folder, held)
        print(lint.report(issues))
        return int(not issues.where("severity = 'error'").isEmpty())
    elif name == "doctor":
        rows = _collection(args).inventory().collect()
        print(f"data: {_data(args)}")
        for r in rows:
            print(f"  {r['archive']}: " + (f"ERROR {r['error']}" if r["error"] else f"v{r['version']}, {r['entries']} files" + ", solid" * r["solid"]))
        return int(any(r["error"] for r in rows))
    else:
        return _data_set(name, args, _collection(args))
    return 0


def _data_set(name: str, args: argparse.Namespace, held: Collection) -> int:
    """Commands over the data sets."""
    cached = lambda kind, make: exports.cached(held, args.cache, kind, make) if args.cache else make()
    if name == "lookup":
        from lamina.operators.find import find

        found = find(held, " ".join(args.query))
        print(found.report())
        return int(not (found.found or found.suggestions))
    if name in ("templates", "instances"):
        rows = exports.object_rows(cached(name, lambda: getattr(held, name)))
    elif name == "recipes":
        rows = exports.recipe_rows(cached(name, lambda: held.recipes))
    if name in ("templates", "instances", "recipes"):
        print(f"{exports.write_json(rows, args.file)} {name} -> {args.file}")
        for issue in held.issues.collect():
            print(f"warning: {issue['file']}: {issue['error']}", file=sys.stderr)
        return 0
    args.folder.mkdir(parents=True, exist_ok=True)
    if name == "export":
        for kind in sorted(TYPED) if args.dataset == "all" else [args.dataset]:
            print(f"{exports.write_json(held.typed(kind), args.folder / f'{kind}.json')} {kind}")
    elif name == "lua":
        for file, text in exports.lua_modules(held).items():
            (args.folder / file).write_text(text, "utf-8")
            print(args.folder / file)
    else:
        print(f"{exports.write_page(held, args.folder)} rows -> {args.folder}")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, OSError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())

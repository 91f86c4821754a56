"""Command line: ``check`` a tree of sources, ``lsp`` serves editors, ``cache`` status, clear and prune, ``env`` detection, effective ``config``, ``stubs`` of a
library's sources.

Exit codes: 0 nothing found, 1 findings, 2 wrong use.
"""

from __future__ import annotations

import argparse
import contextlib
import itertools
import sys
from collections.abc import Sequence
from pathlib import Path

from effectflow.runtime import cut


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="effectflow", description=__doc__)
    sub = out.add_subparsers(dest="command")
    check = sub.add_parser("check", help="report effects that no caller handles")
    check.add_argument("paths", nargs="+")
    check.add_argument("--stubs", action="append", default=[], help="JSON stub files or folders")
    check.add_argument("--python", default="3.12", help="version that stubs are chosen for")
    check.add_argument("--include-ignored", action="store_true")
    check.add_argument("--json", action="store_true")
    check.add_argument("-o", "--output")
    check.add_argument("-v", "--verbose", action="store_true")
    check.add_argument("--cache", help="folder of kept facts")
    check.add_argument("--no-cache", action="store_true", help="parse every file, keep nothing")
    check.add_argument("--library", action="append", help="folders of installed sources (default: this interpreter's)")
    check.add_argument("--debug", action="store_true", help="log what Spark does")
    for flag in ("local", "strict", "absolute", "full-module-path", "no-warn-native", "sound"):
        check.add_argument(f"--{flag}", action="store_true")
    lsp = sub.add_parser("lsp", help="serve an editor over stdio or TCP")
    lsp.add_argument("--tcp", action="store_true")
    lsp.add_argument("--port", type=int, default=2087)
    lsp.add_argument("--stubs", action="append", default=[], help="JSON stub files or folders")
    lsp.add_argument("--python", default="3.12")
    made = sub.add_parser("stubs", help="make a stub file from an interpreter's sources, Python and C")
    made.add_argument("folder", help="a source tree with Lib/ (and Modules/, Objects/, Python/), or a folder of Python sources")
    made.add_argument("--python", required=True, help="version specifier, as >=3.12,<3.13")
    made.add_argument("-o", "--output", required=True)
    made.add_argument("--name", default="stdlib")
    made.add_argument("--module", action="append", default=[], help="only these packages")
    cache = sub.add_parser("cache", help="kept facts")
    cache.add_argument("action", choices=("status", "clear", "prune"))
    cache.add_argument("folder")
    env = sub.add_parser("env", help="virtual environments of a project")
    env.add_argument("root", nargs="?", default=".")
    env.add_argument("--tool")
    env.add_argument("--all", action="store_true")
    env.add_argument("--json", action="store_true")
    sub.add_parser("config", help="effective settings").add_argument("root", nargs="?", default=".")
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("effectflow").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _layers(spark, root: Path):
    from effectflow.sources import settings

    read = lambda name: (root / name).read_text() if (root / name).exists() else None
    return settings.layers(
        spark, ("pyproject", settings.toml_layer(read("pyproject.toml"), "tool", "effectflow")),
        ("tool", settings.toml_layer(read(".effectflow.toml"))), ("environment", settings.environment_layer()),
    )


def _settings(spark, root: Path) -> dict:
    import json

    from effectflow.sources import settings

    return {r.key: json.loads(r.value) for r in settings.effective(_layers(spark, root), by_block=True).collect()}


def _stub_table(spark, paths: Sequence[str], python: str):
    """Stubs of all paths for one version; None without any."""
    from effectflow.sources import stubs

    table = None
    for path in paths:
        place = path if "://" in path else str(Path(path).resolve())  # Spark has a working folder of its own
        part = stubs.for_version(stubs.read_json(spark, place, "stdlib"), python)
        table = part if table is None else table.unionByName(part)
    return table


def _check(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    import sysconfig

    from effectflow.plans.check import Check, Options, report_json, report_text
    from effectflow.plans.library import Library, imported_sources
    from effectflow.sources import files, native_modules
    from effectflow.sources.cache import FactCache

    spark, found = session(), None
    spark.sparkContext.setLogLevel("INFO" if args.debug else "WARN")
    chosen = _settings(spark, Path.cwd())
    for path in map(Path, args.paths):
        if not path.exists():
            print(f"{path}: no such file or folder", file=sys.stderr)
            continue
        base = path.resolve()
        if base.is_dir():
            every = files.scan(spark, str(base))
            ignore = None if args.include_ignored else every.where(F.element_at(F.split("path", "/"), -1) == ".gitignore")
            rows = files.select_files(
                every.where(F.col("path").endswith(".py")), chosen["include"], [*files.DEFAULT_EXCLUDE, *chosen["exclude"]],
                ignore,
            ).select(F.concat(F.lit(f"{base}/"), "path").alias("path"), "text")
        else:
            rows = spark.createDataFrame([(str(base), base.read_text(errors="replace"))], "path string, text string")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return 2
    found = cut(found)
    table = _stub_table(spark, args.stubs, args.python)
    options = Options(
        ignored=chosen["ignore_exceptions"], local_only=args.local or chosen["analysis.local_only"], strict=args.strict or chosen["analysis.strict_mode"], mode="sound" if args.sound else "reference",
        full_module_path=args.full_module_path or chosen["analysis.full_module_path"], warn_native=chosen["analysis.warn_native"] and not args.no_warn_native,
    )
    keeps = args.cache and chosen["cache.enabled"] and not args.no_cache
    kept = FactCache(spark, str(Path(args.cache).resolve()), chosen["cache.ttl_hours"], chosen["cache.max_file_entries"]) if keeps else None
    roots = args.library or [sysconfig.get_path("stdlib"), sysconfig.get_path("purelib")]
    places = [str(Path(r).resolve()) for r in roots]
    modules = None if options.local_only else native_modules.standard(spark).unionByName(native_modules.below(spark, places))
    sources = None if options.local_only else imported_sources(spark, found, places)
    library = None
    if sources is not None:
        library = Library(sources, FactCache(spark, f"{Path(args.cache).resolve()}/library") if keeps else None)
    run = Check(found, table, modules, options, library, kept)
    shown = run.diagnostics.cache()
    if args.json:
        lines = [report_json(run).first().value]
    else:
        here = str(Path.cwd()) + "/"
        rows = shown if args.absolute else shown.withColumn("file_id", F.regexp_replace("file_id", "^" + here.replace(".", r"\."), ""))
        total = run.summary.first()
        lines = itertools.chain(
            (r.value for r in report_text(rows).toLocalIterator()), [f"{total.issues} issue(s) in {total.files} file(s)"],
            [f"{total.functions} functions, {total.exceptions} raise statements"] * args.verbose,
        )
    with contextlib.ExitStack() as stack:
        out = stack.enter_context(open(args.output, "w")) if args.output else sys.stdout
        for line in lines:
            print(line, file=out)
    return int(shown.limit(1).count() > 0)


def _env(args: argparse.Namespace) -> int:
    import json
    import os

    from effectflow.operators import detect

    spark, root = session(), Path(args.root).resolve()
    known = [
        p for p in (
            *root.glob("*"), *root.glob(".*"), *root.glob("*/pyvenv.cfg"), *root.glob(".venv/*"), *root.glob("*/bin/python"),
            *root.glob("*/Scripts/python.exe"),
        ) if p.is_file()
    ]
    text = lambda p: p.read_text(errors="replace") if p.name in ("pyproject.toml", ".pdm.toml") else None
    rows = [(str(root), str(p.relative_to(root)), text(p)) for p in sorted(set(known))] or [(str(root), "", None)]
    told = [(str(root), "environment", os.environ["VIRTUAL_ENV"])] if os.environ.get("VIRTUAL_ENV") else []
    found = detect.environments(
        spark.createDataFrame(rows, "project string, rel_path string, content string"),
        spark.createDataFrame(told, "project string, tool string, path string"),
    )
    found = found.where(found.tool == args.tool) if args.tool else found
    out = [r.asDict() for r in (detect.all_environments(found) if args.all else detect.first_environment(found)).collect()]
    if args.json:
        print(json.dumps(out if args.all else out[0] if out else None))
    else:
        print("\n".join(f"{r['tool']}: {r['venv_path']}" for r in out) or "no environment found")
    return 0 if out else 1


def _lsp(args: argparse.Namespace) -> int:
    from effectflow.streaming import server

    try:
        from effectflow.plans.check import Options

        s = _settings(session(), Path.cwd())
        options = Options(
            ignored=s["ignore_exceptions"], local_only=s["analysis.local_only"], strict=s["analysis.strict_mode"], warn_native=s["analysis.warn_native"],
            full_module_path=s["analysis.full_module_path"], most_per_file=s["lsp.max_diagnostics_per_file"] or None,  # 0: all
        )
        server.main(args.tcp, args.port, options, s["lsp.debounce_ms"] / 1000, _stub_table(session(), args.stubs, args.python))
    except OSError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def _stubs(args: argparse.Namespace) -> int:
    from datetime import UTC, datetime

    from pyspark.sql import functions as F

    from effectflow.operators import merge
    from effectflow.plans import stubs
    from effectflow.plans.library import native_stubs, stubs_of, united
    from effectflow.sources import files

    base = Path(args.folder).resolve()
    library = base / "Lib" if (base / "Lib").is_dir() else base
    if not base.is_dir():
        print(f"{base}: no such folder", file=sys.stderr)
        return 2
    every = files.scan(session(), str(library), "*.py").select(F.concat(F.lit("Lib/"), "path").alias("path"), "text")
    if args.module:
        package = F.regexp_replace(F.element_at(F.split("path", "/"), 2), r"\.py$", "")
        every = every.where(package.isin(*args.module))
    every = cut(every)
    found = stubs.with_twins(stubs_of(files.library_modules(every).join(every, "path")))
    found = merge.highest(found, ["module", "cls", "member", "exc"], "confidence")
    if any((base / name).is_dir() for name in ("Modules", "Objects", "Python")):
        sources = cut(files.scan(session(), str(base), "*.[ch]").select("path", "text"))
        header = sources.where(F.col("path").endswith(".h")).select(F.lit("").alias("module"), "path", "text")
        of_module = files.native_modules(sources).join(sources, "path").select("module", "path", "text")
        of_module = of_module.where(F.col("module").isin(*args.module)) if args.module else of_module
        found = united(native_stubs(of_module.unionByName(header)), found)
    rows = cut(found)
    said = stubs.write_json(rows, args.name, args.python, datetime.now(UTC).isoformat(timespec="seconds")).first().value
    Path(args.output).write_text(said + "\n")
    print(f"{stubs.counted(rows).first().stubs} function(s) in {args.output}")
    return 0


def _cache(args: argparse.Namespace) -> int:
    from effectflow.sources.cache import FactCache

    cache = FactCache(session(), str(Path(args.folder).resolve()))
    if args.action == "clear":
        cache.clear()
    elif args.action == "prune":
        cache.prune()
    row = cache.stats().first()
    print(f"{row.files} file(s), {row.rows} fact(s), {row.stale} stale")
    return 0


def _config(args: argparse.Namespace) -> int:
    from effectflow.sources import settings

    table = _layers(session(), Path(args.root))
    for r in settings.effective(table, by_block=True).orderBy("key").collect():
        print(f"{r.key} = {r.value}  # {r.layer}")
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 2
    return {"check": _check, "lsp": _lsp, "cache": _cache, "env": _env, "config": _config, "stubs": _stubs}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())

"""File scans, project roots, ignore files, archives and library layouts as tables of paths."""

from __future__ import annotations

import fnmatch
import io
import tarfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from effectflow.functions.names import package_module
from effectflow.operators.resolve import small
from effectflow.sources import patterns

#: A scan's partitions: folders of at most LEVELS levels below the root, until there are MOST_FOLDERS; files in runs.
LEVELS, MOST_FOLDERS, RUN_FILES = 4, 256, 64

#: What a scan leaves out where nothing else is said.
DEFAULT_EXCLUDE = (".venv",)

#: Files and folders that mark a project's root: fixed names.
ROOT_MARKERS = (
    ".git", ".hg", ".svn",
    "pyproject.toml", "poetry.lock", "Pipfile", "setup.py", "setup.cfg", "requirements.txt",
    "Cargo.toml", "Cargo.lock",
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "deno.json", "deno.jsonc",
    "go.mod", "go.sum", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "composer.lock", "Gemfile", "Gemfile.lock",
    "CMakeLists.txt", "Makefile", "build.zig", "Package.swift", "pubspec.yaml", "mix.exs", "stack.yaml", "package.yaml",
    "Dockerfile", "docker-compose.yml", "README.md", "LICENSE", ".editorconfig",
)


class TreeSource(DataSource):
    """``spark.read.format("tree").load(root)``: every file below a folder as (path, size, mtime, text), hidden ones too.

    Spark's own file listing leaves out names that begin with ``_`` or ``.``, and with them ``__init__.py`` and ignore
    files. Folders are listed on the driver level by level until there are a few hundred; each is a partition then, walked
    and read on the executors through Arrow's file systems (mounted folders, and the stores that Arrow knows by their
    scheme), and so is each run of the files above them. Options: ``glob`` on file names, ``texts``.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size bigint, mtime timestamp, text string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("glob", "*"), self.options.get("texts", "true") == "true")


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, glob: str, texts: bool):
        self.root, self.glob, self.texts = root.removeprefix("file:") if root.startswith("file:/") and "://" not in root else root, glob, texts

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _opened(self.root)
        files, folders = [], [base]
        for _ in range(LEVELS):
            if not folders or len(folders) >= MOST_FOLDERS:
                break
            entries = [e for d in folders for e in store.get_file_info(fs.FileSelector(d, recursive=False, allow_not_found=True))]
            files += [e.path for e in entries if e.type == fs.FileType.File]
            folders = [e.path for e in entries if e.type == fs.FileType.Directory]
        runs = [files[k : k + RUN_FILES] for k in range(0, len(files), RUN_FILES)]
        return [InputPartition(x) for x in [*folders, *runs]] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = _opened(self.root)
        wanted = partition.value
        found = store.get_file_info(fs.FileSelector(wanted, recursive=True) if isinstance(wanted, str) else wanted)
        for f in found:
            if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.glob):
                text = None
                if self.texts:
                    with store.open_input_stream(f.path) as stream:
                        text = stream.read().decode("utf-8", "replace")
                yield f.path.removeprefix(base.rstrip("/") + "/"), f.size, f.mtime, text


def scan(spark: SparkSession, root: str, glob: str = "*", texts: bool = True) -> DataFrame:
    """(path relative to root, size, mtime, text) of all files below a folder; a missing root is an empty table.

    Without ``texts`` no file is opened and there is no such column.
    """
    spark.dataSource.register(TreeSource)
    found = spark.read.format("tree").option("glob", glob).option("texts", str(texts).lower()).load(root)
    return found if texts else found.drop("text")


def select_files(
    files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDE, ignore: DataFrame | None = None,
) -> DataFrame:
    """Files by globs and ignore files, sorted. ``ignore``: (path, text) of ignore files among them."""
    out = patterns.select_paths(files, "path", include, exclude)
    if ignore is not None:
        out = out.join(patterns.ignored_paths(out.select("path"), ignore_rules(ignore)), "path", "left_anti")
    return out.orderBy("path")


def python_files(spark: SparkSession, root: str, exclude: Sequence[str] = DEFAULT_EXCLUDE) -> DataFrame:
    return select_files(scan(spark, root, "*.py"), exclude=exclude)


def ignore_rules(ignore: DataFrame) -> DataFrame:
    """(dir, ord, regex, negated, only_dirs) of ignore files (path, text); unreadable (null) texts are skipped."""
    schema = "dir string, ord int, regex string, negated boolean, only_dirs boolean"

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                for k, line in enumerate((text or "").split("\n")):
                    if rule := patterns.ignore_rule(line):
                        out.append((path.rpartition("/")[0], k, *rule))
            yield pd.DataFrame(out, columns=["dir", "ord", "regex", "negated", "only_dirs"])

    return ignore.select("path", "text").mapInPandas(rows, schema)


def project_root(files: DataFrame, starts: DataFrame, markers: Sequence[str] = ROOT_MARKERS) -> DataFrame:
    """(start, root): the nearest folder at or above each start that holds a marker. The root folder itself never counts.

    ``files`` has every known path (files and folders) of the file system in question, ``starts`` (start) folders.
    """
    homes = files.where(
        F.element_at(F.split("path", "/"), -1).isin(*markers)
    ).select(F.regexp_replace("path", "/[^/]*$", "").alias("root")).where("root <> ''").distinct()
    parts = F.split("start", "/")
    above = starts.select(
        "start",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"),
    )
    best = above.join(small(homes), "root").groupBy("start").agg(F.max_by("root", F.length("root")).alias("root"))
    return starts.join(best, "start", "left")


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: members of tar archives (.tar, .tar.gz, .tar.xz) as (archive, member, content).

    One partition an archive, read as a stream, one member at a time, from a mounted folder or a store that Arrow knows by
    its scheme; from other stores, read them with ``binaryFile`` and pass the bytes to ``members``.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _opened(self.path)
        if store.get_file_info(base).type == fs.FileType.File:
            return [InputPartition(base)]
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".tar", ".tar.gz", ".tgz", ".tar.xz")))
        return [InputPartition(p) for p in paths] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        store, _ = _opened(self.path)
        with store.open_input_stream(partition.value, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            for m in tar:
                if m.isfile():
                    yield partition.value, m.name, tar.extractfile(m).read()


def members(archives: DataFrame) -> DataFrame:
    """(archive, member, content) of archives given as (path, content), from any store that Spark reads."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame({"archive": [path], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return archives.select("path", "content").mapInPandas(rows, "archive string, member string, content binary")


#: Fixed names: native sources that are no modules, prefixes of test modules, folders of a library that are left out.
NO_MODULES = ("config", "main", "getpath", "getbuildinfo")
TEST_PREFIXES = ("_test", "xx", "_xx")
SKIPPED_FOLDERS = (
    "test", "tests", "idlelib", "tkinter", "turtledemo", "lib2to3", "ensurepip", "venv", "site-packages", "__pycache__",
    "pydoc_data", "msilib",
)


def native_modules(files: DataFrame) -> DataFrame:
    """(path, module) of the native sources of an interpreter's tree (path relative to it): a module's file, any file of a
    module's folder under the folder's name, built-in objects as ``builtins``; test modules left out."""
    stem = F.regexp_extract("path", r"([^/]+)\.c$", 1)
    inside = F.regexp_extract("path", r"^Modules/(_[^/]+)/[^/]+\.c$", 1)
    objects = F.col("path").rlike(r"^Objects/[^/]+object\.c$") | (F.col("path") == "Python/bltinmodule.c")
    single = F.col("path").rlike(r"^Modules/[^/]+\.c$") & ~stem.isin(*NO_MODULES) & (stem.endswith("module") | stem.startswith("_"))
    module = F.when(objects, "builtins").when(inside != "", inside).when(single, F.regexp_replace(stem, "module$", ""))
    found = files.select("path", module.alias("module")).where("module IS NOT NULL AND module <> ''")
    for p in TEST_PREFIXES:
        found = found.where(~F.col("module").startswith(p))
    return found


def library_modules(files: DataFrame, skip_folders: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """(path, module) of a library's Python sources (path below ``Lib/``): test folders and files, and ``__main__``, left out."""
    rel = F.regexp_replace("path", "^Lib/", "")
    parts, name = F.split(rel, "/"), F.element_at(F.split(rel, "/"), -1)
    keep = F.col("path").startswith("Lib/") & name.endswith(".py") & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip_folders])) & ~(
        name.startswith("test_") | name.startswith("_test")
    ) & (name != "__main__.py")
    return files.where(keep).select("path", package_module(rel).alias("module")).where("module <> ''")


__all__ = [
    "ArchiveSource", "TreeSource", "ignore_rules", "library_modules", "members", "native_modules", "project_root", "python_files",
    "scan", "select_files",
]

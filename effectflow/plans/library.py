"""Signatures of library sources: found in the module itself, under its stem, by suffix, or behind a re-export."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from effectflow.functions import names
from effectflow.operators import native, resolve
from effectflow.runtime import cut
from effectflow.plans import stubs as writers
from effectflow.sources import c_facts, facts
from effectflow.sources import files as file_source

#: Submodules where packages usually keep what they export, in order: fixed names.
INNER = ("_parser", "_impl", "_core", "decoder", "encoder")


class Library:
    """``files`` (module, path, text). Effects are closed within each module, names by their first suffix match. ``cache`` keeps
    the facts of the sources, like that of a check."""

    def __init__(self, files: DataFrame, cache=None):
        from effectflow.plans.check import Check, Options

        self.files = files
        self.check = Check(files.select("path", "text"), options=Options(local_only=True), cache=cache)
        owner = files.select(F.col("path").alias("file_id"), "module").distinct()
        fn = self.check.functions.where("name <> '<module>'").join(owner, "file_id")
        short = F.substr(F.col("qualname"), F.length(F.regexp_extract("file_id", r"([^/]+?)(?:\.\w+)?$", 1)) + 2)
        self.functions = fn.select(
            "module", "fn_id", short.alias("member"), "qualname", "ordinal",
            F.coalesce("docstring", F.lit("")).alias("docstring"),
        )
        # lookups join this some ten times
        self.signatures = cut(self.functions.join(self.check.signatures, "fn_id").select(
            "module", "member", "ordinal", names.qualify(F.col("effect"), F.col("module")).alias("effect"),
        ).distinct())
        self.imports = facts.imports(self.check.facts).join(owner, "file_id").select("module", "alias", "target").distinct()

    def _direct(self, asked: DataFrame) -> DataFrame:
        """(module, member, effect) found in the module: the exact member, then the first that ends with it."""
        heads, asked = self.signatures.select("module", F.col("member").alias("full"), "ordinal").distinct(), cut(asked.distinct())
        first = resolve.suffix_first(asked, "member", heads, "full", "ordinal", by=["module"])
        exact = asked.join(heads.select("module", F.col("full").alias("member"), "full"), ["module", "member"])
        chosen = resolve.cascade(
            asked, ["module", "member"],
            [exact.select("module", "member", "full").distinct(), first.select("module", "member", "full")],
        ).where("full IS NOT NULL")
        return cut(chosen.join(
            self.signatures.select("module", F.col("member").alias("full"), "effect"), ["module", "full"],
        ).select("module", "member", "effect"))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """(module, member, effect) of ``asked`` (module, member): the module, then what it imports the name from, then its
        usual inner modules; each later place only for what the earlier ones left."""
        asked = asked.select("module", "member").distinct()
        found = self._direct(asked)
        left = cut(asked.join(found.select("module", "member"), ["module", "member"], "left_anti"))
        by_import = left.join(self.imports.withColumnRenamed("alias", "member"), ["module", "member"]).select(
            "module", "member", names.parent(F.col("target")).alias("m"), names.last_part(F.col("target")).alias("f"),
            F.lit(0).alias("place"),
        )
        inner = left.select("*", F.posexplode(F.array(*[F.lit(x) for x in INNER])).alias("k", "x")).select(
            "module", "member", F.concat_ws(".", "module", "x").alias("m"), F.col("member").alias("f"),
            (F.col("k") + 1).alias("place"),
        )
        # relative imports have lost their package: the module's own is tried too
        near = by_import.withColumn("m", F.concat_ws(".", "module", "m"))
        tried = cut(by_import.unionByName(near).unionByName(inner))
        hit = tried.join(
            self._direct(
                tried.select(F.col("m").alias("module"), F.col("f").alias("member"))
            ).select(F.col("module").alias("m"), F.col("member").alias("f"), "effect"),
            ["m", "f"],
        )
        best = hit.groupBy("module", "member").agg(F.min("place").alias("place"))
        return found.unionByName(hit.join(best, ["module", "member", "place"]).select("module", "member", "effect")).distinct()

    def documented(self, asked: DataFrame) -> DataFrame:
        """(module, member) whose docstring speaks of raising; docstrings are read from the sources, nothing is imported."""
        said = self.functions.where(F.contains(F.lower("docstring"), F.lit("raise"))).select("module", "member")
        return asked.select("module", "member").distinct().join(said.distinct(), ["module", "member"], "left_semi")


def imported_sources(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame | None:
    """(module, path, text) below library folders, of the packages that ``files`` (path, text) import; None if there are none.

    A package is its top folder or file; the first root that has it counts. Folders of tests are left out.
    """
    named = facts.imports(facts.extract(files)).select(names.first_part(F.col("target")).alias("package")).distinct()
    wanted = sorted(r["package"] for r in named.where("package <> ''").collect())  # imports of one project
    parts = []
    for package in wanted:
        for root in roots:
            home = Path(root, package)
            if home.is_dir():
                found = file_source.scan(spark, str(home), "*.py").select(F.concat(F.lit(f"Lib/{package}/"), "path").alias("path"), "text")
            elif home.with_suffix(".py").is_file():
                body = home.with_suffix(".py").read_text(errors="replace")
                found = spark.createDataFrame([(f"Lib/{package}.py", body)], "path string, text string")
            else:
                continue
            parts.append(found)
            break
    if not parts:
        return None
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = cut(every)
    return file_source.library_modules(every).join(every, "path").select("module", "path", "text")


def native_stubs(files: DataFrame) -> DataFrame:
    """(module, cls, member, exc, confidence) of an interpreter's C sources (module, path, text), generated headers among them."""
    files = c_facts.with_headers(files)
    found = cut(c_facts.extract(files), by="kind")
    every = c_facts.functions(found)
    fn = resolve.first_by(every, ["module", "name"], ["path", "line"])
    by_path = native.marked(
        every.select(F.col("path").alias("module"), "name", "line"),
        c_facts.markers(found).select(F.col("path").alias("module"), "line"),
    )
    marked = every.join(by_path.withColumnRenamed("module", "path"), ["path", "name"], "left_semi").select("module", "name").distinct()
    hands_on = native.propagating(c_facts.sites(found), c_facts.jumps(found), c_facts.clears(found))
    exports = c_facts.exports(found, files)
    known = native.native_signatures(fn, c_facts.calls(found), hands_on, exports, marked)
    rows = known.select("module", "py_name", F.explode("effects").alias("exc"), "confidence")
    return rows.select(
        "module", names.parent(F.col("py_name")).alias("cls"), names.last_part(F.col("py_name")).alias("member"), "exc",
        "confidence",
    ).distinct()


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """Native and library stubs (module, cls, member, exc, confidence) as one, by the rule for merged sources."""
    key = F.to_json(F.array("module", "cls", "member")).alias("qualname")
    flat = lambda df: df.select(key, "exc", "confidence", F.lit("").alias("notes"))
    both = writers.merged(flat(first), flat(second))
    parts = F.from_json("qualname", "array<string>")
    columns = [parts[k].alias(n) for k, n in enumerate(("module", "cls", "member"))]
    return both.select(*columns, F.explode(F.split("exc", ",")).alias("exc"), "confidence")


def stubs_of(files: DataFrame, confidence: str = "exact") -> DataFrame:
    """(module, cls, member, exc, confidence) of library sources (module, path, text), for ``stubs.write_json``."""
    found = cut(facts.extract(files), by="kind")
    owner = files.select(F.col("path").alias("file_id"), "module").distinct()
    fn = cut(facts.functions(found).where("name <> '<module>'").join(owner, "file_id"))
    short = F.substr(F.col("qualname"), F.length(F.regexp_extract("file_id", r"([^/]+?)(?:\.\w+)?$", 1)) + 2)
    fn = fn.select("file_id", "fn", "module", short.alias("member")).withColumn("qualname", F.concat_ws(".", "module", "member"))
    raised = facts.raises(found).where("NOT is_re_raise AND exc_type <> ''").join(fn, ["file_id", "fn"])
    raised = raised.select("qualname", names.qualify(F.col("exc_type"), F.col("module")).alias("effect"))
    called = facts.calls(found).join(fn, ["file_id", "fn"]).select("module", "qualname", F.col("func_name").alias("name"))
    known = native.library_signatures(fn.select("module", "qualname", "member"), raised, called, native.syscalls(files.sparkSession))
    rows = known.join(fn.select("module", "member", "qualname").distinct(), "qualname")
    return rows.select(
        "module", names.parent(F.col("member")).alias("cls"), names.last_part(F.col("member")).alias("member"),
        F.col("effect").alias("exc"), F.lit(confidence).alias("confidence"),
    )

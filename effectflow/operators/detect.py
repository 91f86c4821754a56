"""Environment detectors over facts (project, rel_path, content): rules in a fixed order, first or all."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectflow.operators.rank import rule_hits
from effectflow.operators.resolve import first_by

#: Tools in order of priority: fixed names.
TOOLS = ("poetry", "pipenv", "pdm", "uv", "rye", "hatch", "venv", "pyenv", "environment")
#: Files that tell a tool: fixed names.
_MARKS = ("poetry.lock", "Pipfile.lock", "pdm.lock", "uv.lock", "rye.lock", "requirements.lock", ".python-version", ".venv/pyvenv.cfg")
_EXECUTABLES = ("bin/python", "Scripts/python.exe")


def settings(files: DataFrame) -> DataFrame:
    """(project, hatch, hatch_path, pdm_path) of the projects' own TOML files; broken ones count as missing."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for project, path, content in zip(batch["project"], batch["rel_path"], batch["content"]):
                try:
                    found = tomllib.loads(content or "")
                except tomllib.TOMLDecodeError:
                    continue
                envs = found.get("tool", {}).get("hatch", {}).get("envs", {}) if path == "pyproject.toml" else {}
                default = envs.get("default", {}) if isinstance(envs, dict) else {}
                python = found.get("python", {}).get("path") if path == ".pdm.toml" else None
                out.append((project, bool(envs), default.get("path") if isinstance(default, dict) else None, python))
            yield pd.DataFrame(out, columns=["project", "hatch", "hatch_path", "pdm_path"])

    read = files.where(F.col("rel_path").isin("pyproject.toml", ".pdm.toml")).select("project", "rel_path", "content").mapInPandas(
        rows, "project string, hatch boolean, hatch_path string, pdm_path string",
    )
    return read.groupBy("project").agg(
        F.bool_or("hatch").alias("hatch"), F.max("hatch_path").alias("hatch_path"), F.max("pdm_path").alias("pdm_path"),
    )


def environments(files: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(project, priority, tool, venv_path, python_executable, is_valid) of every detector that answers.

    ``files`` are (project, rel_path, content); ``told`` (project, tool, path) what tools say when asked (poetry, pipenv,
    pyenv, environment), in place of running them. A detector needs its mark; its environment is ``.venv`` unless the tool
    or its settings name another. Valid ones have an executable; one named by the environment just needs to be named.
    """
    has = lambda path: F.bool_or(F.col("rel_path") == path)
    marks = files.groupBy("project").agg(
        *[has(m).alias(m.replace("/", "|")) for m in _MARKS], F.bool_or(F.col("rel_path").startswith(".venv/")).alias("dot_venv"),
        F.array_sort(
            F.collect_set(F.when(F.col("rel_path").rlike(r"(^|/)(bin/python|Scripts/python\.exe)$"), F.col("rel_path")))
        ).alias("executables"),
    )
    facts = marks.join(settings(files), "project", "left")
    named = told if told is not None else facts.select("project", F.lit("").alias("tool"), F.lit("").alias("path")).limit(0)
    said = named.groupBy("project").pivot("tool", ["poetry", "pipenv", "pyenv", "environment"]).agg(F.first("path"))
    facts = facts.join(said, "project", "left")
    c = lambda name: F.col(f"`{name}`")
    dot = F.when(c("dot_venv"), F.lit(".venv"))
    # the folder two above the interpreter
    pdm = F.regexp_replace("pdm_path", "/[^/]+/[^/]+$", "")
    other_locks = c("poetry.lock") | c("Pipfile.lock") | c("pdm.lock") | c("uv.lock") | c("rye.lock")
    path: dict[str, Column] = {
        "poetry": F.coalesce("poetry", dot), "pipenv": F.coalesce("pipenv", dot), "pdm": F.coalesce(pdm, dot), "uv": dot, "rye": F.coalesce(dot, F.col("pyenv")),
        "hatch": F.coalesce("hatch_path", dot), "venv": dot, "pyenv": F.col("pyenv"), "environment": F.col("environment"),
    }
    rules = [
        ("poetry", c("poetry.lock")), ("pipenv", c("Pipfile.lock")), ("pdm", c("pdm.lock")), ("uv", c("uv.lock") & c("dot_venv")), (
            "rye", c("rye.lock") | c("requirements.lock") | c(".python-version") & c("dot_venv"),
        ),
        ("hatch", F.coalesce("hatch", F.lit(False))), ("venv", c(".venv|pyvenv.cfg")), (
            "pyenv", c(".python-version") & ~c("dot_venv") & ~other_locks,
        ), ("environment", F.col("environment").isNotNull()),
    ]
    hits = rule_hits(facts, ["project"], rules).withColumnRenamed("rule", "tool").join(facts, "project")
    where = F.coalesce(*[F.when(F.col("tool") == t, p) for t, p in path.items()])
    out = hits.withColumn("venv_path", where)
    inside = F.filter("executables", lambda x: F.exists(F.array(*[F.lit(e) for e in _EXECUTABLES]), lambda e: x == F.concat_ws("/", F.col("venv_path"), e)))
    out = out.withColumn("python_executable", F.try_element_at(inside, F.lit(1)))
    valid = F.when(
        F.col("tool") == "environment", F.col("venv_path").isNotNull(),
    ).when(F.col("tool") == "pyenv", F.col("venv_path").isNotNull()).otherwise(F.col("python_executable").isNotNull())
    return out.select("project", "priority", "tool", "venv_path", "python_executable", valid.alias("is_valid"))


def first_environment(found: DataFrame) -> DataFrame:
    """The first detector of each project that answers with an environment."""
    return first_by(found.where("venv_path IS NOT NULL"), ["project"], ["priority"])


def all_environments(found: DataFrame) -> DataFrame:
    """All in order; the environment variable's only if no detector has its path."""
    own = found.where("tool <> 'environment' AND venv_path IS NOT NULL")
    named = found.where("tool = 'environment'").join(own.select("project", "venv_path").distinct(), ["project", "venv_path"], "left_anti")
    return own.unionByName(named.select(*own.columns)).orderBy("project", "priority")

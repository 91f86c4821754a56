"""Globs and ignore files as filters; texts as lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A shell glob, whose star crosses slashes, as an anchored regular expression for the JVM."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", k + 1 if glob[k : k + 1] != "!" else k + 2)) > 0:
            body = glob[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]")
            k = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    """Path, file name, or (for ``prefix/**/suffix``) any path below the prefix whose tail fits the suffix."""
    if "**" in glob:
        head, _, tail = glob.partition("**")
        head, tail = head.rstrip("/"), tail.lstrip("/")
        below = F.lit(True) if not head else path.rlike(glob_regex(head + "/*"))
        rest = path if not head else F.substr(path, F.lit(len(head) + 2))
        if not tail:
            return below
        parts = F.split(rest, "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
        return below & F.exists(tails, lambda t: t.rlike(glob_regex(tail)))
    return path.rlike(glob_regex(glob)) | F.element_at(F.split(path, "/"), -1).rlike(glob_regex(glob))


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """Whether a glob fits the path, its file name, or any directory above it."""
    out = F.lit(False)
    for glob in globs:
        parts = F.split(path, "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        out = out | matches_glob(path, glob) | F.exists(above, lambda p: p.rlike(glob_regex(glob.rstrip("/"))))
    return out


def select_paths(df: DataFrame, path: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Excludes first, then includes; no include takes all. Filters on the scan's own column, before anything is parsed."""
    c = F.col(path)
    out = df.where(~excluded(c, exclude)) if exclude else df
    if include:
        hit = F.lit(False)
        for glob in include:
            hit = hit | matches_glob(c, glob)
        out = out.where(hit)
    return out


def lines(df: DataFrame, key: str, text: str, sep: str = "\n") -> DataFrame:
    """(key, line from 1, content) of every line of every text."""
    cut = df.select(key, F.posexplode(F.split(F.col(text), sep)).alias("at", "content"))
    return cut.select(key, (F.col("at") + 1).alias("line"), "content")


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex on a path relative to the ignore file, negated, directories only) of an ignore-file line; None for no rule."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    only_dirs, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", line.removeprefix("/")):
        out += {"**/": "(?:[^/]+/)*", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (
            part.replace("[!", "[^") if part[0] == "[" and len(part) > 1 else re.escape(part)
        )
    return f"^{'' if anchored else '(?:[^/]+/)*'}{out}$", negated, only_dirs


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (path) that ignore files rule out. ``rules``: (dir, ord, regex, negated, only_dirs), dir '' at the root.

    Each file and each directory above it is judged by each ignore file above them; the last rule of a file that fits
    decides for that file; any file's verdict is enough. One join on the directory, no path by rule product.
    """
    parts, n = F.split("path", "/"), F.size(F.split("path", "/"))
    subjects = files.select("path", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn(
        "subject", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "/"),
    ).withColumn("is_dir", F.col("k") < n)
    at = subjects.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d"))
    at = at.withColumn("dir", F.array_join(F.slice(parts, F.lit(1), F.col("d")), "/")).withColumn(
        "rest", F.array_join(F.slice(F.split("subject", "/"), F.col("d") + 1, F.col("k")), "/"),
    )
    hit = at.join(rules, "dir").where((F.col("is_dir") | ~F.col("only_dirs")) & F.expr("rest RLIKE regex"))
    last = hit.groupBy("path", "subject", "dir").agg(F.max_by("negated", "ord").alias("negated"))
    return last.where("NOT negated").select("path").distinct()


__all__ = ["excluded", "glob_regex", "ignore_rule", "ignored_paths", "lines", "matches_glob", "select_paths"]

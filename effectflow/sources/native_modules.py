"""Extension modules: which modules are shared libraries, told by the names of files below library folders."""

from __future__ import annotations

import importlib.machinery
import importlib.util
import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.runtime import constant
from effectflow.sources import files as file_source

#: Endings of shared libraries that can be modules: fixed names.
ENDINGS = ("so", "pyd", "dylib")
#: A folder whose modules have no package.
FLAT = "lib-dynload/"


def of_paths(paths: DataFrame, python: str | None = None) -> DataFrame:
    """(path, module, is_native) of ``paths`` (path, relative to a library folder): Python files and shared libraries.

    ``a/b.cpython-313-x86_64-linux-gnu.so`` is ``a.b``; an ``__init__`` is its folder. What stands between name and ending is
    the tag; with ``python`` (``3.13``), files whose tag names another interpreter's version don't count. Folders and names
    that can't be imported, and endings with a version behind them, are no modules.
    """
    rest = F.regexp_replace("path", f"^{FLAT}", "")
    leaf = F.element_at(F.split(rest, "/"), -1)
    parts = F.split(leaf, r"\.")
    name, ending = F.element_at(parts, 1), F.element_at(parts, -1)
    tag = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), ".")
    folder = F.replace(F.regexp_replace(rest, r"/?[^/]*$", ""), F.lit("/"), F.lit("."))
    module = F.regexp_replace(F.concat_ws(".", F.nullif(folder, F.lit("")), name), r"\.__init__$", "")
    native = ending.isin(*ENDINGS)
    fits = (F.size(parts) == 2) & (ending == "py") | native & (F.size(parts) >= 2)
    if python:
        digits = F.regexp_extract(tag, r"(?:cpython-|cp)(\d+)", 1)
        fits = fits & ((digits == "") | (digits == python.replace(".", "")) | F.contains(tag, F.lit("abi3")))
    found = paths.where(fits).select("path", module.alias("module"), native.alias("is_native"))
    return found.where(F.col("module").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$"))


def below(spark: SparkSession, roots: Sequence[str], python: str | None = None) -> DataFrame:
    """(module, is_native) of the shared libraries below library folders; nothing is opened or imported."""
    listed = [file_source.scan(spark, root, f"*.{ending}", texts=False).select("path") for root in roots for ending in ENDINGS]
    none = spark.createDataFrame([], "path string")
    return of_paths(reduce(DataFrame.unionByName, listed, none), python).select("module", "is_native").distinct()


def standard(spark: SparkSession) -> DataFrame:
    """(module, is_native) of the standard library of the interpreter that runs Spark: builtin modules and shared libraries."""

    def native(module: str) -> bool:
        if module in sys.builtin_module_names:
            return True
        try:
            spec = importlib.util.find_spec(module)
        except (ImportError, ValueError):
            return False
        return bool(spec and spec.origin and spec.origin.endswith(tuple(importlib.machinery.EXTENSION_SUFFIXES)))

    return constant(spark, [(m, native(m)) for m in sorted(sys.stdlib_module_names)], "module string, is_native boolean")

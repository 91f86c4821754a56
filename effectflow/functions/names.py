"""Dotted names, module names and effect names as column expressions."""

from __future__ import annotations

import builtins
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Builtin effect names: the interpreter's own exception classes, and names of other platforms and versions.
BUILTIN_EFFECTS = frozenset(n for n, x in vars(builtins).items() if isinstance(x, type) and issubclass(x, BaseException)) | {"VMSError", "WindowsError", "EncodingWarning", "PythonFinalizationError"}


def among(name: Column, values: Collection[str]) -> Column:
    """Whether a name is one of fixed ones (without commas): folded to one literal when planned, and quick to build."""
    return F.array_contains(F.split(F.lit(",".join(sorted(values))), ","), name)


def last_part(name: Column, sep: str = ".") -> Column:
    """What follows the last separator; the whole name without one."""
    return F.substring_index(name, sep, -1)


def first_part(name: Column, sep: str = ".") -> Column:
    return F.substring_index(name, sep, 1)


def parent(name: Column, sep: str = ".") -> Column:
    """What precedes the last separator; empty without one."""
    parts = F.split(name, f"[{sep}]")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), sep)


def split_qualname(name: Column) -> tuple[Column, Column, Column]:
    """(module, class, member): one part is a module, two are module and function, of more the last is the member,
    the first the module, and all between the class."""
    parts, n = F.split(name, "[.]"), F.size(F.split(name, "[.]"))
    module = F.element_at(parts, 1)
    owner = F.when(n >= 3, F.array_join(F.slice(parts, F.lit(2), n - 2), ".")).otherwise("")
    member = F.when(n >= 2, F.element_at(parts, -1)).otherwise("")
    return module, owner, member


def qualify(effect: Column, module: Column) -> Column:
    """Effect names with their module: builtins as they are; bare names behind the module; ``lower.X`` behind the module's
    top package; anything else dotted as it is. Without a module nothing changes."""
    # written with few copies of its arguments, as they may be long expressions themselves
    home = F.coalesce(module, F.lit(""))
    named = F.concat_ws(".", first_part(home), last_part(effect))
    as_it_is = F.contains(effect, F.lit(".")) | among(effect, BUILTIN_EFFECTS) | (effect == "")
    out = F.when(effect.rlike(r"^\p{Ll}[^.]*[.]"), named).when(as_it_is, effect).otherwise(F.concat_ws(".", home, effect))
    return F.when(home == "", effect).otherwise(out)


def module_of_path(path: Column, full: bool = False) -> Column:
    """Module of a project-relative path: without ``.py`` and a leading ``src/``; ``a/a.py`` is ``a`` unless ``full``."""
    flat = F.regexp_replace(path, r"^(?:\./)?(?:src/)?(.*?)(?:\.py)?$", "$1")
    return F.replace(flat if full else F.regexp_replace(flat, r"^([^/]+)/\1$", "$1"), F.lit("/"), F.lit("."))


def package_module(path: Column) -> Column:
    """Dotted module of a library path, ``__init__`` standing for its package."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))

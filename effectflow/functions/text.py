"""Messages, positions, hashes and coercions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Editor severities by name; anything else is an error.
SEVERITIES = {"error": 1, "warning": 2, "information": 3, "info": 3, "hint": 4}


def short_hash(value: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def archive_key(name: Column, size: Column, mtime: Column) -> Column:
    """Key of an unpacked archive: md5 of name:size:mtime, twelve digits."""
    return F.substring(F.md5(F.concat_ws(":", name, size.cast("string"), mtime.cast("string"))), 1, 12)


def uri_to_path(uri: Column) -> Column:
    """Path of a ``file://`` URI, decoded; the slash before a drive letter goes."""
    plain = F.url_decode(F.regexp_replace(F.regexp_replace(uri, "^file://", ""), r"\+", "%2B"))
    return F.regexp_replace(plain, r"^/([A-Za-z]:)", "$1")


def editor_range(line: Column, col: Column) -> Column:
    """Zero-based start and one-character end of a one-based position."""
    row = F.greatest(line - 1, F.lit(0))
    return F.struct(row.alias("start_line"), col.alias("start_col"), row.alias("end_line"), (col + 1).alias("end_col"))


def severity_number(severity: Column) -> Column:
    out = F.lit(1)
    for name, n in SEVERITIES.items():
        out = F.when(F.lower(severity) == name, F.lit(n)).otherwise(out)
    return out


def report_line(path: Column, line: Column, col: Column, severity: Column, message: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit(":"), col.cast("string"), F.lit(": "), severity, F.lit(": "), message)


def call_message(name: Column, effects: Column) -> Column:
    """``effects``: array of names."""
    return F.concat(F.lit("call to '"), name, F.lit("' may raise unhandled exception(s): "), F.array_join(effects, ", "))


def strict_message(name: Column, effects: Column) -> Column:
    return F.concat(F.lit("function '"), name, F.lit("' may raise undocumented exceptions: "), F.array_join(effects, ", "))


def invalid_directive(tag: str) -> str:
    return f"invalid ignore comment: must include exception types in brackets (e.g., # {tag}: ignore[ValueError])"


def toml_string(value: Column) -> Column:
    """A basic TOML string's inside: backslash, quote and the four usual controls escaped."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def flag(value: Column) -> Column:
    """``true``, ``1``, ``yes`` in any case."""
    return F.lower(F.trim(value)).isin("true", "1", "yes")


def whole_number(value: Column) -> Column:
    return value.try_cast("bigint")


def version_specifier(archive: Column) -> Column:
    """``>=3.12,<3.13`` of an archive name with a version in it; null without one."""
    major, minor = F.regexp_extract(archive, r"(\d+)\.(\d+)", 1), F.regexp_extract(archive, r"(\d+)\.(\d+)", 2)
    up = (minor.try_cast("int") + 1).cast("string")
    return F.when(minor != "", F.concat(F.lit(">="), major, F.lit("."), minor, F.lit(",<"), major, F.lit("."), up))

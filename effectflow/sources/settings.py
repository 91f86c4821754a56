"""Layered settings as rows of (layer, priority, key, value): defaults, project file, tool file, environment, switches."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.operators.rank import last_wins

DEFAULTS: dict[str, object] = {
    "ignore_exceptions": ["KeyboardInterrupt", "SystemExit"], "ignore_modules": [], "include": [], "exclude": [".venv"], "analysis.strict_mode": False, "analysis.local_only": False,
    "analysis.warn_native": True, "analysis.full_module_path": False, "analysis.allow_bare_except": False, "analysis.require_reraise_after_log": False, "analysis.ignore_include": [], "analysis.ignore_exclude": [],
    "cache.enabled": True, "cache.max_file_entries": 10_000, "cache.max_memory_mb": 500, "cache.ttl_hours": 24, "lsp.debounce_ms": 500, "lsp.max_diagnostics_per_file": 0,
}


def flat(values: Mapping, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in values.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {prefix + k: v}
    return out


def toml_layer(text: str | None, *table: str) -> dict[str, object]:
    """Settings of one TOML text below ``table``; nothing for a missing or broken one."""
    try:
        found = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return {}
    for name in table:
        found = found.get(name, {})
        if not isinstance(found, Mapping):
            return {}
    return flat(found)


def environment_layer(prefix: str = "EFFECTFLOW_", env: Mapping[str, str] = os.environ) -> dict[str, object]:
    """``PREFIX_ANALYSIS__STRICT_MODE`` sets ``analysis.strict_mode``; booleans and numbers as the default's type, bad numbers ignored."""
    out: dict[str, object] = {}
    for name, value in env.items():
        key = name.removeprefix(prefix).lower().replace("__", ".")
        if name.startswith(prefix) and key in DEFAULTS:
            kind = type(DEFAULTS[key])
            if kind is bool:
                out[key] = value.strip().lower() in ("true", "1", "yes")
            elif kind is int:
                if value.strip().lstrip("-").isdigit():
                    out[key] = int(value)
            elif kind is list:
                out[key] = [x.strip() for x in value.split(",") if x.strip()]
            else:
                out[key] = value
    return out


def layers(spark: SparkSession, *named: tuple[str, Mapping[str, object]]) -> DataFrame:
    """(layer, priority, key, value as JSON) of layers from the weakest to the strongest; values of a wrong type are dropped."""
    rows = []
    for n, (layer, values) in enumerate((("default", DEFAULTS), *named)):
        for key, value in values.items():
            known = DEFAULTS.get(key)
            if known is None or isinstance(value, type(known)) and isinstance(value, bool) == isinstance(known, bool):
                rows.append((layer, n, key, json.dumps(value)))
    return spark.createDataFrame(rows, "layer string, priority int, key string, value string")


def effective(table: DataFrame, by_block: bool = False) -> DataFrame:
    """(key, value, layer): the strongest layer of each key. ``by_block``: a layer that sets one key of ``cache``, ``lsp`` or
    ``analysis`` to something other than its default sets the whole block, the rest of it to the defaults."""
    best = last_wins(table, ["key"], ["priority"], ["value", "layer"])
    if not by_block:
        return best
    block = F.when(F.col("key").contains("."), F.regexp_extract("key", "^([^.]+)", 1))
    base = table.where("priority = 0").select("key", F.col("value").alias("base"))
    changed = table.where("priority > 0").join(base, "key").where("value <> base").withColumn("block", block).where("block IN ('cache', 'lsp', 'analysis')")
    owner = changed.groupBy("block").agg(F.max("priority").alias("p"))
    inside = base.withColumn("block", block).join(owner, "block").join(
        table.where("priority > 0").select("key", F.col("priority").alias("p"), F.col("value").alias("v"), F.col("layer").alias("l")),
        ["key", "p"], "left",
    )
    forced = inside.select("key", F.coalesce("v", "base").alias("value"), F.coalesce("l", F.lit("default")).alias("layer"))
    return best.join(forced.select("key"), "key", "left_anti").unionByName(forced)

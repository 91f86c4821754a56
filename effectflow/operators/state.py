"""Caches and snapshots as tables: validity, eviction, pruning, sessions, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(age: Column, ttl: Column, *equal: tuple[Column, Column]) -> Column:
    """Whether a cached entry still holds: young enough and every fingerprint equal; false for null."""
    ok = age <= ttl
    for a, b in equal:
        ok = ok & (a == b)
    return F.coalesce(ok, F.lit(False))


def prune(entries: DataFrame, alive: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entries that stay, and those whose subject is gone."""
    keys = alive.select(*key).distinct()
    return entries.join(keys, list(key), "left_semi"), entries.join(keys, list(key), "left_anti")


def debounce(events: DataFrame, time: str, gap: str, by: Sequence[str] = ()) -> DataFrame:
    """Sessions of events that follow each other within ``gap``: (by, started, last, n). Without ``by`` one timer serves all."""
    return events.groupBy(*by, F.session_window(time, gap).alias("__w")).agg(F.min(time).alias("started"), F.max(time).alias("last"), F.count("*").alias("n")).drop("__w")


def fold_last(events: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last write of each key, and how many there were."""
    best = events.groupBy(*by).agg(F.max(F.struct(*order, *values)).alias("__m"), F.count("*").alias("n_edits"))
    return best.select(*by, *[F.col(f"__m.{c}").alias(c) for c in values], "n_edits")

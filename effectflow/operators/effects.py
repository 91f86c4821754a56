"""Handled, suppressed and documented effects: anti-joins and group filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectflow.operators.resolve import small


def unhandled(pairs: DataFrame, handlers: DataFrame, site: Sequence[str], effect: str, handler: str, ancestors: DataFrame | None = None) -> DataFrame:
    """Pairs (site, effect, ...) that no handler (site, handler) of their site catches.

    A handler catches itself and its descendants: ``ancestors`` has (effect, ancestor) and must be reflexive; without
    it only equal names are caught. A null handler catches everything. Anti-joins throughout.
    """
    bare, caught = catches(handlers, site, effect, handler, ancestors)
    return uncaught(pairs, bare, caught, site, effect)


def uncaught(pairs: DataFrame, bare: DataFrame, caught: DataFrame, site: Sequence[str], effect: str) -> DataFrame:
    """``unhandled`` with the tables of ``catches``."""
    return pairs.join(bare, list(site), "left_anti").join(caught, [*site, effect], "left_anti")


def catches(handlers: DataFrame, site: Sequence[str], effect: str, handler: str, ancestors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(site) of bare handlers and (site, effect) of what typed ones catch: loops write these once."""
    site = list(site)
    bare = handlers.where(F.col(handler).isNull()).select(*site).distinct()
    typed = handlers.where(F.col(handler).isNotNull()).select(*site, F.col(handler).alias("__h"))
    if ancestors is None:
        return bare, typed.withColumnRenamed("__h", effect)
    known = ancestors.select(F.col("effect").alias("__e"), F.col("ancestor").alias("__h"))
    caught = typed.join(small(known), "__h").select(*site, F.col("__e").alias(effect))
    return bare, caught.unionByName(typed.select(*site, F.col("__h").alias(effect))).distinct()


def unmarked_groups(df: DataFrame, by: Sequence[str], mark: Column, *aggregates: Column) -> DataFrame:
    """(by, aggregates) of the groups of which no row is marked: one aggregation, partial before the shuffle. A null mark
    marks nothing."""
    out = df.groupBy(*by).agg(F.coalesce(F.bool_or(mark), F.lit(False)).alias("__marked"), *aggregates)
    return out.where(~F.col("__marked")).drop("__marked")


def drop_documented(df: DataFrame, documented: DataFrame, key: Sequence[str]) -> DataFrame:
    """Elements that aren't documented stay, the rest of their group is untouched."""
    return df.join(documented.select(*key).distinct(), list(key), "left_anti")


def undocumented_strict(effects: DataFrame, escaping: DataFrame, with_calls: DataFrame, documented: DataFrame, unit: str, effect: str) -> DataFrame:
    """Undocumented effects of units that let any escape or that call nothing."""
    shown = effects.join(escaping.select(unit).distinct(), unit, "left_semi").unionByName(
        effects.join(with_calls.select(unit).distinct(), unit, "left_anti")
    ).distinct()
    return drop_documented(shown, documented, [unit, effect])


def with_interesting(df: DataFrame, key: Sequence[str], effect: str, boring: Sequence[str]) -> DataFrame:
    """Keys that have any effect beyond the boring ones, with their number of such."""
    return df.groupBy(*key).agg(F.count_if(~F.col(effect).isin(*boring)).alias("n_interesting")).where("n_interesting > 0")

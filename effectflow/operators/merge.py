"""Merging signature sources: sets, confidences, last writers, nested output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of confidences, the weakest first.
CONFIDENCES = ("conservative", "likely", "exact", "manual")


def ordinal(confidence: Column, order: Sequence[str] = CONFIDENCES) -> Column:
    """Place of a confidence in the order, from 1; 0 for null or unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), confidence), F.lit(0)).cast("int")


def highest(df: DataFrame, by: Sequence[str], confidence: str, order: Sequence[str] = CONFIDENCES) -> DataFrame:
    """The strongest confidence of each key."""
    return df.groupBy(*by).agg(F.max_by(confidence, ordinal(F.col(confidence), order)).alias(confidence))


def lowest(df: DataFrame, by: Sequence[str], confidence: str, order: Sequence[str] = CONFIDENCES) -> DataFrame:
    """The weakest confidence of each key."""
    return df.groupBy(*by).agg(F.min_by(confidence, ordinal(F.col(confidence), order)).alias(confidence))


def decide(effects: Column, explicit: Column, vague: str = "Exception") -> Column:
    """Confidence of an analysed unit: nothing or only the vague effect is conservative, an explicit one exact, else likely."""
    return F.when((F.size(effects) == 0) | (effects == F.array(F.lit(vague))), "conservative").when(explicit, "exact").otherwise("likely")


def as_set(column: str) -> Column:
    """A set as sorted, comma-joined text."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def merge_two(a: DataFrame, b: DataFrame, key: Sequence[str], element: str, confidence: str, note: str | None = None) -> DataFrame:
    """Key-wise union of two sources: elements united; exact if either is exact, else the second's confidence where it has
    the key; notes joined with ``; ``. One union and one aggregation instead of a full outer join."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    kinds = [F.max(F.when(F.col(confidence) == "exact", F.lit(True))).alias("__exact"), F.max_by(confidence, "__side").alias("__last")]
    notes = [] if note is None else [
        F.array_join(
            F.transform(F.array_sort(F.collect_set(F.when(F.col(note) != "", F.struct("__side", note)))), lambda x: x[note]),
            "; ",
        ).alias(note)
    ]
    merged = both.groupBy(*key).agg(as_set(element).alias(element), *kinds, *notes)
    return merged.withColumn(confidence, F.when(F.col("__exact"), F.lit("exact")).otherwise(F.col("__last"))).drop("__exact", "__last")

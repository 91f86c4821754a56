"""Keep-first, keep-newest, as-of and other orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectflow.operators.resolve import first_by
from effectflow.runtime import cut


def rule_hits(df: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, priority, rule) for every rule that holds, by its place in the list; one pass over ``df``."""
    hit = F.array(*[F.when(cond, F.struct(F.lit(k + 1).alias("priority"), F.lit(name).alias("rule"))) for k, (name, cond) in enumerate(rules)])
    return df.select(*key, F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("h")).select(*key, "h.priority", "h.rule")


def keep_newest(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """At most ``n`` rows of each key, by ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def last_wins(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last row in ``order`` (which must have no ties): partial aggregation, no sort of groups."""
    best = df.groupBy(*by).agg(F.max(F.struct(*order, *values)).alias("__m"))
    return best.select(*by, *[F.col(f"__m.{c}").alias(c) for c in values])


def _merged(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str]) -> DataFrame:
    """Rows of both sides: the key, ``__t`` (position), ``__side`` (0: right), ``__l`` and ``__r`` (the row of that side)."""
    row, value = F.struct(*left.columns).alias("v"), F.struct(*values).alias("v")
    none = lambda df, what: F.lit(None).cast(df.select(what).schema["v"].dataType)
    marked = left.select(
        *[F.col(c) for c in by], F.col(left_on).alias("__t"), F.lit(1).alias("__side"), row.alias("__l"), none(right, value).alias("__r"),
    )
    other = right.select(
        *[F.col(c) for c in by], F.col(right_on).alias("__t"), F.lit(0).alias("__side"), none(left, row).alias("__l"), value.alias("__r"),
    )
    return marked.unionByName(other)


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str],
    keep_unmatched: bool = True, split: bool = False,
) -> DataFrame:
    """Each left row with ``values`` of the latest right row at or before it, within ``by``.

    Both sides are merged and ordered once; the last non-null right row is carried forward. One shuffle on ``by``,
    no range join: a key's rows are sorted in one task (a file's definitions and calls, a user's events), so ``by`` should
    be as fine as its rows allow; ``split`` is for keys that may hold a large part of all rows, and costs a written table and a
    shuffle more. At one position the right row comes first; ties among right rows go to the greatest values.
    """
    both = _merged(left, right, by, left_on, right_on, values)
    if split:
        return _matched(_carried(both, by), values, keep_unmatched)
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    return _matched(both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)), values, keep_unmatched)


def _carried(both: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left rows of ``both`` with the last right row in ``__r``, where one key may hold a large part of all rows.

    Rows are dealt by ranges of key and position, so a key of any size is as many parts as its rows need. Within a part the
    last right row is carried forward; the last one of each part of a key is carried into its later parts by a short table
    (a row for each key and part). Rows of one key and position stay together.
    """
    dealt = cut(both.repartitionByRange(*by, "__t", "__side").withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *by).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.withColumn("__near", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1")
    ends = dealt.groupBy(*by, "__part").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__r"))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)["__r"])
    carried = cut(carried.where("__carried IS NOT NULL").select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), "__carried"))
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = near.join(carried, same, "left")
    return out.withColumn("__r", F.coalesce("__near", "__carried"))


def _matched(rows: DataFrame, values: Sequence[str], keep_unmatched: bool) -> DataFrame:
    out = rows.where("__side = 1")
    if not keep_unmatched:
        out = out.where(F.col("__r").isNotNull())
    return out.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in values])


__all__ = ["asof_backward", "first_by", "keep_newest", "last_wins", "rule_hits"]

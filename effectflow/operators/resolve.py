"""Name resolution as equi-joins: prefixes and suffixes are exploded instead of compared in nested loops."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectflow.runtime import LARGE, apart

#: A dimension of at most this many rows, or of stored bytes, is broadcast; larger ones join by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 2 << 20
#: Operators whose results may be larger than the optimizer's estimate.
_GROWING = re.compile(r"\b(Generate|Expand|Join|\w*Map\w*)\b")
#: Stored tables, of whose size only the compressed bytes are known.
_STORED = re.compile(r"\bRelation\b.* parquet\b")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small: by the optimizer's size where nothing in the plan can exceed that, else
    if it has at most ``most`` rows, reading no more than that to find out. Otherwise it is kept ``apart``."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(plan.stats().sizeInBytes()) <= BROADCAST_BYTES and not _GROWING.search(plan.toString()) and not _STORED.search(plan.toString()):
        return F.broadcast(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else apart(df)


def looped(df: DataFrame) -> DataFrame:
    """``small`` for a table that every round of a loop joins: what the rounds send to the driver doesn't grow with it."""
    return small(df, LARGE)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, nulls of the order first.

    Ascending column names are aggregated, partially before the shuffle, so a frequent key costs no task more than a row
    a partition; other orders are ranked in a window.
    """
    if all(isinstance(o, str) for o in order):
        rest = [c for c in df.columns if c not in keys]
        best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
        return best.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def prefixes(name: Column, sep: str = ".") -> Column:
    """All leading parts of a dotted name, the longest first."""
    parts = F.split(name, f"[{sep}]")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def suffixes(name: Column, sep: str = ".") -> Column:
    """All trailing parts of a dotted name, the longest first."""
    parts = F.split(name, f"[{sep}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), sep))


def longest_prefix(df: DataFrame, name: str, dim: DataFrame, dim_key: str, sep: str = ".", strict: bool = False) -> DataFrame:
    """Rows of ``df`` with the columns of ``dim`` whose key is the longest prefix of ``name``; inner join.

    ``strict`` leaves the whole name out. Distinct names are resolved once, then joined back.
    """
    names = df.select(name).where(F.col(name).isNotNull()).distinct()
    cut = names.withColumn("__p", F.explode(prefixes(F.col(name), sep)))
    if strict:
        cut = cut.where(F.col("__p") != F.col(name))
    hit = cut.join(small(dim), cut["__p"] == dim[dim_key])
    best = hit.groupBy(name).agg(F.max_by(F.struct(*dim.columns), F.length("__p")).alias("__d"))
    return df.join(best, name).select(*df.columns, *[F.col(f"__d.{c}").alias(c) for c in dim.columns])


def suffix_first(df: DataFrame, name: str, dim: DataFrame, dim_key: str, ordinal: str, by: Sequence[str] = (), sep: str = ".") -> DataFrame:
    """Rows of ``df`` with the first row of ``dim`` (by ``ordinal``) whose key ends with ``name`` on a part boundary, within ``by``."""
    keyed = dim.withColumn(name, F.explode(suffixes(F.col(dim_key), sep)))
    first = first_by(keyed, [*by, name], [ordinal])
    return df.join(first, [*by, name])


def cascade(df: DataFrame, key: Sequence[str], strategies: Sequence[DataFrame]) -> DataFrame:
    """``df`` keyed by ``key`` with the first strategy's match; a strategy is a table of ``key`` + the same result columns.

    Every key of ``df`` appears, with nulls where no strategy has it, and the number of the strategy. One join per
    strategy and a coalesce: each strategy must have at most one row a key.
    """
    key = list(key)
    columns = [c for c in strategies[0].columns if c not in key]
    out = df
    for k, s in enumerate(strategies):
        out = out.join(s.select(*key, F.struct(*columns).alias(f"__s{k}")), key, "left")
    marks = [F.col(f"__s{k}") for k in range(len(strategies))]
    step = F.coalesce(*[F.when(m.isNotNull(), F.lit(k)) for k, m in enumerate(marks)])
    return out.withColumn("__hit", F.coalesce(*marks)).select(*df.columns, *[F.col(f"__hit.{c}").alias(c) for c in columns], step.alias("strategy"))


def _dyadic(lo: Column, hi: Column) -> Column:
    """[lo, hi) of whole numbers as an array of (level, block): block b of level l is [b * 2^l, (b + 1) * 2^l).

    At most two blocks a level; null and empty ranges have none.
    """
    def blocks(level: Column) -> Column:
        first, last = -F.call_function("shiftright", -lo, level), F.call_function("shiftright", hi, level)
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        block = lambda c: F.struct(level.alias("level"), c.alias("block"))
        left, right = F.when((first < last) & odd(first), block(first)), F.when((first < last) & odd(last), block(last - 1))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), blocks)))


def range_pick(df: DataFrame, value: str, rules: DataFrame, lo: str, hi: str, score: Sequence[Column | str], key: Sequence[str]) -> DataFrame:
    """Each row with the best rule whose [lo, hi) holds its value, by ``score``; whole numbers.

    An equi-join, however many rules there are: ranges are cut in blocks of powers of two, and a value lies in one block of
    each size that any rule has.
    """
    cut = rules.withColumn("__at", F.explode(_dyadic(F.col(lo).cast("long"), F.col(hi).cast("long"))))
    cut = cut.withColumns({"__level": F.col("__at.level"), "__block": F.col("__at.block")}).drop("__at")
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())  # at most 63
    here = df.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    block = F.call_function("shiftright", F.col(value).cast("long"), F.col("__l"))
    hit = here.join(small(cut), (F.col("__l") == F.col("__level")) & (block == F.col("__block"))).drop("__l", "__level", "__block")
    return first_by(hit, key, score)

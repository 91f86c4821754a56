"""Mixing sources to target weights: cube-method balanced sampling.

Each source has a target share of all words. A document is taken ``floor(rate)`` times for sure, with
``rate = target / source size``, and once more with the fractional rest as inclusion probability. The cube method
decides these: probabilities move along vectors of the null space of the balancing constraints (documents and
words of the source) until all but two are 0 or 1, so both totals stay what they were. Blocks of a source are moved
independently; the few undecided units of all blocks meet again in the next level, until a source is one block.
There a landing problem of at most 14 units is left. It is decided by a linear program over its outcomes: of all
distributions that give each unit its inclusion probability, the one whose totals stray least, then a draw from it.
Where the draw still strays by more than ``NEAR`` of the source's target, as it may in a source of few documents, the
nearest total that up to ``SOUGHT`` units allow is taken instead; there, probabilities give way to the target. A single
unit keeps its draw, so that many sources of one document together come near the sum of their targets.

Sources are rows of a table like any other: their sizes, order, targets and blocks never come to the driver, only sums
over them do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.llm.common import arrow_pass, n_words, read, written

BLOCK = 4096
LANDING = 12  # units beside those that the flight leaves: 2 ** 14 outcomes at most
NEAR = 0.02  # of a source's target
SOUGHT = 18  # units whose outcomes are all looked at then
PIVOTS = 500  # of the linear program; any step before is a valid distribution too
MOST_TIMES = 3
BROADCAST_SOURCES = 100_000  # rows of some 100 bytes; more join by a shuffle
_KEY = "doc_id long, source string, unit binary"
_EPS = 1e-9


def weighed(sources: DataFrame, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``sources`` with ``weight``: the weights in turn by code point, null last.

    Places come from a sort by ranges and the counts of the ranges (a row a shuffle partition on the driver).
    """
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    dealt = written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources-by-name")
    firsts, at = [], 0
    for row in sorted(dealt.groupBy("part").count().collect()):
        firsts.append((row["part"], at))
        at += row["count"]
    first = F.broadcast(spark.createDataFrame(firsts or [(0, 0)], "part int, first long"))
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    turn = F.array(*[F.lit(int(w)) for w in weights])
    return dealt.join(first, "part").withColumn("weight", turn[F.pmod(place, F.lit(len(weights))).cast("int")]).drop("part", "first")


def water_level(sources: DataFrame, most: int = MOST_TIMES) -> float:
    """The level of targets: each is ``level * weight``, but ``most * size`` where that is less; together all sizes.

    A round shares what the full ones leave among the rest; levels only rise, and the rounds end when no more get full.
    """
    level = 0.0
    total = sources.agg(F.sum("size")).first()[0] or 0
    while True:
        full = F.lit(level) * F.col("weight") > F.col("size") * most
        held, open_ = sources.agg(F.sum(F.when(full, F.col("size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_ or (now := (total - (held or 0)) / open_) <= level:
            return level
        level = now


def with_targets(sources: DataFrame, most: int = MOST_TIMES, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """source, size, n, target, whole, p of each source (source, size, n): how often its documents are taken at least,
    and the probability of once more."""
    table = written(weighed(sources, weights), "sources-weighed")
    level = water_level(table, most)
    target = F.least(F.lit(level) * F.col("weight"), (F.col("size") * most).cast("double"))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.least(F.lit(most), F.floor(F.col("rate") + _EPS)).cast("int")
    out = table.withColumn("target", target).withColumn("rate", rate).withColumn("whole", whole)
    return out.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).drop("rate", "weight")


def _null_vector(rows: list[tuple[float, ...]]) -> tuple[float, ...]:
    """A vector that all rows of constraints map to 0; one unit more than constraints."""
    if len(rows) == 1:
        (a, b), = rows
        return (b, -a) if a or b else (1.0, 0.0)
    (a1, a2, a3), (b1, b2, b3) = rows
    u = (a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1)
    if any(abs(x) > _EPS for x in u):
        return u
    row = rows[0] if a1 or a2 else rows[1]
    return (row[1], -row[0], 0.0) if row[0] or row[1] else (1.0, 0.0, 0.0)


def flight(p: np.ndarray, constraints: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves ``p`` along the null space of ``constraints`` (rows by units) until as many units as rows are undecided."""
    p = p.astype(float).copy()
    width = len(constraints) + 1
    waiting = np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist()[::-1]
    columns = [tuple(map(float, c)) for c in constraints.T]
    active: list[int] = []
    while True:
        while len(active) < width and waiting:
            active.append(waiting.pop())
        if len(active) < width:
            break
        u = _null_vector([tuple(columns[k][j] for k in active) for j in range(width - 1)])
        scale = max(map(abs, u))
        u = [x / scale for x in u]
        up = min(((1 - p[k]) / x if x > 0 else p[k] / -x) for k, x in zip(active, u) if abs(x) > _EPS)
        down = min((p[k] / x if x > 0 else (1 - p[k]) / -x) for k, x in zip(active, u) if abs(x) > _EPS)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(active, u):
            p[k] += step * x
        active = [k for k in active if _EPS < p[k] < 1 - _EPS]
    decided = (p <= _EPS) | (p >= 1 - _EPS)
    p[decided] = np.rint(p[decided])
    return p


def _outcomes(p: np.ndarray, cost: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of outcomes and their probabilities: least mean cost among the distributions with marginals ``p``.

    The simplex method over all outcomes, from the nested ones (the k likeliest units, for each k), which always do.
    """
    m = len(p)
    rows = np.vstack([bits.T, np.ones(len(bits))])
    goal = np.append(p, 1.0)
    likeliest = np.argsort(-p, kind="stable")
    basis = np.concatenate(([0], np.cumsum(1 << likeliest)))
    for _ in range(PIVOTS):
        inverse = np.linalg.inv(rows[:, basis])
        x = np.maximum(inverse @ goal, 0.0)
        reduced = cost - (cost[basis] @ inverse) @ rows
        enter = int(reduced.argmin())
        if reduced[enter] > -1e-10:
            break
        change = inverse @ rows[:, enter]
        ratio = np.full(m + 1, np.inf)
        np.divide(x, change, out=ratio, where=change > 1e-9)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[leave] = enter
    else:
        x = np.maximum(np.linalg.inv(rows[:, basis]) @ goal, 0.0)
    return basis, x / x.sum()


def nearest(done: np.ndarray, free: np.ndarray, words: np.ndarray, off: float) -> np.ndarray:
    """``done`` with units among ``free`` decided anew, so that ``off`` more words are taken, as nearly as they allow.

    All outcomes of at most SOUGHT units are compared, of all sizes if there are more; of the nearest, the one with the
    fewest changes.
    """
    free = free[np.argsort(words[free], kind="stable")]
    if len(free) > SOUGHT:
        free = free[np.linspace(0, len(free) - 1, SOUGHT).round().astype(int)]
    sums, changes = np.zeros(1), np.zeros(1)
    for k in free:
        sums = np.concatenate((sums, sums + words[k] * (1 - 2 * done[k])))
        changes = np.concatenate((changes, changes + 1))
    best = np.lexsort((changes, np.abs(sums - off)))[0]
    flip = free[(int(best) >> np.arange(len(free))) & 1 == 1]
    done = done.copy()
    done[flip] = 1 - done[flip]
    return done


def land(p: np.ndarray, constraints: np.ndarray, rng: np.random.Generator, most: float = np.inf) -> np.ndarray:
    """Decides all units of a source. The units of most words sit out the flight; they and the two that it leaves are the
    landing problem: an outcome is drawn, each unit with its probability, so that words stray least. If they stray by
    more than ``most``, the nearest outcome is taken, but for a single unit."""
    goal, undecided = float(constraints[-1] @ p), np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    spare = min(len(p) // 2, LANDING)
    held = np.argsort(-constraints[-1], kind="stable")[:spare]
    free = np.setdiff1d(np.arange(len(p)), held)
    p = p.copy()
    p[free] = flight(p[free], constraints[:, free], rng)
    rest = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(rest):
        bits = ((np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1).astype(float)
        off = (bits - p[rest]) @ constraints[:, rest].T
        off = off / np.maximum(1.0, np.abs(constraints[:, rest]).max(axis=1))
        chosen, q = _outcomes(p[rest], off[:, 1] ** 2 + 1e-3 * off[:, 0] ** 2, bits)
        p[rest] = bits[rng.choice(chosen, p=q)]
    done = np.rint(p)
    off = goal - float(constraints[-1] @ done)
    return nearest(done, undecided, constraints[-1], off) if abs(off) > most and len(undecided) > 1 else done


def _moved(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of units (doc_id, source, unit, size, copies, p, target, blocks): moved within blocks of their source, landed
    where it is one block. One block is in memory at a time."""
    columns = ["doc_id", "source", "unit", "size", "copies", "p", "target", "blocks"]
    block = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "unit"), F.col("blocks")).cast("long")
    dealt = units.select(*columns).withColumn("block", block).repartition("source", "block")
    dealt = dealt.sortWithinPartitions("source", "block", F.desc("size"), "doc_id", "unit")

    def move(key: tuple, held: list[tuple]) -> dict:
        ids, sources, unit, size, copies, p, target, blocks = zip(*held)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{key[1]}|{key[0]!r}".encode("utf-8", "surrogatepass")))
        rows = np.array([copies, np.array(size) * np.array(copies)], float)
        start = np.array(p, float)
        done = land(start, rows, rng, NEAR * target[0]) if blocks[0] == 1 else flight(start, rows, rng)
        return dict(zip(columns[:-1], (list(ids), list(sources), list(unit), list(size), list(copies), done.tolist(), list(target))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[1], row[-1]) != key:
                    yield move(key, held)
                    held = []
                key = (row[1], row[-1])
                held.append(row[:-1])
        if held:
            yield move(key, held)

    return arrow_pass(dealt, make, f"{_KEY}, size long, copies long, p double, target double")


def _of_source(units: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``units`` with columns of their source; the table is broadcast if it has at most BROADCAST_SOURCES rows."""
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = table.select(F.col("source").alias("__name"), *columns)
    return units.join(F.broadcast(side) if few else side, units["source"].eqNullSafe(F.col("__name"))).drop("__name")


def _unit() -> F.Column:
    """128 bits of a text; null for null."""
    return F.unhex(F.md5("text"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, unit, size, copies, source_size, target, times: each distinct row and how often it's taken.

    (doc_id, source, unit) is the key, nulls included; ``unit`` has 128 bits of the text. ``copies`` is how often the row
    repeats; repeated rows (one id, source and text) share a decision. Null and empty texts have size 0 and weigh nothing,
    a null source is a source, very long texts are one unit. Ties in size go by id, then text. Extra columns fall away.
    Empty tables give an empty result; where all sizes are 0, nothing is taken.
    """
    rows = docs.select("doc_id", "source", _unit().alias("unit"), n_words().alias("size"))
    units = written(rows.groupBy("doc_id", "source", "unit", "size").agg(F.count("*").alias("copies")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("n"))
    table = written(with_targets(sizes).withColumnRenamed("size", "source_size"), "sources")
    in_blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    left = _of_source(units, table.withColumn("blocks", in_blocks), "p", "target", "blocks")
    parts, level, waiting = [], 0, None
    while waiting != 0:
        moved = written(_moved(left, level, seed), f"cube-{level}")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(moved.where(~undecided))
        left = moved.where(undecided)
        counts = written(left.groupBy("source").agg(F.count("*").alias("n")), "undecided")
        now = counts.agg(F.sum("n")).first()[0] or 0
        if waiting is not None and now >= waiting:
            raise RuntimeError("the cube method stalled")
        left, waiting, level = _of_source(left, counts.withColumn("blocks", in_blocks), "blocks"), now, level + 1
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part)
    out = _of_source(decided.drop("target"), table, "source_size", "target", "whole")
    return out.withColumn("times", (F.col("whole") + F.col("p")).cast("long")).drop("whole", "p")


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns, whatever the names of further ones."""
    taken = mix(docs, seed).where(F.col("times") > 0)
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__of"), F.col("unit").alias("__text"), F.col("times").alias("__times"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(row, "doc_id", "source", _unit().alias("unit"))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & keyed["source"].eqNullSafe(F.col("__of")) & keyed["unit"].eqNullSafe(F.col("__text"))
    repeated = keyed.join(taken, same).select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return repeated.select("__row.*")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the words that the mix takes of each."""
    out = mix(read(spark, sf_dir, "documents"))
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))

"""Recursion: hierarchies by doubling, cyclic graphs by semi-naive fixpoints. Loops end at the fixpoint alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectflow.operators.resolve import looped
from effectflow.runtime import apart, counted, cut, forget, together, united

KEPT_APART = 8
#: After LONG rounds edges are shortcut, while paths of two stay within SHORTCUT times the edges.
LONG, SHORTCUT = 4, 16


def hierarchy(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth), each pair once with its least depth, each node its own ancestor at depth 0.

    Distances double each round, so a hierarchy of depth n takes log n rounds of two joins, and no table has a bound on
    its rows (as recursive CTEs have). A round without a new pair is the last one, so cycles are fine. Null ends are no
    edge.
    """
    links = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"))
    jump, left = counted(links.where("node IS NOT NULL AND ancestor IS NOT NULL").distinct())
    nodes = jump.select("node").union(jump.select("ancestor")).distinct()
    total, pairs = counted(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    far = 1
    while left:
        step = jump.select(F.col("node").alias("low"), F.col("ancestor").alias("node"))
        further = total.join(step, "node").select(F.col("low").alias("node"), "ancestor", (F.col("depth") + far).alias("depth"))
        nearest = total.unionByName(further).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        twice = jump.join(step, "node").select(F.col("low").alias("node"), "ancestor").distinct()
        was, known = (total, jump), pairs
        (total, pairs), (jump, left) = together(lambda: counted(nearest), lambda: counted(twice))  # noqa: B023
        forget(*was)
        if pairs == known:
            break
        far *= 2
    return total


def reachability(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): all pairs with a path of at least one edge; cycles are fine."""
    step = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    return propagate(step, step)


def _shortcut(edges: DataFrame, times: int = SHORTCUT) -> DataFrame:
    """``edges`` (a, b) and paths of two, four, ... of them as further edges: long chains take fewer rounds.

    The paths of two are counted from the degrees before they are made, so that a graph whose paths are many more than its
    edges stays as it is.
    """
    hops, n = counted(edges.select("a", "b").distinct())
    most = times * n
    while True:
        into = hops.groupBy(F.col("b").alias("v")).agg(F.count("*").alias("i"))
        out = hops.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("o"))
        paths = into.join(out, "v").agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0
        if not paths or paths > 2 * most:
            return hops
        two = hops.select(F.col("a").alias("c"), F.col("b").alias("a")).join(hops, "a").select(F.col("c").alias("a"), "b")
        further, more = counted(hops.unionByName(two).distinct())
        if more > most:
            forget(further)
            return hops
        forget(hops)
        if more == n:
            return further
        hops, n = further, more


def propagate(
    edges: DataFrame, seeds: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None,
    free: DataFrame | None = None,
) -> DataFrame:
    """Least fixpoint of (a, b): ``seeds``, and (x, b) wherever edge (x, a) and (a, b) hold.

    ``edges`` (a, b, ...) says that a takes over what b has; ``seeds`` (a, b) what a has of its own. ``keep`` filters what
    an edge hands over: it sees (a, b) with the edge's further columns; without it, chains of edges are shortcut after a few
    rounds (what earlier rounds found has handed over along single edges already, so only new pairs go on then too). Only
    new pairs go on. Each round writes what it found; the finds of ``KEPT_APART`` rounds are one table again after that, so
    plans stay short and old tables go. There is no bound on the rounds. ``known`` (a, b): pairs that hold already; they
    neither go on nor come out. ``free`` (a, b): further edges, which ``keep`` doesn't filter; these are shortcut with it too.

    Tables of more than ``LARGE`` rows join by shuffle, so rounds send the driver no more as tables grow.
    """
    along = lambda df, *more: looped(df.select(F.col("a").alias("__to"), F.col("b").alias("__from"), *more))
    more = [c for c in edges.columns if c not in ("a", "b")] if keep else []
    kept, free = (along(edges, *more), free) if keep else (None, edges if free is None else edges.select("a", "b").unionByName(free.select("a", "b")))
    moves, rounds = None if free is None else along(free), 0
    delta, new = counted(seeds.select("a", "b").distinct())
    parts, total = [delta], new
    while new:
        if rounds == LONG and free is not None:
            moves = along(_shortcut(free))
        rounds += 1
        over = lambda m, *c: delta.join(m, delta.a == m["__from"]).select(F.col("__to").alias("a"), delta.b, *c)  # noqa: B023, E731
        found = ([keep(over(kept, *more)).select("a", "b")] if keep else []) + ([] if moves is None else [over(moves)])
        grown = united(found, 0).distinct()
        left = grown.join(united(parts, total), ["a", "b"], "left_anti")
        delta, new = counted(left if known is None else left.join(apart(known), ["a", "b"], "left_anti"))
        total += new
        if new and len(parts) == KEPT_APART:
            whole = cut(united(parts, total))
            forget(*parts)
            parts = [whole]
        if new:
            parts.append(delta)
    return united(parts, total)


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, cause): what must be computed again when ``changed`` (node) change: everything that reaches them."""
    seeds = changed.select(F.col("node").alias("a"), F.col("node").alias("b"))
    return propagate(edges, seeds).select(F.col("a").alias("node"), F.col("b").alias("cause"))

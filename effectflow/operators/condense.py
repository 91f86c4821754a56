"""Cycles as one node: strongly connected components, and closures over the condensed graph with sets as words of bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectflow.operators.closure import KEPT_APART, LONG, _shortcut
from effectflow.operators.resolve import looped, small
from effectflow.runtime import counted, cut, forget

#: Trimming goes on while a round takes more than this share of the edges.
TRIMMED = 0.1
#: After so many rounds of a colouring its edges are shortcut, while they stay within FEW times as many.
DEEP, FEW = 10, 4


def _trim(live: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Edges whose start is some edge's end and whose end is some edge's start: others are in no cycle."""
    while n:
        starts, ends = live.select(F.col("a").alias("b")).distinct(), live.select(F.col("b").alias("a")).distinct()
        left, rest = counted(live.join(small(starts), "b", "left_semi").join(small(ends), "a", "left_semi").select("a", "b"))
        forget(live)
        live, gone, n = left, n - rest, rest
        if gone <= TRIMMED * (n + gone):
            break
    return live, n


def _colours(live: DataFrame, weighed: bool) -> DataFrame:
    """(v, f, g): for each node of ``live`` the greatest colour that reaches it, and the greatest that it reaches, its own included.

    Each node has one colour, a number: its hash or, if ``weighed``, its place by the product of its degrees. Only colours that
    rose go on, both ways in one round; a round joins them with the edges and compares by one aggregate, combined before its
    shuffle.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = live.select(F.col("a").alias("v"), one.alias("o"), none.alias("i")).union(live.select(F.col("b").alias("v"), none.alias("o"), one.alias("i")))
    nodes = ends.groupBy("v").agg((F.sum("o") * F.sum("i")).alias("d"))
    # numbers of sorted rows rise; the hash of one number is a number that no other has
    rank = F.monotonically_increasing_id() if weighed else F.xxhash64(F.monotonically_increasing_id())
    nodes = (nodes.orderBy("d", F.xxhash64("v"), "v") if weighed else nodes).select("v", rank.alias("c"))
    ways = lambda df: df.select(F.col("a").alias("v"), F.lit(True).alias("on"), F.col("b").alias("w")).unionByName(
        df.select(F.col("b").alias("v"), F.lit(False).alias("on"), F.col("a").alias("w"))
    )
    moves, rounds = looped(ways(live)), 0
    delta, new = counted(nodes.select("v", F.explode(F.array(F.lit(True), F.lit(False))).alias("on"), "c"))
    nothing = F.lit(None).cast("long")
    parts = [delta]
    while new:
        if rounds == DEEP:  # long cycles take few rounds more
            moves = looped(ways(_shortcut(live, FEW)))
        rounds += 1
        came = delta.join(moves, ["v", "on"]).select(F.col("w").alias("v"), "on", F.col("c").alias("new"), nothing.alias("old"))
        had = reduce(DataFrame.unionByName, parts).select("v", "on", nothing.alias("new"), F.col("c").alias("old"))
        risen = came.unionByName(had).groupBy("v", "on").agg(F.max("new").alias("c"), F.max("old").alias("old")).where("c > old")
        delta, new = counted(risen.select("v", "on", "c"))
        if new and len(parts) == KEPT_APART:
            whole = cut(reduce(DataFrame.unionByName, parts).groupBy("v", "on").agg(F.max("c").alias("c")))
            forget(*parts)
            parts = [whole]
        parts.append(delta)
    both = reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.max(F.when(F.col("on"), F.col("c"))).alias("f"), F.max(F.when(~F.col("on"), F.col("c"))).alias("g"))
    out = cut(both)
    forget(*parts)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes of cycles through more than one node, with the least node of their cycle class.

    Forward-backward colouring: every node takes the greatest colour that reaches it, and the greatest that it reaches. Where
    these are the same, they are its component's; such nodes go, edges between other colours go, and the rest is coloured
    again. Nodes of most edges are the greatest at first, as they lie in large components; after that hashes decide, so that
    the number of colourings follows the logarithm of a chain of components, whatever their ids. Chains are shortcut in a
    long colouring, as far as that keeps the edges few, so long cycles take few rounds. Nodes of no cycle aren't
    listed, nor are loops of one node. Null ends are no edge; repeated edges count once; no edges give no rows.
    """
    live, n = counted(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    found = []
    kind = edges.schema["a"].dataType
    while True:
        live, n = _trim(live, n)
        if not n:
            break
        colour = _colours(live, weighed=not found)
        found.append(cut(colour.where("f = g").select(F.col("v").alias("node"), F.struct(F.lit(len(found)).alias("turn"), "f").alias("root"))))
        tint = small(colour.where("f <> g"))
        same = live.join(tint.select(F.col("v").alias("a"), F.col("f").alias("fa"), F.col("g").alias("ga")), "a").join(
            tint.select(F.col("v").alias("b"), F.col("f").alias("fb"), F.col("g").alias("gb")), "b",
        )
        was = (live, colour)
        live, n = counted(same.where("fa = fb AND ga = gb").select("a", "b"))
        forget(*was)
    if not found:
        return live.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    every = reduce(DataFrame.unionByName, found)
    least = every.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    out = cut(every.join(small(least), "root").select("node", "component"))
    forget(*found)
    return out


def _at(df: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """``column`` replaced by its component, where it is in one."""
    named = small(classes.select(F.col("node").alias(column), F.col("component").alias("__c")))
    return df.join(named, column, "left").withColumn(column, F.coalesce("__c", column)).drop("__c")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def by_words(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(a, b): the pairs of ``closure.propagate(edges, seeds)``, with sets as words of 64 bits.

    What nodes have is numbered, and words are merged by bitwise or (before and after the shuffle), so a round handles a
    word where ``propagate`` handles up to 64 pairs. It pays where nodes reach many effects. Rows with a null are left
    out; tables may be empty; repeated rows count once.
    """
    known = seeds.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    arcs = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    # Numbers of one task follow each other, so words are full but for the last one of each task.
    names = cut(known.select("b").distinct().withColumn("number", F.monotonically_increasing_id()))
    own = known.join(small(names), "b")
    own = own.groupBy("a", F.shiftright("number", 6).alias("w")).agg(F.bit_or(_bit(F.col("number") % 64)).alias("bits"))
    along = lambda df: small(df.select(F.col("a").alias("__to"), F.col("b").alias("a")))
    moves, rounds = along(arcs), 0
    delta, new = counted(own)
    parts, none = [delta], F.lit(0).cast("long")
    while new:
        if rounds == LONG:
            moves = along(_shortcut(arcs))
        rounds += 1
        came = delta.join(moves, "a").select(F.col("__to").alias("a"), "w", F.col("bits").alias("new"), none.alias("old"))
        had = reduce(DataFrame.unionByName, parts).select("a", "w", none.alias("new"), F.col("bits").alias("old"))
        both = came.unionByName(had).groupBy("a", "w").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = both.select("a", "w", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits")).where("bits <> 0")
        delta, new = counted(fresh)
        if new and len(parts) == KEPT_APART:
            whole = cut(reduce(DataFrame.unionByName, parts).groupBy("a", "w").agg(F.bit_or("bits").alias("bits")))
            forget(*parts)
            parts = [whole]
        if new:
            parts.append(delta)
    total = reduce(DataFrame.unionByName, parts).groupBy("a", "w").agg(F.bit_or("bits").alias("bits"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    numbers = total.select("a", F.explode(F.transform(places, lambda i: F.shiftleft("w", 6) + i)).alias("number"))
    return numbers.join(small(names), "number").select("a", "b")


def condensed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(a, b): the pairs of ``closure.propagate(edges, seeds)``, each cycle handled as one node.

    Edges and seeds move to components, ``by_words`` closes the condensed graph, and components become nodes once, at the
    end. Rows with a null are left out; tables may be empty; repeated rows count once.
    """
    once = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    classes = components(once)
    arcs = _at(_at(once, "a", classes), "b", classes)
    total = by_words(arcs, _at(seeds.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "a", classes))
    members = small(classes.select("node", F.col("component").alias("a")))
    return total.join(members, "a", "left").select(F.coalesce("node", "a").alias("a"), "b")

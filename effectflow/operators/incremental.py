"""A recursive view kept between runs: on a change, only what loses or gains support is computed again.

Deleting and deriving again over tables. What a change takes away is followed along the old edges (every pair that might
have lost support), taken off, and derived again where other support is left; then that and what the change adds goes on
along the new edges, up to pairs that hold already. Cycles are fine: a pair that only supported itself is gone after the
first step. The work follows the reverse closure of the change, not the size of the graph.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.operators import closure
from effectflow.operators.resolve import looped
from effectflow.runtime import LARGE, _place, apart, counted, cut, forget

#: Of the kept tables: a change rewrites the parts that hold something it touches.
PARTS = 64


def _handed(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) that edges (a takes over what b has) hand over from ``pairs``."""
    moves = edges.select(F.col("a").alias("__to"), F.col("b").alias("__from"))
    return pairs.join(moves, pairs.a == moves["__from"]).select(F.col("__to").alias("a"), "b")


def _minus(rows: DataFrame, other: DataFrame) -> DataFrame:
    return rows.join(other, ["a", "b"], "left_anti")


def maintain(result: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(removed, added) pairs that turn ``result`` = ``closure.propagate(*old)`` into ``closure.propagate(*new)``.

    ``old`` and ``new``: edges (a, b) and seeds (a, b), without repeated rows. Tables given should be written ones, as they
    are read more than once.
    """
    (was_edges, was_seeds), (edges, seeds) = old, new
    gone_edges, n_gone = counted(_minus(was_edges, edges))
    come_edges, n_come = counted(_minus(edges, was_edges))
    # what might have lost support, by way of the old edges
    lost, n_lost = counted(_minus(was_seeds, seeds).unionByName(_handed(looped(gone_edges), result)).distinct())
    removed = cut(closure.propagate(was_edges, lost)) if n_lost else lost
    held = cut(_minus(result, looped(removed))) if n_lost else result
    # what has other support, and what is new
    start = _minus(seeds, was_seeds)
    if n_lost:
        start = start.unionByName(removed.join(seeds, ["a", "b"], "left_semi"))
        moves = edges.select(F.col("a").alias("__to"), F.col("b").alias("__from"))
        asked = removed.join(moves, removed.a == moves["__to"]).select(F.col("__from").alias("a"), "b", F.col("__to"))
        start = start.unionByName(asked.join(held, ["a", "b"], "left_semi").select(F.col("__to").alias("a"), "b"))
    if n_come:
        start = start.unionByName(_handed(looped(come_edges), held))
    start, n_start = counted(_minus(start.distinct(), held))
    added = cut(closure.propagate(edges, start, known=held)) if n_start else start
    forget(gone_edges, come_edges)
    return _minus(removed, added), _minus(added, result)


class KeptClosure:
    """Edges, seeds and their closure in a folder on any store that Spark writes.

    Tables are partitioned by a hash of their first column, and a run overwrites the parts that it changes. ``runs`` has the
    beginning and the end of each run's writes: after one that was cut off, the next run computes all anew.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        rows = self.spark.read.schema("a string, b string, part int").parquet(f"{self.root}/{name}")
        rows = rows.where("a IS NOT NULL").select("a", "b")  # a part that lost all its rows keeps a null one
        return rows if rows.limit(LARGE + 1).count() <= LARGE else apart(rows)

    def _whole(self) -> bool:
        system, place = _place(self.spark, f"{self.root}/runs")
        if not system.exists(place):
            return False
        runs = self.spark.read.schema("run string, done boolean").parquet(f"{self.root}/runs")
        open_ = runs.groupBy("run").agg(F.bool_or("done").alias("done")).where("NOT done")
        return open_.isEmpty()

    def _note(self, run: str, done: bool) -> None:
        self.spark.createDataFrame([(run, done)], "run string, done boolean").coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    @staticmethod
    def _part(column: str = "a"):
        return F.pmod(F.hash(column), F.lit(PARTS)).alias("part")

    def _write(self, rows: DataFrame, name: str, parts: DataFrame | None) -> None:
        """Rows (a, b) of the given parts, or of all; parts that are given and have no row are emptied."""
        kept = rows.select("a", "b", self._part())
        if parts is not None:
            none = F.lit(None).cast("string")
            kept = kept.join(F.broadcast(parts), "part", "left_semi").unionByName(parts.select(none.alias("a"), none.alias("b"), "part"))
        kept = cut(kept) if parts is not None else kept  # it is read from the parts that go
        writer = kept.repartition("part").write.mode("overwrite").partitionBy("part")
        (writer if parts is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(f"{self.root}/{name}")
        if parts is not None:
            forget(kept)

    def refresh(self, edges: DataFrame, seeds: DataFrame) -> DataFrame:
        """The closure of ``edges`` and ``seeds`` (a, b: strings), by way of what is kept, which is brought up to date."""
        edges, seeds = (cut(x.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()) for x in (edges, seeds))
        run = uuid.uuid4().hex
        if not self._whole():
            self._drop_runs()
            self._note(run, False)
            result = cut(closure.propagate(edges, seeds))
            for rows, name in ((edges, "edges"), (seeds, "seeds"), (result, "result")):
                self._write(rows, name, None)
            self._note(run, True)
            return result
        kept = {name: self._read(name) for name in ("edges", "seeds", "result")}
        removed, added = maintain(kept["result"], (kept["edges"], kept["seeds"]), (edges, seeds))
        changes = {"edges": (kept["edges"], edges), "seeds": (kept["seeds"], seeds)}
        touched = {name: cut(_minus(x, y).unionByName(_minus(y, x)).select(self._part()).distinct()) for name, (x, y) in changes.items()}
        removed, n_removed = counted(removed)
        added, n_added = counted(added)
        result = cut(_minus(kept["result"], looped(removed)).unionByName(added)) if n_removed or n_added else cut(kept["result"])
        self._note(run, False)
        self._write(edges, "edges", touched["edges"])
        self._write(seeds, "seeds", touched["seeds"])
        if n_removed or n_added:
            self._write(result, "result", cut(removed.unionByName(added).select(self._part()).distinct()))
        self._note(run, True)
        return result

    def _drop_runs(self) -> None:
        self.spark.createDataFrame([], "run string, done boolean").write.mode("overwrite").parquet(f"{self.root}/runs")

"""Connected components of an edge table, by alternating large-star and small-star steps.

All steps are joins and partial aggregates over edges; each step's edges are a written table. Nothing but whether edges are
stars already reaches the driver: edges that are need no step at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectflow.llm.common import written

TASK_EDGES = 50_000  # a step of fewer edges for each task takes fewer tasks


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge, and none is a smaller end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return nodes.where("child > 1 OR child = 1 AND parent = 1").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the least node it reaches. Self-loops fall away.

    Least neighbours are partial aggregates. They are written before the edges join them, so both sides of the join are
    tables with exchanges of their own, and adaptive execution splits the partition of a node with many neighbours.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = 1 + now.count() // TASK_EDGES  # steps make no more edges than there are, so tables needn't have more parts

    def put(df: DataFrame, name: str) -> DataFrame:
        few = tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return written(df.coalesce(tasks) if few else df, name)

    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.col("k")).alias("m"))
        least = put(least, "least")
        nearer = both.where("b > a").join(least, both.a == least.k)
        large = put(nearer.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        small = put(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), "least")
        hop = large.join(small, large.a == small.k).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = put(hop.unionByName(small.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

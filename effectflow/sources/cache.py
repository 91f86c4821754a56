"""Facts kept between runs: Parquet keyed by path and content hash. Only new or changed files are parsed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.operators import closure, state
from effectflow.runtime import cut
from effectflow.sources import facts


#: Of the columns of facts: folders of other layouts aren't read.
LAYOUT = "facts-2"


class FactCache:
    """A folder of fact rows with the hash of the text they came from and the time of their storing.

    ``root`` can be on any store that Spark writes. Entries older than ``ttl_hours`` count as missing; of a path's
    entries the newest counts. Appends only: ``prune``, which also keeps the newest ``most`` paths alone, and ``clear``
    write the folder anew.
    """

    def __init__(self, spark: SparkSession, root: str, ttl_hours: int = 24, most: int = 10_000):
        self.spark, self.root, self.ttl_hours, self.most = spark, f"{root.rstrip('/')}/{LAYOUT}", ttl_hours, most

    def _path(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.root)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def entries(self) -> DataFrame | None:
        system, where = self._path()
        return self.spark.read.parquet(self.root) if system.exists(where) else None

    def _young(self) -> Column:
        return state.valid(F.current_timestamp() - F.col("stored_at"), F.expr(f"INTERVAL '{self.ttl_hours}' HOUR"))

    def _fresh(self, table: DataFrame) -> DataFrame:
        newest = table.groupBy("file_id").agg(F.max("stored_at").alias("stored_at"))
        return table.where(self._young()).join(newest, ["file_id", "stored_at"], "left_semi")

    def facts(self, files: DataFrame) -> DataFrame:
        """Facts of ``files`` (path, text): kept ones where path and hash agree, parsed and stored ones for the rest."""
        keyed = files.select("path", "text", F.sha2("text", 256).alias("sha256"))
        table = self.entries()
        wanted = keyed.select(F.col("path").alias("file_id"), "sha256")
        kept = cut(self._fresh(table).join(wanted, ["file_id", "sha256"], "left_semi")) if table is not None else None
        new = keyed if kept is None else keyed.join(kept.select(F.col("file_id").alias("path"), "sha256").distinct(), ["path", "sha256"], "left_anti")
        made = cut(facts.extract(new).join(wanted, "file_id").withColumn("stored_at", F.current_timestamp()))
        made.write.mode("append").parquet(self.root)
        both = made if kept is None else kept.unionByName(made)
        return both.drop("sha256", "stored_at")

    def stats(self) -> DataFrame:
        """(files, rows, stale): entries held, and how many of the files' are too old."""
        table = self.entries()
        if table is None:
            return self.spark.createDataFrame([(0, 0, 0)], "files long, rows long, stale long")
        per = table.groupBy("file_id").agg(F.count("*").alias("n"), F.bool_and(~self._young()).alias("old"))
        return per.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if("old").alias("stale"))

    def _replace(self, table: DataFrame) -> None:
        cut(table).write.mode("overwrite").parquet(self.root)

    def prune(self, alive: DataFrame | None = None) -> None:
        """Drops stale and superseded entries, those of paths that aren't in ``alive`` (path), and all but the newest paths."""
        if (table := self.entries()) is None:
            return
        left = self._fresh(table)
        if alive is not None:
            left, _ = state.prune(left, alive.select(F.col("path").alias("file_id")), ["file_id"])
        paths = left.groupBy("file_id").agg(F.max("stored_at").alias("at"))
        kept = paths.orderBy(F.desc("at"), "file_id").limit(self.most).select("file_id")
        self._replace(left.join(kept, "file_id", "left_semi"))

    def invalidate(self, paths: DataFrame, edges: DataFrame | None = None) -> None:
        """Drops entries of ``paths`` (path) and, with ``edges`` (a, b: path a depends on path b), of all that reach them."""
        if (table := self.entries()) is None:
            return
        gone = paths.select(F.col("path").alias("file_id")).distinct()
        if edges is not None:
            gone = closure.affected(edges, gone.withColumnRenamed("file_id", "node")).select(F.col("node").alias("file_id")).distinct()
        self._replace(state.prune(table, gone, ["file_id"])[1])

    def clear(self) -> None:
        system, where = self._path()
        system.delete(where, True)


class PackageCache:
    """Effects of installed packages kept by name and version: a folder each, made once, never stale."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def place(self, package: str, version: str) -> FactCache:
        """The facts of one package@version; names and versions are as in their index, so they make safe paths."""
        return FactCache(self.spark, f"{self.root}/{package}@{version}", ttl_hours=24 * 365 * 100)

    def facts(self, package: str, version: str, files: DataFrame) -> DataFrame:
        """Facts of a package's sources (path, text): all kept ones, or parsed and kept now."""
        held = self.place(package, version)
        kept = held.entries()
        return held.facts(files) if kept is None else kept.drop("sha256", "stored_at")

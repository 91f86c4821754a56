"""Session helpers: the driver tables, and cutting the lineage of loops by written tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of an Arrow batch where texts are parsed.
TEXT_ROWS = 256
#: Tables of more rows join by shuffle: the optimizer knows stored bytes alone, and rows may take ten times as many on the driver.
LARGE = 20_000
#: Texts for one task where there are many.
TASK_TEXTS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of fixed rows whose size the optimizer knows, so that it is broadcast where that helps."""
    kind = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) or [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only in local mode, where the session names none."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="effectflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_in_memory: ContextVar[bool] = ContextVar("in_memory", default=False)


@contextlib.contextmanager
def in_memory() -> Iterator[None]:
    """Inside, ``cut`` keeps its tables on the driver instead of writing them: for the facts of a single document alone."""
    token = _in_memory.set(True)
    try:
        yield
    finally:
        _in_memory.reset(token)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def apart(df: DataFrame) -> DataFrame:
    """``df`` joined by shuffle, whatever the optimizer takes its size for; a broadcast hint of the other side still counts."""
    return df.hint("merge")


def held(df: DataFrame, rows: int) -> DataFrame:
    """``apart``, if what ``df`` is made from has more than ``LARGE`` rows: results of joins and unions carry no hint of their own."""
    return apart(df) if rows > LARGE else df


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` of ``rows`` texts (or what these are made from) dealt to as many tasks as they need, four a core at most: short
    texts are few stored bytes, by which Spark deals them, but each takes its time to parse."""
    tasks = min(-(-rows // TASK_TEXTS), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by) if tasks > 1 else df


def united(parts: Sequence[DataFrame], rows: int) -> DataFrame:
    """All rows of tables of ``counted``, ``rows`` together: a union loses the hints of its parts."""
    whole = reduce(DataFrame.unionByName, parts)
    return held(whole, rows) if len(parts) > 1 else whole


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder (partitioned ``by`` a column) and read from there.

    The table goes when the session ends, or by ``forget``. One of more than ``LARGE`` rows is kept ``apart``.
    """
    return counted(df, by)[0]


def counted(df: DataFrame, by: str | None = None) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, observed while writing."""
    spark = df.sparkSession
    if _in_memory.get():
        found = df.toArrow()
        return spark.createDataFrame(found, df.schema), found.num_rows
    seen = Observation()
    root = f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    system, place = _place(spark, root)
    system.deleteOnExit(place)
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    rows = seen.get["n"]
    out = held(out, rows)
    out._cut_path = path
    return out, rows


def together(*calls: Callable[[], object]) -> list:
    """Results of calls that start jobs of their own, run at the same time."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, call) for call in calls]]


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing lazy reads any more."""
    for df in tables:
        if not hasattr(df, "_cut_path"):  # kept in memory
            continue
        system, place = _place(df.sparkSession, df._cut_path)
        system.delete(place, True)

"""What the operators of this subpackage share: reading tables, written intermediate tables, Arrow passes.

Intermediate tables are written as Parquet under ``spark.checkpoint.dir`` and read again. That cuts the
lineage, survives the loss of executors and lets later passes read only the columns they need. The folder
is read from the session; a local one is made only in local mode where the session names none, as in tests.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from effectflow.runtime import shared_dir

#: Rows of an Arrow batch: texts are long, so batches are kept small.
BATCH_ROWS = 256

#: The separators of words in the contracts of the text operators; everything else is part of a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows, for the whole session: the setting is read when a plan runs, so it can't be put back
    before. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _tables_dir(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder of the scope, else one of the application. Either goes when the session
    ends, at the latest."""
    path = _scope.get() or f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables written inside go to a folder of their own, whose path this gives. Results that are still lazy read from
    there, so its end deletes nothing: call ``delete`` once they are written."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    token = _scope.set(path)
    try:
        yield path
    finally:
        _scope.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scope's folder, with all tables in it."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a written table: computed once, then read from the shared folder."""
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_pass(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over whole partitions; ``make`` turns batches into dicts of columns."""
    tuned(df.sparkSession)
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make(batches):
            arrays = [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return df.mapInArrow(run, kind)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Python workers live on beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def per_row(df: DataFrame, row: Callable[..., tuple], schema: str) -> DataFrame:
    """``row(*columns) -> tuple`` for every row of ``df``, one result row each, in Arrow batches."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = _parse_names(schema)
        for batch in batches:
            if batch.num_rows:
                made = [row(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
                yield dict(zip(names, map(list, zip(*made))))

    return arrow_pass(df, make, schema)


def _parse_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def plain_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with just these columns; extra columns, whatever their names, fall away."""
    return df.select(*[F.col(f"`{n}`") for n in names])

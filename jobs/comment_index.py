"""An index of the comments in a growing table of texts: which mark, in which file, on which line, and where it repeats.

Before findings are suppressed by comments, one wants to know which comments there are. The job reads a folder of Parquet
files with the columns of ``documents`` as a stream and takes what is new since the last run (``availableNow`` and a
checkpoint). A text is a file at ``source/lang/doc_id``; a later delivery of a path replaces the earlier one.

``deliveries/``  path, lang, hash of the text, lines, comments: a row for each delivery, partitioned by batch
``current/``     path, line, tag, listed, hash of the comments of each path's newest delivery, partitioned by lang

A batch that runs again overwrites its own partitions, and ``current`` is made anew for the languages of the batches since
it was last made, so a run that was cut off can be repeated. ``made/`` says up to which batch ``current`` goes.

    python -m jobs.comment_index --documents DIR --output DIR [--checkpoint DIR] [--config FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from effectflow.functions import text as texts
from effectflow.operators import rank
from effectflow.sources import patterns
from jobs.common import configured, log, session

#: mark: what begins a comment; include, exclude: globs on paths; files_per_batch: 0 takes all new files at once.
DEFAULTS = {"mark": "#", "include": [], "exclude": [], "files_per_batch": 0}


def deliveries(docs: DataFrame, include: list[str], exclude: list[str], mark: str) -> DataFrame:
    """path, lang, version, lines, comments of the rows that the globs select.

    A missing part of a path is ``-``; a document without an id is told from others by its text. ``version`` is the hash of
    the text, ``lines`` their number. ``comments`` has line, tag, listed, hash of each line with a mark: ``tag`` is the word
    behind the first run of marks, lower-cased ('' without one), ``listed`` what is in the brackets after it (null without),
    ``hash`` that of the comment, from its first mark on.
    """
    text = F.coalesce("text", F.lit(""))
    version = texts.short_hash(text)
    part = lambda c: F.regexp_replace(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("-")), "/", "_")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), version))
    path = F.concat_ws("/", part("source"), part("lang"), name)
    rows = docs.select(path.alias("path"), part("lang").alias("lang"), version.alias("version"), F.split(text, "\n").alias("content"))

    def comment(line: Column) -> Column:
        said = F.substr(line["said"], F.locate(mark, line["said"]))
        behind = F.regexp_replace(said, rf"^(?:\Q{mark}\E)+\s*", "")
        tag = F.lower(F.regexp_extract(behind, r"^([A-Za-z_][A-Za-z0-9_-]*)", 1))
        has_list = F.regexp_like(behind, F.lit(r"^[A-Za-z_][^\[#]*\[[^\]]*\]"))
        listed = F.when(has_list, F.regexp_extract(behind, r"\[([^\]]*)\]", 1))
        return F.struct(line["line"].alias("line"), tag.alias("tag"), listed.alias("listed"), texts.short_hash(said).alias("hash"))

    numbered = F.transform("content", lambda said, k: F.struct((k + 1).alias("line"), said.alias("said")))
    marked = F.filter(numbered, lambda x: F.contains(x["said"], F.lit(mark)))
    return patterns.select_paths(rows, "path", include, exclude).select(
        "path", "lang", "version", F.size("content").alias("lines"), F.transform(marked, comment).alias("comments"),
    )


#: Stated, as the values of partitions would be guessed else.
_CURRENT = "path string, line int, tag string, listed string, hash string, lang string"


def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:  # not there yet, or without rows
        return None


def _put(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _as_glob(path: str) -> str:
    """The same path as a pattern: a stream reads a folder by its path, but a single file by a pattern alone."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _current(spark: SparkSession, output: str, last: int) -> None:
    """Makes ``current`` anew for the languages of batches after the one it goes up to."""
    made = _table(spark, f"{output}/made")
    since = -1 if made is None else made.agg(F.max("batch")).first()[0]
    if since >= last:
        return
    every = _table(spark, f"{output}/deliveries")
    langs = every.where(F.col("batch") > since).select("lang").distinct()
    told = every.join(langs, "lang", "left_semi").withColumn("turn", F.struct("batch", "version"))
    newest = rank.last_wins(told, ["path"], ["turn"], ["lang", "comments"])
    # a language that has no comments any more keeps a row, so that its old partition goes
    rows = newest.select("path", "lang", F.explode_outer("comments").alias("comment")).select("path", "comment.*", "lang")
    _put(rows, f"{output}/current", "lang")
    spark.range(1).select(F.lit(last).alias("batch")).write.mode("append").parquet(f"{output}/made")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str | None = None, settings: dict | None = None) -> DataFrame:
    """Takes what is new in ``documents`` and returns the current comments: path, lang, line, tag, listed, hash."""
    conf = {**DEFAULTS, **(settings or {})}
    schema = spark.read.parquet(documents).schema
    reader = spark.readStream.schema(schema)
    if conf["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", conf["files_per_batch"])

    def take(batch: DataFrame, number: int) -> None:
        files = deliveries(batch, conf["include"], conf["exclude"], conf["mark"]).dropDuplicates(["path", "version"])
        _put(files.withColumn("batch", F.lit(number)), f"{output}/deliveries", "batch")

    stream = reader.parquet(_as_glob(documents)).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint or f"{output}/_checkpoint")
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    taken = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    log.info("comment_index: read %d new rows in %d batches from %s", sum(n for _, n in taken), len(taken), documents)
    every = _table(spark, f"{output}/deliveries")
    last = -1 if every is None else every.agg(F.max("batch")).first()[0]
    _current(spark, output, last)
    found = _table(spark, f"{output}/current", _CURRENT)
    if found is None:
        found = spark.createDataFrame([], _CURRENT)
    out = found.where("line IS NOT NULL").select("path", "lang", "line", "tag", "listed", "hash")
    log.info("comment_index: %s/current has %d comments up to batch %d", output, out.count(), last)
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.comment_index")
    parser.add_argument("--documents", required=True, help="folder of Parquet files that grows")
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", help="default: _checkpoint below the output")
    parser.add_argument("--config", help="TOML, as jobs/comment_index.toml")
    given = parser.parse_args(args)
    spark = session("comment_index")
    try:
        run(spark, given.documents, given.output.rstrip("/"), given.checkpoint, configured(spark, given.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

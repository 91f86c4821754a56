"""The report of a whole code base for continuous integration: what escapes which call, and what each file lets through.

Sources come from a table of (path, text) (``--sources``, Parquet), or are generated from the tables of a folder
(``--tables``: a module for each row of ``supplier``). The job runs the check, and writes

``report/kind=finding/``  file_id, line, severity, message
``report/kind=file/``     file_id, functions, raises, findings, effects: what a file defines, raises and lets escape
``summary/``              one JSON row of totals, for the log of a build

Both are overwritten as a whole, so a rerun gives the same result, and one after a failure repairs it.

    python -m jobs.escape_report (--sources DIR | --tables DIR) --output DIR [--stubs FILES] [--config FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.operators import merge
from effectflow.plans import code_base
from effectflow.plans.check import Check, Options
from effectflow.runtime import counted, cut, forget, spread
from effectflow.sources import facts, patterns, stubs
from jobs.common import configured, log, session

#: ignore: effects that are never reported; include, exclude: globs on paths; mode, strict, warn_native, root: see Options.
DEFAULTS = {
    "ignore": ["KeyboardInterrupt", "SystemExit"], "include": [], "exclude": [], "mode": "reference", "strict": False, "warn_native": True, "root": "",
    "python": "3.12",
}


def _by_file(check: Check, findings: DataFrame) -> DataFrame:
    """file_id, functions, raises, findings, effects (sorted) of every file, zeros and null included."""
    count = lambda df, name: df.groupBy("file_id").agg(F.count("*").alias(name))
    own = check.functions.where("name <> '<module>'")
    escaping = check.signatures.join(own.select("fn_id", "file_id"), "fn_id").groupBy("file_id").agg(merge.as_set("effect").alias("effects"))
    out = check.files.select(F.col("path").alias("file_id"))
    for part in (count(own, "functions"), count(facts.raises(check.facts), "raises"), count(findings, "findings"), escaping):
        out = out.join(part, "file_id", "left")
    return out.fillna(0, ["functions", "raises", "findings"])


def report(spark: SparkSession, sources: DataFrame, output: str, signatures: DataFrame | None = None, settings: dict | None = None) -> DataFrame:
    """Checks ``sources`` (path, text), writes the report and returns it: kind, file_id, line, severity, message, functions,
    raises, findings, effects. Of a path that is there twice, the last text in order counts."""
    conf = {**DEFAULTS, **(settings or {})}
    files = patterns.select_paths(sources.select("path", "text"), "path", conf["include"], conf["exclude"])
    files, n = counted(files.where("path IS NOT NULL").groupBy("path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")))
    options = Options(
        ignored=conf["ignore"], mode=conf["mode"], strict=conf["strict"], warn_native=conf["warn_native"], root=conf["root"] or None,
    )
    check = Check(spread(files, n, "path"), None if signatures is None else stubs.for_version(signatures, conf["python"]), options=options)
    log.info("escape_report: read %d files", n)
    findings = cut(check.diagnostics.select("file_id", "line", "severity", "message"))
    rows = findings.withColumn("kind", F.lit("finding")).unionByName(_by_file(check, findings).withColumn("kind", F.lit("file")), allowMissingColumns=True)
    rows.repartition("kind", F.pmod(F.hash("file_id"), F.lit(64))).sortWithinPartitions("file_id").write.mode("overwrite").partitionBy("kind").parquet(f"{output}/report")
    done = spark.read.schema(rows.schema).parquet(f"{output}/report")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = done.where("kind = 'file'").agg(F.count("*").alias("files"), total("functions"), total("raises"), total("findings"))
    sums.coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    log.info("escape_report: wrote %s, %s", f"{output}/report", spark.read.json(f"{output}/summary").first())
    forget(findings)
    return done


def run(
    spark: SparkSession, output: str, sources: str | None = None, tables: str | None = None, stub_files: str | None = None,
    settings: dict | None = None,
) -> DataFrame:
    """``report`` of the table at ``sources``, or of the code base generated from the folder ``tables``."""
    rows = spark.read.parquet(sources) if sources else code_base.sources(spark, tables)
    known = stubs.read_json(spark, stub_files, "given") if stub_files else None
    return report(spark, rows, output, known, settings)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.escape_report")
    given = parser.add_mutually_exclusive_group(required=True)
    given.add_argument("--sources", help="Parquet table of (path, text)")
    given.add_argument("--tables", help="folder with supplier.parquet and nation.parquet")
    parser.add_argument("--output", required=True)
    parser.add_argument("--stubs", help="JSON stub files of libraries")
    parser.add_argument("--config", help="TOML, as jobs/escape_report.toml")
    asked = parser.parse_args(args)
    spark = session("escape_report")
    try:
        run(spark, asked.output.rstrip("/"), asked.sources, asked.tables, asked.stubs, configured(spark, asked.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

"""What the jobs share: their logger, configuration files read by Spark, and the session of the command line."""

from __future__ import annotations

import logging
import tomllib
from collections.abc import Mapping

from pyspark.sql import SparkSession

log = logging.getLogger("effectflow.jobs")


def configured(spark: SparkSession, path: str | None, defaults: Mapping[str, object]) -> dict[str, object]:
    """``defaults``, overlaid by the TOML file at ``path`` (on any store that Spark reads). Unknown keys are an error."""
    text = spark.read.text(path, wholetext=True).first()[0] if path else ""
    given = tomllib.loads(text)
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {**defaults, **given}


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()

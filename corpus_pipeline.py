"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. ``quality_classifier``: texts that importance resampling rejects go.
2. ``jaccard_join``: of each component of five-word shingles at a Jaccard of 0.8, the least doc_id stays.
3. ``personal_data``: spans of personal data are replaced in the texts.
4. ``source_mix``: documents are taken as often as the mix to target weights says.
5. ``packing``: what is left is tokenized and packed into sequences.

All stages but the last return the columns of ``documents``. Cube sampling, resampling and packing aren't
expressible in SQL, so ``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.llm import common, mixing, packing, pii, quality, simjoin

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """A stage whose result is a written table of its own: its intermediate tables go before it returns, so results can be
    kept, composed and read at any time. ``folder`` is the result's place; it goes when the session ends, if not before."""

    @functools.wraps(f)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.scope(spark, f"stage-{f.__name__}") as tables:
            made = f(spark, docs, sf_dir)
            with common.scope(spark, f"result-{f.__name__}") as folder:
                out = common.written(made, "rows")
        common.delete(spark, tables)
        out.folder = folder
        return out

    return staged


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes. Labels come from ``labels``.

    Null and empty texts weigh 0 and are kept or not like any of that weight; repeated rows and ties at the cut stay or go
    together; very long texts count at the common length; without labels all stay; an empty table stays empty. Further
    columns fall away.
    """
    return quality.kept(common.columns_of(docs, COLUMNS), common.read(spark, sf_dir, "labels"))


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: its least doc_id.

    Texts without words are linked with nothing and stay. Rows that share a doc_id are documents of their own unless
    their texts are equal (then the least row stays) or linked. Rows without a doc_id stay.
    """
    docs = common.columns_of(docs, COLUMNS)
    repeated = common.written(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if repeated.limit(1).count():
        return _join_of_rows(docs, repeated)
    found = simjoin.similarity_components(docs, 5, 80, 100)
    return _without(docs, found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id")


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    dropped = common.written(dropped, "dropped")
    few = dropped.count() <= simjoin.BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def _join_of_rows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The stage where doc_ids repeat: every different text under an id is numbered, and the numbers are joined."""
    again = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    again = again.select("doc_id", "text", "row.*")
    once = docs.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").unionByName(again)
    rows = common.written(once.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so the numbers stay
    found = simjoin.similarity_components(rows.select(F.col("row").alias("doc_id"), "text"), 5, 80, 100)
    place = rows.select("row", F.struct("doc_id", F.xxhash64("text"), "row").alias("place"))
    members = common.written(found.select(F.col("doc_id").alias("row"), "component_id").join(place, "row"), "members")
    first = members.groupBy("component_id").agg(F.min_by("row", "place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.written(first, "first")  # so that the members of a large component can be split where they join it
    left = _without(rows, members.join(first, "component_id").where("row <> first").select("row"), "row").drop("row")
    return left.unionByName(docs.where("doc_id IS NULL"))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced; ``n_chars`` follows the text where it changes.

    Null texts stay null, empty ones empty; very long texts are whole; repeated rows stay repeated; ties have nothing to
    decide; an empty table stays empty. Further columns fall away.
    """
    return pii.redacted(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words weigh nothing and count by their probability like the rest; rows that are equal in id, source and
    text share a decision; nulls in any of these are values of their own; a very long text is one unit; an empty table, or
    one without words, gives no rows. Further columns fall away.
    """
    return mixing.mixed(common.columns_of(docs, COLUMNS))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    Null and empty texts are one piece, the end id; long ones are cut; repeated rows are packed as often; equal pieces tie;
    an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's intermediate tables go as soon as its result is written, and a result as soon as the next one is. The last
    one stays until the session ends.
    """
    docs, before = common.read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if before:
            common.delete(spark, before)
        before = docs.folder
    return docs

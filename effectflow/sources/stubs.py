"""Signature stubs: nested JSON or TOML of any shape to one relation, versions as ranges, lookups as joins."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.operators.resolve import range_pick, small

SCHEMA = "source string, priority int, version_spec string, module string, cls string, member string, ord bigint, exc string, confidence string"
#: Priorities of stub sources, the highest first.
PRIORITIES = {"project": 100, "stdlib": 50, "third-party": 40}


def flatten(texts: DataFrame) -> DataFrame:
    """(source, priority, version_spec, module, cls, member, ord, exc, confidence) of stub texts (source, priority, text).

    ``{"metadata": ..., module: {member: effects}}`` or ``{module: {class: {member: effects}}}``; effects are a list
    (all ``likely``) or an object of confidences. Module-level members may stand under an empty class. A text that isn't
    JSON has no rows. Everything is VARIANT until its shape is known.
    """
    root = texts.select("source", "priority", F.try_parse_json("text").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).select(
        "source", "priority", "v", F.try_variant_get("v", "$.metadata.version", "string").alias("version_spec"),
    )
    root.createOrReplaceTempView("__stub_roots")
    spark = texts.sparkSession
    return spark.sql("""
      WITH modules AS (SELECT source, priority, version_spec, m.key AS module, m.value AS v FROM __stub_roots, LATERAL variant_explode(v) m WHERE m.key NOT IN ('metadata', 'format_version')),
      members AS (SELECT source, priority, version_spec, module, e.pos AS ord, e.key AS k, e.value AS v FROM modules, LATERAL variant_explode(v) e WHERE schema_of_variant(modules.v) LIKE 'OBJECT%'),
      shaped AS (SELECT *, schema_of_variant(v) AS shape FROM members),
      flat AS (
        SELECT source, priority, version_spec, module, '' AS cls, k AS member, ord * 100000L AS ord, v FROM shaped WHERE shape LIKE 'ARRAY%' OR (shape LIKE 'OBJECT%' AND NOT (shape LIKE '%OBJECT<%OBJECT<%' OR shape LIKE '%: ARRAY<%'))
        UNION ALL
        SELECT source, priority, version_spec, module, k, c.key, ord * 100000L + c.pos, c.value FROM shaped, LATERAL variant_explode(v) c WHERE shape LIKE '%OBJECT<%OBJECT<%' OR (shape LIKE 'OBJECT%' AND shape LIKE '%: ARRAY<%')),
      effects AS (SELECT source, priority, version_spec, module, cls, member, ord, x.key AS name, x.value AS e FROM flat, LATERAL variant_explode(v) x)
      SELECT source, priority, version_spec, module, cls, member, ord, coalesce(name, variant_get(e, '$', 'string')) AS exc, CASE WHEN name IS NULL THEN 'likely' ELSE variant_get(e, '$', 'string') END AS confidence FROM effects""")


def read_json(spark: SparkSession, path: str, source: str, priority: int | None = None) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(
        F.lit(source).alias("source"), F.lit(priority if priority is not None else PRIORITIES[source]).alias("priority"),
        F.col("value").alias("text"),
    )
    return flatten(texts)


def read_toml(text: str) -> list[tuple[str, str, str, str | None]]:
    """(qualname, effect, confidence, notes) of an old stub text: a table a qualified name; ``exact`` where none is given."""
    out = []
    for name, body in tomllib.loads(text).items():
        if name != "metadata" and isinstance(body, dict):
            out += [(name, e, body.get("confidence", "exact"), body.get("notes")) for e in body.get("raises", [])]
    return out


def version_number(version: Column) -> Column:
    """A dotted version as a number that sorts: major, minor and patch in steps of a thousand; null for null.

    A part counts by its leading digits, so a pre-release (``3.13rc1``) takes the stubs of its release; no digits are 0.
    """
    parts = F.split(version, "[.]")
    at = lambda k: F.coalesce(F.regexp_extract(F.try_element_at(parts, F.lit(k)), "^[0-9]+", 0).try_cast("bigint"), F.lit(0))
    return F.when(version.isNotNull(), at(1) * 1_000_000 + at(2) * 1000 + at(3))


def with_bounds(stubs: DataFrame, spec: str = "version_spec") -> DataFrame:
    """``lo``, ``hi`` and ``score`` of comma-joined version clauses (>=, >, <, <=, ==, ~=); no clause is no bound.

    The score is the specificity: ten for ``==``, five for ``~=``, one for each other clause.
    """
    clause = F.filter(F.transform(F.split(F.coalesce(F.col(spec), F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    op = lambda c: F.regexp_extract(c, "^(==|~=|>=|<=|>|<)", 1)
    at = lambda c: version_number(F.regexp_extract(c, r"([0-9]+(?:[.][0-9]+)*)", 1))
    parts = lambda c: F.size(F.split(F.regexp_extract(c, r"([0-9]+(?:[.][0-9]+)*)", 1), "[.]"))
    step = lambda c: F.when(parts(c) <= 1, 1_000_000).when(parts(c) == 2, 1000).otherwise(1)
    wild = lambda c: F.when(c.endswith("*"), step(c)).otherwise(1)
    near = lambda c: F.when(parts(c) <= 2, F.floor(at(c) / 1_000_000) * 1_000_000 + 1_000_000).otherwise(F.floor(at(c) / 1000) * 1000 + 1000)
    low = F.transform(clause, lambda c: F.when(op(c).isin(">=", "==", "~="), at(c)).when(op(c) == ">", at(c) + 1).otherwise(F.lit(0).cast("bigint")))
    high = F.transform(
        clause,
        lambda c: F.when(op(c) == "<", at(c)).when(op(c) == "<=", at(c) + 1).when(op(c) == "==", at(c) + wild(c)).when(op(c) == "~=", near(c)).otherwise(F.lit(1 << 60)),
    )
    weight = F.aggregate(F.transform(clause, lambda c: F.when(op(c) == "==", 10).when(op(c) == "~=", 5).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return stubs.withColumns({"lo": F.coalesce(F.array_max(low), F.lit(0)), "hi": F.coalesce(F.array_min(high), F.lit(1 << 60)), "score": weight})


def for_version(stubs: DataFrame, version: str) -> DataFrame:
    """Rows of the sources' most specific specifier that holds the version; ties keep the least specifier text."""
    specs = with_bounds(stubs.select("source", "version_spec").distinct())
    asked = stubs.sparkSession.range(1).select(version_number(F.lit(version)).alias("__at"))
    best = range_pick(asked, "__at", specs, "lo", "hi", [F.desc("score"), "version_spec"], ["source"])
    best = best.select(F.col("source").alias("__source"), F.col("version_spec").alias("__spec"))
    return stubs.join(
        small(best), (F.col("source") == F.col("__source")) & F.col("version_spec").eqNullSafe(F.col("__spec")),
    ).drop("__source", "__spec")


def lookup(names: DataFrame, stubs: DataFrame) -> DataFrame:
    """(module, member, exc, confidence, source) for distinct ``names`` (module, member; member may be ``Class.method``).

    Exact first, in the module or its underscored twin; then, for methods, any class of the module that has the method,
    the first in order. The source of highest priority that has the name wins.
    """
    dot = F.col("member").contains(".")
    asked = names.select("module", "member").distinct().select(
        "*", F.when(dot, F.regexp_replace("member", r"[.][^.]*$", "")).otherwise("").alias("cls"),
        F.regexp_extract("member", r"([^.]*)$", 1).alias("leaf"),
    )
    keyed = asked.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("twin"), F.col("module").alias("m")),
                F.struct(F.lit(1).alias("twin"), F.concat(F.lit("_"), "module").alias("m")),
            )
        ).alias("t"),
    )
    s = small(
        stubs.select(
            "source", "priority", F.col("module").alias("s_module"), F.col("cls").alias("s_cls"),
            F.col("member").alias("s_member"), "ord", "exc", "confidence",
        )
    )
    hit = keyed.join(
        s,
        (F.col("t.m") == F.col("s_module")) & (F.col("leaf") == F.col("s_member")) & ((F.col("cls") == F.col("s_cls")) | (F.col("cls") != "")),
    )
    fuzzy = (F.col("cls") != F.col("s_cls")).cast("int")
    order = F.struct((-F.col("priority")).alias("p"), fuzzy.alias("fuzzy"), F.col("t.twin").alias("twin"), "ord")
    best = F.min(order).over(Window.partitionBy("module", "member"))
    chosen = hit.withColumn("o", order).withColumn("b", best).where("o = b")
    return chosen.select("module", "member", "exc", "confidence", "source").distinct()

"""Writing signature stubs: merged, deduplicated, nested; JSON and the older TOML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectflow.functions import names, text
from effectflow.operators import merge
from effectflow.operators.rank import last_wins

#: Modules that exist for tests alone: fixed prefixes.
TEST_PREFIXES = ("_test", "xx", "_xx")
#: Libraries whose signatures also count for the native module that they replace: fixed names.
TWINS = {"_pyio": "_io", "_pydecimal": "_decimal", "_pydatetime": "_datetime"}


def without_tests(stubs: DataFrame, module: str = "module") -> DataFrame:
    keep = F.lit(True)
    for p in TEST_PREFIXES:
        keep = keep & ~F.col(module).startswith(p)
    return stubs.where(keep)


def with_twins(stubs: DataFrame) -> DataFrame:
    """Rows (module, ...), and again under the native module's name."""
    pairs = stubs.sparkSession.createDataFrame(list(TWINS.items()), "module string, twin string")
    again = stubs.join(F.broadcast(pairs), "module").withColumn("module", F.col("twin")).drop("twin")
    return stubs.unionByName(again)


def flat(raw: DataFrame) -> DataFrame:
    """(module, cls, member, exc, confidence) of raw stubs (ord, qualname, exc, confidence): the last writer of each pair by ``ord``."""
    last = last_wins(raw, ["qualname", "exc"], ["ord"], ["confidence"])
    module, cls, member = names.split_qualname(F.col("qualname"))
    return last.select(module.alias("module"), cls.alias("cls"), member.alias("member"), "exc", "confidence")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Native and library stubs (qualname, exc, confidence, notes) as one: sets united, the confidence rule, notes joined."""
    return merge.merge_two(first, second, ["qualname"], "exc", "confidence", "notes")


def write_json(stubs: DataFrame, name: str, version: str, generated_at: str, skip_tests: bool = True) -> DataFrame:
    """(value) one JSON text of ``flat`` stubs: module, then class or function; a list where every confidence is likely.

    A stub file is one document, a few thousand functions.
    """
    rows = without_tests(stubs) if skip_tests else stubs
    effects = rows.groupBy("module", "cls", "member").agg(
        F.array_sort(F.collect_set(F.struct("exc", "confidence"))).alias("e"),
        F.bool_and(F.col("confidence") == "likely").alias("plain"),
    )
    body = F.when(F.col("plain"), F.to_json(F.col("e.exc"))).otherwise(F.to_json(F.map_from_entries("e")))
    key = lambda c: F.to_json(F.array(c))
    pair = lambda k, v: F.concat(F.substr(key(k), F.lit(2), F.length(key(k)) - 2), F.lit(": "), v)
    object_ = lambda pairs: F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ", "), F.lit("}"))
    members = effects.select("module", "cls", pair(F.col("member"), body).alias("p"))
    classes = members.where("cls <> ''").groupBy("module", "cls").agg(object_(F.collect_list("p")).alias("v"))
    level = members.where("cls = ''").select("module", "p").unionByName(classes.select("module", pair(F.col("cls"), F.col("v")).alias("p")))
    modules = level.groupBy("module").agg(object_(F.collect_list("p")).alias("v")).select(pair(F.col("module"), F.col("v")).alias("p"))
    meta = F.to_json(
        F.struct(
            F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit("2.0").alias("format_version"),
            F.lit("effectflow").alias("generator"), F.lit(generated_at).alias("generated_at"),
        )
    )
    return modules.agg(F.collect_list("p").alias("all")).select(
        F.concat(
            F.lit("{"), F.concat_ws(", ", F.concat(F.lit('"metadata": '), meta), F.array_join(F.array_sort("all"), ", ")),
            F.lit("}"),
        ).alias("value")
    )


def counted(stubs: DataFrame) -> DataFrame:
    """(stubs) how many functions."""
    return stubs.select("module", "cls", "member").distinct().agg(F.count("*").alias("stubs"))


def write_toml(stubs: DataFrame) -> DataFrame:
    """(value) lines of the older format from (qualname, exc, confidence, notes): effects united, the weakest confidence, the first notes."""
    one = stubs.groupBy("qualname").agg(F.array_sort(F.collect_set("exc")).alias("e"), F.min(F.when(F.col("notes") != "", F.col("notes"))).alias("n"))
    one = one.join(merge.lowest(stubs, ["qualname"], "confidence").withColumnRenamed("confidence", "c"), "qualname")
    quoted = lambda c: F.concat(F.lit('"'), text.toml_string(c), F.lit('"'))
    lines = F.filter(
        F.array(
            F.concat(F.lit("["), quoted(F.col("qualname")), F.lit("]")),
            F.concat(F.lit("raises = ["), F.array_join(F.transform("e", quoted), ", "), F.lit("]")),
            F.concat(F.lit("confidence = "), quoted(F.col("c"))), F.concat(F.lit("notes = "), quoted(F.col("n"))), F.lit(""),
        ),
        lambda x: x.isNotNull(),
    )
    return one.select("qualname", F.posexplode(lines).alias("k", "value")).orderBy("qualname", "k").select("value")


def version_summary(runs: DataFrame) -> DataFrame:
    """(total, failed) over (version, ok)."""
    return runs.agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed"))

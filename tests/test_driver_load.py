"""What a run sends to the driver, and how many rounds it takes, must not grow with its tables."""

from pyspark.sql import functions as F

from effectflow import runtime
from effectflow.operators import closure, resolve
from effectflow.plans import code_base
from effectflow.plans.check import Check
from effectflow.runtime import counted, united


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_written_tables_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(runtime, "LARGE", 20)
    asked = spark.range(1000)
    large, n = counted(spark.range(30).withColumn("x", F.col("id") % 3))
    few, _ = counted(spark.range(10))
    assert n == 30 and "BroadcastHashJoin" not in plan(asked.join(large, "id"))
    assert "BroadcastHashJoin" not in plan(asked.join(large.groupBy("id").count(), "id"))
    assert "BroadcastHashJoin" not in plan(asked.join(united([few, few, few], 30), "id", "left_anti"))
    assert "BroadcastHashJoin" in plan(asked.join(few, "id"))
    assert asked.join(large, "id").count() == 30


def test_small_counts_stored_tables(spark, tmp_path):
    """The stored bytes of such a table are far below the bound, its rows are not."""
    path = f"file://{tmp_path}/t"
    spark.range(300_000).selectExpr("id div 1000 AS k").write.parquet(path)
    df = resolve.small(spark.read.parquet(path))
    assert "BroadcastHashJoin" not in plan(spark.range(1_000_000).join(df, F.col("id") == F.col("k")))


def test_free_edges_are_shortcut_beside_filtered_ones(spark, monkeypatch):
    """A chain of 60 calls without handlers takes few rounds though other edges filter: as many pairs as along single edges."""
    n = 60
    free = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    guarded = spark.createDataFrame([(100, 0, "x"), (101, 100, "y")], "a long, b long, site string")
    seeds = spark.createDataFrame([(n, "e"), (n, "f")], "a long, b string")
    rounds = []

    def keep(df):
        rounds.append(1)
        return df.where("NOT (site = 'x' AND b = 'e')")

    found = {tuple(r) for r in closure.propagate(guarded, seeds, keep=keep, free=free).collect()}
    assert found == {(k, x) for k in range(n + 1) for x in "ef"} | {(100, "f"), (101, "f")}
    assert len(rounds) < 30


def test_texts_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """A stored table of many short texts is one small file, its parse isn't one task; nothing is dealt where texts are few."""
    base = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    for name, n in (("supplier", 10), ("nation", 0)):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows = rows.crossJoin(spark.range(n).select("id")).withColumn("s_suppkey", F.col("s_suppkey") + 1000 * F.col("id")).drop("id") if n else rows
        rows.coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    n = 10 * base.count()
    monkeypatch.setattr(runtime, "TASK_TEXTS", n // 5)
    dealt = code_base.sources(spark, f"file://{tmp_path}")
    assert dealt.rdd.getNumPartitions() == 5 and dealt.select("path").distinct().count() == n
    assert code_base.sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1
    assert runtime.spread(dealt, 10**9).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_targets_of_many_facts_join_by_shuffle(spark, monkeypatch):
    """Joined strategies carry no hint of their own: adaptive execution took what it found below its bound in compressed bytes."""
    made, cascade = [], resolve.cascade

    def seen(*args):
        made.append(cascade(*args))
        made[-1].collect()
        return made[-1]

    monkeypatch.setattr(runtime, "LARGE", 0)
    monkeypatch.setattr(resolve, "cascade", seen)
    files = spark.createDataFrame([("a.py", "def f():\n    raise KeyError\ndef g():\n    f()\n"), ("b.py", "import a\ndef h():\n    a.f()\n")], "path string, text string")
    found = {(r.name, r.fn_id) for r in Check(files).targets.collect()}
    assert found == {("f", "a.py#a.f"), ("a.f", "a.py#a.f")}
    assert "isFinalPlan=true" in plan(made[0]) and "BroadcastHashJoin" not in plan(made[0])

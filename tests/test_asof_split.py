import random
from statistics import median

from pyspark.sql import functions as F

from effectflow.operators import rank
from effectflow.runtime import cut


def test_split_keys_equal_whole_ones(spark):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = spark.createDataFrame([(k, key(), rng.randrange(60) if rng.random() < 0.95 else None) for k in range(400)], "id long, who string, t long")
    right = spark.createDataFrame([(key(), rng.randrange(60), rng.randrange(5)) for _ in range(60)], "who string, t long, value long")
    for keep in (True, False):
        one = rank.asof_backward(left, right, ["who"], "t", "t", ["value"], keep)
        two = rank.asof_backward(left, right, ["who"], "t", "t", ["value"], keep, split=True)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.columns == two.columns
    assert rank.asof_backward(left.limit(0), right, ["who"], "t", "t", ["value"], split=True).count() == 0
    assert rank.asof_backward(left, right.limit(0), ["who"], "t", "t", ["value"], split=True).where("value IS NOT NULL").count() == 0


def test_one_key_is_many_parts(spark, monkeypatch):
    n, seen = 200_000, []

    def noting(df):
        out = cut(df)
        if "__side" in df.columns:
            seen.append([r["count"] for r in out.groupBy("__part").count().collect()])
        return out

    monkeypatch.setattr(rank, "cut", noting)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(n).select(F.lit("hot").alias("who"), F.col("id").alias("t"))
        right = spark.createDataFrame([("hot", 7, "early"), ("hot", 150_000, "late")], "who string, t long, value string")
        got = rank.asof_backward(left, right, ["who"], "t", "t", ["value"], split=True).groupBy("value").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.value: r["count"] for r in got} == {None: 7, "early": 149_993, "late": 50_000}
    assert len(seen[0]) >= 4 and max(seen[0]) <= 2 * median(seen[0])

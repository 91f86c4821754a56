import datetime as dt
import time

from pyspark.sql import functions as F

from effectflow.operators import state
from effectflow.plans.check import Check
from effectflow.streaming import edits

T0 = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drained(query):
    query.processAllAvailable()
    query.stop()


def rows(spark, tmp_path, batches, schema):
    """A stream of one file a batch."""
    folder = tmp_path / "in"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_apply_edit():
    assert edits.apply_edit("ab\ncd\n", (0, 1), (1, 1), "X") == "aXd\n"
    assert edits.apply_edit("ab", None, None, "new") == "new"
    assert edits.apply_edit("ab", (9, 9), (9, 9), "c") == "abc"
    assert edits.apply_edit("ab\ncd", (0, 99), (0, 99), "!") == "ab!\ncd"


def test_fold(spark, tmp_path):
    none = (None, None, None, None)
    batches = [[("u", at(0), "open", *none, "def f():\n    pass\n"), ("v", at(0), "open", *none, "x")], [("u", at(2), "change", 1, 4, 1, 8, "g()"), ("u", at(1), "change", 0, 4, 0, 5, "ff")], [("v", at(3), "close", *none, None), ("u", at(4), "save", *none, None)]]
    out = edits.folded(rows(spark, tmp_path, batches, edits.EVENT))
    drained(out.writeStream.format("memory").queryName("folded").outputMode("update").start())
    got = {(r.uri, r.text, r.n_edits) for r in spark.table("folded").collect()}
    assert ("u", "def ff():\n    g()\n", 2) in got and ("v", "x", 0) in got


def test_debounce_matches_batch(spark, tmp_path):
    batches = [[("u", at(k)) for k in (0, 1, 2, 60)], [("v", at(61)), ("u", at(100))], [("u", at(9000))]]
    stream = rows(spark, tmp_path, batches, "uri string, ts timestamp")
    drained(edits.debounced(stream, "10 seconds", late="30 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").start())
    got = {(r.uri, r.started, r.n) for r in spark.table("bursts").collect()}
    flat = spark.createDataFrame([r for b in batches for r in b], "uri string, ts timestamp")
    want = {(r.uri, r.started, r.n) for r in state.debounce(flat, "ts", "10 seconds", ["uri"]).where(F.col("last") < F.lit(at(8000))).collect()}
    assert got == want and len(want) == 4


def test_cache(spark, tmp_path):
    schema = "key string, ts timestamp, mtime double, size long, sha256 string"
    batches = [[("a", at(0), 1.0, 5, "h")], [("a", at(10), 1.0, 5, "h"), ("a", at(20), 1.0, 5, "i")], [("a", at(5000), 1.0, 5, "i")]]
    out = edits.cached(rows(spark, tmp_path, batches, schema), ttl_seconds=100)
    drained(out.writeStream.format("memory").queryName("hits").outputMode("append").start())
    assert [r.hit for r in spark.table("hits").orderBy("ts").collect()] == [False, True, False, False]


def until(query, done, seconds=60):
    """Waits for a running stream whose input has ended, then stops it."""
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert done()


def test_last_burst_comes_without_later_events(spark, tmp_path):
    batches = [[("u", at(k)) for k in (0, 1, 2)] + [("v", at(5)), ("v", None), (None, None)]]
    stream = rows(spark, tmp_path, batches, "uri string, ts timestamp")
    query = edits.bursts(stream, 300).writeStream.format("memory").queryName("timed").outputMode("append").start()
    until(query, lambda: spark.table("timed").count() == 3)
    flat = spark.createDataFrame([r for r in batches[0] if r[0] and r[1]], "uri string, ts timestamp")
    want = {(r.uri, r.started, r.last) for r in state.debounce(flat, "ts", "10 seconds", ["uri"]).collect()}
    got = spark.table("timed").collect()
    assert {(r.uri, r.started, r.last) for r in got if r.uri} == want
    assert {r.uri: r.n for r in got} == {"u": 3, "v": 2, None: 1}


def test_idle_keys_leave_the_cache(spark, tmp_path):
    schema = "key string, ts timestamp, mtime double, size long, sha256 string"
    out = edits.cached(rows(spark, tmp_path, [[("a", at(0), 1.0, 5, "h"), ("b", at(0), 1.0, 5, "h")]], schema), ttl_seconds=100, forget_ms=300)
    query = out.writeStream.format("memory").queryName("idle").outputMode("append").start()
    held = lambda: [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    until(query, lambda: spark.table("idle").count() == 2 and held()[-1:] == [0])
    assert max(held()) == 2


def test_publish(spark, tmp_path):
    none = (None, None, None, None)
    text = "def f():\n    raise ValueError()\ndef g():\n    f()\n"
    stream = edits.folded(rows(spark, tmp_path, [[("u.py", at(0), "open", *none, text)]], edits.EVENT))
    seen = []
    drained(edits.publish(stream, lambda files: Check(files).diagnostics, lambda df, n: seen.extend(r.message for r in df.collect()), str(tmp_path / "check")))
    assert seen == ["call to 'f' may raise unhandled exception(s): ValueError"]

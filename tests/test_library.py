from effectflow.plans.check import NATIVE, Check, Options
from effectflow.plans.library import Library
from effectflow.sources.cache import FactCache, PackageCache

LIB = [
    ("pack", "/lib/pack/__init__.py", "from .inner import go\nfrom pack.other import gone as left\ndef own():\n    _raise()\ndef _raise():\n    raise KeyError()\ndef told():\n    'May raise things.'\n    return 1\n"),
    ("pack.inner", "/lib/pack/inner.py", "class Bad(Exception): pass\ndef go():\n    raise Bad()\n"),
    ("pack.other", "/lib/pack/other.py", "def gone():\n    raise OSError()\n"),
    ("pack._core", "/lib/pack/_core.py", "class C:\n    def run(self):\n        raise ValueError()\n"),
]
MAIN = "import pack\nfrom pack import left as l2\ndef f():\n    pack.own()\ndef g():\n    pack.go()\ndef h():\n    l2()\ndef i():\n    pack.run()\ndef j():\n    pack.told()\ndef k():\n    pack.unknown()\n"


def signatures(check):
    out = {}
    for r in check.signatures.collect():
        out.setdefault(r.fn_id.split(".")[-1], set()).add(r.effect)
    return out


def test_lookup_in_sources(spark):
    library = Library(spark.createDataFrame(LIB, "module string, path string, text string"))
    main = spark.createDataFrame([("main.py", MAIN)], "path string, text string")
    got = signatures(Check(main, library=library))
    assert got == {"f": {"KeyError"}, "g": {"pack.inner.Bad"}, "h": {"OSError"}, "i": {"ValueError"}, "j": {NATIVE}}
    assert "j" not in signatures(Check(main, library=library, options=Options(warn_native=False)))


def test_fact_cache(spark, tmp_path):
    cache = FactCache(spark, str(tmp_path / "facts"))
    one = spark.createDataFrame([("a.py", "def f():\n    raise A()\n"), ("b.py", "x = 1\n")], "path string, text string")
    assert cache.stats().first().files == 0
    first = cache.facts(one).count()
    before = cache.entries().count()
    assert cache.facts(one).count() == first and cache.entries().count() == before  # nothing parsed again
    changed = spark.createDataFrame([("a.py", "def f():\n    raise A()\ndef g(): f()\n"), ("b.py", "x = 1\n")], "path string, text string")
    assert signatures(Check(changed, cache=cache)) == signatures(Check(changed)) != signatures(Check(one))
    assert cache.entries().count() > before
    cache.prune(spark.createDataFrame([("a.py",)], "path string"))
    assert cache.stats().first().files == 1
    cache.invalidate(spark.createDataFrame([("a.py",)], "path string"))
    assert cache.stats().first().files == 0
    cache.clear()
    assert cache.entries() is None
    old = FactCache(spark, str(tmp_path / "old"), ttl_hours=0)
    old.facts(one)
    assert old.stats().first().stale == 2


def test_cache_keeps_the_newest_and_drops_dependents(spark, tmp_path):
    cache = FactCache(spark, str(tmp_path / "facts"), most=2)
    for name in "abcd":
        cache.facts(spark.createDataFrame([(f"{name}.py", "x = 1\n")], "path string, text string"))
    cache.prune()
    assert {r.file_id for r in cache.entries().select("file_id").distinct().collect()} == {"c.py", "d.py"}
    wide = FactCache(spark, str(tmp_path / "facts"))
    wide.facts(spark.createDataFrame([(f"{n}.py", "x = 1\n") for n in "ab"], "path string, text string"))
    edges = spark.createDataFrame([("a.py", "b.py"), ("b.py", "c.py")], "a string, b string")  # a imports b imports c
    wide.invalidate(spark.createDataFrame([("c.py",)], "path string"), edges)
    assert {r.file_id for r in wide.entries().select("file_id").distinct().collect()} == {"d.py"}


def test_package_cache(spark, tmp_path):
    kept = PackageCache(spark, str(tmp_path))
    one = spark.createDataFrame([("p/a.py", "def f(): raise A()\n")], "path string, text string")
    first = kept.facts("p", "1.0", one)
    assert kept.facts("p", "1.0", one.limit(0)).count() == first.count() > 0  # sources aren't read again
    assert kept.facts("p", "2.0", one.limit(0)).count() == 0
    assert set(first.columns) == set(kept.facts("p", "1.0", one).columns)

import random

import duckdb
import pytest

import __spark_entry__ as entry
from effectflow.functions import names, text
from effectflow.operators import closure, effects, merge, native, rank, resolve
from effectflow.plans import catalogue
from effectflow.plans import stubs as writers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, db, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    said = db.execute(catalogue.SQL[name])
    order = [d[0] for d in said.description]
    assert sorted(order) == columns
    flat = lambda rows, at: sorted(tuple(str(r[k]) for k in at) for r in rows)
    assert flat(found.collect(), columns) == flat(said.fetchall(), [order.index(c) for c in columns])


def test_entry(spark):
    assert entry.entry(spark).columns == ["s_suppkey", "effects"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 12
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(18)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    for parts in (1, 5):
        table = spark.createDataFrame(sorted(edges), "a long, b long").repartition(parts)
        assert {tuple(r) for r in closure.reachability(table).collect()} == want


def test_hierarchy(spark):
    """Each pair once at its least depth, whatever the paths; cycles end at the fixpoint."""
    rng = random.Random(4)
    chain = [(k, k - 1) for k in range(1, 21)] + [(100, 7), (100, 3)]
    ring = [(k, (k + 1) % 9) for k in range(9)]
    some = [(rng.randrange(14), rng.randrange(14)) for _ in range(25)]
    for edges in (chain, ring, some, chain + [(0, 20)], [(1, 1)], []):
        nodes = {x for e in edges for x in e}
        want = {(k, k): 0 for k in nodes}
        while more := {(a, c): want[(b, c)] + 1 for a, b in edges for b2, c in list(want) if b2 == b and want[(b, c)] + 1 < want.get((a, c), 99)}:
            want |= more
        table = spark.createDataFrame([*edges, (None, 5), (5, None)], "child long, parent long")
        assert {(r.node, r.ancestor): r.depth for r in closure.hierarchy(table).collect()} == want


def test_long_chains(spark):
    """Far more rounds than any bound on them would allow: chains are shortcut, and without a filter or with one, nothing is lost."""
    n = 1500
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    seeds = spark.createDataFrame([(n, 7)], "a long, b long")
    assert closure.propagate(edges, seeds).count() == n + 1
    few = spark.createDataFrame([(k, k + 1) for k in range(25)], "a long, b long")
    assert closure.propagate(few, spark.createDataFrame([(25, 7)], "a long, b long"), keep=lambda df: df.where("a <> 3")).count() == 22
    hub = spark.createDataFrame([(k, 0) for k in range(1, 200)] + [(0, k) for k in range(200, 400)] + [(399, 400)], "a long, b long")
    assert closure.propagate(hub, spark.createDataFrame([(400, 1)], "a long, b long")).count() == 202


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 2, "w"), (None, 3, "n")], "k string, u int, v string")
    got = {r.id: r.v for r in rank.asof_backward(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: "y", 2: None, 3: None, 4: "n"}


def test_resolution_edges(spark):
    calls = spark.createDataFrame([("f",), ("C.f",), ("self.f",), (None,)], "name string")
    fn = spark.createDataFrame([("m.f", 2), ("m.C.f", 1), ("m.g", 0)], "qualname string, ordinal int")
    assert {r.name: r.qualname for r in resolve.suffix_first(calls, "name", fn, "qualname", "ordinal").collect()} == {"f": "m.C.f", "C.f": "m.C.f"}
    dim = spark.createDataFrame([("a",), ("a.b",)], "p string")
    asked = spark.createDataFrame([("a.b.c",), ("a.b",), ("x",)], "name string")
    assert {r.name: r.p for r in resolve.longest_prefix(asked, "name", dim, "p").collect()} == {"a.b.c": "a.b", "a.b": "a.b"}
    assert {r.name: r.p for r in resolve.longest_prefix(asked, "name", dim, "p", strict=True).collect()} == {"a.b.c": "a.b", "a.b": "a"}


def test_range_pick_against_all_pairs(spark):
    rng = random.Random(6)
    wide = lambda: rng.choice([rng.randrange(-50, 50), rng.randrange(-(1 << 40), 1 << 40), 0, 1 << 60])
    rules = [(k, *sorted((wide(), wide())), rng.randrange(5)) for k in range(120)] + [(900, 5, 5, 9), (901, 9, 2, 9), (902, None, 5, 9)]
    values = [(k, wide()) for k in range(200)] + [(999, None)]
    got = resolve.range_pick(spark.createDataFrame(values, "id long, v long"), "v", spark.createDataFrame(rules, "rule long, lo long, hi long, score int"), "lo", "hi", [F.desc("score"), "rule"], ["id"])
    want = {}
    for k, v in values:
        fits = [(-s, r) for r, a, b, s in rules if v is not None and a is not None and a <= v < b]
        if fits:
            want[k] = min(fits)[1]
    assert {r.id: r.rule for r in got.collect()} == want and len(want) > 50
    none = resolve.range_pick(spark.createDataFrame(values, "id long, v long"), "v", spark.createDataFrame([], "rule long, lo long, hi long, score int"), "lo", "hi", ["score"], ["id"])
    assert none.count() == 0


def test_names(spark):
    t = spark.createDataFrame([("ValueError", "p.m"), ("Own", "p.m"), ("decoder.Bad", "p.m"), ("Cls.Bad", "p.m"), ("_x.Bad", "p.m"), ("Own", None)], "e string, m string")
    assert [r[0] for r in t.select(names.qualify(F.col("e"), F.col("m"))).collect()] == ["ValueError", "p.m.Own", "p.Bad", "Cls.Bad", "_x.Bad", "Own"]
    p = spark.createDataFrame([("src/a/b.py",), ("a/a.py",), ("x.py",), ("./y/z.py",)], "p string")
    assert [r[0] for r in p.select(names.module_of_path(F.col("p"))).collect()] == ["a.b", "a", "x", "y.z"]
    assert p.select(names.module_of_path(F.col("p"), full=True)).collect()[1][0] == "a.a"
    u = spark.createDataFrame([("file:///a%20b/c+d.py", "Python-3.12.12.tar.xz", 'a"b\\\n')], "u string, v string, s string")
    assert tuple(u.select(text.uri_to_path(F.col("u")), text.version_specifier(F.col("v")), text.toml_string(F.col("s"))).first()) == ("/a b/c+d.py", ">=3.12,<3.13", 'a\\"b\\\\\\n')


def test_merge_and_writers(spark):
    kind = "qualname string, exc string, confidence string, notes string"
    a = spark.createDataFrame([("m.f", "A", "likely", "n1"), ("m.g", "B", "exact", "")], kind)
    b = spark.createDataFrame([("m.f", "C", "conservative", "n2"), ("m.g", "B", "likely", "")], kind)
    got = {r.qualname: (r.exc, r.confidence, r.notes) for r in writers.merged(a, b).collect()}
    assert got == {"m.f": ("A,C", "conservative", "n1; n2"), "m.g": ("B", "exact", "")}
    raw = spark.createDataFrame([(1, "m.f", "A", "exact"), (2, "m.f", "A", "likely"), (3, "m.f", "B", "likely"), (4, "m.C.g", "E", "exact"), (5, "_testx.f", "E", "exact"), (6, "n.h", "Q", "conservative")], "ord int, qualname string, exc string, confidence string")
    import json

    said = json.loads(writers.write_json(writers.flat(raw), "n", ">=3", "2020-01-01T00:00:00Z").first().value)
    assert {k: v for k, v in said.items() if k != "metadata"} == {"m": {"f": ["A", "B"], "C": {"g": {"E": "exact"}}}, "n": {"h": {"Q": "conservative"}}}
    assert writers.counted(writers.flat(raw)).first().stubs == 4
    import tomllib

    lines = "\n".join(r.value for r in writers.write_toml(a.unionByName(b)).collect())
    assert tomllib.loads(lines)["m.f"] == {"raises": ["A", "C"], "confidence": "conservative", "notes": "n1"}
    assert {r.module for r in writers.with_twins(spark.createDataFrame([("_pyio", 1), ("x", 2)], "module string, v int")).collect()} == {"_pyio", "_io", "x"}
    conf = spark.createDataFrame([("k", "exact"), ("k", "likely"), ("k", None)], "k string, c string")
    assert merge.highest(conf, ["k"], "c").first().c == "exact"


def test_handlers(spark):
    pairs = spark.createDataFrame([(1, "KeyError"), (2, "KeyError"), (3, "KeyError"), (4, "Own")], "site int, effect string")
    handlers = spark.createDataFrame([(1, "LookupError"), (2, None), (3, "OSError"), (4, "Exception")], "site int, handler string")
    known = spark.createDataFrame([("KeyError", "KeyError"), ("KeyError", "LookupError")], "effect string, ancestor string")
    assert {r.site for r in effects.unhandled(pairs, handlers, ["site"], "effect", "handler", known).collect()} == {3, 4}


def test_native(spark):
    fn = spark.createDataFrame([("_m", "f", 60, True), ("_m", "f_impl", 80, True), ("_m", "g", 200, True), ("_m", "h", 300, False)], "module string, name string, line int, returns_pointer boolean")
    call = spark.createDataFrame([("_m", "f_impl", "PyErr_SetString", 81, "PyExc_ValueError"), ("_m", "g", "PyArg_ParseTuple", 201, None), ("_m", "g", "PyErr_SetFromErrnoWithFilename", 202, "PyExc_IOError"), ("_m", "h", "PyErr_Format", 301, "PyExc_IOError")], "module string, caller string, callee string, line int, first_arg string")
    site = spark.createDataFrame([("_m", "f", "f_impl", 61, "plain"), ("_m", "h", "g", 302, "plain"), ("_m", "g", "PyObject_CallNoArgs", 205, "plain"), ("_m", "f", "PyObject_CallNoArgs", 62, "plain")], "module string, caller string, callee string, line int, kind string")
    goto = spark.createDataFrame([("_m", "h", 305, "on_error"), ("_m", "h", 306, "next")], "module string, caller string, line int, label string")
    clear = spark.createDataFrame([("_m", "g", 210, "PyErr_Clear")], "module string, caller string, line int, label string")
    export = spark.createDataFrame([("_m", "f", "f"), ("_m", "go", "g"), ("_m", "h", "h"), ("_m", "lost", "none")], "module string, py_name string, c_name string")
    markers = spark.createDataFrame([("_m", 30)], "module string, line int")
    got = {r.py_name: (r.effects, r.confidence) for r in native.native_signatures(fn, call, native.propagating(site, goto, clear), export, native.marked(fn, markers)).collect()}
    assert got == {"f": (["Exception", "ValueError"], "exact"), "go": (["OSError", "TypeError"], "likely"), "h": (["OSError", "TypeError"], "exact")}
    unknown = spark.createDataFrame([("PyExc_ValueError",), ("PyExc_IOError",), ("PyExc_Mine",), ("&PyExc_KeyError",), ("x",), (None,)], "r string")
    assert [r[0] for r in unknown.select(native.error_name(F.col("r"))).collect()] == ["ValueError", "OSError", None, "KeyError", None, None]
    words = spark.createDataFrame([(n,) for n in ("FileIO_methods", "json_methods", "bufferedreader_methods", "PyList_Methods", "iter_methods", "table")], "n string")
    assert [r[0] for r in words.select(native.table_class(F.col("n"))).collect()] == ["FileIO", "", "Bufferedreader", "List", "", ""]
    text_ = "/*[clinic input]\n@classmethod\n_m.Reader.__new__ as reader_new\n  x: int\n[clinic start generated code]*/\n/*[clinic input]\n_m.Other.__init__\n[clinic start generated code]*/"
    assert {(r.type, r.c_name) for r in native.constructors(spark.createDataFrame([("_m", text_)], "module string, text string")).collect()} == {("Reader", "reader_new"), ("Other", "Other___init__")}


def test_first_constructor_by_path_and_place(spark):
    block = lambda *lines: "/*[clinic input]\n" + "\n".join(lines) + "\n[clinic start generated code]*/\n"
    rows = [("m", "b.c", block("T.__new__ as late")), ("m", "a.c", block("x", "T.__init__ as second") + block("U.__new__")), ("m", "a.c", "")]
    rows += [("m", "A.c", block("V.__init__ as v2", "V.__new__ as v3"))]
    for order in (rows, rows[::-1]):
        got = native.constructors(spark.createDataFrame(order, "module string, path string, text string").repartition(3)).collect()
        assert sorted((r.type, r.c_name) for r in got) == [("T", "second"), ("U", "U___new__"), ("V", "v2")]


def test_operators_have_callers():
    """Each operator is called by the engine, not by the catalogue alone."""
    import ast
    from pathlib import Path

    import effectflow

    root = Path(effectflow.__file__).parent
    defined, used = {}, set()
    for path in root.rglob("*.py"):
        if "llm" in path.parts:
            continue
        tree = ast.parse(path.read_text())
        if path.parent.name == "operators":
            defined |= {n.name: path.name for n in tree.body if isinstance(n, ast.FunctionDef) and not n.name.startswith("_")}
        if path.name not in ("catalogue.py", "code_base.py"):
            own = {id(n) for f in tree.body if isinstance(f, ast.FunctionDef) for n in ast.walk(f) if isinstance(n, (ast.Name, ast.Attribute)) and getattr(n, "id", getattr(n, "attr", "")) == f.name}
            used |= {getattr(n, "id", getattr(n, "attr", "")) for n in ast.walk(tree) if isinstance(n, (ast.Name, ast.Attribute)) and id(n) not in own}
    # entry points of the library itself: nothing inside needs to call these
    entries = {"native_signatures", "marked", "propagating", "constructors", "table_class", "native_exports"}
    assert sorted(set(defined) - used - entries) == []


def test_library_signatures(spark):
    fn = spark.createDataFrame([("m", "m.f", "f"), ("m", "m.C.__init__", "C.__init__"), ("m", "m.C.run", "C.run"), ("m", "m.D.run", "D.run"), ("m", "m.C.go", "C.go"), ("m", "m.opens", "opens")], "module string, qualname string, member string")
    raised = spark.createDataFrame([("m.C.__init__", "ValueError"), ("m.D.run", "KeyError")], "qualname string, effect string")
    call = spark.createDataFrame([("m", "m.f", "C"), ("m", "m.C.go", "self.run"), ("m", "m.opens", "os.close"), ("m", "m.C.run", "f")], "module string, qualname string, name string")
    got = {}
    for r in native.library_signatures(fn, raised, call, native.syscalls(spark)).collect():
        got.setdefault(r.qualname, set()).add(r.effect)
    assert got["m.f"] == {"ValueError"} and got["m.C.go"] == {"ValueError", "KeyError"} and got["m.opens"] == {"OSError"}


def test_every_page_is_a_call(spark, tmp_path):
    hosts = ["a.b.c", "x.b.c", "b.c", "q.c", "lone", "z.lone", "y.xb.c"]
    spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    want = set()
    for k, h in enumerate(hosts):
        tail = h.split(".", 1)[-1]
        first = min(j for j, d in enumerate(hosts) if d == tail or d.endswith("." + tail))
        want.add((k, tail, hosts[first], first))
    assert {tuple(r) for r in catalogue.QUERIES["suffix_match_every"](spark, str(tmp_path)).collect()} == want


def test_every_supplier_has_its_effect(spark):
    s = {r.s_suppkey: r for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    nation = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    has = {k: {nation[r.s_nationkey]} for k, r in s.items()}
    edges = [(k, (7 * k + 3) % len(s)) for k, r in s.items() if r.s_acctbal > 0]
    for _ in s:
        for a, b in edges:
            has[a] |= has.get(b, set())
    assert {r.s_suppkey: set(r.effects.split(",")) for r in entry.entry(spark).collect()} == has


def test_changes_and_merges_over_whole_tables(spark):
    sf = "/root/testdata/sf0.01"  # no supplier owes at sf0.001
    s = spark.read.parquet(f"{sf}/supplier.parquet").collect()
    owing = {r.s_suppkey for r in s if r.s_acctbal < 0}
    causes = {k: {k} for k in owing}
    for _ in s:
        for r in s:
            if r.s_acctbal > 0 and (got := causes.get((7 * r.s_suppkey + 3) % len(s))):
                causes[r.s_suppkey] = causes.get(r.s_suppkey, set()) | got
    assert owing and {r.node: r.n_causes for r in catalogue.QUERIES["affected_by_debt"](spark, sf).collect()} == {k: len(v) for k, v in causes.items()}
    sets = {}
    for r in spark.read.parquet(f"{sf}/customer.parquet").collect():
        sets.setdefault(r.c_nationkey, set()).add(r.c_mktsegment)
    for r in s:
        sets.setdefault(r.s_nationkey, set()).add("PAID" if r.s_acctbal > 0 else "OWED")
    assert {r.k: set(r.e.split(",")) for r in catalogue.QUERIES["merge_whole_sources"](spark, sf).collect()} == sets


def test_native_vague_effects(spark):
    fn = spark.createDataFrame([("_m", "f", 10, False), ("_m", "f_impl", 20, True), ("_m", "g", 30, True), ("_m", "g_impl", 40, False), ("_m", "r", 50, False), ("_m", "s", 60, False), ("_m", "t", 70, False)], "module string, name string, line int, returns_pointer boolean")
    kept = ("PyErr_Restore", "PyErr_SetRaisedException", "_PyErr_SetRaisedException")
    call = spark.createDataFrame([("_m", "g_impl", "PyErr_SetString", 41, "PyExc_ValueError"), *[("_m", c, k, 51, "x") for c, k in zip("rst", kept)]], "module string, caller string, callee string, line int, first_arg string")
    site = spark.createDataFrame([("_m", "f", "f_impl", 11, "plain"), ("_m", "g", "g_impl", 31, "plain")], "module string, caller string, callee string, line int, kind string")
    none = spark.createDataFrame([], "module string, caller string, line int, label string")
    export = spark.createDataFrame([("_m", n, n) for n in "fgrst"], "module string, py_name string, c_name string")
    marks = native.marked(fn, spark.createDataFrame([], "module string, line int"))
    got = {r.py_name: r.effects for r in native.native_signatures(fn, call, native.propagating(site, none, none), export, marks).collect()}
    assert got == {"f": ["Exception"], "g": ["Exception", "ValueError"], "r": ["Exception"], "s": ["Exception"], "t": ["Exception"]}

"""The engine itself over a code base that is generated from ``supplier`` and ``nation``: one Python file a supplier.

Each query runs what a check runs (parsing, views of facts, edges, signatures, findings, stubs, the fact cache); its SQL says
what must come out, from the tables alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.functions import names
from effectflow.operators import detect, merge
from effectflow.plans import stubs as writers
from effectflow.plans.check import Check, Options, report_text
from effectflow.plans.library import Library, native_stubs, stubs_of
from effectflow.plans.registry import query
from effectflow.runtime import constant, cut, shared_dir, spread, table
from effectflow.sources import facts, patterns, stubs
from effectflow.sources import files as file_source
from effectflow.sources.cache import FactCache

#: A module: {k} the supplier, {t} another one, {n} its nation, {doc} a docstring, {mark} a comment, {end} further lines.
_MODULE = '''import s{t}
from contextlib import suppress
from errors import {n} as Own

class Local(Own, ValueError):
    pass

def first(x):
    """{doc}"""
    if x:
        raise Own(x)
    raise Local("bad")

def guarded(xs):
    try:
        first(1)
    except (KeyError, OSError):
        raise
    except:
        pass
    with suppress(Local):
        first(2)
    return sorted(xs, key=first)

async def opened(x):
    """{doc}"""
    await first(3){mark}
    s{t}.opened(4)
    raise
{end}'''

_BASE_SQL = """base AS (
  SELECT s_suppkey AS k, (7 * s_suppkey + 3) % (SELECT count(*) FROM supplier) AS t, 'errors.' || n_name AS effect, 's' || s_suppkey || '.py' AS file_id, s_acctbal AS b,
    s_acctbal > 5000 AS told, s_acctbal < 0 AS bare, s_acctbal >= 0 AND s_acctbal < 3000 AS ignored, s_acctbal > 9000 AS broken
  FROM supplier JOIN nation ON n_nationkey = s_nationkey), good AS (SELECT * FROM base WHERE NOT broken)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text) of all suppliers' modules."""
    s = table(spark, sf, "supplier")
    n = s.agg(F.count("*").alias("n"))
    dealt = spread(s, s.count(), "s_suppkey")
    rows = dealt.join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(n))
    values = {
        "k": F.col("s_suppkey").cast("string"),
        "t": ((F.col("s_suppkey") * 7 + 3) % F.col("n")).cast("string"),
        "n": F.col("n_name"),
        "doc": F.when(F.col("s_acctbal") > 5000, "Raises Local.").otherwise("Plain."),
        "mark": F.when(F.col("s_acctbal") < 0, "  # EF : ignore").when(F.col("s_acctbal") < 3000, "  # ef: ignore[ Local, Other ]").otherwise(""),
        "end": F.when(F.col("s_acctbal") > 9000, "def broken(:\n").otherwise(""),
    }
    text = F.lit(_MODULE)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return rows.select(F.concat(F.lit("s"), values["k"], F.lit(".py")).alias("path"), text.alias("text"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.extract(sources(spark, sf))


@query(f"""WITH {_BASE_SQL} SELECT file_id, 's' || k || '.' || name AS qualname, CAST(line AS INTEGER) AS line, is_async, CASE WHEN doc THEN CASE WHEN told THEN 'Raises Local.' ELSE 'Plain.' END END AS docstring
  FROM good, (VALUES ('<module>', 1, false, false), ('first', 8, false, true), ('guarded', 14, false, false), ('opened', 25, true, true)) f(name, line, is_async, doc)""")
def source_functions(spark, sf):
    """Definitions with their qualified names, docstrings and places."""
    return facts.functions(_facts(spark, sf)).select("file_id", "qualname", "line", "is_async", "docstring")


@query(f"""WITH {_BASE_SQL} SELECT file_id, CASE exc WHEN 'own' THEN effect ELSE exc END AS exc_type, CAST(line AS INTEGER) AS line, message, again AS is_re_raise, CAST(n AS INTEGER) AS n_tries
  FROM good, (VALUES ('own', 11, NULL, false, 0), ('Local', 12, 'bad', false, 0), ('', 18, NULL, true, 0), ('', 29, NULL, true, 0)) r(exc, line, message, again, n)""")
def source_raises(spark, sf):
    """Raise statements: types through the imports, messages, raises of what was caught."""
    return facts.raises(_facts(spark, sf)).select("file_id", "exc_type", "line", "message", "is_re_raise", F.size("tries").alias("n_tries"))


@query(f"""WITH {_BASE_SQL} SELECT file_id, replace(name, 'peer', 's' || t) AS func_name, CAST(line AS INTEGER) AS line, CAST(line AS INTEGER) AS end_line, is_async, args, CAST(tries AS INTEGER) AS n_tries, CAST(sups AS INTEGER) AS n_sups
  FROM good, (VALUES ('Own', 11, false, 'x', 0, 0), ('Local', 12, false, '', 0, 0), ('first', 16, false, '', 1, 0), ('first', 22, false, '', 0, 1), ('sorted', 23, false, 'xs,first', 0, 0),
  ('first', 27, true, '', 0, 0), ('peer.opened', 28, false, '', 0, 0)) c(name, line, is_async, args, tries, sups)""")
def source_calls(spark, sf):
    """Calls with their callable arguments, awaits, and the blocks around them."""
    found = facts.calls(_facts(spark, sf))
    return found.select(
        "file_id", "func_name", "line", "end_line", "is_async", F.array_join("callable_args", ",").alias("args"),
        F.size("tries").alias("n_tries"), F.size("sups").alias("n_sups"),
    )


@query(f"""WITH {_BASE_SQL} SELECT file_id, 'try' AS kind, 15 AS line, 'KeyError,OSError' AS types, true AS has_bare, true AS reraises FROM good
  UNION ALL SELECT file_id, 'suppress', 21, 'Local', NULL, NULL FROM good""")
def source_handlers(spark, sf):
    """Try blocks and suppressing contexts."""
    found = _facts(spark, sf)
    tries = facts.try_blocks(found).select(
        "file_id", F.lit("try").alias("kind"), "line", F.array_join("handled_types", ";").alias("types"), "has_bare", "reraises",
    )
    none = F.lit(None).cast("boolean")
    held = facts.suppress_blocks(found).select(
        "file_id", F.lit("suppress").alias("kind"), "line", F.array_join("types", ";").alias("types"), none.alias("has_bare"),
        none.alias("reraises"),
    )
    return tries.unionByName(held)


@query(f"""WITH {_BASE_SQL} SELECT file_id, 's' || t AS alias, 's' || t AS target FROM good UNION ALL SELECT file_id, 'suppress', 'contextlib.suppress' FROM good UNION ALL SELECT file_id, 'Own', effect FROM good""")
def source_imports(spark, sf):
    """The import map of each file."""
    return facts.imports(_facts(spark, sf))


@query(f"WITH {_BASE_SQL} SELECT file_id, 's' || k || '.Local' AS qualname, effect || ',ValueError' AS bases FROM good")
def source_classes(spark, sf):
    """Classes and their bases, through the imports."""
    return facts.classes(_facts(spark, sf)).select("file_id", "qualname", F.array_join("bases", ",").alias("bases"))


@query(f"""WITH {_BASE_SQL} SELECT file_id, 27 AS line, ignored AS valid, CASE WHEN ignored THEN 'Local,Other' END AS types, 'await first(3)  # ' || CASE WHEN ignored THEN 'ef: ignore[ Local, Other ]' ELSE 'EF : ignore' END AS raw
  FROM base WHERE ignored OR bare""")
def source_directives(spark, sf):
    """Suppression comments with and without a list."""
    return facts.directives(sources(spark, sf), Options().tags).select(
        "file_id", "line", "valid", F.array_join("exc_types", ",").alias("types"), "raw",
    )


@query(f"WITH {_BASE_SQL} SELECT file_id, 30 AS line FROM base WHERE broken")
def source_errors(spark, sf):
    """Files that can't be parsed, and where."""
    return facts.errors(_facts(spark, sf)).select("file_id", "line")


@query(f"""WITH {_BASE_SQL} SELECT file_id || '#s' || k || '.' || fn AS caller, replace(name, 'peer', 's' || t) AS name
  FROM good, (VALUES ('first', 'Own'), ('first', 'Local'), ('guarded', 'first'), ('guarded', 'first'), ('guarded', 'first'), ('guarded', 'sorted'), ('guarded', 'xs'), ('opened', 'first'), ('opened', 'peer.opened')) c(fn, name)""")
def check_edges(spark, sf):
    """Callers and what they call, callables handed to higher-order calls included."""
    return Check(sources(spark, sf)).edges.select(F.col("a").alias("caller"), "name")


_CLOSED_SQL = """own(k, effect) AS (SELECT k, effect FROM good UNION ALL SELECT k, 'Local' FROM good),
  opened(k, effect) AS (SELECT * FROM own UNION SELECT g.k, o.effect FROM opened o JOIN good g ON g.t = o.k)"""


@query(f"""WITH RECURSIVE {_BASE_SQL}, {_CLOSED_SQL}
  SELECT 's' || k || '.py#s' || k || '.' || fn AS fn_id, effect FROM own, (VALUES ('first'), ('guarded')) f(fn) UNION ALL SELECT 's' || k || '.py#s' || k || '.opened', effect FROM opened""")
def check_signatures(spark, sf):
    """Whatever may escape each function: a fixpoint over calls of other files, cycles among them."""
    return Check(sources(spark, sf)).signatures


_FOUND_SQL = f"""{_CLOSED_SQL}, found(k, line, fn, effect) AS (
    SELECT k, 16, 'first', effect FROM own UNION ALL SELECT k, 22, 'first', effect FROM own WHERE effect <> 'Local'
    UNION ALL SELECT own.k, 27, 'first', own.effect FROM own JOIN good USING (k) WHERE NOT ignored AND NOT (told AND own.effect = 'Local')
    UNION ALL SELECT g.k, 28, 's' || g.t || '.opened', o.effect FROM good g JOIN opened o ON o.k = g.t WHERE NOT (told AND o.effect = 'Local')
  ), findings AS (
    SELECT 's' || k || '.py' AS file_id, line, 'error' AS severity, 'call to ''' || fn || ''' may raise unhandled exception(s): ' || string_agg(effect, ', ' ORDER BY effect) AS message FROM found GROUP BY k, line, fn
    UNION ALL SELECT file_id, 27, 'warning', 'invalid ignore comment: must include exception types in brackets (e.g., # effectflow: ignore[ValueError])' FROM good WHERE bare
    UNION ALL SELECT file_id, 1, 'error', 'failed to analyse file' FROM base WHERE broken)"""


@query(f"WITH RECURSIVE {_BASE_SQL}, {_FOUND_SQL} SELECT * FROM findings")
def check_diagnostics(spark, sf):
    """The whole check: unhandled calls, minus what is handled, documented or ignored, invalid comments, unread files."""
    found = Check(sources(spark, sf)).diagnostics
    return found.select("file_id", "line", "severity", F.regexp_replace("message", "^(failed to analyse file).*", "$1").alias("message"))


@query(f"""WITH RECURSIVE {_BASE_SQL}, {_FOUND_SQL}
  SELECT (SELECT count(*) FROM base) AS files, (SELECT 4 * count(*) FROM good) AS functions, (SELECT 4 * count(*) FROM good) AS exceptions, (SELECT count(*) FROM findings) AS issues""")
def check_summary(spark, sf):
    """Totals of a check."""
    return Check(sources(spark, sf)).summary


@query(f"""WITH RECURSIVE {_BASE_SQL}, {_FOUND_SQL}
  SELECT file_id || ':' || line || ':' || CASE line WHEN 1 THEN 0 WHEN 16 THEN 8 WHEN 22 THEN 8 ELSE CASE severity WHEN 'error' THEN 4 ELSE 0 END END || ': ' || severity || ': ' || message AS value FROM findings""")
def report_lines(spark, sf):
    """The text report of a check."""
    found = report_text(Check(sources(spark, sf)).diagnostics)
    return found.select(F.regexp_replace("value", "(failed to analyse file).*", "$1").alias("value"))


@query(f"""WITH RECURSIVE {_BASE_SQL}, {_CLOSED_SQL}, shown(k, line, fn, effect) AS (
    SELECT k, 14, 'guarded', effect FROM own UNION ALL SELECT o.k, 25, 'opened', o.effect FROM opened o JOIN good g USING (k) WHERE NOT (g.told AND o.effect = 'Local'))
  SELECT 's' || k || '.py' AS file_id, line, 'function ''' || fn || ''' may raise undocumented exceptions: ' || string_agg(effect, ', ' ORDER BY effect) AS message FROM shown GROUP BY k, line, fn""")
def strict_findings(spark, sf):
    """Functions that let effects escape which their docstrings don't name."""
    found = Check(sources(spark, sf), options=Options(strict=True)).diagnostics
    return found.where("message LIKE 'function %'").select("file_id", "line", "message")


@query(f"""WITH RECURSIVE {_BASE_SQL}, own(k, effect) AS (SELECT k, 's' || k || substr(effect, 7) FROM good UNION ALL SELECT k, 's' || k || '.Local' FROM good),
  opened(k, effect) AS (SELECT * FROM own UNION SELECT g.k, o.effect FROM opened o JOIN good g ON g.t = o.k)
  SELECT 's' || k || '.py#s' || k || '.' || fn AS fn_id, effect FROM own, (VALUES ('first'), ('guarded')) f(fn) UNION ALL SELECT 's' || k || '.py#s' || k || '.opened', effect FROM opened""")
def sound_signatures(spark, sf):
    """Signatures where handlers inside callees count and own classes have their module."""
    return Check(sources(spark, sf), options=Options(mode="sound", root="")).signatures


@query(f"""WITH {_BASE_SQL} SELECT 's' || k AS module, member, 's' || k || x AS effect FROM (SELECT k, substr(effect, 7) AS x FROM good UNION ALL SELECT k, '.Local' FROM good), (VALUES ('first'), ('guarded')) m(member)""")
def library_lookup(spark, sf):
    """Names of a library to the effects of its sources."""
    files = sources(spark, sf).withColumn("module", F.regexp_replace("path", "[.]py$", ""))
    asked = files.select("module", F.explode(F.array(*[F.lit(x) for x in ("first", "guarded", "missing")])).alias("member"))
    return Library(files).lookup(asked)


@query(f"""WITH {_BASE_SQL} SELECT 's' || k AS module, '' AS cls, member, exc, 'exact' AS confidence FROM (SELECT k, 's' || k || substr(effect, 7) AS exc FROM good UNION ALL SELECT k, 's' || k || '.Local' FROM good), (VALUES ('first'), ('guarded'), ('opened')) m(member)""")
def library_stubs(spark, sf):
    """Signatures of library sources as stub rows: calls within the module, handlers not modelled."""
    return stubs_of(sources(spark, sf).withColumn("module", F.regexp_replace("path", "[.]py$", "")))


_NATIVE = """#include "Python.h"
static int
low(int x)
{
    PyErr_SetString(PyExc_{exc}, "{ not a brace");
    return -1;
}
static PyObject *
run(PyObject *self, PyObject *args)
{
    if (!PyArg_ParseTuple(args, "i", &x)) {
        return NULL;
    }
    {call}
    return Py_None;
}
static PyMethodDef m_methods[] = {
    {"go", (PyCFunction)run, METH_VARARGS},
    {NULL, NULL}
};
"""


@query("""SELECT 'm' || s_suppkey AS module, 'go' AS member, exc, 'likely' AS confidence FROM (
    SELECT s_suppkey, 'TypeError' AS exc FROM supplier UNION ALL
    SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'KeyError' ELSE 'ValueError' END FROM supplier WHERE s_acctbal < 5000)""")
def native_effects(spark, sf):
    """Effects of C sources: what a function sets, what it hands on where a failing result leaves it, exported names."""
    s = table(spark, sf, "supplier")
    text = F.replace(F.lit(_NATIVE), F.lit("{exc}"), F.when(F.col("s_acctbal") < 0, "KeyError").otherwise("ValueError"))
    text = F.replace(text, F.lit("{call}"), F.when(F.col("s_acctbal") < 5000, "if (low(x) < 0)\n        return NULL;").otherwise("low(x);"))
    module = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))
    files = s.select(module.alias("module"), F.concat(F.lit("Modules/"), module, F.lit("module.c")).alias("path"), text.alias("text"))
    return native_stubs(files).select("module", "member", "exc", "confidence")


@query("""SELECT n_name || '.' || c_mktsegment AS qualname, CASE WHEN owed THEN 'OWED' ELSE 'PAID' END AS exc, CASE WHEN bool_or(n_regionkey = 0) THEN 'likely' ELSE 'exact' END AS confidence FROM (
  SELECT n_name, n_regionkey, c_mktsegment, c_acctbal < 0 AS owed FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY n_name, c_mktsegment, owed""")
def toml_stubs(spark, sf):
    """Signatures written in the older format and read again; the weakest confidence of a name holds."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    weak = F.explode(F.when(F.col("n_regionkey") == 0, F.array(F.lit("exact"), F.lit("likely"))).otherwise(F.array(F.lit("exact"))))
    flat = rows.select(
        F.concat_ws(".", "n_name", "c_mktsegment").alias("qualname"),
        F.when(F.col("c_acctbal") < 0, "OWED").otherwise("PAID").alias("exc"), weak.alias("confidence"), F.lit("").alias("notes"),
    ).distinct()
    text = "\n".join(r.value for r in writers.write_toml(flat).collect())  # a stub file: names by nation and segment
    found = [(q, e, c) for q, e, c, _ in stubs.read_toml(text)]
    return constant(spark, found, "qualname string, exc string, confidence string")


@query(r"""SELECT page_id FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) WHERE regexp_matches(path, '(^|/)en/') OR regexp_matches(path, '(^|/)([^/]*[^1/])?1(/|$)')""")
def ignored_files(spark, sf):
    """Paths that ignore files leave out: folders, globs (which folders on the way may fit too), and what is taken back."""
    files = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    rules = file_source.ignore_rules(
        constant(spark, [(".gitignore", "# none\nen/\n*1\n!*11\n"), ("none/.gitignore", None)], "path string, text string")
    )
    hit = patterns.ignored_paths(files.select("path").distinct(), rules)
    return files.join(hit, "path", "left_semi").select("page_id")


@query("""SELECT n_name AS module, cls, member, exc, confidence, CAST(n_regionkey AS VARCHAR) AS source FROM nation,
  (VALUES ('', 'f', 'A', 'likely'), ('', 'f', 'B', 'likely'), ('', 'g', 'C', 'exact'), ('K', 'm', 'A', 'likely'), ('K', 'p', 'D', 'conservative')) s(cls, member, exc, confidence)""")
def stub_rows(spark, sf):
    """Nested stub texts of every shape to one relation."""
    n = table(spark, sf, "nation")
    body = F.concat(
        F.lit('{"metadata": {"version": ">=3"}, "'), "n_name",
        F.lit('": {"f": ["A", "B"], "g": {"C": "exact"}, "K": {"m": ["A"], "p": {"D": "conservative"}}}}'),
    )
    texts = n.select(F.col("n_regionkey").cast("string").alias("source"), F.lit(1).alias("priority"), body.alias("text"))
    return stubs.flatten(texts).select("module", "cls", "member", "exc", "confidence", "source")


_SPECS = [("any", ""), ("three", ">=3"), ("range", ">=3.10,<3.13"), ("exact", "==3.12.*"), ("near", "~=3.11"), ("old", "<3.12"), ("next", ">3.12")]


@query("""WITH chosen(r, spec) AS (VALUES (0, 'any'), (1, 'three'), (2, 'range'), (3, 'near'), (4, 'exact'))
  SELECT n_name AS module, spec AS exc FROM nation JOIN chosen ON r = n_regionkey""")
def stub_versions(spark, sf):
    """Each source's most specific specifier that holds a version; region r has the first r + 1 of these and two that don't hold."""
    order = {"any": 0, "three": 1, "range": 2, "near": 3, "exact": 4, "old": 0, "next": 0}
    specs = constant(spark, [(name, spec, order[name]) for name, spec in _SPECS], "exc string, version_spec string, least int")
    rows = table(spark, sf, "nation").join(specs, F.col("n_regionkey") >= F.col("least"))
    none = F.lit("f")
    table_ = rows.select(
        F.col("n_name").alias("source"), F.lit(1).alias("priority"), "version_spec", F.col("n_name").alias("module"),
        F.lit("").alias("cls"), none.alias("member"), F.lit(0).cast("long").alias("ord"), "exc",
        F.lit("exact").alias("confidence"),
    )
    return stubs.for_version(table_, "3.12").select("module", "exc")


@query("""SELECT n_name AS module, asked AS member, exc, confidence FROM nation, (VALUES ('f', 'A', 'likely'), ('g', 'C', 'exact'), ('K.m', 'D', 'likely'), ('X.m', 'D', 'likely')) s(asked, exc, confidence)
  WHERE NOT (asked = 'g' AND n_regionkey = 0)""")
def stub_lookup(spark, sf):
    """Names to stubs: exact in the module or its underscored twin, methods of any class, the highest source first."""
    n = table(spark, sf, "nation")
    have = constant(
        spark, [("low", 1, "", "f", "Z", "exact"), ("high", 9, "", "f", "A", "likely"), ("low", 1, "K", "m", "D", "likely")],
        "source string, priority int, cls string, member string, exc string, confidence string",
    )
    rows = n.join(F.broadcast(have)).select(
        "source", "priority", F.lit("").alias("version_spec"), F.col("n_name").alias("module"), "cls", "member",
        F.lit(0).cast("long").alias("ord"), "exc", "confidence",
    )
    twin = n.where("n_regionkey <> 0").select(
        F.lit("low").alias("source"), F.lit(1).alias("priority"), F.lit("").alias("version_spec"),
        F.concat(F.lit("_"), "n_name").alias("module"), F.lit("").alias("cls"), F.lit("g").alias("member"),
        F.lit(0).cast("long").alias("ord"), F.lit("C").alias("exc"), F.lit("exact").alias("confidence"),
    )
    asked = n.select(F.col("n_name").alias("module"), F.explode(F.array(*[F.lit(x) for x in ("f", "g", "K.m", "X.m", "none")])).alias("member"))
    return stubs.lookup(asked, rows.unionByName(twin)).select("module", "member", "exc", "confidence")


@query("""SELECT n_regionkey, n_name AS module, c_mktsegment AS member, string_agg(DISTINCT exc, ',' ORDER BY exc) AS exc FROM (
  SELECT n_regionkey, n_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'OWED' ELSE 'PAID' END AS exc FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY ALL""")
def stub_files(spark, sf):
    """Signatures written as a stub file a region and read again."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    flat = rows.select(
        "n_regionkey", F.col("n_name").alias("module"), F.lit("").alias("cls"), F.col("c_mktsegment").alias("member"),
        F.when(F.col("c_acctbal") < 0, "OWED").otherwise("PAID").alias("exc"), F.lit("likely").alias("confidence"),
    )
    flat = cut(flat.distinct())
    out = None
    for region in sorted(r[0] for r in flat.select("n_regionkey").distinct().collect()):
        text = writers.write_json(flat.where(F.col("n_regionkey") == region), f"r{region}", ">=3", "2020-01-01T00:00:00Z")
        read = stubs.flatten(text.select(F.lit("x").alias("source"), F.lit(1).alias("priority"), F.col("value").alias("text")))
        part = read.groupBy(F.lit(region).cast("int").alias("n_regionkey"), "module", "member").agg(merge.as_set("exc").alias("exc"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else flat.select("n_regionkey", "module", "member", "exc").limit(0)


@query(f"""WITH RECURSIVE {_BASE_SQL}, r(a, b) AS (SELECT k, t FROM good WHERE t IN (SELECT k FROM good) UNION SELECT r.a, g.t FROM r JOIN good g ON g.k = r.b WHERE g.t IN (SELECT k FROM good))
  SELECT k AS a, 'first' AS a_fn, k AS b, 'first' AS b_fn FROM good WHERE false UNION ALL SELECT k, 'guarded', k, 'first' FROM good UNION ALL SELECT k, 'opened', k, 'first' FROM good
  UNION ALL SELECT a, 'opened', b, 'opened' FROM r UNION ALL SELECT a, 'opened', b, 'first' FROM r WHERE a <> b""")
def check_reaches(spark, sf):
    """Every function that a function calls, directly or not."""
    part = lambda c, k: F.regexp_extract(c, r"#s(\d+)\.(\w+)$", k)
    found = Check(sources(spark, sf)).reaches
    return found.select(
        part("fn_id", 1).cast("long").alias("a"), part("fn_id", 2).alias("a_fn"), part("target", 1).cast("long").alias("b"),
        part("target", 2).alias("b_fn"),
    )


_MARKED = "CASE WHEN s_acctbal < 0 THEN 'poetry.lock,uv.lock,.venv/bin/python' WHEN s_acctbal < 3000 THEN 'uv.lock,.venv/bin/python' WHEN s_acctbal < 6000 THEN 'Pipfile.lock' ELSE '.venv/pyvenv.cfg,.venv/Scripts/python.exe' END"


@query("""SELECT s_name AS project, tool, '.venv' AS venv_path, CASE tool WHEN 'venv' THEN '.venv/Scripts/python.exe' ELSE '.venv/bin/python' END AS python_executable, true AS is_valid
  FROM (SELECT s_name, CASE WHEN s_acctbal < 0 THEN 'poetry' WHEN s_acctbal < 3000 THEN 'uv' WHEN s_acctbal >= 6000 THEN 'venv' END AS tool FROM supplier) WHERE tool IS NOT NULL""")
def first_environment(spark, sf):
    """The first detector of each project that answers with an environment."""
    files = table(spark, sf, "supplier").select(
        F.col("s_name").alias("project"), F.explode(F.split(F.expr(_MARKED), ",")).alias("rel_path"),
        F.lit(None).cast("string").alias("content"),
    )
    return detect.first_environment(detect.environments(files)).drop("priority")


@query(f"WITH {_BASE_SQL} SELECT file_id, CAST(CASE WHEN bare THEN 2 ELSE 1 END AS BIGINT) AS versions FROM base")
def cache_refreshed(spark, sf):
    """Facts kept by path and content: a second run over changed files parses and stores these alone."""
    cache = FactCache(spark, f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}")
    files = sources(spark, sf)
    cache.facts(files)
    cache.facts(
        files.withColumn("text", F.when(F.contains("text", F.lit("# EF : ignore")), F.concat("text", F.lit("\n# more\n"))).otherwise(F.col("text")))
    )
    return cache.entries().groupBy("file_id").agg(F.count_distinct("sha256").alias("versions"))


@query("""SELECT page_id, replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.py$', ''), '/', '.') AS module, regexp_extract(path, '([^/]*)$', 1) AS leaf FROM (
  SELECT page_id, 'src/' || replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', ''), '.', '_') || '.py' AS path FROM pages)""")
def module_names(spark, sf):
    """Paths to module names, from the folders that every URL names."""
    rest = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/$", "")
    path = F.concat(F.lit("src/"), F.replace(rest, F.lit("."), F.lit("_")), F.lit(".py"))
    return table(spark, sf, "pages").select(
        "page_id", names.module_of_path(path, full=True).alias("module"), F.element_at(F.split(path, "/"), -1).alias("leaf"),
    )

import json

from effectflow import cli
from effectflow.operators import native
from effectflow.plans import library
from effectflow.sources import c_facts

MODULE = r"""
/* a comment with f(x) and "quotes" */
#include "clinic/thing.c.h"
/*[clinic input]
thing.checked
[clinic start generated code]*/

static PyObject *
thing_checked_impl(PyObject *module, int x)
{
    PyObject *r = make(x);
    if (r == NULL) {
        return NULL;
    }
    if (low(x) < 0)
        return NULL;
    if (!other(x)) { PyErr_Clear(); return NULL; }
    return r;  // not called: gone(x)
}

static PyObject *
make(int x)
{
    if (x < 0) {
        PyErr_SetString(PyExc_ValueError, "if (a) { return NULL; }");
        return NULL;
    }
    return PyLong_FromLong(x);
}

static int
low(int x)
{
    switch (x) { case '{': break; }
    PyErr_Format(PyExc_OverflowError, "%d", x);
    return -1;
}

static int
other(int x)
{
    PyErr_SetNone(PyExc_KeyError);
    return 0;
}

static int
jumps(PyObject *self, PyObject *args)
{
    if (PyArg_ParseTuple(args, "i", &x) == 0)
        goto error;
    self->method(x);
    low(x);
    if (x)
        goto error;
    return 0;
error:
    return -1;
}

static PyObject *
Thing_run(PyObject *self, PyObject *none)
{
    return PyObject_CallNoArgs(self);
}

static PyObject *silent(PyObject *self) { Py_RETURN_NONE; }
static int quiet(void) { return 0; }

static PyMethodDef thing_methods[] = {
    THING_CHECKED_METHODDEF
    {"jumps", (PyCFunction)(void(*)(void))jumps, METH_VARARGS | METH_KEYWORDS, PyDoc_STR("x")},
    {"sil" "ent", _PyCFunction_CAST(silent), METH_NOARGS, NULL},
    {"quiet", &quiet, METH_NOARGS},
    {NULL, NULL, 0, NULL}
};
static PyMethodDef ThingType_methods[] = { {"run", Thing_run, METH_NOARGS}, {NULL, NULL} };
"""
HEADER = r"""/*[clinic input]
preserve
[clinic start generated code]*/

#define THING_CHECKED_METHODDEF    \
    {"checked", _PyCFunction_CAST(thing_checked), METH_O, thing_checked__doc__},

static PyObject *
thing_checked(PyObject *module, PyObject *arg)
{
    int x;
    if (x == -1 && PyErr_Occurred()) { goto exit; }
    return thing_checked_impl(module, x);
exit:
    return NULL;
}
"""


def test_tokens():
    rows = c_facts.read_source(MODULE)
    assert [(r["name"], r["flag"]) for r in rows if r["kind"] == "function"] == [("thing_checked_impl", True), ("make", True), ("low", False), ("other", False), ("jumps", False), ("Thing_run", True), ("silent", True), ("quiet", False)]
    uses = {(r["caller"], r["name"]): r["use"] for r in rows if r["kind"] == "call"}
    assert uses[("thing_checked_impl", "make")] == "assigned_checked" and uses[("thing_checked_impl", "low")] == "if_call"
    assert uses[("thing_checked_impl", "other")] == "plain"  # its branch clears the error
    assert uses[("jumps", "low")] == "plain" and not any(name in ("gone", "method", "f", "switch") for _, name in uses)
    assert [r["line"] for r in rows if r["kind"] == "marker"] == [6]
    assert [(r["caller"], r["name"], r["use"]) for r in rows if r["kind"] == "entry"] == [("thing_methods", None, "THING_CHECKED_METHODDEF"), ("thing_methods", "jumps", "jumps"), ("thing_methods", "silent", "silent"), ("thing_methods", "quiet", "quiet"), ("ThingType_methods", "run", "Thing_run")]
    assert [(r["name"], r["first_arg"], r["use"]) for r in c_facts.read_source(HEADER) if r["kind"] == "macro"] == [("checked", "THING_CHECKED_METHODDEF", "thing_checked")]
    assert {r["first_arg"] for r in rows if r.get("name") in ("PyErr_SetString", "PyErr_Format")} == {"PyExc_ValueError", "PyExc_OverflowError"}


def test_broken_sources_are_read_as_far_as_they_go():
    for text in ("", "}}}", "int f(", "static PyObject *f(void) { if (", "/* open", '"open', "#define", "PyMethodDef x[] =", "PyMethodDef x[] = {", "int f(void) { g(((; }", "a" * 100_000, "(" * 5000, "\x00\ud800ü"):
        c_facts.read_source(text)


def test_signatures_of_sources(spark):
    files = spark.createDataFrame([("thing", "Modules/thingmodule.c", MODULE), ("", "Modules/clinic/thing.c.h", HEADER), ("empty", "Modules/empty.c", None)], "module string, path string, text string")
    got = {}
    for r in library.native_stubs(files).collect():
        got.setdefault((r.cls, r.member), (r.confidence, set()))[1].add(r.exc)
    # a marker before it; a pointer is returned and no error set, so any may be
    assert got[("", "checked")] == ("exact", {"Exception", "ValueError", "OverflowError"})
    assert got[("", "jumps")] == ("exact", {"TypeError", "OverflowError"})  # within 50 lines of the marker too
    assert got[("ThingType", "run")] == ("conservative", {"Exception"})
    assert got[("", "silent")] == ("conservative", {"Exception"}) and ("", "quiet") not in got


def test_stub_file_of_a_source_tree(spark, tmp_path, capsys, monkeypatch):
    for path, text in {"Lib/pure.py": "def f():\n    raise KeyError()\n", "Lib/thing.py": "def own():\n    raise OSError()\n", "Modules/thingmodule.c": MODULE, "Modules/clinic/thing.c.h": HEADER, "Modules/_testx.c": MODULE}.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["stubs", "tree", "--python", ">=3.12,<3.13", "-o", "out.json"]) == 0
    said = json.loads((tmp_path / "out.json").read_text())
    assert said["pure"] == {"f": {"KeyError": "exact"}} and said["thing"]["own"] == {"OSError": "exact"}
    assert said["thing"]["checked"] == {"Exception": "exact", "OverflowError": "exact", "ValueError": "exact"} and "_testx" not in said
    assert said["metadata"]["version"] == ">=3.12,<3.13"


def test_kinds_are_those_of_the_operators():
    uses = {r["use"] for r in c_facts.read_source(MODULE + "int t(void) { if (low(1)) return -1; if (!low(1)) { return 0; } }") if r["kind"] == "call"}
    assert uses == {*native.PROPAGATING, "plain"}

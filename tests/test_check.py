import json

import pytest

from effectflow.plans.check import Check, Options, hover, report_json, report_text
from effectflow.sources import facts, stubs

MAIN = '''
import json
import contextlib
from contextlib import suppress
from helper import outer as imported

class Broken(ValueError):
    pass

def fails(x):
    if x:
        raise ValueError("bad")
    raise Broken()

def plain():
    fails(1)

def guarded():
    try:
        fails(1)
    except ValueError:
        pass

def guarded_all():
    try:
        fails(1)
    except:
        pass

def rethrows():
    try:
        fails(1)
    except:
        raise

def quiet():
    with suppress(ValueError, Broken):
        fails(2)

def told():
    """Does it. Raises ValueError and Broken."""
    fails(3)

def half_told():
    """Raises ValueError."""
    fails(3)

def marked():
    fails(4)  # ef: ignore[ValueError]

def reads(s):
    return json.loads(s)

def loops(n):
    return other(n)

def other(n):
    loops(n)
    raise KeyError(n)

def maps(xs):
    return list(map(fails, xs))

async def waits():
    await fails(1)

def safe():
    guarded()
'''

STUBS = json.dumps({"metadata": {"version": ">=3.10,<3.14"}, "json": {"loads": {"ValueError": "exact"}}, "_io": {"open": ["OSError"], "FileIO": {"read": ["OSError"]}}, "builtins": {"len": ["TypeError"]}})


@pytest.fixture(scope="module")
def stub_table(spark):
    return stubs.flatten(spark.createDataFrame([("stdlib", 50, STUBS)], "source string, priority int, text string")).cache()


def run(spark, stub_table, **options):
    files = spark.createDataFrame([("main.py", MAIN), ("bad.py", "def x(:\n")], "path string, text string")
    return Check(files, stub_table, options=Options(**options))


def lines(check):
    by = {n + 1: t for n, t in enumerate(MAIN.split("\n"))}
    fn = {r.line: r.name for r in check.functions.where("file_id = 'main.py'").collect()}
    found = check.diagnostics.where("severity = 'error' AND file_id = 'main.py'").collect()
    return {(fn[max(k for k in fn if k <= r.line)], by[r.line].strip().split("(")[0]): r.exc_types for r in found}


def test_reference_mode(spark, stub_table):
    found = lines(run(spark, stub_table))
    both = ["Broken", "ValueError"]
    assert found[("plain", "fails")] == both
    assert found[("guarded", "fails")] == ["Broken"]  # own classes aren't known as subclasses
    assert ("guarded_all", "fails") not in found
    assert found[("rethrows", "fails")] == both
    assert ("quiet", "fails") not in found and ("told", "fails") not in found and ("marked", "fails") not in found
    assert found[("half_told", "fails")] == ["Broken"]
    assert found[("reads", "return json.loads")] == ["ValueError"]
    assert found[("loops", "return other")] == ["KeyError"] and found[("other", "loops")] == ["KeyError"]
    assert found[("waits", "await fails")] == both
    assert found[("safe", "guarded")] == both  # handlers inside the callee don't count
    assert not any(k[0] == "maps" for k in found)  # callables count for the caller's signature only


def test_sound_mode(spark, stub_table):
    check = run(spark, stub_table, mode="sound", root="")
    found = lines(check)
    assert ("guarded", "fails") not in found and ("safe", "guarded") not in found
    assert found[("plain", "fails")] == ["ValueError", "main.Broken"]
    sigs = {}
    for r in check.signatures.collect():
        sigs.setdefault(r.fn_id.split(".")[-1], set()).add(r.effect)
    assert "guarded" not in sigs and sigs["maps"] == {"ValueError", "main.Broken"}


def test_strict_local_and_reports(spark, stub_table):
    check = run(spark, stub_table, strict=True, local_only=True)
    warned = [r.message for r in check.diagnostics.where("severity = 'warning'").collect()]
    assert "function 'plain' may raise undocumented exceptions: Broken, ValueError" in warned
    assert not any("reads" in m for m in warned)
    said = json.loads(report_json(check).first().value)
    assert said["summary"]["files"] == 2 and said["summary"]["issues"] == len(said["diagnostics"])
    shown = [r.value for r in report_text(check.diagnostics).collect()]
    assert shown[0].startswith("bad.py:1:0: error: failed to analyse file: ") and all(x.startswith("main.py:") for x in shown[1:])
    one = check.diagnostics.where("file_id = 'main.py'").first()
    assert hover(check.diagnostics, one.file_id, one.line).count() == 1


def test_order_of_files_does_not_matter(spark, stub_table):
    files = [(f"m{k}.py", f"def f{k}():\n    f{(k + 1) % 5}()\n    raise E{k}()\n") for k in range(5)]
    # names of other files resolve by their qualified name
    files = [(p, t.replace("    f", "    m").replace("()\n    raise", "()\n    raise", 1)) for p, t in files]
    files = [(f"m{k}.py", f"import m{(k + 1) % 5}\ndef f{k}():\n    m{(k + 1) % 5}.f{(k + 1) % 5}()\n    raise E{k}()\n") for k in range(5)]
    got = []
    for order in (files, files[::-1]):
        table = spark.createDataFrame(order, "path string, text string").repartition(len(got) + 1)
        got.append({(r.fn_id, r.effect) for r in Check(table, stub_table).signatures.collect()})
    assert got[0] == got[1] and len(got[0]) == 25


@pytest.mark.parametrize("mode", ["reference", "sound"])
def test_invalid_comments_and_unread_files(spark, mode):
    texts = {
        "a.py": "\ndef caller():\n    pass  # effectflow: ignore\n",
        "b.py": "def func(: pass",
        "c.py": "x = 1  # EF: ignore[ValueError]\ny = 2  # ef: ignore[]\nz = 3  # ef: ignored\nw = 4  #ef:ignore  [ A ]\nv = 5  # other: ignore\n# ef: ignore # ef: ignore[B]\n",
        "d.py": "def broken(:\n    pass  # ef: ignore\n",
        "e.py": "",
        "f.py": "x = '\x00'\n",
    }
    check = Check(spark.createDataFrame(list(texts.items()), "path string, text string"), options=Options(mode=mode, root=""))
    got = sorted((r.file_id, r.line, r.col, r.severity, r.message.split(":")[0]) for r in check.diagnostics.collect())
    invalid, unread = "invalid ignore comment", "failed to analyse file"
    assert got == [("a.py", 3, 0, "warning", invalid), ("b.py", 1, 0, "error", unread), ("c.py", 3, 0, "warning", invalid), ("d.py", 1, 0, "error", unread), ("f.py", 1, 0, "error", unread)]
    said = json.loads(report_json(check).first().value)
    assert said["summary"]["issues"] == 5 and {d["severity"] for d in said["diagnostics"]} == {"warning", "error"}
    assert all(d["exceptions"] == [] for d in said["diagnostics"])


def test_directives_against_their_definition(spark):
    """Random lines: the first list in brackets behind a mark, else invalid if some mark has no bracket."""
    import random

    rng = random.Random(3)
    bits = ["# ef: ignore", "#EF :ignore", "# effectflow:  ignore", "[A, B]", "[ A ]", "[]", "[ ]", "[,]", "[A", "]", " ", "x", "d", "\t", "# other: ignore", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    want = {}
    for k, line in enumerate(texts):
        behind, rest = [], line
        while True:  # a mark: hash, tag, colon, the word
            at = next((i for i in range(len(rest)) if rest[i] == "#" and (n := _mark(rest, i))), None)
            if at is None:
                break
            rest = rest[_mark(rest, at) :]
            behind.append(rest)
        lists, bare = [], False
        for n, piece in enumerate(behind):
            own = piece[: _next_mark(piece)].lstrip()
            if not own.startswith("["):
                bare = True
            elif "]" in own and own[1 : own.index("]")]:
                lists.append(own[1 : own.index("]")])
        if lists:
            want[k] = (True, list(dict.fromkeys(t.strip(" ") for t in lists[0].split(",") if t.strip(" "))))
        elif bare:
            want[k] = (False, None)
    table = spark.createDataFrame(list(enumerate(texts)), "path long, text string").selectExpr("cast(path AS string) AS path", "text")
    got = {int(r.file_id): (r.valid, r.exc_types) for r in facts.directives(table, ("effectflow", "ef")).collect()}
    assert got == want


def _mark(text, at):
    """Where a mark that starts at a place ends; 0 for none."""
    rest = text[at + 1 :].lstrip()
    for tag in ("effectflow", "ef"):
        if rest.lower().startswith(tag):
            tail = rest[len(tag) :].lstrip()
            if tail.startswith(":") and tail[1:].lstrip().lower().startswith("ignore"):
                return len(text) - len(tail[1:].lstrip()) + len("ignore")
    return 0


def _next_mark(text):
    return next((i for i in range(len(text)) if text[i] == "#" and _mark(text, i)), len(text))

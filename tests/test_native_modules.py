import sysconfig

from effectflow.plans.check import NATIVE, Check, Options
from effectflow.sources import native_modules

PATHS = {
    "a/b.cpython-313-x86_64-linux-gnu.so": ("a.b", True), "a/c.abi3.so": ("a.c", True), "a/d.so": ("a.d", True), "w.cp313-win_amd64.pyd": ("w", True),
    "a/old.cpython-311-darwin.so": None, "a/__init__.py": ("a", False), "a/x/__init__.cpython-313-darwin.so": ("a.x", True), "lib-dynload/_json.cpython-313-x86_64-linux-gnu.so": ("_json", True),
    "a/e.py": ("a.e", False), "a/libz.so.1": None, "a.libs/libq-1f.so": None, "a/readme": None, "a/test.data.py": None, "so": None, "a/.so": None, "a b/c.so": None,
}


def test_modules_of_files(spark):
    paths = spark.createDataFrame([(p,) for p in [*PATHS, None]], "path string")
    got = {r.path: (r.module, r.is_native) for r in native_modules.of_paths(paths, "3.13").collect()}
    assert got == {p: m for p, m in PATHS.items() if m}
    every = {r.path for r in native_modules.of_paths(paths).collect()}
    assert every == set(got) | {"a/old.cpython-311-darwin.so"}


def test_standard_library(spark):
    found = {r.module: r.is_native for r in native_modules.standard(spark).collect()}
    assert found["sys"] and found["_thread"] and not found["json"] and not found["dataclasses"]
    dynamic = {r.module for r in native_modules.below(spark, [sysconfig.get_path("stdlib"), "/nowhere"]).collect()}
    assert all(found[m] for m in dynamic & set(found))


def test_calls_into_shared_libraries(spark, tmp_path):
    package = tmp_path / "lib" / "pack"
    package.mkdir(parents=True)
    (package / "_fast.abi3.so").write_bytes(b"\x7fELF")
    (package / "slow.py").write_text("def g():\n    pass\n")
    modules = native_modules.standard(spark).unionByName(native_modules.below(spark, [str(tmp_path / "lib")]))
    text = (
        "import pack, math\nfrom pack._fast import go\nfrom pack.slow import g\nfrom _thread import start_new_thread\n"
        "def a():\n    go()\ndef b():\n    g()\ndef c():\n    pack._fast.go2()\ndef d():\n    start_new_thread()\ndef e():\n    math.sqrt(2)\n"
        "def f():\n    try:\n        go()\n    except Exception:\n        pass\n"
    )
    files = spark.createDataFrame([("m.py", text)], "path string, text string")
    found = {r.line for r in Check(files, modules=modules).diagnostics.collect() if NATIVE in r.exc_types}
    math = {14} if {r.module: r.is_native for r in modules.collect()}["math"] else set()
    assert found == {6, 10, 12} | math
    assert Check(files, modules=modules, options=Options(warn_native=False)).diagnostics.count() == 0

import io
import json
import threading

import pytest

from effectflow import cli
from effectflow.streaming import server

URI = "file:///tmp/a%20b.py"


def frame(**message):
    body = json.dumps({"jsonrpc": "2.0"} | message).encode()
    return b"Content-Length: %d\r\n\r\n" % len(body) + body


def frames(data):
    out, source = [], io.BytesIO(data)
    while line := source.readline():
        source.readline()
        out.append(json.loads(source.read(int(line.split(b":")[1]))))
    return out


def test_protocol():
    seen = []

    def analyse(path, text):
        seen.append((path, text))
        return [{"line": k + 1, "col": 0, "message": x, "severity": "warning"} for k, x in enumerate(text.split("\n")) if x.startswith("!")]

    sent, done = [], threading.Event()

    def send(m):
        sent.append(m)
        done.set()

    s = server.Server(analyse, send, debounce=0.05)
    assert s.handle({"id": 1, "method": "initialize"})["result"]["capabilities"]["hoverProvider"]
    doc = {"textDocument": {"uri": URI}}
    s.handle({"method": "textDocument/didOpen", "params": {"textDocument": {"uri": URI, "text": "!a\nb"}}})
    assert sent[-1]["params"]["diagnostics"][0]["severity"] == 2 and seen == [("/tmp/a b.py", "!a\nb")]
    done.clear()
    for text in ("!", "x"):
        s.handle({"method": "textDocument/didChange", "params": doc | {"contentChanges": [{"range": {"start": {"line": 1, "character": 0}, "end": {"line": 1, "character": 0}}, "text": text}]}})
    assert done.wait(5) and seen[1:] == [("/tmp/a b.py", "!a\nx!b")]  # one run for both changes
    assert s.handle({"id": 2, "method": "textDocument/hover", "params": doc | {"position": {"line": 0}}})["result"]["contents"]["value"] == "!a"
    assert s.handle({"id": 3, "method": "textDocument/hover", "params": doc | {"position": {"line": 1}}})["result"] is None
    s.handle({"method": "textDocument/didClose", "params": doc})
    assert sent[-1]["params"]["diagnostics"] == []


def test_frames():
    sink = io.BytesIO()
    source = io.BytesIO(frame(id=1, method="initialize") + frame(method="textDocument/didOpen", params={"textDocument": {"uri": URI, "text": "ü"}}) + frame(method="exit"))
    server.serve(source, sink, lambda p, t: [])
    assert [m.get("method", m.get("id")) for m in frames(sink.getvalue())] == [1, "textDocument/publishDiagnostics"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "src/skip").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("def f():\n    raise ValueError()\ndef g():\n    f()\n")
    (tmp_path / "src/skip/b.py").write_text("def h():\n    raise KeyError()\nh()\n")
    (tmp_path / "src/.gitignore").write_text("skip/\n")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["check", "src", "--cache", "kept"]) == 1
    out = capsys.readouterr().out
    assert "src/a.py:4:4: error: call to 'f' may raise unhandled exception(s): ValueError" in out and "1 issue(s) in 1 file(s)" in out
    assert cli.main(["check", "src", "--include-ignored", "--json", "-o", "out.json", "--cache", "kept"]) == 1
    assert json.loads((tmp_path / "out.json").read_text())["summary"]["issues"] == 2
    assert cli.main(["cache", "status", "kept"]) == 0 and capsys.readouterr().out.startswith("2 file(s)")
    assert cli.main(["cache", "clear", "kept"]) == 0 and cli.main(["check", "none"]) == 2 and cli.main([]) == 2
    (tmp_path / "pyproject.toml").write_text("[tool.effectflow.cache]\nttl_hours = 5\n")
    capsys.readouterr()
    assert cli.main(["config", "."]) == 0 and "cache.ttl_hours = 5  # pyproject" in capsys.readouterr().out
    (tmp_path / ".venv/bin").mkdir(parents=True)
    for name in ("uv.lock", ".venv/bin/python"):
        (tmp_path / name).write_text("")
    monkeypatch.delenv("VIRTUAL_ENV", raising=False)
    assert cli.main(["env", ".", "--json"]) == 0 and json.loads(capsys.readouterr().out)["tool"] == "uv"
    with pytest.raises(SystemExit) as e:
        cli.main(["wrong"])
    assert e.value.code == 2


def test_settings_take_effect(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "src/made").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("def f():\n    raise ValueError()\ndef g():\n    f()\ndef h():\n    raise KeyError()\ndef i():\n    h()\n")
    (tmp_path / "src/made/b.py").write_text("def h():\n    raise KeyError()\nh()\n")
    (tmp_path / "pyproject.toml").write_text('[tool.effectflow]\nignore_exceptions = ["ValueError"]\nexclude = ["made"]\n[tool.effectflow.lsp]\ndebounce_ms = 50\nmax_diagnostics_per_file = 7\n')
    monkeypatch.chdir(tmp_path)
    assert cli.main(["check", "src"]) == 1
    out = capsys.readouterr().out
    assert "KeyError" in out and "ValueError" not in out and "1 issue(s) in 1 file(s)" in out
    seen = []
    monkeypatch.setattr(server, "main", lambda *a: seen.append(a))
    assert cli.main(["lsp"]) == 0
    _, _, options, debounce, stub_table = seen[0]
    assert stub_table is None
    assert (list(options.ignored), options.most_per_file, debounce) == (["ValueError"], 7, 0.05)


def test_stubs_and_library_of_the_interpreter(spark, tmp_path, capsys, monkeypatch):
    """A stub file made from the running interpreter's sources, and a check that reads them without one."""
    import sysconfig

    monkeypatch.chdir(tmp_path)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import json\ndef f(s):\n    return json.loads(s)\ndef g(s):\n    try:\n        return json.loads(s)\n    except (TypeError, json.JSONDecodeError):\n        return None\n")
    assert cli.main(["stubs", sysconfig.get_path("stdlib"), "--module", "json", "--python", ">=3.13,<3.14", "-o", "std.json"]) == 0
    assert "function(s) in std.json" in capsys.readouterr().out
    made = json.loads((tmp_path / "std.json").read_text())
    assert made["metadata"]["version"] == ">=3.13,<3.14" and "TypeError" in made["json"]["loads"]
    assert cli.main(["check", "src", "--stubs", "std.json", "--python", "3.13", "--library", "nowhere"]) == 1
    with_stubs = capsys.readouterr().out
    assert "src/a.py:3:11: error: call to 'json.loads'" in with_stubs and ":6:" not in with_stubs
    assert cli.main(["check", "src", "--python", "3.13"]) == 1
    without = capsys.readouterr().out
    assert "src/a.py:3:11: error: call to 'json.loads'" in without and "TypeError" in without and ":6:" not in without
    assert cli.main(["check", "src", "--local"]) == 0
    assert cli.main(["stubs", "nowhere", "--python", ">=3", "-o", "x.json"]) == 2


def test_cache_switches(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.py").write_text("def f(): raise A()\nf()\n")
    assert cli.main(["check", "a.py", "--cache", "kept", "--no-cache"]) == 1 and not (tmp_path / "kept").exists()
    assert cli.main(["check", "a.py", "--cache", "kept", "--debug"]) == 1 and (tmp_path / "kept").exists()


def test_editor_server_with_stubs(spark):
    from effectflow.sources import stubs

    table = stubs.flatten(spark.createDataFrame([("stdlib", 50, '{"json": {"loads": ["ValueError"]}}')], "source string, priority int, text string"))
    analyse = server.analyse_with(stubs=table)
    assert [f["exc_types"] for f in analyse("/a.py", "import json\ndef f(s):\n    return json.loads(s)\n")] == [["ValueError"]]
    assert analyse("/a.py", "def func(: pass")[0]["severity"] == "error"

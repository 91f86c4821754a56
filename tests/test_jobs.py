import hashlib
import os
import re
import subprocess
import sys
import uuid

import pytest

from jobs import comment_index, escape_report
from jobs.common import configured
from tests.conftest import ROOT

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string"


def short(s):
    return hashlib.sha256(s.encode()).hexdigest()[:16]


def brute_comments(rows):
    """``rows`` in the order of delivery; the last of a path counts."""
    latest = {}
    for doc_id, text, lang, source, *_ in rows:
        text = text or ""
        part = lambda x: (x or "-").replace("/", "_")
        name = str(doc_id) if doc_id is not None else f"text-{short(text)}"
        latest[f"{part(source)}/{part(lang)}/{name}"] = (part(lang), text)
    out = set()
    for path, (lang, text) in latest.items():
        for k, line in enumerate(text.split("\n"), 1):
            if "#" in line:
                said = line[line.index("#") :]
                behind = re.sub(r"^#+\s*", "", said)
                m = re.match(r"[A-Za-z_][A-Za-z0-9_-]*", behind)
                listed = re.match(r"[A-Za-z_][^\[#]*\[([^\]]*)\]", behind)
                out.add((path, lang, k, m[0].lower() if m else "", listed[1] if listed else None, short(said)))
    return out


def add(spark, folder, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], DOCS).coalesce(1).write.mode("append").parquet(folder)


def shown(df):
    rows = [tuple(r) for r in df.select("path", "lang", "line", "tag", "listed", "hash").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ONE = [
    (1, "a\nx = 1  # ef: ignore[A, B]\n## Todo later", "en", "s/1", 0), (2, "none", "en", None, 0), (3, None, None, "s", 0), (None, "#! run\n# 9\n#", "de", "", 0),
    (4, "# same\n# same", "en", "s", 0), (4, "# same\n# same", "en", "s", 0), (5, "", "", "s", 0), (6, "é # noqa", "1", "s", 0),
]
TWO = [(4, "# now\n" + "x\n" * 5000 + "# end[ ]", "en", "s", 0), (6, "clean now", "1", "s", 0), (7, "# new", "fr", "s", 0)]


def test_comments_of_a_growing_folder(spark, tmp_path, caplog):
    docs, out = f"file://{tmp_path}/documents.parquet", f"file://{tmp_path}/out"
    add(spark, docs, ONE)
    before = dict(spark.conf.getAll)
    with caplog.at_level("INFO", "effectflow.jobs"):
        assert shown(comment_index.run(spark, docs, out)) == brute_comments(ONE)
        assert shown(comment_index.run(spark, docs, out)) == brute_comments(ONE)
        add(spark, docs, TWO)
        assert shown(comment_index.run(spark, docs, out)) == brute_comments(ONE + TWO)
    read = [int(x) for x in re.findall(r"read (\d+) new rows", caplog.text)]
    assert read == [len(ONE), 0, len(TWO)]
    assert dict(spark.conf.getAll) == before
    assert len({p.name for p in (tmp_path / "out/current").iterdir() if p.name.startswith("lang=")}) == 5


def test_comments_after_a_run_that_was_cut_off(spark, tmp_path, monkeypatch):
    docs, out = f"file://{tmp_path}/documents.parquet", f"file://{tmp_path}/out"
    add(spark, docs, ONE)
    comment_index.run(spark, docs, out)
    add(spark, docs, TWO)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # the batch is written and noted, the current table isn't
        m.setattr(comment_index, "_current", fail)
        with pytest.raises(OSError):
            comment_index.run(spark, docs, out)
    with monkeypatch.context() as m:  # the batch itself fails half-way
        add(spark, docs, [(8, "# late", "fr", "s", 0)])
        m.setattr(comment_index, "deliveries", fail)
        with pytest.raises(Exception, match="lost"):
            comment_index.run(spark, docs, out)
    assert shown(comment_index.run(spark, docs, out)) == brute_comments([*ONE, *TWO, (8, "# late", "fr", "s", 0)])


def test_comments_of_an_empty_folder_and_of_selected_paths(spark, tmp_path):
    docs, out = f"file://{tmp_path}/documents.parquet", f"file://{tmp_path}/out"
    spark.createDataFrame([], DOCS).write.parquet(docs)
    assert shown(comment_index.run(spark, docs, out)) == set()
    add(spark, docs, ONE)
    found = shown(comment_index.run(spark, docs, out, settings={"include": ["s/*"], "exclude": ["s/en"], "files_per_batch": 1}))
    assert found == {r for r in brute_comments(ONE) if r[0].startswith("s/") and r[1] != "en"}


SOURCES = [
    ("a.py", "def f(x):\n    raise KeyError(x)\ndef g():\n    f(1)\n"), ("b.py", "import a\ndef h():\n    try:\n        a.f(1)\n    except KeyError:\n        pass\n"),
    ("c.py", "def (:"), ("d.py", None), ("e.py", ""), (None, "raise X"),
]


def test_report_of_sources(spark, tmp_path):
    rows = spark.createDataFrame([(*r, 1) for r in [*SOURCES, SOURCES[0]]], "path string, text string, line int")
    first, found = (escape_report.report(spark, rows, f"file://{tmp_path}/out").collect() for _ in range(2))
    assert set(first) == set(found)
    files = {r.file_id: (r.functions, r.raises, r.findings, r.effects) for r in found if r.kind == "file"}
    assert files["a.py"] == (2, 1, 1, "KeyError") and files["d.py"] == files["e.py"] == (0, 0, 0, None) and files["c.py"][2] == 1
    assert files["b.py"][:3] == (1, 0, 0)
    assert {(r.file_id, r.line, r.severity) for r in found if r.kind == "finding"} == {("a.py", 4, "error"), ("c.py", 1, "error")}
    total = spark.read.json(f"file://{tmp_path}/out/summary").first()
    assert (total.files, total.functions, total.raises, total.findings) == (5, 3, 1, 2)
    # fewer files later: nothing of the old report stays
    less = escape_report.report(spark, rows.where("path = 'b.py'"), f"file://{tmp_path}/out")
    assert [r.file_id for r in less.collect()] == ["b.py"]
    assert escape_report.report(spark, rows.limit(0), f"file://{tmp_path}/out").count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "c.toml").write_text('mark = "//"\n')
    assert configured(spark, f"file://{tmp_path}/c.toml", comment_index.DEFAULTS)["mark"] == "//"
    (tmp_path / "d.toml").write_text("wrong = 1\n")
    with pytest.raises(ValueError, match="wrong"):
        configured(spark, f"file://{tmp_path}/d.toml", comment_index.DEFAULTS)
    for name, job in (("comment_index", comment_index), ("escape_report", escape_report)):
        assert set(configured(spark, f"file://{ROOT}/jobs/{name}.toml", job.DEFAULTS)) == set(job.DEFAULTS)


def test_command_line(spark, tmp_path):
    add(spark, f"file://{tmp_path}/documents.parquet", ONE)
    out = f"{tmp_path}/{uuid.uuid4().hex}"
    call = [sys.executable, "-m", "jobs.comment_index", "--documents", f"{tmp_path}/documents.parquet", "--output", out, "--config", "jobs/comment_index.toml"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --driver-java-options -Djava.io.tmpdir={tmp_path} pyspark-shell"}
    said = subprocess.run(call, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert f"read {len(ONE)} new rows" in said.stderr
    assert shown(spark.read.parquet(f"{out}/current").where("line IS NOT NULL").withColumn("lang", comment_index.F.col("lang").cast("string"))) == brute_comments(ONE)

import random

import pytest

from effectflow.operators import incremental
from effectflow.plans.check import Check

PAIR = "a string, b string"


def closed(edges, seeds):
    out = set(seeds)
    while True:
        more = {(x, b) for x, y in edges for a, b in out if a == y} - out
        if not more:
            return out
        out |= more


def rows(df):
    found = [tuple(r) for r in df.select("a", "b").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", range(3))
def test_random_changes_of_cyclic_graphs(spark, tmp_path, seed):
    rng = random.Random(seed)
    node = lambda: f"n{rng.randrange(14)}"
    edges, seeds = {(node(), node()) for _ in range(24)}, {(node(), f"e{rng.randrange(4)}") for _ in range(6)}
    kept = incremental.KeptClosure(spark, f"file://{tmp_path}/kept")
    table = lambda x: spark.createDataFrame(sorted(x), PAIR)
    assert rows(kept.refresh(table(edges), table(seeds))) == closed(edges, seeds)
    for step in range(4):
        edges = {e for e in edges if rng.random() < 0.85} | {(node(), node()) for _ in range(step)}
        seeds = {s for s in seeds if rng.random() < 0.8} | ({(node(), "e9")} if step % 2 else set())
        assert rows(kept.refresh(table(edges), table(seeds))) == closed(edges, seeds)
        assert rows(kept._read("result")) == closed(edges, seeds)


def test_a_cycle_does_not_support_itself_and_all_may_go(spark, tmp_path):
    kept = incremental.KeptClosure(spark, f"file://{tmp_path}/kept")
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], PAIR)
    assert len(rows(kept.refresh(ring, spark.createDataFrame([("b", "X"), ("d", "X")], PAIR)))) == 4
    assert rows(kept.refresh(ring, spark.createDataFrame([("d", "X")], PAIR))) == {("d", "X")}
    none = spark.createDataFrame([], PAIR)
    assert rows(kept.refresh(none, none)) == set() == rows(kept._read("edges"))


def test_only_the_reverse_closure_is_touched(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(40)] + [(f"m{k}", f"m{k + 1}") for k in range(40)], PAIR)
    seeds = spark.createDataFrame([("n40", "X"), ("m40", "X"), ("n20", "Y")], PAIR)
    result = spark.createDataFrame([(f"{c}{k}", "X") for c in "nm" for k in range(41)] + [(f"n{k}", "Y") for k in range(21)], PAIR)
    removed, added = incremental.maintain(result, (chain, seeds), (chain, seeds.where("b <> 'Y'")))
    assert rows(removed) == {(f"n{k}", "Y") for k in range(21)} and rows(added) == set()


def test_after_a_run_that_was_cut_off(spark, tmp_path, monkeypatch):
    kept = incremental.KeptClosure(spark, f"file://{tmp_path}/kept")
    one, seeds = spark.createDataFrame([("a", "b")], PAIR), spark.createDataFrame([("b", "X")], PAIR)
    kept.refresh(one, seeds)
    two = spark.createDataFrame([("a", "b"), ("c", "a")], PAIR)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(kept, "_write", fail)
        kept.refresh(two, seeds)
    assert rows(kept.refresh(two, seeds)) == {("a", "X"), ("b", "X"), ("c", "X")}
    assert kept._whole()


def test_check_with_kept_signatures(spark, tmp_path):
    kept = incremental.KeptClosure(spark, f"file://{tmp_path}/kept")
    texts = {"a.py": "import b\ndef f():\n    b.g()\n", "b.py": "import a\ndef g():\n    raise KeyError\ndef h():\n    a.f()\n"}
    for b in (texts["b.py"], "import a\ndef g():\n    raise OSError\ndef h():\n    a.f()\n", "def g():\n    pass\n"):
        files = spark.createDataFrame([("a.py", texts["a.py"]), ("b.py", b)], "path string, text string")
        cold, warm = Check(files), Check(files, kept=kept)
        show = lambda c: sorted(map(str, c.diagnostics.collect()))
        assert show(cold) == show(warm)
        assert sorted(map(tuple, cold.signatures.collect())) == sorted(map(tuple, warm.signatures.collect()))

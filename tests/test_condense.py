import pytest

from effectflow.operators import closure, condense
from effectflow.plans.check import Check, Options


def reach(edges):
    found = set(edges)
    while more := {(a, d) for a, b in found for c, d in edges if b == c} - found:
        found |= more
    return found


def classes(edges):
    """Nodes in a cycle of two or more, with the least node of their class."""
    r = reach(edges)
    nodes = {x for e in edges for x in e}
    same = {a: {b for b in nodes if a == b or ((a, b) in r and (b, a) in r)} for a in nodes}
    return {(a, min(s)) for a, s in same.items() if len(s) > 1}


RING = {(k, (k + 1) % 40) for k in range(40)}
PAIRS = {e for k in range(0, 12, 2) for e in ((k, k + 1), (k + 1, k), (k + 2, k))}  # a chain of cycles, ids against the arrows


@pytest.mark.parametrize("edges", [RING, PAIRS])
def test_components_and_condensed(spark, edges):
    rows = [*sorted(edges), *sorted(edges)[:3], (None, 1), (2, None), (3, 3)]
    table = spark.createDataFrame(rows, "a long, b long")
    assert {tuple(r) for r in condense.components(table).collect()} == classes(edges)
    seeds = spark.createDataFrame([(k, f"e{k}") for k in range(0, 40, 3)] + [(99, "own"), (99, "own"), (None, "x"), (1, None)], "a long, b string")
    want = {tuple(r) for r in closure.propagate(table.dropna(), seeds.dropna()).collect()}
    got = [tuple(r) for r in condense.condensed(table, seeds).collect()]
    assert set(got) == want and len(got) == len(want)


def test_words_of_more_than_64_bits(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(6, 3)], "a long, b long")
    seeds = spark.createDataFrame([(6, k) for k in range(300)], "a long, b long").repartition(3)
    for closed in (condense.condensed(edges, seeds), condense.by_words(edges, seeds)):
        assert closed.distinct().count() == closed.count() == 7 * 300


def test_empty(spark):
    none = spark.createDataFrame([], "a string, b string")
    own = spark.createDataFrame([("x", "E")], "a string, b string")
    assert condense.components(none).count() == 0 and condense.components(none).columns == ["node", "component"]
    assert [tuple(r) for r in condense.condensed(none, own).collect()] == [("x", "E")]
    assert condense.condensed(own, none).count() == 0


def test_cycle_is_coloured_both_ways_at_once(spark, monkeypatch):
    """No second pass finds what reaches a colour back: a cycle takes one round a node, and few more."""
    n, rounds, real = 9, [], condense.counted
    for module in (condense, closure):
        monkeypatch.setattr(module, "counted", lambda *a: rounds.append(1) or real(*a))
    edges = {(k, (k + 1) % n) for k in range(n)}
    found = {tuple(r) for r in condense.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert found == classes(edges)
    assert len(rounds) <= n + 5, len(rounds)


def test_condensed_computes_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(k, (k + 1) % 3) for k in range(3)], "a long, b long").mapInArrow(told, "a long, b long")
    assert condense.condensed(edges, spark.createDataFrame([(0, "x")], "a long, b string")).count() == 3
    assert seen.value == 3


def test_check_closes_over_the_condensed_graph(spark):
    """The same signatures with a cycle across files as one node."""
    rows = [("a.py", "import b\ndef f():\n    b.g()\n    raise KeyError\n"), ("b.py", "import a\ndef g():\n    a.f()\n    raise OSError\n"), ("c.py", "import a\ndef h():\n    a.f()\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    plain, one = ({tuple(r) for r in Check(files, options=Options(condense=c)).signatures.collect()} for c in (False, True))
    assert one == plain == {(f"{m}.py#{m}.{fn}", e) for m, fn in (("a", "f"), ("b", "g"), ("c", "h")) for e in ("KeyError", "OSError")}

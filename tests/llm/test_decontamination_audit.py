import hashlib
import itertools
import random
import re

import pytest

from effectflow.llm import decontaminate, filteraudit

DOCS = "doc_id long, text string, lang string, item_id string, quality int"
ODD = [None, "", " ", "a", "...", "ü Ü", "x" * 70_000, "word " * 20_000, "\x00\x01", "a\nb\tc  d", "😀" * 50, "A#B", "same", "same"]


def docs_of(spark, texts, langs=("en", None, "de")):
    rows = [(k, t, langs[k % len(langs)], "clash", 9) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Benchmark decontamination

def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(texts, items):
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for item, said in items:
            iw = words(said)
            size = min(10, len(iw))
            for s in range(len(iw) - size + 1 if iw else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == iw[s : s + size]:
                        hit |= set(range(p, p + size))
                        ids |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def contaminated(spark, texts, items):
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    rows = decontaminate.contamination(docs_of(spark, texts), bench).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("few", [True, False])
def test_windows_against_brute_force(spark, few, monkeypatch):
    if not few:  # the join by a shuffle
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "dé", "e1", "F"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k % 9, say(rng.choice([1, 2, 3, 9, 10, 11, 14, 25]))) for k in range(12)]
    items += [(20, None), (21, "..."), (None, say(12)), (22, items[5][1]), (2, items[7][1].upper()), (23, "x y x y x y x y x y x y")]
    texts = [say(rng.randrange(0, 40)) for _ in range(30)] + ODD
    for _, said in items:
        texts += [f"{say(5)} {said} {say(4)}", (said or "")[2:], said, f"{said} {said}"]
    texts += ["x y x y x y x y x y", "y x " * 30, texts[3], items[3][1].replace(" ", "\n")]
    try:
        assert contaminated(spark, texts, items) == brute_contamination(texts, items)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables_and_one_hot_passage(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    empty = brute_contamination(["a b"], [])
    assert contaminated(spark, ["a b"], []) == empty
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert decontaminate.contamination(docs_of(spark, []).limit(0), bench).count() == 0
    texts = [f"n{k} {passage}" if k % 3 == 0 else f"n{k}" for k in range(90)]
    items = [(k, passage if k % 2 else f"{passage} z{k}") for k in range(40)]
    assert contaminated(spark, texts, items) == brute_contamination(texts, items)


def test_only_dataframe_functions_on_the_path(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    found = decontaminate.contamination(docs_of(spark, ["a b c d e f g h i j"]), bench)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|ExternalRDD", plan)


# Filter interaction audit

def brute_audit(rows, labels):
    facts = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
            any(d is not None and doc_id is not None and d < doc_id and (x or "") == t for d, x, _ in rows),
        )) if x}
        mine = [x for x in labels if x[0] is not None and x[0] == doc_id]
        facts.append((lang or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out, shapley = {}, {}
    for part in {f[0] for f in facts}:
        mine = [f[1:] for f in facts if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = [x for x in mine if f in x[0]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "PARTS_HELD", 1)
    rng = random.Random(8)
    texts = list(ODD)
    for _ in range(60):
        n = rng.choice([10, 99, 100, 130])
        texts.append(" ".join(rng.choice(["W", "w", "x#", "ß"]) + str(rng.randrange(rng.choice([20, 400]))) for _ in range(n)))
    texts += rng.sample(texts[20:], 20)
    rows = [(k, t, ["en", None, "de", ""][k % 4]) for k, t in enumerate(texts)] + [(None, "same", "en"), (None, "other", "en"), (3, "a", None), (3, "same", "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 70, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], DOCS)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filteraudit.audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert filteraudit.audit(docs.limit(0), marks).count() == 0
    assert {r.good_lost for r in filteraudit.audit(docs, marks.limit(0)).collect()} == {0}


def test_first_failures_table():
    table = filteraudit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    for code, k in itertools.product(range(32), range(120)):
        step = next((s for s, f in enumerate(filteraudit.ORDERS[k]) if code >> "ABCDE".index(f) & 1), 5)
        assert table[code, k] == step

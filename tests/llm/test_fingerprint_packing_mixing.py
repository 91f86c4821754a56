import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from effectflow.llm import common, fingerprint, mixing, packing, quality, simjoin, tokencount

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
ODD = [None, "", " ", "a", "ü ü ü", "word " * 20_000, "\x00\x01", "a\nb\tc  d", "😀😀 x²", "same text here", "same text here", "İstanbul ΣΑΣ ﬁ <|endoftext|> don't 12½ _a_ \x1c \x85 \xa0x"]


def odd_docs(spark):
    sources = ["b", None, "a", "ä"]
    rows = [(k, t, None, sources[k % 4], None, "clash") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", "en", "a", 7, None)], DOCS)


# Fingerprints

def test_fingerprint_follows_the_definition():
    rng = random.Random(1)
    text = " ".join(rng.choice("alpha beta gamma delta épsilon".split()) + str(rng.randrange(99)) for _ in range(900))
    data = text.encode()

    def rolled(k):
        window = [data[k - b] if k >= b else 0 for b in range(7)]
        mixed = 0
        for b, c in enumerate(window):
            mixed ^= c << 5 * b & 0xFFFFFFFF
        h = sum(window) + sum(c * (7 - b) for b, c in enumerate(window)) + mixed & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ h >> 13

    h = fingerprint.rolling(np.frombuffer(data, np.uint8))
    assert [int(x) for x in h[:300]] == [rolled(k) for k in range(300)]
    level, a, b = fingerprint.fingerprint(text).split(":")
    triggers = [k for k in range(len(data) - 1) if (rolled(k) + 1 & 0xFFFFFFFF) % (3 << int(level)) == 0]
    below = [k for k in range(len(data) - 1) if (rolled(k) + 1 & 0xFFFFFFFF) % (3 << int(level) - 1) == 0]
    assert len(a) == 2 * (len(triggers) + 1) and len(triggers) < 64 <= len(below)
    # equal chunks have equal codes wherever they stand
    other = fingerprint.fingerprint("prefix words " + text)
    assert fingerprint.likeness(fingerprint.fingerprint(text), other) > 0.9


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 70))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
            row = new
        assert fingerprint._common(a, b) == row[-1]


def plain_fingerprint(text):
    """The definition, a byte at a time."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "0::"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rolled, window = [], [0] * 7
    for byte in data:
        window = [*window[1:], byte]
        mixed = 0
        for back, c in enumerate(window[::-1]):
            mixed ^= c << 5 * back & 0xFFFFFFFF
        h = sum(window) + sum(c * (k + 1) for k, c in enumerate(window)) + mixed & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        rolled.append(h ^ h >> 13)

    def chunks(level):
        out, chunk = [], []
        for k, byte in enumerate(data):
            chunk.append(byte)
            if k == len(data) - 1 or (rolled[k] + 1 & 0xFFFFFFFF) % (3 << level) == 0:
                out.append(chunk)
                chunk = []
        return out

    def codes(level):
        said = ""
        for chunk in chunks(level):
            h, power = 0, 1
            for byte in chunk:
                h, power = (h + (byte + 1) * power) % 2**64, power * 0x9E3779B97F4A7C15 % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            said += letters[h >> 58] + letters[h >> 52 & 63]
        return said

    level = next(k for k in range(40) if len(chunks(k)) <= 64)
    return f"{level}:{codes(level)}:{codes(level + 1)}"


def plain_likeness(a, b):
    """By edit distance without replacement, at the levels that both have."""
    if a == b:
        return 1.0
    (la, *pa), (lb, *pb) = a.split(":"), b.split(":")
    best = 0.0
    for i, x in enumerate(pa):
        for j, y in enumerate(pb):
            if int(la) + i == int(lb) + j and x and y:
                p, q = ([t[k : k + 2] for k in range(0, len(t), 2)] for t in (x, y))
                row = list(range(len(q) + 1))
                for m, c in enumerate(p):
                    new = [m + 1]
                    for n, d in enumerate(q):
                        new.append(row[n] if c == d else 1 + min(row[n + 1], new[-1]))
                    row = new
                best = max(best, 1 - row[-1] / (len(p) + len(q)))
    return best


def test_fingerprints_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op3_fingerprints(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    assert got.keys() == texts.keys()
    for k, d in enumerate(order):
        t, n = texts[d], texts[order[(k + 1) % len(order)]]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.fingerprint(t), fingerprint.fingerprint(e))
        if len(t) + len(n) < 3000:
            assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(t), plain_fingerprint(e))
            assert r.near_edited == pytest.approx(plain_likeness(r.fingerprint, r.edited_fingerprint))
            assert r.near_next == pytest.approx(plain_likeness(r.fingerprint, plain_fingerprint(n)))
    assert sum(r.near_edited for r in got.values()) / len(got) > 0.6 > 0.15 > sum(r.near_next for r in got.values()) / len(got)


def test_fingerprints_of_odd_rows(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark).limit(4)).unionByName(spark.createDataFrame([(3, f"text {k} of id three", None, None, None, None) for k in range(9)] + [(None, f"text {k} of no id", None, None, None, None) for k in range(9)], DOCS))
    hashed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    want = []
    for k, r in enumerate(order):
        t, n = r.text, order[(k + 1) % len(order)].text
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        want.append((r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.fingerprint(t), fingerprint.fingerprint(e), fingerprint.likeness(fingerprint.fingerprint(t), fingerprint.fingerprint(n))))
    for parts in (1, 5):
        got = fingerprint.compare_with_next(docs.repartition(parts)).drop("near_edited").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert fingerprint.compare_with_next(docs.limit(0)).count() == 0
    one = fingerprint.compare_with_next(docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0
    assert fingerprint.fingerprints(docs).count() == docs.count()


# Packing

def test_shortest_pack_first():
    rng = random.Random(4)
    for capacity, n in ((10, 40), (64, 500), (2048, 3000)):
        hist = defaultdict(int)
        for _ in range(n):
            hist[rng.randrange(1, capacity + 1)] += rng.choice((1, 1, 7))
        placed = packing.shortest_pack_first(hist, capacity)
        ranks, packs = defaultdict(list), defaultdict(list)
        for length, lo, hi, sequence, offset in placed:
            for k in range(lo, hi):
                ranks[length].append(k)
                packs[sequence + k - lo].append((offset, length))
        assert all(sorted(v) == list(range(hist[k])) for k, v in ranks.items())
        for pack in packs.values():
            at = 0
            for offset, length in sorted(pack):
                assert offset == at
                at += length
            assert at <= capacity
        # the brute-force rule on single items gives the same number of packs
        open_ = []
        for length in sorted((k for k, c in hist.items() for _ in range(c)), reverse=True):
            fit = min((t for t in open_ if t + length <= capacity), default=None)
            if fit is not None:
                open_.remove(fit)
            open_.append((fit or 0) + length)
        assert len(open_) == len(packs)


def test_packed_documents(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", 3)  # several salted blocks a length
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "'x' AS size"))
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(int)
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 256):
            part = ids[a : a + 256]
            want[(r.doc_id, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids))] += 1
    got, at = defaultdict(int), defaultdict(list)
    for r in packing.pack(docs, capacity=256).collect():
        got[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        at[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in at.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 256
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_are_those_of_the_plain_call(as_text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    if as_text:
        t.encode_special_tokens = True
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "  ", "\n", "a", "B", "don't", "12", "½", "ü", "İ", "ﬁ", "_", "!?", "\x1c", "\xa0", "e\u0301", "word", "中文", "😀", "'LL", "</w>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(4000)] + ["a <|endoftext|> b", "a<|endoftext|>b"]
    for ids, text in zip(packing.WordIds(packing.tokenizer_path(), as_text).ids(texts), texts):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == t.encode(text, add_special_tokens=False).ids, text


def test_many_placements_join_by_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = lambda: sorted(map(tuple, packing.pack(docs, capacity=64).collect()))
    few = rows()
    monkeypatch.setattr(packing, "PLACEMENTS_MOST", -1)
    monkeypatch.setattr(packing, "PLACEMENT_ROWS", 7)
    assert rows() == few


# Token counts

def test_token_counts(spark):
    docs = odd_docs(spark)
    enc = tokencount.encoder(tokencount.tokenizer_path())
    want = sorted(((r.doc_id is None, r.doc_id or 0, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect()))
    for block in (1, 7, 1 << 18):
        flat = common.written(tokencount.write_flat(docs.repartition(3), tokencount.tokenizer_path(), block_tokens=block), "t") if block > 1 else common.written(tokencount.write_flat(docs.where("length(text) < 50 OR text IS NULL").repartition(2), tokencount.tokenizer_path(), block_tokens=block), "t")
        got = tokencount.named(tokencount.scan(flat.where("block >= 0")), flat.where("block < 0")).collect()
        if block > 1:
            assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want
    assert tokencount.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_scan_of_any_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    files = {f: rng.choice([9, 9, 1, 2, 3], size=int(rng.integers(0, 60))).astype(np.uint16) for f in range(5)}
    rows, want = [], []
    for f, ids in files.items():
        cuts = sorted({0, len(ids), *map(int, rng.integers(0, len(ids) + 1, 6))})
        rows += [(f, k, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))] + [(f, 99, None)]
        n = ordinal = 0
        for x in ids:
            if x == 9:
                want.append((f, ordinal, n))
                ordinal, n = ordinal + 1, 0
            else:
                n += 1
        if n:
            want.append((f, ordinal, n))
    table = spark.createDataFrame([(f, b, bytearray(d) if d is not None else None) for f, b, d in rows], "file long, block long, data binary").repartition(3)
    assert sorted(tuple(r) for r in tokencount.scan(table, end=9).select("file", "ordinal", "n_tokens").collect()) == sorted(want)


# Mixing

def water_fill(sizes, most=3, weights=(1, 2, 3)):
    """Targets by source, a source at a time."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left = {}, float(sum(sizes.values()))
    open_ = list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def test_targets(spark):
    rng = random.Random(3)
    cases = [{"b": 100, "a": 10, None: 1000, "c": 0}, {"a": 0}, {None: 5}, {}]
    cases += [{rng.choice("aäÄzß😀\uffee") + str(k): int(rng.paretovariate(0.4)) for k in range(200)} | {None: 7}]
    for sizes in cases:
        table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long").repartition(3)
        got = {r.source: r for r in mixing.with_targets(table).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys()
        for s, r in got.items():
            assert r.target == pytest.approx(want[s]) and 0 <= r.p < 1 and r.whole + r.p <= 3
            assert r.whole + r.p == pytest.approx(want[s] / sizes[s] if sizes[s] else 0, abs=1e-6)


def test_landing_keeps_probabilities_and_totals():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 40):
        words = np.maximum(1, np.exp(rng.normal(4, 1, n))).round()
        p, rows = rng.random(n), np.stack([np.ones(n), words])
        mean = np.zeros(n)
        off = []
        for seed in range(500):
            q = mixing.land(p, rows, np.random.default_rng(seed))
            assert set(q) <= {0.0, 1.0}
            mean += q / 500
            off.append(abs((q - p) @ words))
        assert np.abs(mean - p).max() < 0.1
        assert n < 40 or np.mean(off) < 0.02 * words.sum()
    for n in (1, 4, 8):  # the program's distribution has these marginals exactly
        p = rng.random(n)
        bits = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(float)
        chosen, q = mixing._outcomes(p, rng.random(1 << n), bits)
        assert np.allclose(q @ bits[chosen], p) and (q >= 0).all() and np.isclose(q.sum(), 1)


def test_flight_keeps_totals_and_probabilities():
    sizes = np.array([5, 9, 2, 7, 1, 4, 4, 8, 3, 6], float)
    p, a = np.full(10, 0.37), np.stack([np.ones(10), sizes])
    mean = np.zeros(10)
    for seed in range(600):
        q = mixing.flight(p, a, np.random.default_rng(seed))
        assert ((q > 0) & (q < 1)).sum() <= 2 and np.allclose(a @ q, a @ p)
        mean += q / 600
    assert np.abs(mean - p).max() < 0.08


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)  # several levels
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(1, 60), None, rng.choice(["x", "y", "y", None]), 0, "c") for k in range(900)]
    docs = spark.createDataFrame(rows + rows[:5], DOCS)
    got = mixing.mix(docs.repartition(5)).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.times) for r in got) == sorted((r.doc_id, r.times) for r in again)
    assert len(got) == 900 and sum(r.copies for r in got) == 905
    total = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert 0 <= r.times <= 3
        total[r.source][0] += r.size * r.times * r.copies
        total[r.source][1] = r.target
        total[r.source][2] += r.size * r.copies
    want = water_fill({s: v[2] for s, v in total.items()})
    for s, (taken, target, _) in total.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) < 0.02 * target
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.times * r.copies for r in got)


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert sum(r.copies for r in mixing.mix(docs).collect()) == docs.count()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.times for r in mixing.mix(docs.where("trim(text) = ''")).collect()} <= {0}


def test_keys_of_the_mix(spark):
    """Nulls in different columns, repeated rows, repeated ids and clashing names."""
    names = "doc_id long, text string, lang string, source string, n_chars long, unit string, times int, p string, `a.b` string, size int, copies int, target int, __id string"
    odd = [(1, None, "x"), (1, "x", None), (1, "x", "x"), (None, "x", "x"), (None, None, None), (1, None, None), (2, "same words here", "x"), (2, "other words here", "x"), (2, "same words here", "y")]
    rng = random.Random(2)
    rows = [*odd, odd[6], odd[1], odd[0]] + [(k, "w " * rng.randrange(1, 50), rng.choice(["x", None, "y"])) for k in range(10, 300)]
    docs = spark.createDataFrame([(d, t, None, s, 0, "u", 9, "p", "ab", 1, 2, 3, "id") for d, t, s in rows], names).repartition(4)
    got = mixing.mix(docs).collect()
    copies, sizes = defaultdict(int), defaultdict(int)
    for d, t, s in rows:
        copies[(d, s, hashlib.md5(t.encode()).digest() if t is not None else None)] += 1
        sizes[s] += len((t or "").split())
    assert {(r.doc_id, r.source, bytes(r.unit) if r.unit is not None else None): r.copies for r in got} == copies
    want = water_fill(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.times <= 3
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[(r.doc_id, r.source, hashlib.md5(r.text.encode()).digest() if r.text is not None else None)] += 1
    assert taken == {(r.doc_id, r.source, bytes(r.unit) if r.unit is not None else None): r.times * r.copies for r in got if r.times}


def test_mix_of_very_many_sources(spark):
    n = 100_000
    docs = spark.range(n + 3000).selectExpr("id AS doc_id", f"repeat('w ', cast(1 + id % 7 AS int)) AS text", f"concat('host', lpad(cast(least(id, {n}) AS string), 7, '0')) AS source")
    got = mixing.mix(docs).selectExpr("count(*) AS n", "count(DISTINCT source) AS sources", "sum(size * times) AS taken", "sum(size) AS size", "max(times) AS most").first()
    assert (got.n, got.sources) == (n + 3000, n + 1) and got.most <= 3 and abs(got.taken - got.size) < 0.02 * got.size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_query_of_the_mix(spark, sf):
    got = mixing.op2_source_mix(spark, f"/root/testdata/{sf}").collect()
    words = {r.doc_id: (r.source, len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for source, size in words.values():
        sizes[source] += size
    want, taken = water_fill(dict(sizes)), defaultdict(int)
    assert {r.doc_id: (r.source, r.size) for r in got} == words and len(got) == len(words)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for source, target in want.items():
        off = abs(taken[source] - target)
        if off > 0.02 * target:  # then no choice of its documents is nearer
            whole = int(target / sizes[source])
            own = [size for of, size in words.values() if of == source]
            assert 1 < len(own) <= mixing.SOUGHT
            sums = {0}
            for size in own:
                sums |= {s + size for s in sums}
            assert off <= min(abs(whole * sizes[source] + s - target) for s in sums) + 1e-6, source
    again = mixing.op2_source_mix(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


# Quality

def test_kth_highest(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.random() * 1e6, 5.0, -3.5, rng.gauss(0, 1e-9)]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert quality.kth_highest(table, "v", k, rows=16) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_highest(table, "v", 0) == float("inf")


def plain_buckets(text):
    """N-grams of a text to buckets, a token at a time."""
    import re

    low = 0xFFFFFFFF
    hashes = [zlib.crc32(t.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & low for t in re.findall(r"\w+|[^\w\s]+", text.lower())]
    out = [h >> 16 for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        h = a * 0x85EBCA6B + (b ^ b >> 7) * 0xC2B2AE35 & low
        h = (h ^ h >> 15) * 0x2C1B3C6D & low
        out.append(1 if a == b else h >> 16)
    return out


def test_packed_buckets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        found = rng.integers(0, 1 << 16, n).astype(np.uint16)
        assert (quality.unpacked(quality.packed(found)) == np.sort(found)).all()
    assert (quality.unpacked(quality.packed(np.array([65535, 0, 65535], np.uint16))) == [0, 65535, 65535]).all()
    assert sorted(quality.grams("A b b, c!").tolist()) == sorted(plain_buckets("A b b, c!"))


def test_selection_against_brute_force(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [tuple(r) for r in base.collect()] + [(9000, None), (9001, ""), (9002, "a"), (9003, "tie tie"), (9003, "tie tie"), (None, "no id"), (9004, "word " * 3000)]
    docs = spark.createDataFrame([(d, t, "c", "c") for d, t in rows], "doc_id long, text string, score string, quality string")
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()} | {9002: 0}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(known.items()) + [(9003, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    bags = [np.bincount(plain_buckets(t or ""), minlength=quality.BUCKETS) for _, t in rows]
    mine = [known.get(d) == 1 for d, _ in rows]
    raw, target = sum(bags), sum(n * m for n, m in zip(bags, mine))
    weights = []
    for n, m in zip(bags, mine):
        r, t, k = raw - n, target - n * m, n.sum()
        at = np.flatnonzero(n)
        ratio = np.log((t[at] + 2.0) / (r[at] * (t.sum() / r.sum()) + 2.0))
        weights.append(float((n[at] * ratio).sum() * 100 / (k + 20)) if k else 0.0)
    labelled = [(w, known[d] == 1) for (d, _), w in zip(rows, weights) if d in known]
    cuts = sorted({w for w, _ in labelled})
    middles = [(a + b) / 2 for a, b in zip(cuts, cuts[1:])]
    good = sum(g for _, g in labelled)
    accuracy = {c: sum(w >= c for w, g in labelled if g) / good + sum(w < c for w, g in labelled if not g) / (len(labelled) - good) for c in middles}
    gap = {c: b - a for c, a, b in zip(middles, cuts, cuts[1:])}
    cut = max((c for c in middles if accuracy[c] >= max(accuracy.values()) - 1e-12), key=lambda c: gap[c])
    got = quality.op1_importance_resampling(spark, str(tmp_path)).collect()
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(17, "doc_id").alias("g")).collect()}
    scores = sorted(((w + noise[d]) for (d, _), w in zip(rows, weights)), reverse=True)
    least = scores[sum(w >= cut for w in weights) - 1]
    want = sorted((str(d), round(w, 6), round(w + noise[d], 6), w + noise[d] >= least - 1e-9) for (d, _), w in zip(rows, weights))
    assert sorted((str(r.doc_id), round(r.log_weight, 6), round(r.score, 6), r.kept) for r in got) == want
    assert 0 < sum(r.kept for r in got) < len(got)


def test_ties_at_the_cut_all_stay(spark):
    docs = spark.createDataFrame([(4, "tie tie tie")] * 5 + [(k, f"good words here {k}") for k in range(10, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 25)) for k in range(10, 30)], "doc_id long, quality int")
    scores, _, _, least = quality.resample(docs, labels)
    tied = [r.score for r in scores.where("doc_id = 4").collect()]
    assert len(set(tied)) == 1 and len(tied) == 5
    assert quality.kth_highest(scores, "score", 1 + scores.where(f"score > {tied[0]!r}").count()) == tied[0]
    kept = quality.kept(docs, labels)
    assert kept.where("doc_id = 4").count() in (0, 5) and kept.columns == docs.columns


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id for r in quality.kept(docs, half).select("doc_id").collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    good, bad = [[r.doc_id in kept for r in rest if r.quality == q] for q in (1, 0)]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 0, 1), (9, 1, None), (None, 1, 0), (4, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    scored, _, _, least = quality.resample(docs, labels)
    assert scored.count() == docs.count() and scored.where("score IS NULL").count() == 0
    assert quality.kept(docs, labels).columns == docs.columns
    none = quality.kept(docs, labels.limit(0))
    assert none.count() == docs.count()  # nothing to go by
    assert quality.kept(docs.limit(0), labels).count() == 0


# Similarity join

def brute_components(rows, words, num, den):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for d, t in rows:
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((d, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (d, x) in enumerate(sets):
        for e, y in sets[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sets, find


@pytest.mark.parametrize(("words", "num", "den", "limits"), [
    (3, 90, 100, None), (3, 90, 100, (100_000, 7)), (5, 80, 100, (300, 2048)), (5, 80, 100, (100_000, 7)), (1, 50, 100, (1, 1)), (1, 50, 100, None),
])
def test_similarity_components(spark, monkeypatch, words, num, den, limits):
    if limits:  # blocks of any size give the same
        monkeypatch.setattr(simjoin, "BLOCK_SHINGLES", limits[0])
        monkeypatch.setattr(simjoin, "BLOCK_ROWS", limits[1])
    rng = random.Random(words)
    base = [[f"b{j}w{k}" for k in range(70)] for j in range(2)]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(9, "same text here"), (3, "other text of id three"), (3, "third text of id three"), (2000, "other text of id three")]
    rows += [(3000 + k, f"a passage that all of these share and no more {k} " + " ".join(f"p{k}q{j}" for j in range(k % 5))) for k in range(40)]
    for k in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(70)] = f"x{rng.randrange(500)}"
        rows.append((1000 - k, " ".join(w)))
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, component_id string").repartition(3)
    got = simjoin.similarity_components(docs, words, num, den).collect()
    sets, find = brute_components(rows, words, num, den)
    want = sorted((d, len(s), find(d) if s else d) for d, s in sets)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert simjoin.similarity_components(docs.limit(0), words, num, den).count() == 0


def test_a_shared_phrase_makes_no_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK_ROWS", 16)
    seen = []

    def counting(heads, num, den, make=simjoin._node_pairs):
        pairs = make(heads, num, den)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(simjoin, "_node_pairs", counting)
    for n in (96, 384):
        rows = [(k, " ".join(f"w{k}x{j}" for j in range(20)) + " one shared phrase " + " ".join(f"v{k}x{j}" for j in range(20))) for k in range(n)]
        got = simjoin.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
        assert all(r.component_id == r.doc_id for r in got)
    assert sum(seen) == 0


def test_sketch_counts_every_shingle(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "COUNTED", 50)
    texts = [*ODD, *[f"common words here n{k} m{k}" for k in range(60)]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    counts = simjoin.sketch(docs, 3)
    want = np.zeros(len(counts), np.int64)
    for t in texts:
        w = simjoin.word_hashes(t or "")
        if len(w):
            np.add.at(want, simjoin._buckets(simjoin._shingled(w, 3), len(counts)), 1)
    assert (counts == want).all() and len(counts) == 1 << 16
    assert simjoin.sketch(docs.limit(0), 3).sum() == 0


def test_null_id_in_the_join(spark):
    got = {(r.doc_id, r.component_id) for r in simjoin.similarity_components(odd_docs(spark), 3, 90, 100).collect()}
    assert (None, None) in got and (10, 9) in got


# Pipeline

def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = common.read(spark, sf, "documents")
    first = {r.doc_id for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), name)
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen[name] = docs
    kept = seen["quality_classifier"].collect()
    assert {r.doc_id for r in kept} < first
    rows = [(r.doc_id, r.text) for r in kept]
    _, find = brute_components(rows, 5, 80, 100)
    assert sorted(r.doc_id for r in seen["jaccard_join"].collect()) == sorted({find(d) for d, _ in rows})
    clean = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert len(clean) == seen["jaccard_join"].count() and not any("@mail" in r.text for r in clean.values())
    mix = seen["source_mix"].collect()
    assert {r.doc_id for r in mix} < set(clean) and all(clean[r.doc_id] == r for r in mix)
    pieces = seen["packing"].collect()
    assert sum(r.start == 0 for r in pieces) == len(mix)
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.select("doc_id", "start", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces)


def test_pipeline_of_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from effectflow.llm import pii

    docs = odd_docs(spark).unionByName(odd_docs(spark).where("doc_id = 3"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, table = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        table = seen[name] = common.written(stage(spark, table, str(tmp_path)), name)
    plain = lambda df: sorted(map(str, map(tuple, df.select(*corpus_pipeline.COLUMNS).collect())))
    assert plain(seen["quality_classifier"]) == plain(docs)  # one label says nothing
    rows = docs.select(*corpus_pipeline.COLUMNS).collect()
    _, find = brute_components([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 5, 80, 100)
    once = {str(tuple(r)) for r in rows if r.doc_id is None or find(r.doc_id) == r.doc_id}
    assert plain(seen["jaccard_join"]) == sorted(once)
    masked = [(r.doc_id, r.text and pii.redact(r.text, pii.find_spans(r.text))) for r in seen["jaccard_join"].collect()]
    assert sorted(map(str, masked)) == sorted(str((r.doc_id, r.text)) for r in seen["personal_data"].collect())
    sure = {str(tuple(r)) for r in seen["personal_data"].select(*corpus_pipeline.COLUMNS).collect()}
    assert set(plain(seen["source_mix"])) <= sure
    pieces = seen["packing"].collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == sorted(str(r.doc_id) for r in seen["source_mix"].collect())
    for name, stage in corpus_pipeline.STAGES:
        empty = common.written(stage(spark, (docs if name == "quality_classifier" else seen["jaccard_join"]).limit(0), str(tmp_path)), name)
        assert empty.count() == 0


def test_folders_of_a_run(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pathlib import Path

    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    out = corpus_pipeline.run(spark, SF)
    left = {p.name for p in shared.iterdir()} - before
    assert len(left) == 1 and left.pop().startswith("result-packing") and out.count()


def test_folder_must_be_shared(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_join_keeps_every_text_of_a_shared_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [
        (5, words("a")), (5, words("b")), (5, words("c")),  # one id, three documents
        (7, words("b") + " tail"), (2, words("c") + " tail"),  # near copies of two of them
        (9, words("d")), (9, words("d")), (9, words("d") + " tail"),  # equal and linked texts
        (11, ""), (11, " "), (11, ""), (12, None), (12, None), (None, words("a")), (13, words("e")),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", n) for n, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(5, "a"), (5, "b"), (2, "c"), (9, "d"), (11, ""), (11, " "), (12, None), (None, "a"), (13, "e")]
    for parts in (1, 4):
        left = corpus_pipeline.jaccard_join(spark, docs.repartition(parts), "")
        assert tuple(left.columns) == corpus_pipeline.COLUMNS
        got = [(r.doc_id, r.text and (r.text.strip() and r.text[0] or r.text)) for r in left.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)

"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes decides where chunks end: after a byte where ``(hash + 1)`` is a multiple
of ``3 * 2**level``. The triggers of a level are among those of the level below, so one pass gives every level;
the fingerprint takes the lowest level with at most 64 chunks, and the next one. Each chunk becomes a 12-bit code
(two base64 characters) of a polynomial hash, taken for all chunks at once from prefix sums::

    level:codes at this level:codes at the next

Two fingerprints compare at a level that both have, by edit distance without replacement:
``1 - distance / (codes of both)``; 1 for two empty ones, 0 where they have no level in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.llm.common import BATCH_ROWS, arrow_pass, per_row, plain_text, read, tuned, written

WINDOW, SMALLEST, MOST_CHUNKS = 7, 3, 64
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = np.array([a + b for a in _B64 for b in _B64])
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions below n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at every position: their sum, their weighted sum, their shifted xor."""
    n = len(data)
    wide = np.zeros(n + WINDOW - 1, np.uint32)
    wide[WINDOW - 1 :] = data
    plain, weighted, mixed = (np.zeros(n, np.uint32) for _ in range(3))
    for back in range(WINDOW):
        part = wide[WINDOW - 1 - back : WINDOW - 1 - back + n]
        plain += part
        weighted += part * np.uint32(WINDOW - back)
        mixed ^= part << np.uint32(5 * back)
    h = plain + weighted + mixed
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if n == 0:
        return "0::"
    h = rolling(data) + np.uint32(1)
    at = np.flatnonzero(h % np.uint32(SMALLEST) == 0)
    at = at[at < n - 1]  # the last chunk ends with the text
    ratio = (h[at] // np.uint32(SMALLEST)).astype(np.int64)
    low = ratio & -ratio  # 2 ** (levels above the lowest); 0 counts as every level
    level_of = np.where(ratio == 0, 32, np.frexp(np.maximum(low, 1))[1] - 1)
    counts = np.bincount(level_of, minlength=34)[::-1].cumsum()[::-1]
    level = int(np.argmax(counts + 1 <= MOST_CHUNKS))
    up, down = _tables(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])))

    def codes(level: int) -> str:
        ends = np.concatenate((at[level_of >= level] + 1, [n]))
        starts = np.concatenate(([0], ends[:-1]))
        piece = (sums[ends] - sums[starts]) * down[starts]
        piece ^= piece >> np.uint64(32)
        piece *= np.uint64(0xD6E8FEB86659FD93)
        return "".join(_CODES[(piece >> np.uint64(52)).astype(np.int64)])

    return f"{level}:{codes(level)}:{codes(level + 1)}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints."""
    if a == b:
        return 1.0
    (la, a0, a1), (lb, b0, b1) = a.split(":"), b.split(":")
    both = {int(la): a0, int(la) + 1: a1}.items(), {int(lb): b0, int(lb) + 1: b1}
    best = 0.0
    for level, x in both[0]:
        y = both[1].get(level)
        if x and y:
            p, q = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (x, y))
            best = max(best, 2 * _common(p, q) / (len(p) + len(q)))
    return best


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row's whole text, however long; null texts are empty, repeated rows stay, extra columns
    fall away. No shuffle."""
    return per_row(docs.select(id_col, plain_text(text_col).alias("text")), lambda i, t: (i, fingerprint(t)), f"{id_col} long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third (of code points, rounded down) replaced by the first as many of the next."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RANGE_BYTES = 64 << 20  # of stored input that a range has, about


def _ranges(docs: DataFrame) -> int:
    """Ranges for ``docs``, by the size that the optimizer knows of its files; at least the shuffle partitions."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = docs._jdf.queryExecution().optimizedPlan()
    size = int(plan.stats().sizeInBytes())
    known = size < 1 << 60 and "Join" not in plan.toString()  # a join's is a product
    return max(least, min(-(-size // RANGE_BYTES), 1 << 20)) if known else least


def _row(key: int | None, text: str, print_: str, following: str, following_print: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    said = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), said, print_, other, likeness(print_, other), likeness(print_, following_print)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract of the query: fingerprints of each text and its edited text, and their likenesses.

    The edited text takes its end from the next document by descending id, the last from the first (a single row
    from itself). Null ids come last; rows of one id are in order of a hash of their texts, then of the texts. Null texts
    are empty; very long ones are whole; repeated rows each get their row; extra columns fall away; an empty table gives
    an empty result.

    One shuffle deals the texts to ranges of (id, hash), so rows that share an id, or have none, are ranges like any
    other. Each range compares its rows in one pass and leaves its first and last text beside its results; the last
    row of each range is then compared with the first of the next one.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), plain_text().alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("key").desc_nulls_last(), F.col("hash")]
    dealt = rows.repartitionByRange(_ranges(docs), *order).sortWithinPartitions(*order, "text").select("key", "text")
    names = [part.split()[0] for part in _RESULT.split(",")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, first, held, out = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                print_ = fingerprint(text)
                if held is None:
                    first = text
                else:
                    out.append((*_row(*held, text, print_), None, None, None))
                held = (key, text, print_)
                if len(out) >= BATCH_ROWS:
                    yield dict(zip((*names, "part", "head", "tail"), map(list, zip(*out))))
                    out = []
        if held is not None:
            out.append((held[0], *[None] * 6, part, first, held[1]))
            yield dict(zip((*names, "part", "head", "tail"), map(list, zip(*out))))

    found = written(arrow_pass(dealt, make, f"{_RESULT}, part int, head string, tail string"), "ranges")
    ends = found.where("part IS NOT NULL").select(F.col("doc_id").alias("key"), "part", "head", "tail")
    parts = sorted(r["part"] for r in ends.select("part").collect())  # a number a range
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])) or [(-1, -1)], "part int, next int")
    heads = ends.select(F.col("part").alias("next"), F.col("head").alias("following"))
    pairs = ends.join(F.broadcast(follows), "part").join(heads, "next").select("key", "tail", "following")
    last = per_row(pairs, lambda key, text, following: _row(key, text, fingerprint(text), following, fingerprint(following)), _RESULT)
    return found.where("part IS NULL").select(*names).unionByName(last)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how like they are."""
    return compare_with_next(read(spark, sf_dir, "documents"))

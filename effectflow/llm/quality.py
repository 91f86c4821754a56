"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Texts become bags of hashed word n-grams (lower-cased words, punctuation runs, their pairs; a pair of equal tokens
has one bucket of its own). Two generative models are bucket counts: the raw one over every text of the corpus, the
target one over texts labelled good. A text's log importance weight is the sum over its n-grams of the log ratio of
the two, each without the text itself, so that neither its own words nor its label speak for it; taken to a common length, as
else long texts would win or lose by length alone. A sample without replacement in proportion to the weights is the ``k`` highest of weight + Gumbel noise.

``k`` follows the corpus: the number of texts whose weight reaches a cut, and the cut is where the labelled rows
part best (highest mean of both classes' accuracy). Labelled rows are the ``label_bound`` of least hashed id, a
documented bound: they are broadcast, and only the target model and the cut are fitted on them. The raw counts and
the selection cover all rows.

Each text is tokenized once: its sorted buckets, as differences, are written beside the row, and counts, weights and the
selection read those.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.llm.common import arrow_pass, plain_text, read, tuned, written

BUCKETS = 1 << 16
LABEL_BOUND = 20_000
SMOOTHING = 2.0
#: A weight is that of LENGTH n-grams like the text's; FEW more count as neutral, so that a few words say little.
LENGTH, FEW = 100, 20
_SAME = 1  # the bucket of a pair of equal tokens
_CACHE_MOST = 80_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Token -> 32-bit hash, filled on demand."""

    def __missing__(self, token: str) -> int:
        h = zlib.crc32(token.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF
        if len(self) < _CACHE_MOST:
            self[token] = h
        return h


_hashes = _Hashes()


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    tokens = _TOKEN.findall(text.lower())
    one = np.fromiter(map(_hashes.__getitem__, tokens), np.uint32, len(tokens))
    mixed = one[:-1] * np.uint32(0x85EBCA6B) + (one[1:] ^ (one[1:] >> np.uint32(7))) * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    two = np.where(one[:-1] == one[1:], np.uint32(_SAME), mixed >> shift)
    return np.concatenate((one >> shift, two)).astype(np.uint16)


def packed(found: np.ndarray) -> bytes:
    """Buckets as bytes that compress well: sorted, differences, the low bytes before the high ones."""
    steps = np.diff(np.sort(found), prepend=np.uint16(0)).astype(np.uint16)
    return steps.view(np.uint8).reshape(-1, 2).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The sorted buckets again."""
    halves = np.frombuffer(data, np.uint8).reshape(2, -1)
    return np.cumsum(np.ascontiguousarray(halves.T).view(np.uint16).ravel(), dtype=np.uint16)


@dataclass(frozen=True)
class Model:
    """Counts of each bucket (a fixed number of them) over all texts and over the target, and the cut on the weight."""

    raw: np.ndarray
    target: np.ndarray
    smoothing: float = SMOOTHING
    cut: float = 0.0

    def weight(self, buckets: np.ndarray, in_target: bool) -> float:
        """The log ratio of a text's n-grams at the common length, its own counts taken out of both models."""
        found, own = np.unique(buckets, return_counts=True)
        n = own.sum()
        raw, target = self.raw.sum() - n, self.target.sum() - n * in_target
        if not n or raw <= 0 or target <= 0:
            return 0.0
        expected = (self.raw[found] - own) * (target / raw)
        ratio = np.log((self.target[found] - own * in_target + self.smoothing) / (expected + self.smoothing))
        return float((own * ratio).sum() * LENGTH / (n + FEW))


def _labelled(labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, quality of at most ``bound`` labelled documents, those of least hashed id; the worst label counts."""
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _counts(bags: DataFrame) -> np.ndarray:
    """Summed bucket counts, raw and target, of (buckets, target): each task sums its own, then slices are summed."""
    slices, width = 64, BUCKETS // 64

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            every = list(map(unpacked, batch.column(0).to_pylist()))
            chosen = [b for b, target in zip(every, batch.column(1).to_pylist()) if target]
            for k, parts in enumerate((every, chosen)):
                if parts:
                    total[k] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        yield {"slice": list(range(slices)), **{name: list(total[k].reshape(slices, width)) for k, name in enumerate(("raw", "target"))}}

    partial = arrow_pass(bags, make, "slice int, raw array<long>, target array<long>")

    def add(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), np.int64)
        for batch in group:
            for k in (0, 1):
                total[k] += batch.column(k + 1).flatten().to_numpy().reshape(-1, width).sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array([key[0].as_py()], pa.int32()), "raw": pa.array([total[0]], pa.list_(pa.int64())),
                "target": pa.array([total[1]], pa.list_(pa.int64())),
            }
        )

    out = np.zeros((2, BUCKETS), np.int64)
    for row in partial.groupBy("slice").applyInArrow(add, partial.schema).collect():  # a fixed number of counts
        out[0, row["slice"] * width : (row["slice"] + 1) * width] = row["raw"]
        out[1, row["slice"] * width : (row["slice"] + 1) * width] = row["target"]
    return out


def buckets(text: Column) -> Column:
    """The packed buckets of a text."""

    @F.arrow_udf("binary")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([packed(grams(t)) for t in texts.to_pylist()], pa.binary())

    return found(text)


def weight(model: Model) -> Column:
    """A column function of buckets and whether they are in the target: the log importance weight."""

    @F.arrow_udf("double")
    def weigh(found: pa.Array, targets: pa.Array) -> pa.Array:
        pairs = zip(found.to_pylist(), targets.to_pylist())
        return pa.array([model.weight(unpacked(b), bool(g)) for b, g in pairs], pa.float64())

    return weigh


def bags(docs: DataFrame, known: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """A written table: ``row`` (the ``columns`` of each row, whatever their names), ``doc_id``, ``buckets`` of the text,
    ``quality`` (null where unknown) and ``target``. The labelled rows, at most the bound, are broadcast."""
    tuned(docs.sparkSession)
    marks = known.select(F.col("doc_id").alias("id"), "quality")
    row = F.struct(*[F.col(f"`{c}`") for c in columns or ["doc_id"]]).alias("row")
    rows = docs.select(row, "doc_id", plain_text().alias("text"))
    marked = rows.join(F.broadcast(marks), rows["doc_id"] == F.col("id"), "left").drop("id")
    target = F.coalesce(F.col("quality") == 1, F.lit(False)).alias("target")
    return written(marked.select("row", "doc_id", buckets(F.col("text")).alias("buckets"), "quality", target), "bags")


def fit(table: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """Both models over ``bags``, and the cut on its labelled rows. Without any of the target, weights and cut are 0."""
    raw, target = _counts(table.select("buckets", "target"))
    model = Model(raw, target, smoothing)
    if not target.any():
        return model
    known = table.where(F.col("quality").isNotNull()).groupBy("doc_id", "quality", "target").agg(F.min("buckets").alias("buckets"))
    pairs = known.select(weight(model)("buckets", "target").alias("w"), "quality").collect()  # one an id, so at most the bound
    return Model(raw, target, smoothing, _best_cut(np.array([p["w"] for p in pairs]), np.array([p["quality"] for p in pairs]) == 1))


def _best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the highest mean accuracy of both classes; nothing to part: no cut."""
    if good.all() or not good.any():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    below_bad = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    above_good = 1 - np.concatenate(([0], np.cumsum(g))) / g.sum()
    score = below_bad + above_good
    edges = np.concatenate(([w[0] - 1], (w[:-1] + w[1:]) / 2, [w[-1] + 1]))
    gaps = np.concatenate(([0], np.diff(w), [0]))
    best = score >= score.max() - 1e-12
    return float(edges[best][np.argmax(gaps[best])])


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise from a hash of the columns: the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_highest(scores: DataFrame, column: str, k: int, rows: int = 4096) -> float:
    """The exact k-th highest value: a few thousand bins are counted, then the bin that holds it is cut again."""
    if k <= 0:
        return math.inf
    low, high = scores.agg(F.min(column), F.max(column)).first()
    while low < high:
        step = (high - low) / rows
        if not (low + step > low and high - step < high):
            break
        cell = F.least(F.floor((F.col(column) - low) / step), F.lit(rows - 1))
        inside = scores.where((F.col(column) >= low) & (F.col(column) <= high))
        counts = sorted(
            (
                (r["cell"], r["n"], r["least"], r["most"]) for r in inside.groupBy(cell.alias("cell")).agg(
                    F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"),
                ).collect()
            ),
            reverse=True,
        )
        for _, n, least, most in counts:
            if k <= n:
                low, high = least, most
                break
            k -= n
    return low


def scored(table: DataFrame, model: Model, seed: int) -> DataFrame:
    """row, doc_id, log_weight, score of ``bags``: the weight, and with Gumbel noise."""
    weighed = table.select("row", "doc_id", weight(model)("buckets", "target").alias("log_weight"))
    return weighed.withColumn("score", F.col("log_weight") + gumbel(seed, "doc_id"))


def resample(
    docs: DataFrame, labels: DataFrame, seed: int = 17, label_bound: int = LABEL_BOUND, columns: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, Model, float]:
    """Scores of all rows (doc_id, log_weight, score), the bags they come from, the model and the k-th highest score.

    Null and empty texts weigh 0, very long ones as any other at the common length. Rows with one id and text tie, and
    ties at the k-th score all stay. Extra columns, whatever their names, have no effect. Empty tables and missing labels
    keep everything.
    """
    known = written(_labelled(labels, label_bound), "labelled")
    table = bags(docs, known, columns)
    model = fit(table)
    scores = written(scored(table, model, seed).drop("row"), "scores")
    k = scores.where(F.col("log_weight") >= model.cut).count()
    return scores, table, model, kth_highest(scores, "score", k)


def kept(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the sample takes, with their columns: read back from the bags, no shuffle."""
    _, table, model, least = resample(docs, labels, seed, columns=docs.columns)
    return scored(table, model, seed).where(F.col("score") >= least).select("row.*")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score, and whether the sample keeps it."""
    scores, _, _, least = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.select("doc_id", "log_weight", "score", (F.col("score") >= least).alias("kept"))

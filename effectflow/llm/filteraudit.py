"""Filter interaction audit: what each of five filters removes under every order of applying them.

A document's failures are five bits, one of 32 codes. ``FIRST`` says for each code and each of the 120 orders at which
step the first failing filter comes (``STEPS`` where none fails): a batch of codes indexes it, and ``np.bincount`` over
(part, order, step) counts all documents, those of good and those of toxic label. Each task emits its sums once for each
part it saw; partial aggregates add them up, so what is shuffled are 720 rows a part and task, whatever the input.

All other figures follow from those sums: a filter in the first place removes all that fail it, one in the last place
what fails it alone.

Whether a text is a copy of one with a smaller doc_id is a question over the whole table: a slim table (hash of the
text, doc_id, other bits) is written, the least doc_id of each repeated hash is a partial aggregate, and both sides of
the join back are written tables, so adaptive execution splits a text that a large part of the rows share.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.llm.common import arrow_pass, plain_text, read, written

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
STEPS = len(FILTERS)  # the step of what no filter removes
PARTS_HELD = 256  # parts whose sums a task holds before it emits them
_MARKS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
_CELLS = len(ORDERS) * (STEPS + 1)


def first_failures() -> np.ndarray:
    """32 codes by 120 orders: the place of the first filter in the order whose bit the code has, else STEPS."""
    bits = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> bits) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def _facts(text: bytes, chars: int) -> tuple[int, bytes]:
    """The bits of A to D, and 128 bits of the text."""
    words = text.split()  # of bytes: at the six ASCII separators alone
    upper = len(text) - len(text.translate(None, _UPPER))
    marked = len(text.translate(None, _MARKS)) < len(text)
    code = (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * chars) << 2 | marked << 3
    return code, hashlib.sha256(text).digest()[:16]


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id, code of every row of ``docs``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column(2)
            made = [_facts(t, n) for t, n in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist())]
            yield {"part": batch.column(0), "doc_id": batch.column(1), "code": [c for c, _ in made], "hash": [h for _, h in made]}

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("part"), "doc_id", plain_text().alias("text"))
    slim = written(arrow_pass(rows, make, "part string, doc_id long, code int, hash binary"), "failures")
    least = slim.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = written(least.select("hash", "least"), "copies")
    copied = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    return slim.join(least, "hash", "left").select("part", "doc_id", (F.col("code") + copied).alias("code"))


def removals(coded: DataFrame) -> DataFrame:
    """part, cell (order * 6 + step), n, good, toxic: sums over rows (part, code, good, toxic) of ``coded``."""
    first = first_failures()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[dict]:
            for part, sums in held.items():
                yield {"part": [part] * _CELLS, "cell": np.arange(_CELLS), "n": sums[0], "good": sums[1], "toxic": sums[2]}

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            names, at = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            cells = (at[:, None] * _CELLS + np.arange(len(ORDERS)) * (STEPS + 1) + first[batch.column(1).to_numpy()]).ravel()
            labels = [None, *(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), len(ORDERS)) for k in (2, 3))]
            sums = np.stack([np.bincount(cells, w, len(names) * _CELLS).astype(np.int64) for w in labels]).reshape(3, len(names), _CELLS)
            for k, name in enumerate(names):
                held[name] = held[name] + sums[:, k] if name in held else sums[:, k]
            if len(held) > PARTS_HELD:
                yield from out()
                held = {}
        yield from out()

    found = arrow_pass(coded.select("part", "code", "good", "toxic"), make, "part string, cell int, n long, good long, toxic long")
    return found.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; zeros included.

    A null text counts as empty, a null lang as the empty string; a part is there if any document has it. Very long texts
    are whole. A null doc_id is no smaller id and has none below it; rows that repeat an id and a text aren't copies of
    one another. Of several label rows of a document, each label counts if any has it; null labels, and documents without
    any, count as neither. Extra columns, whatever their names, fall away; an empty table gives no rows.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    )
    coded = failures(docs).join(written(known, "labels"), "doc_id", "left")
    coded = coded.select("part", "code", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    sums = written(removals(coded), "removals")  # 720 rows a part
    order = F.array(*[F.lit(o) for o in ORDERS])[F.expr(f"cell div {STEPS + 1}")]
    rows = sums.select("part", order.alias("filter_order"), (F.col("cell") % (STEPS + 1) + 1).alias("step"), "n", "good", "toxic")
    run = Window.partitionBy("part", "filter_order").orderBy(F.desc("step"))
    later = F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.withColumn("kept", later).where(F.col("step") <= STEPS)
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    of = Window.partitionBy("part", "filter")
    total = lambda step: F.max(F.when(F.col("step") == step, F.col("n"))).over(of)
    return steps.select(
        "part", "filter_order", "step", "kept", F.col("n").alias("removed"), (total(1) - F.col("n")).alias("redundant"),
        total(STEPS).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(of).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by lang."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_ORDERS_SQL = ", ".join(f"('{o}')" for o in ORDERS)
SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1
), marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS f
  FROM words JOIN least USING (t) LEFT JOIN marks USING (doc_id)
), codes AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f
), grid AS (SELECT part, o, s, o[s] AS x, o[1:s - 1] AS before FROM (SELECT DISTINCT part FROM codes), (VALUES {_ORDERS_SQL}) v(o), (VALUES (1), (2), (3), (4), (5)) n(s)
), seen AS (
  SELECT part, o, s, x, n, good, toxic, f, CASE WHEN f = '' OR before = '' THEN false ELSE regexp_matches(f, '[' || before || ']') END AS gone, contains(f, x) AS hit
  FROM grid JOIN codes USING (part)
), steps AS (
  SELECT part, o, s, x, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM steps
"""

"""Token counts: separator scan over flat token files.

A flat token file is ids one after another, each document ended by the end-of-document id, with no index. Here a file
is a table of fixed-size blocks (file, block, data), cut without regard to documents, so that files of any length are
read in parallel. One vectorised search a block finds the separators. A block alone knows the lengths between its own
separators; what lies before its first one depends on earlier blocks. A prefix scan over one short row a block (tokens so
far, separators so far, position after the last separator so far) gives each block its carry, and the first document of
each block is closed with it. The scan has two levels, parts of a file and blocks of a part, so that one file of any
length is scanned in many tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.llm.common import arrow_pass, plain_text, read, written

BLOCK_TOKENS = 1 << 18
PART_BLOCKS = 1 << 12  # of a file that one task of the prefix scan carries through
END_OF_DOCUMENT = 50256
_loaded: dict[str, object] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encoder(path: str):
    """One tokenizer a Python worker; strings of special tokens are ordinary text to it."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("documents", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def write_flat(docs: DataFrame, path: str, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token files of ``docs``, one a partition: rows (file, block, data, ids).

    ``data`` has little-endian unsigned 16-bit ids. Rows with blocks -1, -2, ... list the ids of the
    file's documents in order: a manifest without counts or positions. Null and empty texts have no tokens but their end;
    a very long text is encoded whole and lies in as many blocks as it needs. Repeated rows and null ids are listed as they
    are; extra columns fall away; an empty table gives no rows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        file, block, listed = TaskContext.get().partitionId(), 0, 0
        buffer, held, ids = [], 0, []
        tokens = encoder(path)
        mark = np.array([end], np.uint16)
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                buffer += [np.array(tokens.encode_ordinary(text), np.uint16), mark]
                held += len(buffer[-2]) + 1
                ids.append(key)
                if held >= block_tokens:
                    flat = np.concatenate(buffer)
                    whole = len(flat) // block_tokens * block_tokens
                    for at in range(0, whole, block_tokens):
                        yield {"file": [file], "block": [block], "data": [flat[at : at + block_tokens].tobytes()], "ids": [None]}
                        block += 1
                    buffer, held = [flat[whole:]], len(flat) - whole
            if ids:
                yield {"file": [file], "block": [-1 - listed], "data": [None], "ids": [ids]}
                listed, ids = listed + 1, []
        if held:
            yield {"file": [file], "block": [block], "data": [np.concatenate(buffer).tobytes()], "ids": [None]}

    return arrow_pass(docs.select("doc_id", plain_text().alias("text")), make, "file long, block long, data binary, ids array<long>")


def scan(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """file, ordinal, n_tokens of every document of flat token files given as (file, block, data).

    ``n_tokens`` is without the separator. Tokens behind a file's last separator are an unended document and counted as
    one. Empty documents (two separators in a row) count 0. An empty or null block changes nothing, an empty table gives
    an empty result. (file, block) must be unique; further columns fall away.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                flat = np.frombuffer(data or b"", np.uint16)
                at = np.flatnonzero(flat == end)
                inner = np.diff(at) - 1
                yield {
                    "file": [file], "block": [block], "tokens": [len(flat)], "ends": [len(at)],
                    "first": [int(at[0]) if len(at) else None], "after": [int(at[-1]) + 1 if len(at) else None], "inner": [inner],
                }

    found = written(
        arrow_pass(
            blocks.select("file", "block", "data"), find,
            "file long, block long, tokens long, ends long, first long, after long, inner array<int>",
        ),
        "separators",
    )
    placed = _carried(found.select("file", "block", "tokens", "ends", "first", "after"))
    heads = placed.where("ends > 0").select("file", "ordinal", (F.col("start") + F.col("first") - F.col("carry")).alias("n_tokens"))
    firsts = placed.where("ends > 1").select("file", "block", "ordinal")
    inside = found.where("ends > 1").select("file", "block", "inner").join(firsts, ["file", "block"])
    inside = inside.select("file", "ordinal", F.posexplode("inner").alias("k", "n"))
    inside = inside.select("file", (F.col("ordinal") + F.col("k") + 1).alias("ordinal"), F.col("n").cast("long").alias("n_tokens"))
    closed = F.coalesce(F.max(F.col("start") + F.col("after")), F.lit(0))
    tails = placed.groupBy("file").agg(F.sum("ends").alias("ordinal"), (F.sum("tokens") - closed).alias("n_tokens")).where("n_tokens > 0")
    return heads.unionByName(inside).unionByName(tails)


def _carried(blocks: DataFrame) -> DataFrame:
    """Rows (file, block, tokens, ends, first, after) with what lies before: ``start`` (tokens), ``ordinal`` (documents
    ended), ``carry`` (the place after the last separator, 0 without any). A written table."""
    rows = blocks.withColumn("part", F.floor(F.col("block") / PART_BLOCKS))
    within = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("start", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    local = local.withColumn("ordinal", F.coalesce(F.sum("ends").over(within), F.lit(0)))
    local = written(local.withColumn("carry", F.max(F.col("start") + F.col("after")).over(within)), "carried-in-parts")
    parts = local.groupBy("file", "part").agg(
        F.sum("tokens").alias("all"), F.sum("ends").alias("ended"), F.max(F.col("start") + F.col("after")).alias("closed"),
    )
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("from", F.coalesce(F.sum("all").over(before), F.lit(0)))
    parts = parts.withColumn("first_ordinal", F.coalesce(F.sum("ended").over(before), F.lit(0)))
    parts = parts.withColumn("reached", F.coalesce(F.max(F.col("from") + F.col("closed")).over(before), F.lit(0)))
    out = local.join(parts.select("file", "part", "from", "first_ordinal", "reached"), ["file", "part"])
    carry = F.greatest(F.coalesce(F.col("from") + F.col("carry"), F.lit(0)), F.col("reached"))
    out = out.withColumn("carry", carry).withColumn("start", F.col("start") + F.col("from")).withColumn(
        "ordinal", F.col("ordinal") + F.col("first_ordinal"),
    )
    return written(out.drop("part", "from", "first_ordinal", "reached"), "carried")


def named(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Counts with the documents' ids: the manifest's lists in order, one a document."""
    lists = manifest.select("file", (-1 - F.col("block")).alias("at"), "ids", F.size("ids").alias("n"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = lists.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ids = placed.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id",
    )
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, file, ordinal, n_tokens for every row of ``docs``, by writing flat files and scanning them. Each row counts,
    repeated ones and those without an id too; ties have nothing to decide."""
    flat = written(write_flat(docs, path or tokenizer_path()), "flat")
    return named(scan(flat.where("block >= 0")), flat.where("block < 0"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat token files."""
    return token_counts(read(spark, sf_dir, "documents"))

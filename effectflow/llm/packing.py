"""Packing: shortest-pack-first over the length histogram.

One pass tokenizes each whole text and cuts it into pieces of at most ``capacity`` ids. Packing then sees only the
histogram of piece lengths: lengths are placed longest first, always into the shortest open packs, and packs with
one history are a group with a count. A placement says: pieces of this length, ranks ``lo`` to ``hi``, lie in
sequences from ``sequence`` on at this offset. Pieces get their rank within their length in salted blocks and join
the placements by it. Work on the driver is bounded by the number of lengths and groups, not by the documents.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.llm.common import arrow_pass, plain_text, read, written

CAPACITY = 2048
END_ID = 1
BLOCK = 250  # pieces ranked in one block, or more, for at most MOST_BLOCKS beside one a length
MOST_BLOCKS = 100_000
PLACEMENTS_MOST = 100_000  # of 40 bytes, to be broadcast
PLACEMENT_ROWS = 1 << 16  # ranks of one length that share a key of the join, where placements are more
_CACHE_MOST = 100_000
#: Texts of these characters alone are cut by the tokenizer's published word pattern; in others, each chunk that has
#: one of them is left to the tokenizer. (Beyond Latin letters, lower-casing and composing may differ.)
_SPECIAL = re.compile("[^\x00-ſ]|[İ\xb2\xb3\xb9\xbc-\xbe\x0b\x0c\x1c-\x1f\x85\xa0]")
_CHUNK = re.compile(r"[^ \n\t\r]+")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, then from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Texts to ids as little-endian 32-bit bytes, a batch at a time.

    The tokenizer drops white space and never joins across it or across its words, so a text's ids are those of its
    chunks, and a chunk's those of its words. Each chunk and word is looked up once a batch; the first
    ``_CACHE_MOST`` of each stay for later batches. Strings of special tokens get these tokens' ids, as in a plain call of
    the tokenizer, unless ``special_as_text``; a chunk with one is left to the tokenizer.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.words) < _CACHE_MOST:
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if _SPECIAL.search(chunk) or any(token in low for token in self.added):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._word, _WORD.findall(low)))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        known = self.chunks
        cut = [_CHUNK.findall(t) if _SPECIAL.search(t) else t.split() for t in texts]
        new = set().union(*cut).difference(known) if cut else ()
        for chunk in new:
            known[chunk] = self._chunk(chunk)
        for chunks in cut:
            yield b"".join(map(known.__getitem__, chunks))
        if len(known) > _CACHE_MOST:
            for chunk in new:
                del known[chunk]


_loaded: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, special_as_text: bool = False) -> WordIds:
    """One per Python worker."""
    key = (path, special_as_text)
    if key not in _loaded:
        _loaded[key] = WordIds(*key)
    return _loaded[key]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full pieces of ``capacity`` ids and the rest, for every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, names = word_ids(path, special_as_text), ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    stop = min(n, start + capacity)
                    out.append((key, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n))
            if out:
                yield dict(zip(names, map(list, zip(*out))))

    return arrow_pass(
        docs.select("doc_id", plain_text().alias("text")), make,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
    )


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, lo, hi, sequence, offset) of all pieces of a length histogram.

    Pieces that no open pack takes fill new ones with as many as fit, one after the other.
    """
    out, open_packs, next_sequence, made = [], [], 0, 0

    def keep(total: int, sequence: int, count: int) -> None:
        nonlocal made
        if count and total < capacity:
            made += 1
            heapq.heappush(open_packs, (total, made, sequence, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and open_packs and open_packs[0][0] + length <= capacity:
            total, _, sequence, count = heapq.heappop(open_packs)
            used = min(count, left)
            out.append((length, rank, rank + used, sequence, total))
            keep(total + length, sequence, used)
            keep(total, sequence + used, count - used)
            rank, left = rank + used, left - used
        each = capacity // length
        for packs, pieces in ((left // each, each), (1, left % each)):
            if packs and pieces:
                for level in range(pieces):
                    out.append((length, rank, rank + packs, next_sequence, level * length))
                    rank += packs
                keep(pieces * length, next_sequence, packs)
                next_sequence += packs
    return out


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their rank among those of their length, and the histogram.

    A length with many pieces is ranked in salted blocks; the blocks' counts (a bounded number) give each block its
    first rank.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    block = max(BLOCK, -(-sum(histogram.values()) // MOST_BLOCKS))
    salts = spark.createDataFrame([(k, n // block + 1) for k, n in histogram.items()] or [(0, 1)], "length long, salts long")
    dealt = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")),
    ).drop("salts")
    firsts, at = [], dict.fromkeys(histogram, 0)
    for r in sorted(dealt.groupBy("length", "salt").count().collect()):
        firsts.append((r["length"], r["salt"], at[r["length"]]))
        at[r["length"]] += r["count"]
    first = spark.createDataFrame(firsts or [(0, 0, 0)], "length long, salt long, first long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    out = dealt.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(first), ["length", "salt"])
    return out.withColumn("rank", F.col("rank") + F.col("first")).drop("first", "salt"), histogram


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """Every row's pieces in their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the end id. A text of any length is cut into full pieces and a rest. Rows
    that repeat are packed as often; pieces of one length are ranked by id, start and ids, so ties are equal pieces.
    A sequence is padded to the capacity unless its ids are a power of two. Extra columns fall away. An empty table gives
    an empty result. Strings of special tokens in a text are those tokens; ``special_as_text`` takes them as text.

    Placements are broadcast if they are at most PLACEMENTS_MOST (in practice some ten a length, whatever the number of
    documents). More of them join by a shuffle, on length and block of ranks, so that a length that most pieces have is
    spread over as many keys as it has blocks.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, path or tokenizer_path(), capacity, special_as_text), "pieces")
    with_rank, histogram = ranked(pieces)
    placements = shortest_pack_first(histogram, capacity)
    table = spark.createDataFrame(placements or [(0, 0, 0, 0, 0)], "__length long, lo long, hi long, first long, offset long")
    inside = (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    if len(placements) <= PLACEMENTS_MOST:
        joined = with_rank.join(F.broadcast(table), inside)
    else:
        block = lambda rank: F.floor(rank / PLACEMENT_ROWS).cast("long")
        cut = table.withColumn("__block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))))
        joined = with_rank.join(cut, inside & (block(F.col("rank")) == F.col("__block")))
    sequence = (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id")
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence, "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return pack(read(spark, sf_dir, "documents"))

"""N-gram Jaccard self-join with a count-vector R-tree, and its components.

A text is a set of distinct word shingles; texts link when intersection / union reaches a threshold. The join is exact:

1. Texts with one set are one class; the least id stands for it.
2. Shingles are hashed into 64 groups and the counts are a point; larger sets count in more groups, each halving one of
   the coarser. The overlap of two sets is at most the sum of coordinate minima. An R-tree over such points alone can't
   part a corpus (between unlike texts the bound of whole nodes nearly always holds), so there is one tree for each set
   of classes that can link at all, a *group*: of the shingles in one global order (by their counts, then by hash), two
   sets over the threshold share one among their first ``n - ceil(t * n) + 1``. Classes that share such a shingle meet
   in the group of the least id among them. As the rarest come first, what many texts share is last in their order: a
   group is large only where nearly all that its members say is said that often.
3. Members of a group are sorted by size and cut in blocks of bounded rows and shingles, from the first row on: blocks
   are the tree's nodes, dealt by ranges, so a group of any size is spread over as many tasks as it has blocks. Within
   a block a packed tree is searched, a node's coordinate maxima bounding the overlap with any point below, and at the
   leaves the bound is taken again in the finest counts that both points have. Between blocks of one group, pairs of
   nodes that the summed minima exclude are dropped first. This names the members that have a partner within the bound.
4. The sets of those are made again from their texts, and blocks and trees are made and searched again; what survives
   is verified on the sets. Pairs that are linked already, directly or not, are skipped, so a block of n near copies
   costs about n verifications and gives at most n - 1 links. Blocks that follow one another are joined next, which
   connects a large group of near copies; whoever isn't in its group's largest component then asks every other block
   that the bound leaves. Then components of all links.

Counts only steer the order, and any order is right. They are those of a sketch: every shingle of every text counts in a
bucket of its hash. There are four buckets a row, within bounds, so that at most 32 MB are sent to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.llm.common import arrow_pass, plain_text, read, written
from effectflow.llm.components import roots
from effectflow.llm.fingerprint import _tables

GROUPS = 64  # of the tree
FILL = 8  # points have as many groups as leave FILL shingles for one
LEAF = 16
COUNTED = 1 << 20  # shingles counted at once
SKETCH_BITS = (16, 23)  # least and most, of the number of buckets
SLICE = 1 << 14  # buckets that are summed together
BLOCK_ROWS = 2048  # of a group that are in memory together
BLOCK_SHINGLES = 1 << 21  # of these (a larger set is a block of its own)
COARSE = 8  # groups of the bounds between whole blocks
BROADCAST_IDS = 1_000_000  # of 8 or 16 bytes
_LONG = "array<long>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    split = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], split, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lower = np.where((data >= 65) & (data <= 90), data | 32, data)
    up, down = _tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    return _mix((sums[ends] - sums[starts]) * down[starts])


def _shingled(w: np.ndarray, words: int) -> np.ndarray:
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
    return h


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; fewer words than a shingle are one shingle."""
    w = word_hashes(text)
    return np.unique(_shingled(w, words)) if len(w) else w


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash, of ``n`` (a power of two)."""
    return (h >> np.uint64(65 - n.bit_length())).astype(np.int64)


def profile(text: str, words: int, num: int, den: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of a text, and its first shingles in the global order, as many as two linked sets must share one of."""
    found = shingles(text, words)
    if not len(found):
        return found, found
    order = np.argsort(counts[_buckets(found, len(counts))], kind="stable")
    return found, found[order[: prefix_length(len(found), num, den)]]


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all texts fall into each bucket. A task sends its counts in slices, which are summed by slice."""
    low, high = SKETCH_BITS
    n = 1 << min(max(docs.count().bit_length() + 2, low), high)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, held, size = np.zeros(n, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = word_hashes(text)
                if len(w):
                    held.append(_shingled(w, words))
                    size += len(held[-1])
                if size >= COUNTED:
                    counts += np.bincount(_buckets(np.concatenate(held), n), minlength=n)
                    held, size = [], 0
        if held:
            counts += np.bincount(_buckets(np.concatenate(held), n), minlength=n)
        parts = counts.reshape(-1, SLICE)
        for k in np.flatnonzero(parts.any(axis=1)):
            yield {"slice": [int(k)], "counts": [parts[k].tobytes()]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.int64)
        for k, part in sums.items():
            yield {"slice": [k], "counts": [np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes()]}

    parts = arrow_pass(docs.select(plain_text().alias("text")), count, "slice long, counts binary").repartition("slice")
    found = written(arrow_pass(parts, add, "slice long, counts binary"), "sketch").collect()  # 4 bytes a bucket
    out = np.zeros((n // SLICE, SLICE), np.uint32)
    for row in found:
        out[row["slice"]] = np.frombuffer(row["counts"], np.uint32)
    return out.ravel()


def profiles(docs: DataFrame, words: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """doc_id, n, set_id (128 bits of the whole set; null if empty), prefix, point (its counts by hash group)."""

    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n, ids, prefix, points = [], [], [], []
            for text in batch.column(1).to_pylist():
                found, first = profile(text, words, num, den, shared.value)
                n.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                prefix.append(first.view(np.int64))
                points.append(point(found).astype(np.uint16).tobytes())  # a few a group, however long the text
            yield {"doc_id": batch.column(0), "n": n, "set_id": ids, "prefix": prefix, "point": points}

    return arrow_pass(docs.select("doc_id", plain_text().alias("text")), make, f"doc_id long, n long, set_id binary, prefix {_LONG}, point binary")


def point(found: np.ndarray) -> np.ndarray:
    """A set as counts of its shingles by hash group."""
    groups = GROUPS
    while len(found) > FILL * groups:
        groups *= 2
    return np.bincount((found >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups).astype(np.int32)


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts (of the last axis) in fewer groups."""
    return counts.reshape(*counts.shape[:-1], groups, -1).sum(axis=-1)


class CountTree:
    """An R-tree over count vectors: ``reach`` gives the points that a query's bound doesn't exclude."""

    def __init__(self, points: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.points = num, den, points
        self.counts = np.stack([_folded(p, GROUPS) for p in points])
        self.sizes = self.counts.sum(axis=1)
        self.groups = np.array([len(p) for p in points])
        self.row = np.zeros(len(points), np.int64)
        self.fine = {}
        for g in np.unique(self.groups):
            at = np.flatnonzero(self.groups == g)
            self.row[at] = np.arange(len(at))
            self.fine[int(g)] = np.stack([points[k] for k in at])
        self.order, cuts = self._packed(np.arange(len(points)))
        bounds = np.concatenate((cuts, [len(points)]))
        self.levels = []  # from the leaves up: first child, end child, maxima, least size, most size
        top, least, most = (f.reduceat(x[self.order], cuts) for f, x in ((np.maximum, self.counts), (np.minimum, self.sizes), (np.maximum, self.sizes)))
        self.levels.append((bounds[:-1], bounds[1:], top, least, most))
        while len(top) > LEAF:
            cuts = np.arange(0, len(top), LEAF)
            ends = np.minimum(cuts + LEAF, len(top))
            top, least, most = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((cuts, ends, top, least, most))

    def _packed(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points in the order of the leaves, split by halves on the widest coordinate; where leaves begin."""
        out, cuts, at, stack = [], [], 0, [points]
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                out.append(part)
                cuts.append(at)
                at += len(part)
                continue
            spread = self.counts[part].astype(np.float64).var(axis=0)
            part = part[np.argsort(self.counts[part, int(spread.argmax())], kind="stable")]
            stack += [part[len(part) // 2 :], part[: len(part) // 2]]
        return np.concatenate(out), np.array(cuts)

    def _fits(self, overlap: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
        """Whether ``overlap / (size + sizes - overlap) >= num / den``."""
        return (self.num + self.den) * overlap >= self.num * (size + sizes)

    def reach(self, i: int) -> np.ndarray:
        """Points, the i-th among them, whose bound with the i-th allows a link."""
        num, den, query, size = self.num, self.den, self.counts[i], int(self.sizes[i])
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            first, end, top, least, most = (x[nodes] for x in self.levels[depth])
            overlap = np.minimum(top, query).sum(axis=1)
            fits = self._fits(overlap, size, least) & (num * least <= den * size) & (most * den >= num * size)
            first, end = first[fits], end[fits]
            n = end - first
            nodes = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        found = self.order[nodes]
        found = found[self._fits(np.minimum(self.counts[found], query).sum(axis=1), size, self.sizes[found])]
        kept = []
        for g in np.unique(self.groups[found]):
            part = found[self.groups[found] == g]
            both = min(int(g), int(self.groups[i]))
            overlap = np.minimum(_folded(self.fine[int(g)][self.row[part]], both), _folded(self.points[i], both)).sum(axis=1)
            kept.append(part[self._fits(overlap, size, self.sizes[part])])
        return np.concatenate(kept) if kept else found


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def join_group(
    ids: list[int], sets: list[np.ndarray], num: int, den: int, label: list[int] | None = None, probe: list[bool] | None = None, side: list[int] | None = None
) -> list[tuple[int, int]]:
    """Links that connect the components of sorted sets. ``label``: what is connected before; ``probe``: pairs need one of
    these; ``side``: pairs need one of each."""
    g = len(ids)
    if g < 2:
        return []
    part = np.unique(np.array(ids if label is None else label), return_inverse=True)[1].astype(np.int64)
    asks = np.ones(g, bool) if probe is None else np.array(probe, bool)
    of = np.arange(g) if side is None else np.array(side)
    tree = CountTree([point(s) for s in sets], num, den)
    counts = tree.counts
    turn = np.argsort(np.abs(counts - counts.mean(axis=0)).sum(axis=1) if g > LEAF else np.arange(g), kind="stable")
    done = np.zeros(g, bool)
    links = []
    for i in turn:
        done[i] = True
        if (part == part[i]).all():
            break
        found = tree.reach(i)
        found = found[~done[found] & (part[found] != part[i]) & (asks[found] | asks[i]) & (of[found] != of[i])]
        for j in found[np.argsort(-np.minimum(counts[found], counts[i]).sum(axis=1), kind="stable")]:
            if part[j] != part[i] and _linked(sets[i], sets[j], num, den):
                links.append((ids[i], ids[j]))
                part[part == part[j]] = part[i]
    return links


def partnered(
    ids: list[int], points: list[np.ndarray], num: int, den: int, settled: list[bool] | None = None,
    side: list[int] | None = None,
) -> np.ndarray:
    """Which points have another id (of the other side, if sides are given) within the bound, or are settled before."""
    named = np.zeros(len(ids), bool) if settled is None else np.array(settled, bool)
    if len(ids) < 2 or named.all():
        return named
    tree, key = CountTree(points, num, den), np.array(ids)
    of = np.arange(len(ids)) if side is None else np.array(side)
    for i in np.flatnonzero(~named):
        if not named[i]:
            found = tree.reach(i)
            found = found[(key[found] != key[i]) & (of[found] != of[i])]
            named[found] = True
            named[i] = len(found) > 0
    return named


def _values(column: pa.Array) -> list[np.ndarray]:
    """Arrays of hashes, or counts from binary, as numpy."""
    if pa.types.is_list(column.type):
        flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        return [flat[a:b].copy() for a, b in zip(at[:-1], at[1:])]
    return [np.frombuffer(v, np.uint16).astype(np.int32) for v in column.to_pylist()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches; the last column as numpy."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[:-1]), _values(batch.columns[-1]))


@dataclass
class Block:
    """Rows of one group that are in memory together. ``whole``: no other block has rows of the group."""

    group: int
    number: int
    whole: bool
    n: list[int]
    ids: list[int]
    values: list[np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], most_rows: int, most_shingles: int) -> Iterator[Block]:
    """Blocks of rows (group, n, doc_id, value) sorted by these: a run of one group's rows in this partition, cut at the
    limits. Only a run that neither touches an end of the partition nor was cut is known to be whole."""
    from pyspark import TaskContext

    number, now, held, weight, first, cut = TaskContext.get().partitionId() << 32, None, ([], [], []), 0, True, False

    def made(last: bool) -> Block:
        return Block(now, number, not (first or last or cut), *held)

    for group, n, key, value in _rows(batches):
        full = len(held[0]) >= most_rows or weight + n > most_shingles
        if held[0] and (group != now or full):
            cut = cut or group == now
            yield made(False)
            first, cut = False, group == now
            number, held, weight = number + 1, ([], [], []), 0
        now, weight = group, weight + n
        for column, x in zip(held, (n, key, value)):
            column.append(x)
    if held[0]:
        yield made(True)


def _coarse(value: np.ndarray) -> list[int]:
    """A point or a set as counts in COARSE groups, for the bounds of whole blocks."""
    return _folded(value if value.dtype == np.int32 else point(value), COARSE).tolist()


def _in_blocks(rows: DataFrame, value: str, work: Callable[[Block], tuple[list, list | None]], mark: str) -> DataFrame:
    """One pass over rows (group, n, doc_id, value) that are dealt by ranges of (group, n, doc_id): a large group takes as
    many blocks and tasks as it needs, whatever its size. ``work(block)`` gives links (a, b) and a mark for each row.

    Returns rows (a, b) of links, and (group, block, doc_id, n, mark, coarse, value) of marked rows; ``coarse`` and
    ``value`` are null where the block is the whole group, as such rows meet nobody else.
    """
    dealt = rows.select("group", "n", "doc_id", value).repartitionByRange("group", "n", "doc_id").sortWithinPartitions("group", "n", "doc_id")
    kind, limits = dict(rows.dtypes)[value], (BLOCK_ROWS, BLOCK_SHINGLES)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out = {k: [] for k in ("a", "b", "group", "block", "doc_id", "n", mark, "coarse", value)}
        held = 0

        def add(**row: object) -> None:
            for k, column in out.items():
                column.append(row.get(k))

        for block in _blocks(batches, *limits):
            links, marks = work(block)
            for a, b in links:
                add(a=a, b=b)
            for n, key, x, m in zip(block.n, block.ids, block.values, marks):
                if not block.whole:
                    stored = x.astype(np.uint16).tobytes() if kind == "binary" else x.view(np.int64)
                    add(group=block.group, block=block.number, doc_id=key, n=n, coarse=_coarse(x), **{mark: m, value: stored})
                    held += n
                elif m is True:
                    add(group=block.group, block=block.number, doc_id=key, n=n, **{mark: m})
            if held > limits[1] // 4 or len(out["a"]) >= limits[0]:
                yield out
                out, held = {k: [] for k in out}, 0
        if out["a"]:
            yield out

    kinds = f"a long, b long, group long, block long, doc_id long, n long, {mark} {
        'boolean' if mark == 'named' else 'long'
    }, coarse array<int>, {value} {kind}"
    return arrow_pass(dealt, make, kinds)


def _heads(open_: DataFrame) -> DataFrame:
    """Nodes above the points: each block's least and most size, maxima of its coarse counts, and whether it asks."""
    tops = [F.max(F.col("coarse")[k]).alias(f"c{k}") for k in range(COARSE)]
    every = open_.groupBy("group", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.bool_or("asks").alias("asks"), *tops)
    several = every.groupBy("group").agg(F.count("*").alias("blocks")).where("blocks > 1").select("group")
    return written(every.join(several, "group", "left_semi"), "heads")


def _node_pairs(heads: DataFrame, num: int, den: int) -> DataFrame:
    """(group, i, j, i_asks, j_asks): pairs of a group's blocks that the summed coordinate minima don't exclude."""
    a = heads.select("group", *[F.col(c).alias(f"i_{c}") for c in heads.columns if c != "group"])
    b = heads.select("group", *[F.col(c).alias(f"j_{c}") for c in heads.columns if c != "group"])
    overlap = sum((F.least(F.col(f"i_c{k}"), F.col(f"j_c{k}")) for k in range(COARSE)), F.lit(0))
    sizes = (F.col("i_most") * den >= F.col("j_least") * num) & (F.col("j_most") * den >= F.col("i_least") * num)
    fits = sizes & (overlap * (num + den) >= (F.col("i_least") + F.col("j_least")) * num)
    pairs = a.join(b, "group").where((F.col("i_block") < F.col("j_block")) & (F.col("i_asks") | F.col("j_asks")) & fits)
    return pairs.select("group", F.col("i_block").alias("i"), F.col("j_block").alias("j"), "i_asks", "j_asks")


def _across(open_: DataFrame, pairs: DataFrame, value: str, work: Callable[[dict[str, list]], dict | None], schema: str) -> DataFrame:
    """``work(columns)`` for each pair of blocks: the rows of either side that ask, or whose other side has some that do."""
    columns = ["doc_id", "group", "label", "asks", value]
    sides = []
    for side, own, other in ((0, "i", "j"), (1, "j", "i")):
        met = open_.join(pairs.withColumnRenamed(own, "block"), ["group", "block"]).where(F.col("asks") | F.col(f"{other}_asks"))
        sides.append(met.select(F.col("block").alias(own), other, F.lit(side).alias("side"), *columns).select("i", "j", "side", *columns))
    dealt = sides[0].unionByName(sides[1]).repartition("i", "j").sortWithinPartitions("i", "j", "side", "doc_id")
    names = ["i", "j", "side", *columns]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, held = None, {}
        for row in _rows(batches):
            if row[:2] != key:
                if key and (out := work(held)):
                    yield out
                key, held = row[:2], {n: [] for n in names[2:]}
            for n, x in zip(names[2:], row[2:]):
                held[n].append(x)
        if key and (out := work(held)):
            yield out

    return arrow_pass(dealt, make, schema)


def _few(ids: DataFrame) -> DataFrame:
    """Rows of one or two ids, to be broadcast if they are at most BROADCAST_IDS, else joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id, n, shingles of the documents with these (distinct) ids, from their texts again."""
    wanted = docs.select("doc_id", plain_text().alias("text")).join(_few(ids), "doc_id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "n": [len(s) for s in found], "shingles": [s.view(np.int64) for s in found]}

    return arrow_pass(wanted, make, f"doc_id long, n long, shingles {_LONG}")


def _meetings(tokens: DataFrame) -> DataFrame:
    """(group, doc_id) of all that share a token with another id: the least id among those with the token is the group.

    The least id is a partial aggregate; both sides of the join back are written tables, so that adaptive execution
    splits a token that a large part of the rows have.
    """
    least = tokens.groupBy("token").agg(F.min("doc_id").alias("group"), F.max("doc_id").alias("last"))
    least = written(least.where(F.col("group") < F.col("last")).select("token", "group"), "tokens")
    met = written(tokens.join(least, "token").where("doc_id <> group").select("group", "doc_id").distinct(), "met")
    return met.unionByName(met.select("group", F.col("group").alias("doc_id")).distinct())


def _members(met: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """(group, doc_id) of ``met`` that have a partner within the bound: trees of points within blocks, then pairs of blocks."""

    def within(block: Block) -> tuple[list, list]:
        return [], partnered(block.ids, block.values, num, den).tolist()

    found = written(_in_blocks(met.join(points, "doc_id"), "point", within, "named"), "named")
    named = found.where("named").select("group", "doc_id")
    open_ = found.where("point IS NOT NULL").withColumn("asks", ~F.col("named")).withColumn("label", F.lit(0).cast("long"))
    heads = _heads(open_)
    pairs = written(_node_pairs(heads, num, den), "point-pairs")
    if pairs.isEmpty():
        return named.distinct()

    def across(held: dict[str, list]) -> dict | None:
        settled = [not x for x in held["asks"]]
        now = partnered(held["doc_id"], held["point"], num, den, settled, held["side"])
        new = [k for k in np.flatnonzero(now) if not settled[k]]
        return {c: [held[c][k] for k in new] for c in ("group", "doc_id")} if new else None

    return named.unionByName(written(_across(open_, pairs, "point", across, "group long, doc_id long"), "named-across")).distinct()


def _links(docs: DataFrame, tokens: DataFrame, points: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links that connect all that is linked among the classes of ``tokens`` (doc_id, token); ``points``: doc_id, n, point."""
    members = written(_members(_meetings(tokens), points, num, den), "members")
    sets = written(_sets(docs, members.select("doc_id").distinct(), words), "sets").where("n > 0")

    def within(block: Block) -> tuple[list, list]:
        labels = _labels(block.ids, join_group(block.ids, block.values, num, den))
        return _stars(block.ids, labels), labels

    found = written(_in_blocks(members.join(sets, "doc_id"), "shingles", within, "label"), "linked")
    links = found.where("a IS NOT NULL").select("a", "b")
    open_ = found.where("shingles IS NOT NULL")
    heads = _heads(open_.withColumn("asks", F.lit(True)))
    if heads.isEmpty():
        return links

    def across(held: dict[str, list]) -> dict | None:
        got = join_group(held["doc_id"], held["shingles"], num, den, held["label"], held["asks"], held["side"])
        got = _stars(held["doc_id"], _labels(held["doc_id"], got))
        return {"a": [a for a, _ in got], "b": [b for _, b in got]} if got else None

    # neighbours in the order of sizes first: they connect a group of near copies to one component
    next_ = heads.withColumn("next", F.lead("block").over(Window.partitionBy("group").orderBy("block"))).select("group", "block", "next")
    chain = next_.where("next IS NOT NULL").select(
        "group", F.col("block").alias("i"), F.col("next").alias("j"), F.lit(True).alias("i_asks"), F.lit(True).alias("j_asks"),
    )
    chain = written(chain, "chain")
    links = links.unionByName(written(_across(open_.withColumn("asks", F.lit(True)), chain, "shingles", across, "a long, b long"), "links-chain"))
    # whoever isn't in its group's largest component then asks all blocks that the bound leaves
    found = roots(links)
    links = found.select(F.col("node").alias("a"), F.col("root").alias("b"))  # stars, for what comes next
    root = found.select(F.col("node").alias("doc_id"), "root")
    several = written(heads.select("group").distinct(), "several")
    labelled = open_.join(_few(several), "group", "left_semi").drop("label").join(root, "doc_id", "left")
    labelled = written(labelled.withColumn("label", F.coalesce("root", "doc_id")).drop("root"), "labelled")
    most = labelled.groupBy("group", "label").agg(F.count("*").alias("k"))
    most = written(most.groupBy("group").agg(F.max_by("label", F.struct("k", "label")).alias("main")), "main")
    asking = labelled.join(_few(most), "group").withColumn("asks", F.col("label") != F.col("main")).drop("main")
    asking = written(asking, "asking")
    pairs = _node_pairs(_heads(asking), num, den).join(chain.select("group", "i", "j"), ["group", "i", "j"], "left_anti")
    pairs = written(pairs, "set-pairs")
    if pairs.isEmpty():
        return links
    return links.unionByName(written(_across(asking, pairs, "shingles", across, "a long, b long"), "links-across"))


def _labels(ids: list[int], links: list[tuple[int, int]]) -> list[int]:
    """The least id of each row's component under links."""
    root = {k: k for k in ids}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(k) for k in ids]


def _stars(ids: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Links of each row with its label: components of stars take fewer steps than those of paths."""
    return [(k, x) for k, x in zip(ids, labels) if k != x]


def similarity_components(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: exact components of Jaccard >= num / den.

    Null texts and texts without words have no shingles and are alone. Rows that repeat a text are linked. Rows that
    share an id are one document with several texts: it is linked with whatever one of them is. Very long texts are one
    set like any other. Ties (one token, one size) are in order of ids. A null doc_id is left alone. Extra columns,
    whatever their names, fall away; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    table = written(profiles(docs, words, num, den, sketch(docs, words)), "profiles")
    full = table.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
    named = written(table.select("doc_id", "n", "set_id").join(classes, "set_id", "left").drop("set_id"), "reps")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    copies = written(named.where("doc_id <> rep").select("doc_id").distinct().join(reps, "doc_id", "left_anti"), "copies")
    tokens = full.join(_few(copies), "doc_id", "left_anti").select("doc_id", F.explode("prefix").alias("token"))
    points = table.where("n > 0").select("doc_id", "n", "point")
    links = _links(docs, tokens, points, words, num, den)
    known = named.where("rep IS NOT NULL AND doc_id IS NOT NULL")
    shared = written(
        known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc_id", "a"),
        "shared",
    )
    same = known.join(shared, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    root = roots(links.unionByName(same))
    out = named.join(root, named.rep == root.node, "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("root", "rep")).alias("component_id"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents with three-word shingles at a Jaccard of 0.9."""
    return similarity_components(read(spark, sf_dir, "documents"), 3, 90, 100)


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT reached.doc_id, steps.b FROM reached JOIN steps ON reached.other = steps.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) USING (doc_id)
"""

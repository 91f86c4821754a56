"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, in DataFrame functions alone.

A window is ``WINDOW`` consecutive words of an item (all of a shorter one); it occurs in a document if its words stand
there one after the other. Windows are sets of (shingle, place) of ``SHINGLE`` words:

1. Every position of every text gives a shingle; those that no item has fall away in one join. What is left, the *hits*
   (text, position, shingle), is written. Texts never shuffle, and equal texts are one from here on.
2. A window occurs only where all of its shingles do, so its prefix is a single shingle: the rarest by the counts of the
   hits. Windows with a shingle that no text has are out at once.
3. Hits of prefix shingles are candidates, if the window then lies within the text (positional and length bounds).
4. A candidate is verified by the hits at all places of the window. Shingles are compared as strings, so this is exact.

Words under windows that occur are summed as a union of intervals. Items are told by classes: windows with one set of
items are a class, texts with one set of classes a combination, and each combination's list of items is made once,
however many texts have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.llm.common import plain_text, read, written

WINDOW = 10
SHINGLE = 3
BROADCAST_SHINGLES = 500_000  # of items; more, or longer than this many characters, join by a shuffle
BROADCAST_CHARS = 16_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z are lower-cased


def split_words(text: Column) -> Column:
    """A text between its separators. The first and the last part are empty where it begins or ends with one."""
    return F.split(F.translate(text, _UPPER, _UPPER.lower()), _BETWEEN)


def _n_words(parts: Column) -> Column:
    empty = lambda k: (F.element_at(parts, k) == "").cast("int")
    return (F.size(parts) - empty(1) - F.when(F.size(parts) > 1, empty(-1)).otherwise(0)).cast("long")


def _shingles(parts: str, k: int) -> Column:
    """Structs of ``k`` consecutive words for each place."""
    n = F.greatest(F.size(parts) - (k - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(parts, F.lit(j + 1), n).alias(f"w{j}") for j in range(k)])


def windows(benchmark: DataFrame) -> DataFrame:
    """win, w, k, tokens, items of the distinct windows: 128 bits of its words, their number, the words of a shingle, its
    shingles in order, and the sorted ids of the items that have it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.array_remove(split_words(plain_text()), "").alias("words"))
    long_ = F.least(F.lit(WINDOW), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - long_ + 1)
    cut = words.where(F.size("words") > 0).select("item", long_.alias("w"), F.explode(F.transform(starts, lambda s: F.slice("words", s, long_))).alias("words"))
    win = F.unhex(F.md5(F.concat_ws(" ", "words")))
    one = cut.groupBy(win.alias("win"), "w").agg(F.first("words").alias("words"), F.array_sort(F.collect_set("item")).alias("items"))
    k = F.least(F.lit(SHINGLE), F.col("w"))
    one = one.withColumn("k", k)
    places = F.sequence(F.lit(1), F.col("w") - F.col("k") + 1)
    tokens = F.transform(places, lambda p: F.concat_ws(" ", F.slice("words", p, F.col("k"))))
    return one.select("win", "w", "k", tokens.alias("tokens"), "items")


def _hits(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """text, n, pos, token: where distinct texts have a shingle of the items. ``n`` is the number of parts of the text."""
    bounds = tokens.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars")).collect()  # SHINGLE rows at most
    few = sum(r["n"] for r in bounds) <= BROADCAST_SHINGLES and sum(r["chars"] for r in bounds) <= BROADCAST_CHARS
    # split once a text, as the parts are read more than once; an outer explode adds no filter that would split again
    parts = texts.select(F.unhex(F.md5("text")).alias("text"), split_words(F.col("text")).alias("parts"))
    found = []
    for k in sorted(r["k"] for r in bounds):
        names = [F.col(f"at.w{j}") for j in range(k)]
        at = parts.select("text", F.size("parts").alias("n"), F.posexplode_outer(_shingles("parts", k)).alias("pos", "at"))
        at = at.select("text", "n", "pos", "at", F.xxhash64(*names).alias("hash"))
        words = F.split("token", " ")
        wanted = tokens.where(F.col("k") == k).select("token", F.xxhash64(*[words[j] for j in range(k)]).alias("hash"))
        # the hash finds, the words decide: in a pass over what was found, so that the loop over all words does little
        near = written(at.join(F.broadcast(wanted) if few else wanted, "hash").drop("hash"), "found")
        found.append(near.where(F.concat_ws(" ", *names) == F.col("token")).select("text", "n", "pos", "token"))
    none = texts.select(F.lit(None).cast("binary").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit("").alias("token")).limit(0)
    return reduce(DataFrame.unionByName, found, none).distinct()


def occurrences(texts: DataFrame, known: DataFrame) -> DataFrame:
    """text, start, w, win: where windows of ``known`` occur in the distinct texts of ``texts`` (text)."""
    at = known.select("win", "w", F.size("tokens").alias("m"), "k", F.posexplode("tokens").alias("off", "token"))
    at = written(at, "window-shingles")
    hits = written(_hits(texts, at.select("k", "token").distinct()), "hits")
    counts = hits.groupBy("token").agg(F.count("*").alias("often"))
    rarest = at.join(counts, "token").groupBy("win", "w", "m").agg(F.min(F.struct("often", "off", "token")).alias("probe"), F.count("*").alias("have"))
    prefix = written(rarest.where("have = m").select("win", "w", "m", "probe.off", "probe.token"), "prefixes")
    start = (F.col("pos") - F.col("off")).alias("start")
    near = hits.join(prefix, "token").select("text", "n", start, "win", "w", "m").where("start >= 0 AND start + w <= n")
    near = written(near, "candidates")
    asked = near.join(at.select("win", "off", "token"), "win").select("text", "start", "win", "w", "m", (F.col("start") + F.col("off")).alias("pos"), "token")
    held = asked.join(hits.select("text", "pos", "token"), ["text", "pos", "token"]).groupBy("text", "start", "w", "win", "m").count()
    return held.where(F.col("count") == F.col("m")).select("text", "start", "w", "win")


def _covered(found: DataFrame) -> DataFrame:
    """text, n_hit: words under any occurrence. A text's rows are sorted and streamed; there are some ten a word at most."""
    before = Window.partitionBy("text").orderBy("start", "w").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("w")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    return found.select("text", new.alias("new")).groupBy("text").agg(F.sum("new").cast("long").alias("n_hit"))


def _listed(found: DataFrame, known: DataFrame) -> DataFrame:
    """text, n_items, items_sha256: the items of a text, made once for each set of classes."""
    of = F.md5(F.array_join("items", ",")).alias("class")
    classes = known.select("win", of)
    items = known.select(of, "items").dropDuplicates(["class"]).select("class", F.explode("items").alias("item"))
    sets = found.select("text", "win").distinct().join(classes, "win").groupBy("text").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    sets = written(sets.withColumn("set", F.md5(F.array_join("classes", ","))), "item-sets")
    one = sets.select("set", "classes").dropDuplicates(["set"]).select("set", F.explode("classes").alias("class"))
    lists = one.join(items, "class").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = lists.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return sets.select("text", "set").join(lists, "set", "left").drop("set")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    Null and empty texts, and those without words, have no words; such items have no window. Repeated rows and equal texts
    get equal results. Items that share an id are one item with the windows of all; an item without an id covers words
    but is in no list. Shingles of one count tie by their place in the window. Very long texts are whole; a text's
    words are in memory once. Extra columns, whatever their names, fall away; an empty table gives no rows, an empty
    benchmark clean ones.
    """
    docs = docs.select("doc_id", plain_text().alias("text"))
    known = written(windows(benchmark), "windows")
    found = written(occurrences(docs.select("text"), known), "occurrences")
    told = written(_covered(found).join(_listed(found, known), "text"), "contaminated")
    parts = docs.select("doc_id", F.unhex(F.md5("text")).alias("text"), split_words(F.col("text")).alias("parts"))
    rows = parts.select("doc_id", "text", _n_words(F.col("parts")).alias("n_words")).join(told, "text", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), items AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)
), spans AS (
  SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (SELECT r, s, size, item_id FROM spans JOIN windows USING (size, said)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM found) GROUP BY r
), listed AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""

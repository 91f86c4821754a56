"""Every relational operator over the driver tables, with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectflow.functions import names, text
from effectflow.operators import closure, condense, effects, incremental, merge, rank, resolve, state
from effectflow.plans import code_base  # noqa: F401 (registers its queries)
from effectflow.plans.registry import QUERIES, SQL, query
from effectflow.runtime import constant, shared_dir, table
from effectflow.sources import native_modules, patterns, stubs

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def _hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^[^?#]*/(en|fr)/[^?#]*$') AND NOT (contains(url, '?') OR contains(url, '#'))")
def glob_include_exclude(spark, sf):
    """Include globs, then exclude globs, on a path-like column."""
    return patterns.select_paths(table(spark, sf, "pages").select("page_id", "url"), "url", include=["*/en/*", "*/fr/*"], exclude=["*[?]*", "*#*"])


_DOMAINS = [("example.com", 1), ("example.net", 2), ("example.org", 3), ("blog", 4), ("www", 5), ("com", 6), ("org", 7), ("m", 8)]
_DOMAIN_SQL = ", ".join(f"('{d}', {k})" for d, k in _DOMAINS)


def _domains(spark: SparkSession) -> DataFrame:
    return constant(spark, _DOMAINS, "prefix string, rule int")


@query(f"""SELECT page_id, host, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT page_id, {_HOST} AS host FROM pages) JOIN (VALUES {_DOMAIN_SQL}) d(prefix, rule)
  ON host = prefix OR starts_with(host, prefix || '.') GROUP BY page_id, host""")
def longest_prefix_resolve(spark, sf):
    """The longest known prefix of a dotted name, by exploding prefixes."""
    return resolve.longest_prefix(_hosts(spark, sf), "host", _domains(spark), "prefix").select("page_id", "host", "prefix")


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), c AS (SELECT page_id, regexp_replace(host, '^[^.]*[.]', '') AS tail FROM h), d AS (SELECT host, min(page_id) AS page FROM h GROUP BY host),
  f AS (SELECT tail, arg_min(host, page) AS first_host, CAST(min(page) AS BIGINT) AS first_page FROM (SELECT DISTINCT tail FROM c) JOIN d ON host = tail OR ends_with(host, '.' || tail) GROUP BY tail)
  SELECT page_id, tail, first_host, first_page FROM c JOIN f USING (tail)""")
def suffix_match_every(spark, sf):
    """The first definition, in order, whose name ends with a called name."""
    hosts = _hosts(spark, sf)
    calls = hosts.select("page_id", F.regexp_replace("host", "^[^.]*[.]", "").alias("tail"))
    definitions = hosts.select(F.col("host").alias("first_host"), F.col("page_id").alias("first_page"))
    return resolve.suffix_first(calls, "tail", definitions, "first_host", "first_page").select("page_id", "tail", "first_host", "first_page")


@query("""SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN c.c_mktsegment = 'BUILDING' THEN 'segment' WHEN n.n_nationkey IS NOT NULL THEN n.n_name END AS target,
  CASE WHEN s.s_suppkey IS NOT NULL THEN 0 WHEN c.c_mktsegment = 'BUILDING' THEN 1 WHEN n.n_nationkey IS NOT NULL THEN 2 END AS strategy
  FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey AND s.s_acctbal > 0 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 4""")
def cascade_resolve(spark, sf):
    """Strategies in order; a later one sees only what the earlier ones left."""
    c = table(spark, sf, "customer")
    one = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("c_custkey"), F.lit("supplier").alias("target"))
    two = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("segment").alias("target"))
    three = c.join(
        resolve.small(table(spark, sf, "nation").where("n_regionkey < 4")), F.col("n_nationkey") == F.col("c_nationkey"),
    ).select("c_custkey", F.col("n_name").alias("target"))
    return resolve.cascade(c.select("c_custkey"), ["c_custkey"], [one, two, three])


_LIBRARY_PATH = """replace(host, '.', '/') || '/' || CASE page_id % 5 WHEN 0 THEN '_fast.cpython-313-x86_64-linux-gnu.so' WHEN 1 THEN '_fast.abi3.so'
  WHEN 2 THEN '_fast.cpython-311-darwin.so' WHEN 3 THEN 'plain.py' ELSE 'lib_fast.so.1' END"""


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), m AS (
    SELECT DISTINCT replace(host, '/', '.') || CASE page_id % 5 WHEN 3 THEN '.plain' ELSE '._fast' END AS module, page_id % 5 <> 3 AS is_native
    FROM h WHERE page_id % 5 IN (0, 1, 3) AND regexp_matches(host, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$')),
  c AS (SELECT page_id, host || CASE page_id % 2 WHEN 0 THEN '._fast.encode' ELSE '.plain.Box.run' END AS name FROM h)
  SELECT page_id, module, bool_or(is_native) AS is_native FROM c JOIN m ON starts_with(name, module || '.') GROUP BY page_id, module""")
def native_calls(spark, sf):
    """Calls into modules that are shared libraries, told by the files of a library folder: tags, endings and packages."""
    hosts = _hosts(spark, sf)
    files = hosts.select(F.expr(_LIBRARY_PATH).alias("path")).distinct()
    modules = native_modules.of_paths(files, "3.13").groupBy("module").agg(F.bool_or("is_native").alias("is_native"))
    name = F.concat("host", F.when(F.col("page_id") % 2 == 0, "._fast.encode").otherwise(".plain.Box.run"))
    calls = hosts.select("page_id", name.alias("name"))
    return resolve.longest_prefix(calls, "name", modules, "module", strict=True).select("page_id", "module", "is_native")


_RULES = [("any", 0, 1000, 1), ("small", 1, 10, 5), ("middle", 10, 30, 4), ("narrow", 20, 25, 9), ("exact", 7, 8, 10)]
_RULE_SQL = ", ".join(f"('{a}', {b}, {c}, {d})" for a, b, c, d in _RULES)


@query(
    f"SELECT p_partkey, arg_max(r.rule, r.score) AS rule FROM part JOIN (VALUES {_RULE_SQL}) r(rule, lo, hi, score) ON p_size >= lo AND p_size < hi GROUP BY p_partkey"
)
def version_range_specificity(spark, sf):
    """The most specific range that holds a version."""
    rules = constant(spark, _RULES, "rule string, lo int, hi int, score int")
    return resolve.range_pick(
        table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", rules, "lo", "hi", [F.desc("score"), "rule"],
        ["p_partkey"],
    ).select("p_partkey", "rule")


@query("""WITH RECURSIVE up(node, ancestor, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL
  SELECT node, ancestor // 2, depth + 1 FROM up WHERE ancestor > 1) SELECT ancestor, count(*) AS n_below, CAST(max(depth) AS INTEGER) AS depth FROM up WHERE depth > 0 GROUP BY ancestor""")
def hierarchy_closure(spark, sf):
    """Reflexive closure of an acyclic hierarchy: descendants per ancestor."""
    edges = table(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 2").alias("parent"))
    return closure.hierarchy(edges).where("depth > 0").groupBy("ancestor").agg(F.count("*").alias("n_below"), F.max("depth").alias("depth"))


_EDGE_SQL = "edges(a, b) AS (SELECT s_suppkey, (7 * s_suppkey + 3) % (SELECT count(*) FROM supplier) FROM supplier WHERE s_acctbal > 0)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    n = s.agg(F.count("*").alias("n"))
    return s.where("s_acctbal > 0").join(F.broadcast(n)).select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("b"))


@query(f"WITH RECURSIVE {_EDGE_SQL}, r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a) SELECT a, b FROM r")
def cyclic_reachability(spark, sf):
    """All pairs with a path in a graph with cycles."""
    return closure.reachability(_edges(spark, sf))


@query(f"""WITH RECURSIVE {_EDGE_SQL}, r(a, effect) AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION SELECT e.a, r.effect FROM r JOIN edges e ON e.b = r.a) SELECT a AS s_suppkey, string_agg(DISTINCT effect, ',' ORDER BY effect) AS effects FROM r GROUP BY a""")
def propagate_every_effect(spark, sf):
    """Effects of callees taken over by callers until nothing changes, as a set per node."""
    own = table(spark, sf, "supplier").join(
        resolve.small(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"),
    ).select(F.col("s_suppkey").alias("a"), F.col("n_name").alias("b"))
    return closure.propagate(_edges(spark, sf), own).groupBy(F.col("a").alias("s_suppkey")).agg(merge.as_set("b").alias("effects"))


_PART_EDGE_SQL = """edges(a, b) AS (SELECT DISTINCT x.l_partkey, y.l_partkey FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
  WHERE x.l_returnflag = 'R' AND x.l_discount < 0.035)"""


def _part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that follow each other in an order, the first one returned and sold at a low discount: a graph with large cycles."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    following = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    first = l.where("l_returnflag = 'R' AND l_discount < 0.035").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    return first.join(following, ["l_orderkey", "l_linenumber"]).select("a", "b").distinct()


@query(f"""WITH RECURSIVE {_PART_EDGE_SQL}, r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a)
  SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1""")
def strong_components(spark, sf):
    """Cycles of a graph as one node: each node of a cycle with the least node of its class."""
    return condense.components(_part_edges(spark, sf))


@query(f"""WITH RECURSIVE {_PART_EDGE_SQL}, r(a, b) AS (SELECT p_partkey, p_size FROM part UNION SELECT e.a, r.b FROM r JOIN edges e ON r.a = e.b)
  SELECT a AS p_partkey, count(*) AS n_sizes, CAST(sum(b) AS BIGINT) AS sizes FROM r GROUP BY a""")
def condensed_effects(spark, sf):
    """What nodes have or reach, closed over the condensed graph in words of bits."""
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.col("p_size").alias("b"))
    total = condense.condensed(_part_edges(spark, sf), own)
    return total.groupBy(F.col("a").alias("p_partkey")).agg(F.count("*").alias("n_sizes"), F.sum("b").alias("sizes"))


@query(f"""WITH RECURSIVE {_EDGE_SQL}, r(a, cause) AS (SELECT s_suppkey, s_suppkey FROM supplier WHERE s_acctbal < 0
  UNION SELECT e.a, r.cause FROM r JOIN edges e ON e.b = r.a) SELECT a AS node, count(*) AS n_causes FROM r GROUP BY a""")
def affected_by_debt(spark, sf):
    """What must be computed again after a change: reverse reachability."""
    changed = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return closure.affected(_edges(spark, sf), changed).groupBy("node").agg(F.count("*").alias("n_causes"))


@query(f"""WITH RECURSIVE {_EDGE_SQL.replace('s_acctbal > 0', 's_acctbal > 0 AND s_nationkey <> 3 OR s_nationkey = 5')}, r(a, effect) AS (
  SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey <> 7
  UNION SELECT e.a, r.effect FROM r JOIN edges e ON e.b = r.a) SELECT a AS s_suppkey, string_agg(DISTINCT effect, ',' ORDER BY effect) AS effects FROM r GROUP BY a""")
def maintained_effects(spark, sf):
    """Kept effects after edges went and came and seeds went: deleted, derived again where other support is left."""
    s, n = table(spark, sf, "supplier"), resolve.small(table(spark, sf, "nation"))
    word = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in ("a", "b")])
    own = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("a"), F.col("n_name").alias("b"), "s_nationkey")
    count = s.agg(F.count("*").alias("n"))
    to = ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("b")
    later = s.where("s_acctbal > 0 AND s_nationkey <> 3 OR s_nationkey = 5").join(F.broadcast(count)).select(F.col("s_suppkey").alias("a"), to)
    kept = incremental.KeptClosure(spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}")
    kept.refresh(word(_edges(spark, sf)), word(own))
    out = kept.refresh(word(later), word(own.where("s_nationkey <> 7")))
    return out.groupBy(F.col("a").cast("long").alias("s_suppkey")).agg(merge.as_set("b").alias("effects"))


_ANCESTORS = [("R", "R"), ("N", "N"), ("A", "A"), ("R", "X"), ("A", "X")]
_HANDLER_SQL = "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'R' WHEN '2' THEN 'X' WHEN '3' THEN NULL END AS handler FROM orders WHERE left(o_orderpriority, 1) < '4'"


@query(f"""WITH h AS ({_HANDLER_SQL}), a(effect, ancestor) AS (VALUES {", ".join(map(str, _ANCESTORS))})
  SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM h LEFT JOIN a ON a.ancestor = h.handler
    WHERE h.o_orderkey = l.l_orderkey AND (h.handler IS NULL OR a.effect = l.l_returnflag))""")
def unhandled_pairs(spark, sf):
    """Effects at a site that none of its handlers catches, ancestors and bare handlers included."""
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").distinct()
    level = F.substring("o_orderpriority", 1, 1)
    handlers = table(spark, sf, "orders").where(level < "4").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(level == "1", "R").when(level == "2", "X").alias("handler"),
    )
    return effects.unhandled(
        pairs, handlers, ["l_orderkey"], "l_returnflag", "handler", constant(spark, _ANCESTORS, "effect string, ancestor string"),
    )


@query("""SELECT e.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_enclosing(spark, sf):
    """The latest definition at or before a position."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    signups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return rank.asof_backward(
        e.where("event_type = 'error'"), signups, ["user_id"], "ts", "ts", ["signup_id"], split=True,
    ).select("event_id", "signup_id")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_returnflag = 'R')")
def suppress_any(spark, sf):
    """A whole group goes if any member is marked."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    return effects.unmarked_groups(lines, ["l_orderkey"], F.col("l_returnflag") == "R", F.count("*").alias("n"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS left_over FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey
  WHERE NOT (contains(o_orderpriority, 'URGENT') AND l_returnflag = 'N') AND NOT (contains(o_orderpriority, 'HIGH') AND l_returnflag = 'A') GROUP BY l_orderkey""")
def suppress_documented(spark, sf):
    """Only documented elements go."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").distinct()
    o = table(spark, sf, "orders")
    documented = o.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(F.contains("o_orderpriority", F.lit("URGENT")), "N").when(F.contains("o_orderpriority", F.lit("HIGH")), "A").alias("l_returnflag"),
    ).where("l_returnflag IS NOT NULL")
    with_order = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return effects.drop_documented(
        with_order, documented, ["l_orderkey", "l_returnflag"],
    ).groupBy("l_orderkey").agg(merge.as_set("l_returnflag").alias("left_over"))


@query("""WITH e AS (SELECT o_orderkey AS unit, o_orderstatus AS effect, o_orderpriority = '5-LOW' AS told FROM orders), esc AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  SELECT unit, effect FROM e WHERE (unit IN (SELECT l_orderkey FROM esc) OR unit NOT IN (SELECT l_orderkey FROM lineitem)) AND NOT (told AND effect = 'F')""")
def strict_undocumented(spark, sf):
    """Undocumented effects of units that let any escape or that call nothing."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), "l_returnflag")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderstatus").alias("effect"), "o_orderpriority")
    told = orders.where("o_orderpriority = '5-LOW' AND effect = 'F'").select("unit", "effect")
    return effects.undocumented_strict(orders.select("unit", "effect"), lines.where("l_returnflag = 'R'"), lines, told, "unit", "effect")


@query(
    "SELECT user_id, count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS n_interesting FROM events GROUP BY user_id HAVING count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) > 0"
)
def filter_boring(spark, sf):
    """Keys with any effect beyond the boring ones."""
    return effects.with_interesting(table(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "error"])


def _detectors() -> list[tuple[str, F.Column]]:
    c = F.col
    return [
        ("urgent", c("o_orderpriority") == "1-URGENT"), ("open", c("o_orderstatus") == "O"),
        ("large", c("o_totalprice") > 300000), ("high", c("o_orderpriority") == "2-HIGH"), ("fifth", c("o_orderkey") % 5 == 0),
        ("seventh", c("o_custkey") % 7 == 0), ("final", c("o_orderstatus") == "F"), ("low", c("o_orderpriority") == "5-LOW"),
        ("early", F.year("o_orderdate") < 1995),
    ]


_DETECTOR_SQL = [
    ("urgent", "o_orderpriority = '1-URGENT'"), ("open", "o_orderstatus = 'O'"), ("large", "o_totalprice > 300000"),
    ("high", "o_orderpriority = '2-HIGH'"), ("fifth", "o_orderkey % 5 = 0"), ("seventh", "o_custkey % 7 = 0"),
    ("final", "o_orderstatus = 'F'"), ("low", "o_orderpriority = '5-LOW'"), ("early", "year(o_orderdate) < 1995"),
]


@query(
    " UNION ALL ".join(f"SELECT o_orderkey, {k + 1} AS priority, '{name}' AS rule FROM orders WHERE {cond}" for k, (name, cond) in enumerate(_DETECTOR_SQL))
)
def all_detectors(spark, sf):
    """All rules that hold, with their priority."""
    return rank.rule_hits(table(spark, sf, "orders"), ["o_orderkey"], _detectors())


_LEVELS = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query("SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey")
def confidence_max(spark, sf):
    """The strongest of an ordered set of levels."""
    return merge.highest(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", _LEVELS)


@query("SELECT o_custkey, max(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey")
def confidence_min(spark, sf):
    """The weakest of an ordered set of levels."""
    return merge.lowest(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", _LEVELS)


@query("""SELECT l_orderkey, CASE WHEN string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) = 'N' THEN 'conservative' WHEN bool_or(l_linestatus = 'F' AND l_returnflag = 'R') THEN 'exact' ELSE 'likely' END AS confidence
  FROM lineitem GROUP BY l_orderkey""")
def confidence_decision(spark, sf):
    """Confidence from what was found and how."""
    found = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("e"),
        F.bool_or((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("explicit"),
    )
    return found.select("l_orderkey", merge.decide(F.col("e"), F.col("explicit"), "N").alias("confidence"))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS e, CASE WHEN c_nationkey % 3 = 0 THEN 'exact' ELSE 'likely' END AS c FROM customer),
  b AS (SELECT DISTINCT s_nationkey AS k, CASE WHEN s_acctbal > 0 THEN 'PAID' ELSE 'OWED' END AS e, CASE WHEN s_nationkey % 5 = 0 THEN 'exact' ELSE 'conservative' END AS c FROM supplier),
  u AS (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 AS side FROM b)
  SELECT k, string_agg(DISTINCT e, ',' ORDER BY e) AS e, CASE WHEN bool_or(c = 'exact') THEN 'exact' ELSE arg_max(c, side) END AS c FROM u GROUP BY k""")
def merge_whole_sources(spark, sf):
    """Key-wise union of two sources' sets, with the confidence rule."""
    a = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("e"),
        F.when(F.col("c_nationkey") % 3 == 0, "exact").otherwise("likely").alias("c"),
    ).distinct()
    b = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("k"), F.when(F.col("s_acctbal") > 0, "PAID").otherwise("OWED").alias("e"),
        F.when(F.col("s_nationkey") % 5 == 0, "exact").otherwise("conservative").alias("c"),
    ).distinct()
    return merge.merge_two(a, b, ["k"], "e", "c")


@query("SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey")
def dedupe_last_wins(spark, sf):
    """The last writer of each key."""
    return rank.last_wins(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority"])


@query(f"""SELECT page_id, string_split(host, '.')[1] AS module, CASE WHEN len(string_split(host, '.')) >= 3 THEN array_to_string(string_split(host, '.')[2:-2], '.') ELSE '' END AS owner,
  CASE WHEN len(string_split(host, '.')) >= 2 THEN string_split(host, '.')[-1] ELSE '' END AS member FROM (SELECT page_id, {_HOST} AS host FROM pages)""")
def qualify_names(spark, sf):
    """Dotted names to module, class and member."""
    module, owner, member = names.split_qualname(F.col("host"))
    return _hosts(spark, sf).select("page_id", module.alias("module"), owner.alias("owner"), member.alias("member"))


@query("SELECT c_custkey, left(sha256(c_name), 16) AS hash FROM customer")
def hash_key(spark, sf):
    """Short content hashes."""
    return table(spark, sf, "customer").select("c_custkey", text.short_hash(F.col("c_name")).alias("hash"))


@query("""SELECT o_orderkey, greatest(CAST(o_orderkey % 50 AS INTEGER) - 1, 0) AS line, CASE o_orderstatus WHEN 'F' THEN 'warning' ELSE 'error' END AS severity, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS number,
  'c' || o_custkey || ':' || (o_orderkey % 50) || ':' || (o_orderkey % 9) || ': ' || CASE o_orderstatus WHEN 'F' THEN 'warning' ELSE 'error' END || ': call to ''' || o_orderpriority || ''' may raise unhandled exception(s): A, B' AS shown FROM orders""")
def diagnostic_projection(spark, sf):
    """Findings to editor positions, severities and report lines."""
    c, severity = F.col, F.when(F.col("o_orderstatus") == "F", "warning").otherwise("error")
    message = text.call_message(c("o_orderpriority"), F.array(F.lit("A"), F.lit("B")))
    shown = text.report_line(F.concat(F.lit("c"), c("o_custkey").cast("string")), c("o_orderkey") % 50, c("o_orderkey") % 9, severity, message)
    return table(spark, sf, "orders").select(
        "o_orderkey", text.editor_range((c("o_orderkey") % 50).cast("int"), F.lit(0))["start_line"].alias("line"),
        severity.alias("severity"), text.severity_number(severity).alias("number"), shown.alias("shown"),
    )


@query("""SELECT event_id, coalesce(ts - p_ts <= INTERVAL 2 HOUR AND event_type = p_type AND sha256(props) = sha256(p_props), false) AS hit FROM (
  SELECT *, lag(ts) OVER w AS p_ts, lag(event_type) OVER w AS p_type, lag(props) OVER w AS p_props FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def cache_valid(spark, sf):
    """Whether the entry before still holds: age, kind and content hash."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("*", *[F.lag(c).over(before).alias(f"prev_{c}") for c in ("ts", "event_type", "props")])
    hit = state.valid(
        F.col("ts") - F.col("prev_ts"), F.expr("INTERVAL '2' HOUR"), (F.col("event_type"), F.col("prev_event_type")),
        (F.sha2("props", 256), F.sha2("prev_props", 256)),
    )
    return e.select("event_id", hit.alias("hit"))


@query(
    "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10"
)
def evict_oldest(spark, sf):
    """The newest entries of each key stay."""
    return rank.keep_newest(
        table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10,
    ).select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def prune_stale(spark, sf):
    """Entries whose subject is gone."""
    return state.prune(
        table(spark, sf, "orders").select("o_orderkey"),
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"],
    )[1]


@query("""SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def debounce_sessions(spark, sf):
    """Bursts of changes: one run each, when nothing follows for a while."""
    return state.debounce(table(spark, sf, "events").select("user_id", "ts"), "ts", "30 minutes", ["user_id"])


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_edits FROM events GROUP BY user_id")
def fold_pending(spark, sf):
    """The last of a key's pending changes."""
    return state.fold_last(
        table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"],
        ["event_type"],
    )


@query("""WITH layers AS (SELECT o_custkey AS key, o_orderkey AS priority, o_orderstatus AS layer,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Yes' WHEN '2-HIGH' THEN ' true ' WHEN '3-MEDIUM' THEN CAST(o_orderkey AS VARCHAR) WHEN '5-LOW' THEN 'x1' ELSE 'no' END AS value FROM orders)
  SELECT key, value, layer, trim(lower(value)) IN ('true', '1', 'yes') AS is_on, TRY_CAST(value AS BIGINT) AS number_or_null
  FROM (SELECT key, arg_max(value, priority) AS value, arg_max(layer, priority) AS layer FROM layers GROUP BY key)""")
def config_layers(spark, sf):
    """The highest layer of each setting, as a switch and as a number: settings of customers, layers by order."""
    c = F.col("o_orderpriority")
    value = F.when(c == "1-URGENT", "Yes").when(c == "2-HIGH", " true ").when(c == "3-MEDIUM", F.col("o_orderkey").cast("string")).when(c == "5-LOW", "x1").otherwise("no")
    layers = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("priority"), F.col("o_orderstatus").alias("layer"), value.alias("value"),
    )
    best = rank.last_wins(layers, ["key"], ["priority"], ["value", "layer"])
    return best.select("key", "value", "layer", text.flag(F.col("value")).alias("is_on"), text.whole_number(F.col("value")).alias("number_or_null"))


@query("""SELECT event_id, event_type AS module, 'u' || user_id AS member, 'k' || regexp_extract(props, '[0-9]+', 0) AS exc, 'exact' AS confidence FROM events""")
def flattened_props(spark, sf):
    """A nested stub text for each event, made of its properties, to one relation."""
    number = F.get_json_object("props", "$.k")
    body = F.to_json(F.create_map("event_type", F.create_map(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.create_map(F.concat(F.lit("k"), number), F.lit("exact")))))
    texts = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("source"), F.lit(1).alias("priority"), body.alias("text"))
    return stubs.flatten(texts).select(F.col("source").cast("long").alias("event_id"), "module", "member", "exc", "confidence")


__all__ = ["QUERIES", "SQL"]

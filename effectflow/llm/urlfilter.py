"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Every rule is a list of globs. All globs of all rules are packed, one bit a pattern position, into 64-bit
words; one step of the automaton reads one byte of each URL of a batch and moves all patterns at once::

    D = (((D << 1 | carry) | start) & B[byte]) | (D & S[byte])

``B[byte]`` has the positions that accept the byte, ``S[byte]`` those that stay active on it (a star follows
them), ``start`` the first positions (all at the first byte, later only those behind a leading star). A pattern
matches when its last position is active after the last byte. URLs of a batch are sorted by length, so the
words of finished URLs drop out of the arithmetic.

Glob syntax: ``**`` any run of bytes, ``*`` any run without ``/``, ``?`` one byte other than ``/``.

The canonical URL is host + path: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; the path runs from there to ``?``, ``#`` or the end. A null url, or one without ``://``,
is the empty canonical URL: no rule fits and it gets the default verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from effectflow.llm.common import arrow_pass, read

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_AFTER = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; the longest name among the fitting rules wins, on a tie the first one."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    reported: bool = True


def host_rule(rule: str, verdict: str) -> Rule:
    """A rule ``host/path`` that fits the host and its subdomains where the URL's path starts with the rule's."""
    return Rule(rule, verdict, (f"{rule}**", f"*.{rule}**"))


#: The production rules: those of the contract, and globs for what no host rule decides.
HOST_RULES = tuple(host_rule(r, v) for v, r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))
GLOB_RULES = tuple(
    Rule(g, "block", (g,), False) for g in ("*spam*/**", "*pills*/**", "*casino*/**", "ads.*/**", "**/ads/**", "**/wp-login**", "**.exe")
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    m = _AFTER.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class GlobAutomaton:
    """All globs in multiword masks; ``match`` simulates them over many strings at once."""

    def __init__(self, globs: Sequence[str]):
        anchored, free, loops, takes, last, self.always = [], [], [], [], [], []
        position = 0
        for k, glob in enumerate(globs):
            parts = re.findall(rb"\*\*|\*|.", glob.encode(), re.S)
            first, lead = position, None
            for part in parts:
                if part in (b"*", b"**"):
                    if position == first:
                        lead = part if lead in (None, b"*") else lead
                    elif loops[-1] != b"**":
                        loops[-1] = part
                else:
                    takes.append(part)
                    loops.append(b"")
                    position += 1
            if position == first:
                self.always.append((k, lead))
                last.append(-1)
                continue
            (anchored if lead is None else free).append((first, lead))
            last.append(position - 1)
        self.n = len(globs)
        self.last = np.array(last, dtype=np.int64)
        words = self.words = max(1, -(-position // 64))
        self.accept = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        self.begin = np.zeros(words, np.uint64)
        self.firsts = np.zeros(words, np.uint64)
        bit = lambda p: np.uint64(1 << (p % 64))
        slash = ord("/")
        for p, take in enumerate(takes):
            for byte in range(256) if take == b"?" else take:
                if take != b"?" or byte != slash:
                    self.accept[byte, p // 64] |= bit(p)
            if loops[p]:
                self.stay[:, p // 64] |= bit(p)
                if loops[p] == b"*":
                    self.stay[slash, p // 64] &= ~bit(p)
        self.lead_any = np.zeros(words, np.uint64)
        self.lead_no_slash = np.zeros(words, np.uint64)
        for p, _ in anchored + free:
            self.begin[p // 64] |= bit(p)
            self.firsts[p // 64] |= bit(p)
        for p, lead in free:
            (self.lead_any if lead == b"**" else self.lead_no_slash)[p // 64] |= bit(p)

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: strings by globs."""
        out = np.zeros((len(strings), self.n), bool)
        if not strings:
            return out
        sizes = np.array([len(s) for s in strings])
        order = np.argsort(-sizes, kind="stable")
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
        flat = np.frombuffer(b"".join(strings), np.uint8)
        lengths = sizes[order]
        state = np.zeros((len(strings), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        live_lead = np.ones(len(strings), bool)  # no slash read yet
        active = len(strings)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            while active and lengths[active - 1] <= step:
                active -= 1
            byte = flat[starts[:active] + step]
            d = state[:active]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= ~self.firsts
            if step == 0:
                moved |= self.begin
            else:
                moved |= self.lead_any
                moved |= np.where(live_lead[:active, None], self.lead_no_slash, np.uint64(0))
            state[:active] = (moved & self.accept[byte]) | (d & self.stay[byte])
            live_lead[:active] &= byte != 47
        found = np.zeros((len(strings), self.n), bool)
        for k, p in enumerate(self.last):
            if p >= 0:
                found[:, k] = (state[:, p // 64] >> np.uint64(p % 64)) & one
        for k, lead in self.always:
            found[:, k] = (lengths == 0) if lead is None else live_lead if lead == b"*" else True
        out[order] = found
        return out


class UrlFilter:
    """Rules compiled to one automaton; ``judge`` gives host, path, rule and verdict for each URL."""

    def __init__(self, rules: Sequence[Rule], default: str = "allow"):
        self.rules, self.default = list(rules), default
        self.owner = np.array([k for k, r in enumerate(rules) for _ in r.globs], dtype=np.int64)
        self.automaton = GlobAutomaton([g for r in rules for g in r.globs])
        # longest reported rules first, then the unreported ones in their order; globs in the order of their rules
        rank = sorted(range(len(rules)), key=lambda k: (not rules[k].reported, -len(rules[k].name) if rules[k].reported else 0, k))
        place = np.argsort(np.array(rank, dtype=np.int64), kind="stable")
        self.order = np.argsort(place[self.owner], kind="stable") if len(self.owner) else self.owner

    def judge(self, urls: Sequence[str | None]) -> dict[str, list]:
        parts = [split_url(u) for u in urls]
        hit = self.automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
        best = np.full(len(urls), -1)
        if len(self.order):
            hit = hit[:, self.order]
            best = np.where(hit.any(axis=1), self.owner[self.order[hit.argmax(axis=1)]], -1)
        empty = np.array([not h and not p for h, p in parts], bool)
        best[empty] = -1
        rule = [self.rules[k].name if k >= 0 and self.rules[k].reported else None for k in best]
        glob = [self.rules[k].name if k >= 0 and not self.rules[k].reported else None for k in best]
        verdict = [self.rules[k].verdict if k >= 0 else self.default for k in best]
        return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rule, "verdict": verdict, "glob": glob}


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = HOST_RULES + GLOB_RULES, id_col: str = "page_id", url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (null where no host rule fits), verdict, glob.

    Repeated rows stay repeated; a null or empty url, or one without ``://``, has empty host and path and the
    default verdict; an empty table gives an empty result. Only the two columns named are read. Bytes of very
    long URLs cost one automaton step each. No shuffle: each partition is judged where it is read.
    """
    compiled = UrlFilter(rules, default)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {id_col: batch.column(0), **compiled.judge(batch.column(1).to_pylist())}

    kind = pages.schema[id_col].dataType.simpleString()
    return arrow_pass(pages.select(id_col, url_col), make, f"{id_col} {kind}, host string, path string, rule string, verdict string, glob string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the production rules."""
    return filter_urls(read(spark, sf_dir, "pages"))


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN i > 0 THEN translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN i > 0 THEN regexp_extract(r, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, coalesce(instr(url, '://'), 0) AS i, substr(url, instr(url, '://') + 3) AS r FROM pages)
), rules(name, rhost, rpath, rverdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), judged AS (
  SELECT p.*, (SELECT max_by(name || ' ' || rverdict, length(name)) FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best,
    CASE WHEN regexp_matches(host || path, '^[^/]*spam[^/]*/') THEN '*spam*/**' WHEN regexp_matches(host || path, '^[^/]*pills[^/]*/') THEN '*pills*/**'
      WHEN regexp_matches(host || path, '^[^/]*casino[^/]*/') THEN '*casino*/**' WHEN regexp_matches(host || path, '^ads\.[^/]*/') THEN 'ads.*/**'
      WHEN contains(host || path, '/ads/') THEN '**/ads/**' WHEN contains(host || path, '/wp-login') THEN '**/wp-login**' WHEN ends_with(host || path, '.exe') THEN '**.exe' END AS bad
  FROM parts p
)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule, coalesce(split_part(best, ' ', 2), CASE WHEN bad IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN best IS NULL THEN bad END AS glob
FROM judged
"""

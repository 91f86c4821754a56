"""Facts of C sources of an interpreter: one scan a file on the executors, one table of tagged rows.

There is no C compiler here, so sources are read by their tokens, as written: comments, strings and directives are told
apart, braces and parentheses are matched, and what a function does is read from the order of its tokens. Macros aren't
expanded, but for those that define entries of method tables. ``functions``, ``calls``, ``sites``, ``jumps``, ``clears``,
``exports`` and ``markers`` are views for ``operators.native``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from effectflow.operators import native
from effectflow.runtime import TEXT_ROWS

SCHEMA = "module string, path string, kind string, caller string, name string, line int, first_arg string, use string, flag boolean"
#: What stands before a parenthesis without being called: fixed words of the language.
_KEYWORDS = frozenset("if while for switch return sizeof case else do goto typeof alignof defined".split())
_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<line>^[ \t]*\#(?:[^\\\n]|\\\r?\n|\\.)*)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<char>'(?:[^'\\\n]|\\.)*')
    |(?P<word>[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<mark>->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[^\s\w])""",
    re.X | re.S | re.M,
)
_MARKER = "[clinic start generated code]"
_FAILED = {"NULL", "0", "-1"}


@dataclass
class Scan:
    """Tokens of one file and where their brackets end."""

    text: str
    kinds: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)
    markers: list[int] = field(default_factory=list)
    defines: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        line, at, open_ = 1, 0, []
        for m in _TOKEN.finditer(self.text):
            line += self.text.count("\n", at, m.start())
            at = m.start()
            if m.lastgroup == "comment":
                if _MARKER in m[0]:
                    self.markers.append(line + m[0].count("\n", 0, m[0].index(_MARKER)))
            elif m.lastgroup == "line":
                if d := re.match(r"\s*#\s*define\s+(\w+)\s(.*)", m[0], re.S):
                    self.defines.append((d[1], d[2].replace("\\\n", " ")))
            else:
                if m[0] in "([{" and m.lastgroup == "mark":
                    open_.append(len(self.words))
                elif m[0] in ")]}" and m.lastgroup == "mark" and open_:
                    self.ends[open_.pop()] = len(self.words)
                self.kinds.append(m.lastgroup)
                self.words.append(m[0])
                self.lines.append(line)

    def calls(self, start: int, end: int) -> Iterator[int]:
        """Places of names that are called between two tokens."""
        for k in range(start, end - 1):
            if self.kinds[k] == "word" and self.words[k + 1] == "(" and self.words[k] not in _KEYWORDS and (
                k == 0 or self.words[k - 1] not in ("->", ".")
            ):
                yield k

    def first_argument(self, call: int) -> str:
        out, depth = [], 0
        for k in range(call + 2, self.ends.get(call + 1, call + 2)):
            if self.words[k] == "," and not depth:
                break
            depth += (self.words[k] in "([{") - (self.words[k] in ")]}")
            out.append(self.words[k])
        return " ".join(out)

    def statement_end(self, start: int, end: int) -> int:
        """Behind the statement that starts at a token: a block, or what ends with a semicolon."""
        if start < end and self.words[start] == "{":
            return self.ends.get(start, end)
        k = start
        while k < end and self.words[k] != ";":
            k = self.ends.get(k, k) + 1
        return k


def _fails(scan: Scan, start: int, end: int) -> bool:
    """Whether a branch returns a failure and neither sets nor clears an error itself."""
    said = {scan.words[k] for k in scan.calls(start, end)}
    if said & {*native.CLEARING, *native.SETTERS, *native.SPECIFIC}:
        return False
    for k in range(start, end):
        if scan.words[k] == "return":
            return "".join(scan.words[k + 1 : scan.statement_end(k, end)]).strip("()") in _FAILED
    return False


def _assigned(scan: Scan, place: int, start: int) -> tuple[str, int] | None:
    """(variable, call) of the statement just before a token, if it assigns a call's result."""
    k = place - 1
    if k < start or scan.words[k] != ";":
        return None
    first = k - 1
    while first > start and scan.words[first] not in (";", "{", "}"):
        first -= 1
    for at in range(first, k - 2):
        if scan.words[at] == "=" and scan.kinds[at - 1] == "word" and scan.kinds[at + 1] == "word" and scan.words[at + 2] == "(":
            return scan.words[at - 1], at + 1
    return None


def _uses(scan: Scan, start: int, end: int) -> dict[int, str]:
    """How calls of a body are used, where a failing result leaves it: the place of the call, and the kind of use."""
    found: dict[int, str] = {}
    for k in range(start, end):
        if scan.words[k] != "if" or k + 1 >= end or scan.words[k + 1] != "(":
            continue
        close = scan.ends.get(k + 1, end)
        if not _fails(scan, close + 1, min(end, scan.statement_end(close + 1, end) + 1)):
            continue
        inside = list(scan.calls(k + 2, close))
        for call in inside:
            whole = call == k + 2 and scan.ends.get(call + 1) == close - 1
            found[call] = "negated" if scan.words[call - 1] == "!" else "condition" if whole else "if_call"
        if not inside and (before := _assigned(scan, k, start)) and before[0] in scan.words[k + 2 : close]:
            found[before[1]] = "assigned_checked"
    return found


def _entries(scan: Scan, start: int, end: int) -> Iterator[tuple[str | None, str, int]]:
    """(python name, C function, line) of a method table's entries; entries that are macros have no name but the macro's."""
    k = start
    while k < end:
        if scan.words[k] == "{":
            close = scan.ends.get(k, end)
            name, at = "", k + 1
            while at < close and scan.words[at] != ",":
                name += scan.words[at][1:-1] if scan.kinds[at] == "string" else ""
                at += 1
            function, at = "", at + 1
            while at < close and scan.words[at] != ",":
                if scan.kinds[at] == "word":
                    function = scan.words[at]
                elif scan.words[at] == "(" and scan.kinds[at - 1] != "word":  # a cast
                    at = scan.ends.get(at, at)
                at += 1
            if name and function and function != "NULL":
                yield name, function, scan.lines[k]
            k = close
        elif scan.kinds[k] == "word":
            yield None, scan.words[k], scan.lines[k]
        k += 1


def read_source(text: str) -> list[dict]:
    """Fact rows of one C source. Brackets that don't match end with the file."""
    scan = Scan(text)
    rows = [{"kind": "marker", "line": line} for line in scan.markers]
    for name, body in scan.defines:
        if body.lstrip().startswith("{"):
            inner = Scan(body)
            rows += [{"kind": "macro", "name": n, "first_arg": name, "use": f, "line": 0} for n, f, _ in _entries(inner, 0, len(inner.words)) if n]
    k, first = 0, 0  # first: where the declaration begins
    while k < len(scan.words):
        word = scan.words[k]  # at the outermost level
        if word == "PyMethodDef" and k + 2 < len(scan.words) and scan.words[k + 2] == "[":
            table, at = scan.words[k + 1], scan.ends.get(k + 2, k + 2) + 1
            if at + 1 < len(scan.words) and scan.words[at] == "=" and scan.words[at + 1] == "{":
                close = scan.ends.get(at + 1, len(scan.words))
                rows += [{"kind": "entry", "caller": table, "name": n, "use": f, "line": line} for n, f, line in _entries(scan, at + 2, close)]
                k = close
        elif word == "{":
            close = scan.ends.get(k, len(scan.words))
            head = next((c for c in scan.calls(first, k) if scan.ends.get(c + 1, -1) < k), None)
            if head is not None and scan.words[k - 1] == ")" and "=" not in scan.words[first:k]:
                rows += _function(scan, head, k + 1, close, "*" in scan.words[first:head])
            k = close
            first = k + 1
        elif word == ";":
            first = k + 1
        k += 1
    return rows


def _function(scan: Scan, head: int, start: int, end: int, pointer: bool) -> list[dict]:
    name = scan.words[head]
    rows = [{"kind": "function", "name": name, "line": scan.lines[head], "flag": pointer}]
    uses = _uses(scan, start, end)
    for call in scan.calls(start, end):
        callee = scan.words[call]
        rows.append(
            {
                "kind": "call", "caller": name, "name": callee, "line": scan.lines[call], "first_arg": scan.first_argument(call),
                "use": uses.get(call, "plain"),
            }
        )
    rows += [
        {"kind": "goto", "caller": name, "name": scan.words[k + 1], "line": scan.lines[k]} for k in range(start, end - 1) if scan.words[k] == "goto"
    ]
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Facts of C sources (module, path, text), headers among them. A file without text has none."""
    conf, batch_rows = files.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(batch_rows, "10000")) > TEXT_ROWS:
        conf.set(batch_rows, str(TEXT_ROWS))
    schema = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for module, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and (rows := read_source(text)):
                    yield pa.RecordBatch.from_pylist([row | {"module": module, "path": path} for row in rows], schema=arrow)

    return files.select("module", "path", "text").mapInArrow(run, schema)


def with_headers(files: DataFrame) -> DataFrame:
    """(module, path, text) of C sources, and of the generated headers that they include, under the including module.

    ``files`` (module, path, text) has the headers too, whatever their module.
    """
    sources = files.where(F.col("path").endswith(".c"))
    included = F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]+"(clinic/[^"]+)"'), 1))
    wanted = sources.select("module", F.regexp_replace("path", "[^/]*$", "").alias("folder"), included.alias("target"))
    wanted = wanted.select("module", F.concat("folder", "target").alias("path")).distinct()
    headers = files.where(~F.col("path").endswith(".c")).select("path", "text")
    return sources.select("module", "path", "text").unionByName(headers.join(wanted, "path").select("module", "path", "text"))


def _kind(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def functions(facts: DataFrame) -> DataFrame:
    return _kind(facts, "function").select("module", "path", "name", "line", F.col("flag").alias("returns_pointer"))


def calls(facts: DataFrame) -> DataFrame:
    return _kind(facts, "call").select("module", "caller", F.col("name").alias("callee"), "line", "first_arg")


def sites(facts: DataFrame) -> DataFrame:
    return _kind(facts, "call").select("module", "caller", F.col("name").alias("callee"), "line", F.col("use").alias("kind"))


def jumps(facts: DataFrame) -> DataFrame:
    return _kind(facts, "goto").select("module", "caller", "line", F.col("name").alias("label"))


def clears(facts: DataFrame) -> DataFrame:
    return _kind(facts, "call").where(F.col("name").isin(*native.CLEARING)).select("module", "caller", "line", F.col("name").alias("label"))


def markers(facts: DataFrame) -> DataFrame:
    return _kind(facts, "marker").select("module", "path", "line")


def exports(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(module, py_name, c_name): entries of method tables, those of macros by their definition in any file, and constructors
    of generator blocks; names of a class's table stand behind the class."""
    entry = _kind(facts, "entry")
    macro = _kind(facts, "macro").select(F.col("first_arg").alias("m"), F.col("name").alias("py"), F.col("use").alias("c")).distinct()
    plain = entry.where("name IS NOT NULL").select("module", "caller", F.col("name").alias("py"), F.col("use").alias("c"))
    named = entry.where("name IS NULL").join(macro, F.col("use") == F.col("m")).select("module", "caller", "py", "c")
    owner = native.table_class(F.col("caller"))
    py_name = F.when(owner == "", F.col("py")).otherwise(F.concat_ws(".", owner, "py"))
    made = native.constructors(texts).select("module", F.concat_ws(".", "type", "method").alias("py_name"), "c_name")
    return plain.unionByName(named).select("module", py_name.alias("py_name"), F.col("c").alias("c_name")).unionByName(made).distinct()

"""The check of a code base: sources to facts, names to definitions, effects to a fixpoint, minus what is handled.

Two modes. ``reference``: a signature holds whatever callees raise, handlers inside callees don't matter, and handler
names are compared as written. ``sound``: what is handled at a call inside the callee doesn't escape it, class
definitions extend the hierarchy, and handlers are qualified like effects. In both, cycles get the least fixpoint, so
results don't depend on the order of files.
"""

from __future__ import annotations

import builtins
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectflow.functions import names, text
from effectflow.operators import closure, condense, effects, rank, resolve
from effectflow.runtime import apart, constant, counted, cut, held, together
from effectflow.sources import facts, native_modules, stubs as stub_source

#: Stands for whatever native code may raise.
NATIVE = "PossibleNativeException"
#: Effects that nearly every builtin has; a builtin with no other isn't reported.
BORING = ("TypeError", "Exception", "MemoryError")
#: Calls that invoke the callables passed to them: fixed names, as written in sources.
HIGHER_ORDER = (
    "map", "filter", "sorted", "min", "max", "reduce", "functools.reduce", "functools.partial",
    "itertools.filterfalse", "itertools.takewhile", "itertools.dropwhile", "itertools.starmap", "itertools.groupby",
    "concurrent.futures.ThreadPoolExecutor.submit", "concurrent.futures.ProcessPoolExecutor.submit", "asyncio.create_task", "asyncio.ensure_future",
    "heapq.nlargest", "heapq.nsmallest",
)


@dataclass(frozen=True)
class Options:
    """``root`` is taken off paths before they become modules; paths elsewhere have none, so their own effects stay bare.
    ``condense``: signatures of the ``reference`` mode are closed with each cycle as one node (for large cycles and many effects)."""

    ignored: Sequence[str] = ("KeyboardInterrupt", "SystemExit")
    local_only: bool = False
    strict: bool = False
    warn_native: bool = True
    full_module_path: bool = False
    tags: Sequence[str] = ("effectflow", "ef")
    mode: str = "reference"
    root: str | None = None
    builtin_always: Sequence[str] = ()
    builtin_never: Sequence[str] = ()
    most_per_file: int | None = None
    condense: bool = False


#: Names of one error that other platforms have.
OTHER_NAMES = ("EnvironmentError", "IOError", "VMSError", "WindowsError")


def builtin_ancestors(spark: SparkSession) -> DataFrame:
    """(effect, ancestor), reflexive, of the interpreter's own effects, names of other platforms, and the native sentinel."""
    known = {n: x for n, x in vars(builtins).items() if isinstance(x, type) and issubclass(x, BaseException)} | dict.fromkeys(OTHER_NAMES, OSError) | {NATIVE: Exception}
    return constant(
        spark, sorted({(n, b.__name__) for n, x in known.items() for b in x.__mro__[:-1]} | {(n, n) for n in known}),
        "effect string, ancestor string",
    )


def builtin_modules(spark: SparkSession) -> DataFrame:
    """(name, module): where each builtin really lives, and ``builtins`` after that."""
    rows = []
    for n, x in vars(builtins).items():
        home = getattr(x, "__module__", None)
        rows += [(n, m, k) for k, m in enumerate(dict.fromkeys((home if isinstance(home, str) else "builtins", "builtins")))]
    return constant(spark, rows, "name string, module string, place int")


class Check:
    """All tables of one check; each is a plan, and those that others share are cut once."""

    def __init__(
        self, files: DataFrame, stubs: DataFrame | None = None, modules: DataFrame | None = None, options: Options = Options(),
        library=None, cache=None, kept=None,
    ):
        self.spark, self.files, self.options = files.sparkSession, files.select("path", "text"), options
        self.stubs, self.modules = stubs, modules if modules is not None else native_modules.standard(self.spark)
        self.library = library  # effectflow.plans.library.Library: sources behind names that no stub has
        self.kept = kept  # effectflow.operators.incremental.KeptClosure: signatures of the run before
        # one parse a file; a folder for each kind of fact, so that a view reads its own rows alone
        self.facts, self.n_facts = counted(facts.extract(self.files) if cache is None else cache.facts(self.files), by="kind")

    def _module(self, path: str):
        if self.options.root is None:
            return F.lit(None).cast("string")
        root = self.options.root.rstrip("/") + "/" if self.options.root else ""
        return F.when(F.col(path).startswith(root), names.module_of_path(F.substr(F.col(path), F.lit(len(root) + 1)), self.options.full_module_path))

    def _not_ignored(self, df: DataFrame, effect: str) -> DataFrame:
        return df.where(~F.col(effect).isin(*self.options.ignored)) if self.options.ignored else df

    @cached_property
    def functions(self) -> DataFrame:
        return facts.functions(self.facts)

    @cached_property
    def calls(self) -> DataFrame:
        """Calls of the definitions that count, with their caller."""
        return facts.calls(self.facts).where("fn_id IS NOT NULL")

    @cached_property
    def own_effects(self) -> DataFrame:
        """(fn_id, effect) raised in the function itself."""
        raised = facts.raises(self.facts).where("fn_id IS NOT NULL AND NOT is_re_raise AND exc_type <> ''")
        raised = self._not_ignored(raised, "exc_type").withColumn("exc_type", names.qualify(F.col("exc_type"), self._module("file_id")))
        if self.options.mode == "sound":
            raised = raised.withColumn("site", F.concat_ws("!", "file_id", "seq"))
            raised = effects.unhandled(raised, self._handlers("raise"), ["site"], "exc_type", "handler", self.ancestors)
        return raised.select("fn_id", F.col("exc_type").alias("effect")).distinct()

    @cached_property
    def ancestors(self) -> DataFrame:
        """(effect, ancestor), reflexive; own classes with their bases' ancestors in sound mode."""
        known = builtin_ancestors(self.spark)
        if self.options.mode != "sound":
            return known
        own = facts.classes(self.facts).select(
            F.explode("bases").alias("base"), F.element_at(F.split("qualname", "[.]"), -1).alias("name"), "file_id",
        )
        module = self._module("file_id")
        edges = own.select(names.qualify(F.col("name"), module).alias("child"), names.qualify(F.col("base"), module).alias("parent"))
        edges = edges.unionByName(known.select(F.col("effect").alias("child"), F.col("ancestor").alias("parent"))).where("child <> parent")
        pairs = closure.hierarchy(edges).select(F.col("node").alias("effect"), "ancestor")
        return pairs.unionByName(known).distinct()  # names without a parent have themselves alone

    def _handlers(self, kind: str) -> DataFrame:
        """(site, handler) of each call (or raise); null catches all."""
        found = facts.handlers(self.facts, kind)
        if self.options.mode == "sound":
            found = found.withColumn("handler", F.when(F.col("handler").isNotNull(), names.qualify(F.col("handler"), self._module("file_id"))))
        return found.select("site", "handler").distinct()

    @cached_property
    def names(self) -> DataFrame:
        """(file_id, name) of everything called, and of callables passed to higher-order calls: each resolved once."""
        passed = self.calls.where(names.among(F.col("func_name"), HIGHER_ORDER)).select(
            "file_id", F.explode("callable_args").alias("name"),
        ).where("name <> '<lambda>'")
        return self.calls.select("file_id", F.col("func_name").alias("name")).unionByName(passed).distinct()

    @cached_property
    def targets(self) -> DataFrame:
        """(file_id, name, fn_id): exact qualified names of any file (the first path), then suffixes within the file."""
        fn = self.functions.select("fn_id", "file_id", "qualname", "ordinal")
        first = resolve.first_by(
            fn.select(F.col("qualname").alias("name"), "fn_id", F.col("file_id").alias("path"), "ordinal"), ["name"],
            ["path", "ordinal"],
        )
        exact = self.names.join(first.select("name", "fn_id"), "name").select("file_id", "name", "fn_id")
        suffix = resolve.suffix_first(self.names, "name", fn, "qualname", "ordinal", by=["file_id"]).select("file_id", "name", "fn_id")
        return cut(resolve.cascade(self.names, ["file_id", "name"], [held(exact, self.n_facts), held(suffix, self.n_facts)]))

    @cached_property
    def external(self) -> DataFrame:
        """(file_id, name, effect) of names that no source file defines."""
        if self.stubs is None:
            self.stubs = constant(self.spark, [], stub_source.SCHEMA)
        if self.options.local_only:
            return self.names.select("file_id", "name", F.lit("").alias("effect")).limit(0)
        open_ = self.targets.where("fn_id IS NULL").select("file_id", "name")
        alias = facts.imports(self.facts).select("file_id", F.col("alias").alias("name"), "target")
        imported = open_.join(alias, ["file_id", "name"])
        dot = F.col("target").contains(".")
        by_import = imported.select(
            "file_id", "name", F.when(dot, names.parent(F.col("target"))).otherwise(F.col("target")).alias("module"),
            F.when(dot, names.last_part(F.col("target"))).otherwise("").alias("member"),
        )
        rest = open_.join(alias.select("file_id", "name"), ["file_id", "name"], "left_anti")
        bare = rest.where(~F.col("name").contains("."))
        never = [n for n in self.options.builtin_never if n not in self.options.builtin_always]
        homes = builtin_modules(self.spark)
        candidates = (bare.where(~F.col("name").isin(*never)) if never else bare).join(F.broadcast(homes), "name").withColumn("member", F.col("name"))
        known = stub_source.lookup(candidates.select("module", "member"), self.stubs)
        interesting = effects.with_interesting(known, ["module", "member"], "exc", BORING).select("module", "member")
        always = F.col("name").isin(*self.options.builtin_always) if self.options.builtin_always else F.lit(False)
        wanted = candidates.join(
            interesting.withColumn("seen", F.lit(True)), ["module", "member"], "left",
        ).where(F.col("seen").isNotNull() | (always & (F.col("place") == 0)))
        by_builtin = resolve.first_by(wanted, ["file_id", "name"], ["place"]).select("file_id", "name", "module", "member")
        modules = self.modules.unionByName(self.stubs.select("module", F.lit(False).alias("is_native")))
        if self.library is not None:
            modules = modules.unionByName(self.library.files.select("module", F.lit(False).alias("is_native")))
        modules = modules.groupBy("module").agg(F.bool_or("is_native").alias("is_native"))
        dotted = rest.where(F.col("name").contains("."))
        by_prefix = resolve.longest_prefix(dotted, "name", modules, "module", strict=True).select(
            "file_id", "name", "module", F.expr("substr(name, length(module) + 2)").alias("member"),
        )
        asked = cut(by_import.unionByName(by_builtin).unionByName(by_prefix))
        found = stub_source.lookup(asked, self.stubs)
        hit = asked.join(found, ["module", "member"]).select("file_id", "name", F.col("exc").alias("effect"))
        left = asked.join(found, ["module", "member"], "left_anti")
        native = left.join(resolve.small(modules.where("is_native")), "module", "left_semi")
        if self.options.warn_native:
            hit = hit.unionByName(native.select("file_id", "name", F.lit(NATIVE).alias("effect")))
        if self.library is not None:
            left = cut(left.join(native, left.columns, "left_anti"))
            sourced = self.library.lookup(left)
            hit = hit.unionByName(left.join(sourced, ["module", "member"]).select("file_id", "name", "effect"))
            if self.options.warn_native:
                open_ = left.join(sourced, ["module", "member"], "left_anti")
                hit = hit.unionByName(
                    open_.join(self.library.documented(open_), ["module", "member"]).select("file_id", "name", F.lit(NATIVE).alias("effect"))
                )
        return cut(self._not_ignored(hit.distinct(), "effect"))

    @cached_property
    def edges(self) -> DataFrame:
        """(a, b, site): callers and what they call, callables handed to higher-order calls included."""
        plain = self.calls.select("fn_id", "file_id", "call_id", F.col("func_name").alias("name"))
        passed = self.calls.where(names.among(F.col("func_name"), HIGHER_ORDER)).select(
            "fn_id", "file_id", "call_id", F.explode("callable_args").alias("name"),
        ).where("name <> '<lambda>'")
        return plain.unionByName(passed).select(F.col("fn_id").alias("a"), "file_id", "name", F.col("call_id").alias("site"))

    @cached_property
    def handlers(self) -> DataFrame:
        found = self._handlers("call")
        return cut(found) if self.options.mode == "sound" else found  # joined once a round there

    @cached_property
    def signatures(self) -> DataFrame:
        """(fn_id, effect): everything that may escape each function."""
        local = self.edges.join(
            self.targets.where("fn_id IS NOT NULL"), ["file_id", "name"],
        ).select("a", F.col("fn_id").alias("b"), "site").distinct()
        sound = self.options.mode == "sound"
        edges = local if sound else local.select("a", "b").distinct()
        # what doesn't need each other is computed at the same time
        local, *_ = together(
            lambda: cut(edges),
            lambda: self.external, lambda: self.handlers, lambda: self.ancestors,
        )
        outer = self.edges.join(self.external, ["file_id", "name"]).select("a", F.col("effect").alias("b"), "site").distinct()
        keep = None
        if sound:
            bare, caught = (cut(x) for x in effects.catches(self.handlers, ["site"], "b", "handler", self.ancestors))
            keep = lambda df: effects.uncaught(df, bare, caught, ["site"], "b")
            outer = keep(outer)
        seeds = self.own_effects.select(F.col("fn_id").alias("a"), F.col("effect").alias("b")).unionByName(outer.select("a", "b"))
        if sound:  # calls outside all handlers hand everything on
            sites = apart(self.handlers.select("site").distinct())
            local, free = together(
                lambda: cut(local.join(sites, "site", "left_semi")),
                lambda: cut(local.join(sites, "site", "left_anti").select("a", "b").distinct()),
            )
            return closure.propagate(local, seeds, keep=keep, free=free).select(F.col("a").alias("fn_id"), F.col("b").alias("effect"))
        if self.kept is not None:  # handlers on the way are no part of what is kept
            return self.kept.refresh(local, seeds).select(F.col("a").alias("fn_id"), F.col("b").alias("effect"))
        close = condense.condensed if self.options.condense else closure.propagate
        return close(local, seeds).select(F.col("a").alias("fn_id"), F.col("b").alias("effect"))

    @cached_property
    def reaches(self) -> DataFrame:
        """(fn_id, target): every function that a function calls, directly or not."""
        local = self.edges.join(self.targets.where("fn_id IS NOT NULL"), ["file_id", "name"]).select("a", F.col("fn_id").alias("b"))
        return closure.reachability(local).select(F.col("a").alias("fn_id"), F.col("b").alias("target"))

    @cached_property
    def unhandled(self) -> DataFrame:
        """(call_id, fn_id, effect) that no handler at the call catches."""
        called = self.calls.select("call_id", "fn_id", "file_id", F.col("func_name").alias("name"))
        local = called.join(
            self.targets.where("fn_id IS NOT NULL").select("file_id", "name", F.col("fn_id").alias("target")),
            ["file_id", "name"],
        ).join(self.signatures.withColumnRenamed("fn_id", "target"), "target").select("call_id", "fn_id", "effect")
        outer = called.join(self.external, ["file_id", "name"]).select("call_id", "fn_id", "effect")
        pairs = local.unionByName(outer).distinct().withColumnRenamed("call_id", "site")
        left = effects.unhandled(pairs, self.handlers, ["site"], "effect", "handler", self.ancestors).withColumnRenamed("site", "call_id")
        return cut(left) if self.options.strict else left

    @cached_property
    def directives(self) -> DataFrame:
        return facts.directives(self.files, tuple(self.options.tags))

    @cached_property
    def diagnostics(self) -> DataFrame:
        """file_id, line, col, end_line, message, exc_types, severity."""
        out = self._calls_that_escape().unionByName(self._invalid_directives()).unionByName(self._unread())
        if self.options.strict:
            out = out.unionByName(self._strict())
        if self.options.most_per_file is not None:
            out = rank.keep_newest(out, ["file_id"], ["line", "col", "message"], self.options.most_per_file)
        return out

    def _calls_that_escape(self) -> DataFrame:
        """Calls with effects that are neither handled, nor told by the enclosing docstring, nor ignored on their last line."""
        place = self.calls.select("call_id", "file_id", "func_name", "line", "col", "end_line")
        found = self.unhandled.join(place, "call_id")
        told = self.directives.where("valid").select("file_id", F.col("line").alias("end_line"), "exc_types")
        told = told.groupBy("file_id", "end_line").agg(F.flatten(F.collect_list("exc_types")).alias("told"))
        inside = self.functions.where("name <> '<module>'").select("file_id", F.col("line").alias("fn_line"), "docstring")
        near = rank.asof_backward(found.join(told, ["file_id", "end_line"], "left"), inside, ["file_id"], "end_line", "fn_line", ["docstring"])
        effect, doc = F.col("effect"), F.coalesce("docstring", F.lit(""))
        said = F.contains(F.lower(doc), F.lit("raise")) & F.contains(doc, names.last_part(effect))
        ignored = F.array_contains("told", effect) | F.array_contains("told", names.last_part(effect))
        left = F.array_sort(F.collect_set(F.when(~said, effect))).alias("exc_types")
        call = ["call_id", "file_id", "line", "col", "end_line", "func_name"]
        grouped = effects.unmarked_groups(near, call, ignored, left, F.count_if(said).alias("n_said")).where("size(exc_types) > 0")
        message = text.call_message(F.col("func_name"), F.col("exc_types")).alias("message")
        end = F.when(F.col("n_said") == 0, F.col("end_line")).alias("end_line")
        return grouped.select("file_id", "line", "col", end, message, "exc_types", F.lit("error").alias("severity"))

    def _whole_line(self, rows: DataFrame, message: Column, severity: str) -> DataFrame:
        """A finding without effects at the start of each row's line."""
        none = F.array().cast("array<string>").alias("exc_types")
        return rows.select(
            "file_id", F.col("line").cast("int").alias("line"), F.lit(0).alias("col"), F.lit(None).cast("int").alias("end_line"),
            message.alias("message"), none, F.lit(severity).alias("severity"),
        )

    def _invalid_directives(self) -> DataFrame:
        """Comments that ignore without a list, in files that can be read."""
        rows = self.directives.where("NOT valid").join(facts.errors(self.facts).select("file_id"), "file_id", "left_anti")
        return self._whole_line(rows, F.lit(text.invalid_directive(self.options.tags[0])), "warning")

    def _unread(self) -> DataFrame:
        """Files that can't be parsed, at their first line."""
        rows = facts.errors(self.facts).withColumn("line", F.lit(1))
        return self._whole_line(rows, F.concat(F.lit("failed to analyse file: "), F.col("message")), "error")

    def _strict(self) -> DataFrame:
        fn = self.functions.select("fn_id", "file_id", "name", "line", "col", F.coalesce("docstring", F.lit("")).alias("doc"))
        sigs = self._not_ignored(self.signatures, "effect")
        said = sigs.join(fn, "fn_id").where(F.contains("doc", F.col("effect"))).select("fn_id", "effect")
        shown = effects.undocumented_strict(sigs, self.unhandled, self.calls, said, "fn_id", "effect")
        grouped = shown.groupBy("fn_id").agg(F.array_sort(F.collect_set("effect")).alias("exc_types")).join(fn, "fn_id")
        return grouped.select(
            "file_id", "line", "col", F.lit(None).cast("int").alias("end_line"),
            text.strict_message(F.col("name"), F.col("exc_types")).alias("message"), "exc_types",
            F.lit("warning").alias("severity"),
        )

    @cached_property
    def summary(self) -> DataFrame:
        """files, functions, exceptions, issues: one row."""
        total = lambda df, what, name: df.agg(what.alias(name))
        files = total(self.files, F.count_distinct("path"), "files")
        functions = total(self.functions, F.count("*"), "functions")
        raised = total(facts.raises(self.facts), F.count("*"), "exceptions")
        return files.join(functions).join(raised).join(total(self.diagnostics, F.count("*"), "issues"))


def report_text(diagnostics: DataFrame) -> DataFrame:
    """(value) report lines, in the order of files and positions."""
    line = text.report_line(F.col("file_id"), F.col("line"), F.col("col"), F.col("severity"), F.col("message"))
    return diagnostics.orderBy("file_id", "line", "col", "message").select(line.alias("value"))


def report_json(check: Check) -> DataFrame:
    """(value) one JSON text: diagnostics and summary. For reports read by people: it is a single row."""
    found = check.diagnostics.select(
        F.struct(
            F.col("file_id").alias("file"), "line", F.col("col").alias("column"), "message",
            F.col("exc_types").alias("exceptions"), "severity",
        ).alias("d")
    )
    one = found.agg(F.array_sort(F.collect_list("d")).alias("diagnostics"))
    return one.join(check.summary.select(F.struct("*").alias("summary"))).select(F.to_json(F.struct("diagnostics", "summary")).alias("value"))


def hover(diagnostics: DataFrame, path: str, line: int) -> DataFrame:
    """The first finding on a line."""
    return diagnostics.where((F.col("file_id") == path) & (F.col("line") == line)).orderBy("col", "message").limit(1)

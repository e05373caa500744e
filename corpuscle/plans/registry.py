"""Operators as named table functions over a corpus, found without regard to case."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting, config, modules, references, search, symbols
from ..operators.keep import settled
from ..sources import files as source


@dataclass
class Corpus:
    """Files (path, content and, where known, size and mtime) and what is derived from them, lazily."""

    files: DataFrame
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def lines(self) -> DataFrame:
        return self._once("lines", lambda: search.explode_lines(self.files))

    @property
    def code(self) -> DataFrame:
        """The lines with strings and comments blanked."""
        return self._once("code", lambda: symbols.mask_lines(self.files))

    @property
    def symbols(self) -> DataFrame:
        return self._once("symbols", lambda: symbols.extract_symbols(self.files))

    @property
    def declared(self) -> DataFrame:
        """The symbols with the calls in their bodies, settled: one fold of the files for all that edges and graphs read."""
        return self._once("declared", lambda: settled(symbols.extract_calls(self.files)))

    @property
    def edges(self) -> DataFrame:
        """The call edges, settled: every graph of the corpus reads them."""
        return self._once("edges", lambda: settled(self.call_edges()))

    def call_edges(self) -> DataFrame:
        return references.call_edges(self.lines, self.declared.drop("calls"), references.scanned_sites(self.declared))

    @property
    def cases(self) -> DataFrame:
        return self._once("cases", lambda: symbols.extract_test_cases(self.files))

    @property
    def imports(self) -> DataFrame:
        return self._once("imports", lambda: symbols.imports(self.files))

    @property
    def modules(self) -> DataFrame:
        return self._once("modules", lambda: modules.modules(self.files))


TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TOOLS[name.lower()] = f
        return f

    return add


def call(name: str, corpus: Corpus, **params) -> DataFrame:
    """Run a tool; ValueError for an unknown tool or a missing parameter."""
    if name.lower() not in TOOLS:
        raise ValueError(f"no tool {name}; there are {', '.join(sorted(TOOLS))}")
    try:
        return TOOLS[name.lower()](corpus, **params)
    except TypeError as e:
        raise ValueError(f"{name}: {e}") from e


def _recent(df: DataFrame) -> list:
    return [F.col("mtime").desc()] * ("mtime" in df.columns)


@tool("grep_search")
def grep_search(c: Corpus, pattern: str, include: str | None = None) -> DataFrame:
    keep = tuple(x for x in ("mtime",) if x in c.files.columns)
    lines = search.explode_lines(c.files, keep=keep)
    lines = source.search_files(lines)
    where = search.T.glob_matches(F.col("path"), include) if include else None
    return search.grep(lines, pattern, order=[*_recent(lines), F.lower("path"), F.col("line_no")], where=where)


@tool("read_file")
def read_file(c: Corpus, file_path: str, offset: int = 0, max_lines: int = 500) -> DataFrame:
    return search.read_slice(c.files.filter(F.col("path") == file_path), offset=offset, max_lines=max_lines).orderBy("line_no")


@tool("read_symbol")
def read_symbol(c: Corpus, symbol: str, file_path: str | None = None, include_body: bool = True, include_comments: bool = True, signature_hint: str | None = None) -> DataFrame:
    s = references.find_definitions(c.symbols, symbol, file=file_path, hint=signature_hint, limit=1)
    first = F.least("comment_line", "start_line") if include_comments else F.col("start_line")
    last = F.col("end_line") if include_body else F.greatest("head_line", "start_line")
    x = c.lines.join(F.broadcast(s.select("path", first.alias("_a"), last.alias("_b"))), "path")  # one row
    return x.filter(F.col("line_no").between(F.col("_a"), F.col("_b"))).select("path", "line_no", search.T.numbered(F.col("line_no"), F.col("text")).alias("text")).orderBy("line_no")


@tool("list_directory")
def list_directory(c: Corpus, path: str = "", max_depth: int = 3) -> DataFrame:
    files = c.files.filter(F.col("path").startswith(path.rstrip("/") + "/")) if path else c.files
    return search.tree(files, max_depth=max_depth).orderBy("dir", "kind", F.lower("name"))


@tool("glob_search")
def glob_search(c: Corpus, pattern: str) -> DataFrame:
    return search.glob(c.files.drop("content"), pattern, order=[*_recent(c.files), F.col("path")])


@tool("get_file_outline")
def get_file_outline(c: Corpus, file_path: str) -> DataFrame:
    return symbols.outline(c.symbols, file_path)


@tool("find_definition")
def find_definition(c: Corpus, symbol: str, include: str | None = None) -> DataFrame:
    s = c.symbols.filter(search.T.glob_matches(F.col("path"), include)) if include else c.symbols
    return references.find_definitions(s, symbol)


@tool("find_references")
def find_references(c: Corpus, symbol: str, file_path: str | None = None, include: str | None = None, scope: str = "all", signature_hint: str | None = None) -> DataFrame:
    return references.find_references(c.lines, c.symbols, symbol, scope=scope, file=file_path, include=include, hint=signature_hint)


@tool("find_tests")
def find_tests(c: Corpus, symbol: str | None = None, file_path: str | None = None, test_framework: str | None = None) -> DataFrame:
    return references.tests_for(c.lines, c.cases, c.symbols, symbol, file=file_path, framework=test_framework)


@tool("get_related_files")
def get_related_files(c: Corpus, file_path: str) -> DataFrame:
    used = modules.import_files(c.imports.filter(F.col("path") == file_path), c.files).select(F.lit("imports").alias("relation"), F.col("to").alias("path")).distinct()
    by = modules.dependents(c.files, symbols.exported_types(c.symbols), file_path).select(F.lit("dependent").alias("relation"), "path")
    return used.unionByName(by)


@tool("repo_map")
def repo_map(c: Corpus, scope: str | None = None, max_depth: int = 3, include_dependencies: bool = True) -> DataFrame:
    """Modules, below a folder where scope names one, and, unless include_dependencies is off, what each uses and how often."""
    files = c.files.filter(F.col("path").startswith(scope.strip("/") + "/")).withColumn("path", F.substr("path", F.lit(len(scope.strip("/")) + 2))) if scope else c.files
    found = modules.modules(files, max_depth=max_depth)
    if include_dependencies:
        edges = modules.module_edges(symbols.imports(files), files, found)
        used = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((-F.col("refs")).alias("n"), "dst"))).alias("d"))
        used = used.select(F.col("src").alias("module"), F.transform("d", lambda e: F.struct(e.dst.alias("module"), (-e.n).alias("refs"))).alias("dependencies"))
        found = found.join(used, "module", "left")
    return found.orderBy((F.col("module") != modules.ROOT), "module")


@tool("module_dependencies")
def module_dependencies(c: Corpus) -> DataFrame:
    return modules.module_edges(c.imports, c.files, c.modules)


@tool("call_graph")
def call_graph(c: Corpus, symbol: str, file_path: str | None = None, depth: int = 2, direction: str = "downstream") -> DataFrame:
    return references.call_graph(c.lines, c.declared.drop("calls"), symbol, depth=depth, direction=direction, file=file_path, edges=c.edges)


@tool("ask_user")
def ask_user(c: Corpus, question: str, options: list[str] | None = None, asked_at: str | None = None) -> DataFrame:
    """One row (id, question, options, asked_at): what streaming.activity.answers() pairs with an answer, or times out."""
    at = F.lit(asked_at).cast("timestamp") if asked_at else F.current_timestamp()
    spark = c.files.sparkSession
    return spark.range(1).select(search.T.new_id().alias("id"), F.lit(question).alias("question"), F.array(*[F.lit(o) for o in options or []]).cast("array<string>").alias("options"), at.alias("asked_at"))


@tool("config_lookup")
def config_lookup(c: Corpus, key: str) -> DataFrame:
    return config.config_lookup(c.files, key)


@tool("common_root")
def common_root(c: Corpus) -> DataFrame:
    return accounting.common_root(c.files)


@tool("definition_search")
def definition_search(c: Corpus, symbol: str, include: str | None = None) -> DataFrame:
    return search.definition_search(c.lines, symbol, extension=include)


@tool("expand_context")
def expand_context(c: Corpus, symbols: list[str]) -> DataFrame:
    return references.expand_context(c.lines, c.declared.drop("calls"), symbols, made=lambda: c.edges)

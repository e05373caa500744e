"""Modules, roles, entry points and the dependency graph between modules."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .keep import dropped, settled

ROOT = "(root)"


def role(folder):
    """The first rule that names the folder, without regard to case; else Other."""
    out = None
    for names, label in fixed.ROLE_RULES:
        test = F.lower(folder).isin([n.lower() for n in names])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("Other")


def modules(files: DataFrame, *, max_depth: int = 3, other_from: int = 1) -> DataFrame:
    """(module, role, file_count): directories that hold code, files counted in every ancestor; root files first.

    A directory without a role of its own counts from other_from files on.
    """
    code = files.select("path").filter(T.language(F.col("path")).isNotNull() & ~T.excluded(F.col("path"), "modules")).distinct()
    projects = project_modules(files, code)
    if projects is not None:
        return projects
    entry = code.filter(~F.col("path").contains("/"))
    root = entry.agg(F.count("*").alias("file_count"), F.bool_or(F.col("path").isin(fixed.ENTRY_POINTS)).alias("e")).filter("file_count > 0")
    root = root.select(F.lit(ROOT).alias("module"), F.when(F.col("e"), "Entry Point").otherwise("Other").alias("role"), "file_count")
    dirs = T.directories(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(dirs), F.lit(max_depth))), lambda k: F.array_join(F.slice(dirs, 1, k), "/"))
    held = code.filter(F.size(dirs) > 0).select(F.explode(above).alias("module")).groupBy("module").agg(F.count("*").alias("file_count"))
    held = held.withColumn("role", role(F.substring_index("module", "/", -1)))
    return root.unionByName(held.filter((F.col("role") != "Other") | (F.col("file_count") >= other_from)).select("module", "role", "file_count"))


def project_modules(files: DataFrame, code: DataFrame) -> DataFrame | None:
    """(module, role, file_count), a row a project, where a solution lies in the root and there are several projects; else None."""
    p = F.col("path")
    seen = files.agg(F.count_if(p.rlike(r"(?i)^[^/]+\.sln$")).alias("solutions"), F.count_if(p.rlike(r"(?i)\.csproj$")).alias("projects")).first()
    if not seen.solutions or seen.projects < 2:
        return None
    at = files.filter(p.rlike(r"(?i)\.csproj$")).select(F.array_join(T.directories(p), "/").alias("dir"), F.regexp_replace(T.file_name(p), r"\.[^.]*$", "").alias("stem"))
    at = at.select("dir", F.when(F.col("dir") == "", F.col("stem")).otherwise(F.col("dir")).alias("module")).distinct()
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(T.directories(p)), F.lit(1))), lambda k: F.array_join(F.slice(T.directories(p), 1, k), "/")))
    held = code.select(F.explode(F.array_distinct(ups)).alias("dir")).groupBy("dir").agg(F.count("*").alias("file_count"))
    x = at.join(held, "dir", "left")
    return x.select("module", role(F.substring_index("module", "/", -1)).alias("role"), F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"))


def file_module(files: DataFrame, mods: DataFrame) -> DataFrame:
    """(path, module): the longest module that is a directory above the file, else the root."""
    dirs = T.directories(F.col("path"))
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(dirs), F.lit(1))), lambda k: F.array_join(F.slice(dirs, 1, k), "/"))
    x = files.select("path", F.explode(up).alias("module"))
    x = x.join(mods.select("module", F.lit(True).alias("_m")), "module", "left").groupBy("path")
    best = x.agg(F.max(F.when(F.col("_m"), F.struct(F.length("module").alias("n"), "module"))).alias("b"))
    return best.select("path", F.coalesce("b.module", F.lit(ROOT)).alias("module"))


def entry_points(files: DataFrame) -> DataFrame:
    """(path, description) of files that programs start in, by path."""
    told = F.create_map(*[F.lit(v) for kv in fixed.ENTRY_DESCRIPTIONS.items() for v in kv])
    x = files.filter(T.file_name(F.col("path")).isin(fixed.ENTRY_POINTS) & ~T.excluded(F.col("path"), "modules")).select("path").distinct()
    return x.select("path", F.coalesce(F.try_element_at(told, F.lower(T.file_name(F.col("path")))), F.lit("")).alias("description")).orderBy("path")


_PROBES = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.js"]


#: What decides which file an import names: its target and, of a relative one, the folders it stands in and whether it is Python's.
_ASKED = ["target", "base", "dotted"]


def _asked(imports: DataFrame) -> DataFrame:
    """imports with base and dotted, which are empty and false but for relative targets."""
    relative = F.col("target").startswith(".")
    base = F.when(relative, T.directories(F.col("path"))).otherwise(F.array().cast("array<string>"))
    return imports.select("path", "language", "target", "line_no", base.alias("base"), (relative & F.coalesce(F.col("language") == "python", F.lit(False))).alias("dotted"))


def _named_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(target, base, dotted, to): the file that each different import names, as import_files() says; a target that many files import is tried once."""
    held = F.col("base")
    relative = T.normalize_path(F.concat(F.array_join(held, "/"), F.lit("/"), F.col("target")))
    dots = F.length(F.regexp_extract("target", r"^(\.+)", 1))
    package = F.concat(F.slice(held, 1, F.size(held) - dots + 1), F.filter(F.split(F.substr("target", dots + 1), r"\."), lambda p: p != ""))
    inside = F.array_join(package, "/")
    python = F.when(dots - 1 > F.size(held), F.array().cast("array<string>")).otherwise(F.transform(F.array(F.lit(".py"), F.lit("/__init__.py"), F.lit("")), lambda e: F.ltrim(F.concat(inside, e), F.lit("/"))))
    probes = F.transform(F.array(*[F.lit(p) for p in _PROBES]), lambda p: F.concat(relative, p))
    parts = F.split(F.translate("target", ".", "/"), "/")
    ups = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ends = F.flatten(F.transform(ups, lambda u: F.transform(F.array(*[F.lit(e) for e in (".py", "/__init__.py", ".java", ".cs", ".go", ".rs")]), lambda e: F.concat(u, e))))
    # a directory above stands for the modules below it: the first file of it by path
    dirs = files.select("path", F.array_join(T.directories(F.col("path")), "/").alias("d")).filter("d <> ''").groupBy("d").agg(F.min("path").alias("to"))
    known = files.select(F.col("path").alias("c"), F.col("path").alias("to")).unionByName(dirs.select(F.col("d").alias("c"), "to"))
    tried = F.when(F.col("dotted"), python).when(F.col("target").startswith("."), probes).otherwise(F.concat(ends, ups))
    x = asked.select(*_ASKED).distinct().select(*_ASKED, F.posexplode(tried).alias("k", "c"))
    return x.join(known, "c").groupBy(*_ASKED).agg(F.min_by("to", "k").alias("to"))


def import_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, to): the file that an import names, by the first candidate that exists.

    Dotted names try themselves as paths, then their longest dotted prefix;
    relative ones the usual endings. Prefixes end at a separator. Of a relative
    Python import each dot after the first goes a package up; one that leaves the
    corpus names nothing.
    """
    x = _asked(imports)
    x = x.join(_named_files(x, files), _ASKED).filter("to <> path")
    return x.select("path", "language", "target", "line_no", "to").distinct()


def namespaces(files: DataFrame) -> DataFrame:
    """(path, language, namespace) that C# and Java-like files declare: namespace and package lines outside of comments' first columns."""
    lang = T.language(F.col("path"))
    form = F.when(lang == "csharp", F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*namespace\s+([A-Za-z_][\w.]*)"), F.lit(1))).when(lang == "java", F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*package\s+([A-Za-z_][\w.]*)"), F.lit(1)))
    return files.select("path", lang.alias("language"), F.explode(F.array_distinct(form)).alias("namespace"))


def namespace_modules(files: DataFrame, owner: DataFrame) -> DataFrame:
    """(language, namespace, module): where most of a namespace's files lie, of equal ones the first by name. owner: file_module()."""
    x = namespaces(files).join(owner, "path").groupBy("language", "namespace", "module").agg(F.count("*").alias("n"))
    return x.groupBy("language", "namespace").agg(F.min(F.struct((-F.col("n")).alias("n"), "module"))["module"].alias("module"))


def import_modules(imports: DataFrame, files: DataFrame, mods: DataFrame) -> DataFrame:
    """(path, src, target, dst): the module that an import names.

    C# and Java imports by the namespaces that the files declare: the target itself,
    else its longest prefix of whole segments. Others, and those without a declared
    namespace, by the file that the import names.
    """
    owner = file_module(files, mods)
    # what many files import is looked up once: no hot key meets the namespaces or the files
    sharp = imports.filter(F.col("language").isin("csharp", "java")).select("language", "target").distinct()
    parts = F.split("target", r"\.")
    ups = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    tried = sharp.select("language", "target", F.posexplode(ups).alias("k", "namespace"))
    known = tried.join(namespace_modules(files, owner), ["language", "namespace"]).groupBy("language", "target").agg(F.min_by("module", "k").alias("dst"))
    by_name = imports.join(known, ["language", "target"]).select("path", "line_no", "target", "dst").distinct()
    rest = _asked(imports.join(known, ["language", "target"], "left_anti"))
    named = _named_files(rest, files).join(owner.select(F.col("path").alias("to"), F.col("module").alias("dst")), "to")
    by_file = rest.join(named, _ASKED).filter("to <> path").select("path", "line_no", "target", "dst").distinct()
    return by_name.unionByName(by_file).join(owner.withColumnRenamed("module", "src"), "path").select("path", "src", "target", "dst")


def module_edges(imports: DataFrame, files: DataFrame, mods: DataFrame) -> DataFrame:
    """(src, dst, refs) between different modules, by source and falling count; files need their content for namespaces."""
    if "content" in files.columns:
        x = import_modules(imports, files, mods)
    else:
        owner = file_module(files, mods)
        x = import_files(imports, files).join(owner.withColumnRenamed("module", "src"), "path")
        x = x.join(owner.select(F.col("path").alias("to"), F.col("module").alias("dst")), "to")
    return x.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("refs")).orderBy("src", F.col("refs").desc(), "dst")


def mermaid(edges: DataFrame) -> DataFrame:
    """One row: the graph as Mermaid text."""
    line = F.concat(F.lit("  "), T.mermaid_id(F.col("src")), F.lit(" -->|"), F.col("refs").cast("string"), F.lit("| "), T.mermaid_id(F.col("dst")))
    x = edges.agg(F.array_sort(F.collect_list(F.struct("src", (-F.col("refs")).alias("n"), "dst", line.alias("line")))).alias("l"))
    return x.select(F.concat(F.lit("graph TD\n"), F.array_join(F.col("l.line"), "\n")).alias("text"))


def dependents(files: DataFrame, names: DataFrame, path: str, *, limit: int = 20) -> DataFrame:
    """Files, other than path, whose content contains any of the names that path exports: one scan, one file's names in its filter."""
    exported = sorted(r.name for r in names.filter(F.col("path") == path).select("name").distinct().collect())
    hit = F.lit(False)
    for n in exported:
        hit = hit | F.contains(F.col("content"), F.lit(n))
    return files.filter((F.col("path") != path) & hit).select("path").orderBy("path").limit(limit)


# Manifests by precedence, and the project type they tell.
MANIFESTS = [(r"\.csproj$", ".NET"), (r"^package\.json$", "Node.js"), (r"^(pyproject\.toml|requirements\.txt)$", "Python"), (r"^go\.mod$", "Go"), (r"^cargo\.toml$", "Rust"), (r"^(pom\.xml|build\.gradle)$", "Java"), (r"^(cmakelists\.txt|makefile)$", "C/C++")]


def project_type(files: DataFrame, max_dependencies: int = 15) -> DataFrame:
    """One row: the project type of the first manifest in order of precedence, its path and dependencies."""
    name, kind = F.lower(T.file_name(F.col("path"))), F.lit(None)
    rank = F.lit(None).cast("int")
    for k, (rx, label) in reversed(list(enumerate(MANIFESTS))):
        kind, rank = F.when(name.rlike(rx), label).otherwise(kind), F.when(name.rlike(rx), k).otherwise(rank)
    best = files.select("path", "content", kind.alias("type"), rank.alias("rank")).filter("rank is not null")
    best = best.orderBy("rank", F.size(F.split("path", "/")), "path").limit(1)
    text = F.col("content")
    block = F.regexp_extract(text, r'(?s)"dependencies"\s*:\s*\{(.*?)\}', 1)
    deps = (
        F.when(F.col("type") == ".NET", F.regexp_extract_all(text, F.lit(r'(?i)<PackageReference\s+Include="([^"]+)"'), F.lit(1)))
        .when(F.col("type") == "Node.js", F.regexp_extract_all(block, F.lit(r'"([^"]+)"\s*:'), F.lit(1)))
        .when(F.lower(T.file_name(F.col("path"))) == "requirements.txt", F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z0-9._-]+)"), F.lit(1)))
        .when(F.col("type") == "Go", F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v"), F.lit(1)))
        .when(F.col("type") == "Rust", F.regexp_extract_all(F.regexp_extract(text, r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1), F.lit(r"(?m)^([\w-]+)\s*="), F.lit(1)))
        .when(F.col("type") == "Java", F.regexp_extract_all(text, F.lit(r"<artifactId>([^<]+)</artifactId>"), F.lit(1)))
        .otherwise(F.array().cast("array<string>"))
    )
    return best.select("path", "type", F.slice(deps, 1, max_dependencies).alias("dependencies"))


def is_test_project(path: Column, content: Column) -> Column:
    """Whether a project is named after tests, or refers to a test framework's package; false for broken XML."""
    stem = F.regexp_replace(T.file_name(path), r"\.[^.]*$", "")
    return stem.rlike("(?i)test|spec") | F.exists(T.xml_attributes(content, "PackageReference", "Include"), lambda v: v.rlike("(?i)xunit|nunit|mstest|fluentassertions"))


def dependency_versions(files: DataFrame, limit: int = 15) -> DataFrame:
    """(path, seq, name, version) of the dependencies that manifests name, `limit` of each; a version may be null."""
    name, text = F.lower(T.file_name(F.col("path"))), F.col("content")
    pairs = lambda rx: F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("version"))
    block = F.regexp_extract(text, r'(?s)"dependencies"\s*:\s*(\{.*?\})', 1)
    members = F.transform(F.map_entries(F.from_json(block, "map<string,string>")), lambda e: F.struct(e.key.alias("name"), e.value.alias("version")))
    project = F.regexp_extract(text, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    python = F.transform(F.regexp_extract_all(project, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)), lambda v: F.struct(F.regexp_extract(v, r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.nullif(F.trim(F.regexp_replace(v, r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?", "")), F.lit("")).alias("version")))
    found = (
        F.when(name.endswith(".csproj"), pairs(r'(?i)<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?'))
        .when(name == "package.json", members)
        .when(name == "pyproject.toml", python)
        .when(name == "requirements.txt", pairs(r"(?m)^([A-Za-z0-9._-]+)[ \t]*([=<>!~][^\s;#]*)?"))
        .when(name == "go.mod", pairs(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v\S+)"))
        .when(name == "cargo.toml", pairs(r'(?m)^([\w-]+)\s*=\s*(?:"|\{[^}]*version\s*=\s*")([^"]*)"'))
    )
    x = files.select("path", F.posexplode(F.slice(found, 1, limit)).alias("k", "d"))
    return x.select("path", (F.col("k") + 1).alias("seq"), F.col("d.name").alias("name"), F.nullif("d.version", F.lit("")).alias("version"))


def snapshot_id(files: DataFrame) -> DataFrame:
    """One row: a signature of all paths and times, equal where nothing changed; a key for cached results."""
    return files.agg(F.coalesce(F.sum(F.xxhash64("path", "mtime").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("snapshot"))


class Cached:
    """Results by name and corpus state, for a time: made again once the files' signature has changed or the time is up.

    absolute: seconds from the making on; sliding: seconds from the last use on. The
    files are looked at on every call; what is held is a table in the shared folder, so
    that a hit reads it and computes nothing. A table is deleted when its result goes,
    which every call looks after for all names, so DataFrames of an evicted result
    can no longer be read.
    """

    def __init__(self, absolute: float | None = 300, sliding: float | None = 600, clock: Callable[[], float] = time.monotonic) -> None:
        self.absolute, self.sliding, self.clock = absolute, sliding, clock
        self._held: dict[str, _Held] = {}

    def get(self, name: str, files: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        state = snapshot_id(files).first().snapshot
        self.sweep()
        if name in self._held and self._held[name].state != state:
            self.evict(name)
        now = self.clock()
        if name not in self._held:
            self._held[name] = _Held(state, settled(make()), now, now)
        self._held[name].used = now
        return self._held[name].result

    def sweep(self) -> list[str]:
        """Evict what is out of time; the names."""
        now = self.clock()
        over = lambda since, limit: limit is not None and now - since >= limit
        gone = [n for n, h in self._held.items() if over(h.made, self.absolute) or over(h.used, self.sliding)]
        for n in gone:
            self.evict(n)
        return gone

    def evict(self, name: str) -> None:
        dropped(self._held.pop(name).result)


@dataclass
class _Held:
    state: str
    result: DataFrame
    made: float
    used: float

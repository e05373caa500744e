"""Configuration files: discovery by language, readers, lookup by precedence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import explode_lines

# Fixed values: (language group, pattern of the path from the root, format, precedence); the lowest wins.
_RESOURCES = r"(?:src/main/resources/)?"
DISCOVERY = [
    ("csharp", r"appsettings\.json", "json", 4), ("csharp", r"appsettings\.(?!json$)(?![^/]*local)[^/]*\.json", "json", 3), ("csharp", r"appsettings\.(?!json$)(?=[^/]*local)[^/]*\.json", "json", 1), ("csharp", r"properties/launchsettings\.json", "json", 5),
    ("jsts", r"\.env", "env", 4), ("jsts", r"\.env\.local", "env", 2), ("jsts", r"\.env\.(?:development|production|staging|test)", "env", 3), ("jsts", r"\.env\.(?:development|production|staging|test)\.local", "env", 1),
    ("python", r"\.env", "env", 3), ("python", r"(?:settings|config)\.py", "python", 2), ("python", r"config\.ya?ml", "yaml", 2), ("python", r"config\.ini", "ini", 2), ("python", r"pyproject\.toml", "toml", 4),
    ("java", _RESOURCES + r"application\.properties", "properties", 3), ("java", _RESOURCES + r"application\.ya?ml", "yaml", 3),
    ("java", _RESOURCES + r"application-[^/]*\.properties", "properties", 2), ("java", _RESOURCES + r"application-[^/]*\.ya?ml", "yaml", 2),
    ("java", _RESOURCES + r"bootstrap\.ya?ml", "yaml", 4), ("java", _RESOURCES + r"bootstrap\.properties", "properties", 4),
    ("go", r"config\.ya?ml", "yaml", 2), ("go", r"config\.toml", "toml", 2), ("go", r"config\.json", "json", 2), ("go", r"\.env", "env", 3),
    ("go", r"configs?/[^/]+\.ya?ml", "yaml", 2), ("go", r"configs?/[^/]+\.toml", "toml", 2), ("go", r"configs?/[^/]+\.json", "json", 2), ("go", r"configs?/[^/]*\.env", "env", 2),
    ("rust", r"\.env", "env", 3), ("rust", r"config/default\.toml", "toml", 3), ("rust", r"config/local\.toml", "toml", 1), ("rust", r"config/(?!default\.toml$|local\.toml$)[^/]+\.toml", "toml", 2), ("rust", r"settings\.toml", "toml", 2),
    ("c_cpp", r"[^/]*config[^/]*\.h", "c-define", 2), ("c_cpp", r"cmakelists\.txt", "c-define", 3),
    ("c_cpp", r"config/[^/]+\.ini", "ini", 3), ("c_cpp", r"config/[^/]+\.json", "json", 3), ("c_cpp", r"config/[^/]+\.xml", "xml", 3), ("c_cpp", r"config/[^/]+\.ya?ml", "yaml", 3),
]
_GROUPS = {"javascript": "jsts", "typescript": "jsts", "c": "c_cpp", "cpp": "c_cpp"}


def detected_languages(files: DataFrame) -> DataFrame:
    """(language) of the files, with the groups jsts and c_cpp."""
    seen = files.select(T.language(F.col("path")).alias("language")).filter("language is not null").distinct()
    group = F.create_map(*[F.lit(x) for kv in _GROUPS.items() for x in kv])
    return seen.union(seen.select(F.try_element_at(group, F.col("language")))).filter("language is not null").distinct()


def config_files(files: DataFrame) -> DataFrame:
    """(path, format, precedence, content): each discovered file once, at its lowest precedence.

    Files count in the root and in the folders that their rule names. Of a Go
    corpus's folders configs and config the first that holds a file counts.
    """
    spark = files.sparkSession
    rules = spark.createDataFrame([(g, f"(?i)^{p}$", f, n, k) for k, (g, p, f, n) in enumerate(DISCOVERY)], "language string, pattern string, format string, precedence int, rule int")
    rules = F.broadcast(rules.join(detected_languages(files), "language"))  # a fixed table
    at = files.select("path")
    plural = F.broadcast(at.agg(F.coalesce(F.bool_or(F.col("path").rlike("^configs/")), F.lit(False)).alias("plural")))  # one row
    x = at.join(rules, F.expr("path rlike pattern")).join(plural)
    x = x.filter(~((F.col("language") == "go") & F.col("plural") & F.lower("path").startswith("config/")))
    best = x.groupBy("path").agg(F.min(F.struct("precedence", "rule", "format")).alias("b"))
    return files.join(best, "path").select("path", "b.format", "b.precedence", "content")


def _unquoted(v):
    return F.when(v.rlike(r"^(\".*\"|'.*')$") & (F.length(v) >= 2), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def _carried(lines: DataFrame, header: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("text", header, 1)
    return lines.withColumn("section", F.coalesce(F.last(F.when(F.col("text").rlike(header), F.trim(head)), ignorenulls=True).over(w), F.lit(""))).filter(~F.col("text").rlike(header))


def _pairs(lines: DataFrame, rx: str):
    return lines.filter(F.col("text").rlike(rx)).withColumn("k", F.trim(F.regexp_extract("text", rx, 1))).withColumn("v", F.trim(F.regexp_extract("text", rx, 2)))


def _yaml(batch_lines: DataFrame) -> DataFrame:
    """Keys by indentation: the parents are the nearest lines above with less, found by a fold over the file."""
    x = batch_lines.filter(~F.col("text").rlike(r"^\s*(#|---|\.\.\.|$)") & F.col("text").contains(":"))
    ind = F.length(F.regexp_extract("text", r"^(\s*)", 1))
    x = x.withColumn("k", F.trim(F.regexp_extract("text", r"^([^:]*):", 1))).withColumn("v", F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1)))
    row = F.struct("line_no", ind.alias("i"), "k", "v")
    x = x.groupBy("path", "format", "precedence").agg(F.array_sort(F.collect_list(row)).alias("r"))
    start = F.struct(F.array().cast("array<struct<i:int,k:string>>").alias("up"), F.array().cast("array<struct<line_no:int,key:string,v:string>>").alias("out"))

    def step(a, c):
        up = F.filter(a.up, lambda s: s.i < c.i)
        key = F.array_join(F.concat(F.transform(up, lambda s: s.k), F.array(c.k)), ".")
        return F.struct(F.concat(up, F.array(F.struct(c.i.alias("i"), c.k.alias("k")))).alias("up"), F.concat(a.out, F.array(F.struct(c.line_no.alias("line_no"), key.alias("key"), c.v.alias("v")))).alias("out"))

    x = x.select("path", "format", "precedence", F.explode(F.aggregate("r", start, step, lambda a: a.out)).alias("e"))
    v = F.col("e.v")
    value = F.when((v == "") | v.startswith("#"), "(section)").otherwise(_unquoted(F.trim(F.regexp_replace(v, r" #.*$", ""))))
    return x.select("path", "format", "precedence", F.col("e.line_no").alias("line_no"), F.col("e.key").alias("key"), value.alias("value"))


class _Object(list):
    """An object's members, in order, repeated names included."""


def json_members(content: str) -> list[tuple[str, str, str]] | None:
    """(key, name, value) of all members of nested objects, to any depth; None for what is no JSON.

    Containers are {...} or [n items]; numbers keep their text; scalars right
    inside arrays are no members.
    """

    def refuse(x: str):
        raise ValueError(x)

    try:
        whole = json.loads(content, object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None
    out, left = [], [("", whole)]
    while left:
        prefix, v = left.pop()
        if isinstance(v, _Object):
            below = []
            for name, w in v:
                key = f"{prefix}:{name}" if prefix else name
                shown = "{...}" if isinstance(w, _Object) else f"[{len(w)} items]" if isinstance(w, list) else w if isinstance(w, str) else "null" if w is None else str(w).lower()
                out.append((key, name, shown))
                below.append((key, w))
        else:
            below = [(f"{prefix}[{k}]", w) for k, w in enumerate(v)] if isinstance(v, list) else []
        left += [(k, w) for k, w in reversed(below) if isinstance(w, list)]
    return out


class _Number(str):
    """A number as it is written."""


def quoted_lines(content: str) -> dict[str, int]:
    """The first line (from 1) of everything that stands between two neighbouring quotes of a line."""
    out: dict[str, int] = {}
    for k, line in enumerate(content.split("\n"), 1):
        for token in line.split('"')[1:-1]:
            out.setdefault(token, k)
    return out


def _json(files: DataFrame) -> DataFrame:
    """(path, format, precedence, line_no, key, value): a member's line is the first with its quoted name."""
    names = ["path", "format", "precedence", "line_no", "key", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for path, form, precedence, content in zip(*(b.column(k).to_pylist() for k in range(4))):
                members = json_members(content or "") or []
                lines = quoted_lines(content or "") if members else {}
                for key, name, value in members:
                    at = lines.get(name, -1)
                    for c, v in zip(cols, (path, form, precedence, at, key, value)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()])], names=names)

    return files.select("path", "format", "precedence", "content").mapInArrow(run, "path string, format string, precedence int, line_no int, key string, value string")


def config_entries(files: DataFrame, formats: tuple[str, ...] = ("json", "env", "properties", "yaml", "toml", "ini", "python", "c-define")) -> DataFrame:
    """(path, format, precedence, line_no, key, value) of files (path, format, precedence, content); formats: those to read, a scan each."""
    lines = explode_lines(files, keys=("path", "format", "precedence"))
    of = lambda f: lines.filter(F.col("format") == f)
    keep = ["path", "format", "precedence", "line_no"]
    env = _pairs(of("env").filter(~F.col("text").rlike(r"^\s*(#|$)")), r"^([^=]*)=(.*)$").select(*keep, F.col("k").alias("key"), _unquoted(F.col("v")).alias("value"))
    props = _pairs(of("properties").filter(~F.col("text").rlike(r"^\s*([#!]|$)")), r"^([^=:]*)[=:](.*)$").select(*keep, F.col("k").alias("key"), F.col("v").alias("value"))
    toml = _pairs(_carried(of("toml"), r"^\s*\[\[?([^\[\]]+)\]\]?").filter(~F.col("text").rlike(r"^\s*(#|$)")), r"^\s*(\S+)\s*=(.*)$")
    toml = toml.select(*keep, F.concat(F.when(F.col("section") != "", F.concat("section", F.lit("."))).otherwise(""), F.col("k")).alias("key"), _unquoted(F.col("v")).alias("value"))
    ini = _pairs(_carried(of("ini"), r"^\s*\[([^\]]+)\]").filter(~F.col("text").rlike(r"^\s*([;#]|$)")), r"^([^=]*)=(.*)$")
    ini = ini.select(*keep, F.concat(F.when(F.col("section") != "", F.concat("section", F.lit(":"))).otherwise(""), F.col("k")).alias("key"), F.col("v").alias("value"))
    py = _pairs(of("python"), r"^\s*([A-Za-z_]\w*)\s*=(?!=)(.*)$").select(*keep, F.col("k").alias("key"), _unquoted(F.col("v")).alias("value"))
    define = _pairs(of("c-define"), r"^\s*#\s*define\s+(\w+)\s+(.*)$").select(*keep, F.col("k").alias("key"), F.trim(F.regexp_replace(F.regexp_replace("v", r"//.*$", ""), r"/\*.*$", "")).alias("value"))
    cmake = _pairs(of("c-define"), r"(?i)^\s*(?:set|option)\s*\(\s*(\w+)\s+(?:\"[^\"]*\"\s+)?([^)]*)\)").select(*keep, F.col("k").alias("key"), F.trim("v").alias("value"))
    readers = {"json": [_json(files.filter("format = 'json'"))], "env": [env], "properties": [props], "yaml": [_yaml(of("yaml"))], "toml": [toml], "ini": [ini], "python": [py], "c-define": [define, cmake]}
    parts = [part.select(*keep, "key", "value") for f in formats for part in readers[f]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def config_lookup(files: DataFrame, key: str) -> DataFrame:
    """Entries whose key contains the text, without regard to case, by precedence; the first is effective."""
    hits = config_entries(config_files(files)).filter(F.contains(F.lower("key"), F.lit(key.lower())))
    order = ["precedence", "path", "line_no", "key"]
    best = hits.agg(F.min(F.struct(*order)).alias("_b"))
    return hits.join(F.broadcast(best)).withColumn("is_effective", F.struct(*order) == F.col("_b")).drop("_b").orderBy(*order)  # best: one row

"""Source trees as DataFrames, hidden and underscore files included.

`repo` is a Python data source over a file system all executors mount. The driver
lists the files, and bundles of about BUNDLE bytes of them are the partitions, so
that one large folder is read by many tasks. What a scan wants of a file's
extension, name, size and time is told to the source, so that a file it rules out is
neither planned nor opened. (Spark's own pushdown into Python sources is not used:
in 4.1.2 a filter pushed for one query stays in the source for all later queries on
the same DataFrame, and in a union for the other side.) A text of more than LARGEST
bytes has null content: a row has to fit a task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed
from ..functions import text as T

BUNDLE, LARGEST = 32 << 20, 256 << 20
SCHEMA = "path string, name string, ext string, size bigint, mtime timestamp, content string"


class _Entry(InputPartition):
    pass


class RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.content = options.get("content", "true").lower() != "false"
        profile = options.get("profile", "source")
        self.skip = {d.lower() for d in fixed.EXCLUDED_DIRS.get("source" if profile == "csharp" else profile, [])}
        self.generated = profile == "csharp"
        listed = lambda key: set(options[key].lower().split()) if key in options else None
        self.extensions, self.without = listed("extensions"), listed("without") or set()
        self.names = re.compile(options["names"]) if "names" in options else None
        self.after = float(options["changed_after"]) if "changed_after" in options else None

    def _facts(self, at: str) -> "_Facts | None":
        """What is known of a file without opening it; None if it is not wanted."""
        name = os.path.basename(at)
        dot = name.rfind(".")
        ext = name[dot:].lower() if dot >= 0 else ""
        if (self.extensions is not None and ext not in self.extensions) or ext in self.without or (self.names and not self.names.search(name)):
            return None
        facts = _Facts(at, path=os.path.relpath(at, self.root).replace(os.sep, "/"), name=name, ext=ext)
        return None if self.after is not None and facts["mtime"].timestamp() <= self.after else facts

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for at in self._files(self.root):
            facts = self._facts(at)
            if facts is None:
                continue
            # each file counts a little besides its bytes, for being opened
            n = (min(facts["size"], LARGEST) if self.content else 0) + (1 << 16)
            if held and size + n > BUNDLE:
                out.append(_Entry(held))
                held, size = [], 0
            held.append(at)
            size += n
        return out + [_Entry(held)] if held else out or [_Entry([])]

    def _files(self, top: str, only: str = "") -> Iterator[str]:
        """Files below top; of the folders skipped, obj is walked for generated C# files where those are wanted."""
        for folder, dirs, names in os.walk(top):
            pruned = [d for d in dirs if d.lower() in self.skip] if not only else []
            dirs[:] = sorted(d for d in dirs if d not in pruned)
            for n in sorted(names):
                if n.lower().endswith(only):
                    yield os.path.join(folder, n)
            for d in sorted(pruned) if self.generated else ():
                if d.lower() == "obj":
                    yield from self._files(os.path.join(folder, d), ".globalusings.g.cs")

    def read(self, partition: _Entry) -> Iterator[tuple]:
        for at in partition.value:
            facts = self._facts(at)
            if facts is None:  # changed since it was planned
                continue
            content = None
            if self.content:
                with open(at, "rb") as f:
                    head = f.read(4096)
                    if b"\0" not in head and facts["size"] <= LARGEST:
                        content = (head + f.read()).decode("utf-8-sig", errors="replace")
            yield facts["path"], facts["name"], facts["ext"], facts["size"], facts["mtime"], content


class _Facts(dict):
    """A file's facts; its size and time are asked for when first needed."""

    def __init__(self, at: str, **known: str):
        super().__init__(known)
        self._at = at

    def __missing__(self, key: str):
        info = os.stat(self._at)
        self["size"], self["mtime"] = info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc)
        return self[key]


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        return RepoReader(self.options)


def scan(spark: SparkSession, root: str, profile: str = "source", content: bool = True, *, extensions: list[str] | None = None, without: list[str] | None = None, names: str | None = None, changed_after: datetime | None = None) -> DataFrame:
    """(path, name, ext, size, mtime, content) of the files under root, excluded directories pruned while walking.

    extensions and without are extensions (with the dot, any case) wanted and not
    wanted, names is a glob of file names, changed_after a time: other files are
    not opened. Binary files have null content; content=False opens none. The
    profile csharp also finds generated global usings in obj.
    """
    spark.dataSource.register(RepoSource)
    read = spark.read.format("repo").option("path", root).option("profile", profile).option("content", str(content))
    wanted = {
        "extensions": None if extensions is None else " ".join(extensions), "without": None if without is None else " ".join(without),
        "names": names and T.glob_regex(names, names_only=True), "changed_after": changed_after and changed_after.timestamp(),
    }
    return read.options(**{k: v for k, v in wanted.items() if v is not None}).load()


def scan_for(spark: SparkSession, root: str, what: str, **more) -> DataFrame:
    """A named scan: supported, csharp, projects, code, plain_search or search. It reads what the filter of that name keeps, and opens nothing else."""
    known = {
        "supported": (supported, "source", {"extensions": list(fixed.LANGUAGE_BY_EXTENSION)}),
        "csharp": (csharp, "csharp", {"extensions": [".cs"]}),
        "projects": (project_files, "source", {"names": "*.csproj"}),
        "code": (code_files, "code", {"extensions": fixed.CODE_EXTENSIONS}),
        "plain_search": (plain_search_files, "none", {"extensions": fixed.SEARCH_EXTENSIONS}),
        "search": (search_files, "search", {"without": fixed.DOCUMENT_EXTENSIONS}),
    }
    if what not in known:
        raise ValueError(f"no scan {what}; there are {', '.join(known)}")
    keep, profile, wanted = known[what]
    return keep(scan(spark, root, profile, **{**wanted, **more}))


def _extension(files: DataFrame) -> Column:
    """The extension: a scan's own column, else taken from the path."""
    return F.col("ext") if "ext" in files.columns else T.extension(F.col("path"))


def _name(files: DataFrame) -> Column:
    return F.col("name") if "ext" in files.columns and "name" in files.columns else T.file_name(F.col("path"))


def supported(files: DataFrame) -> DataFrame:
    """The files of known languages, outside excluded directories."""
    return files.filter(_extension(files).isin(list(fixed.LANGUAGE_BY_EXTENSION)) & ~T.excluded(F.col("path"), "source"))


def csharp(files: DataFrame) -> DataFrame:
    """C# files, and generated global usings although they lie in obj."""
    p = F.col("path")
    generated = p.rlike(r"(?i)(^|/)obj/(.*/)?[^/]*\.GlobalUsings\.g\.cs$")
    return files.filter(_extension(files) == ".cs").filter(~T.excluded(p, "source") | generated).dropDuplicates(["path"])


def uploads(files: DataFrame, *, max_mb: float = 20.0) -> DataFrame:
    """files with `accepted` and `reason`: path rules, size gate and executable content (bytes in `raw`)."""
    p = F.col("path")
    reason = F.when(p.contains(".."), "path").when(~T.upload_allowed(p), "type").when(F.col("size") > max_mb * 1024 * 1024, "size")
    if "raw" in files.columns:
        reason = reason.when(T.executable(F.col("raw")), "executable")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def project_meta(rows: DataFrame, content: str = "content", folder: str = "folder_id") -> DataFrame:
    """(folder, display_name, created_at) from metadata JSON; what does not parse leaves the folder's id and null."""
    v = F.try_parse_json(content)
    return rows.select(folder, F.coalesce(F.try_variant_get(v, "$.displayName", "string"), F.col(folder)).alias("display_name"), F.try_variant_get(v, "$.createdAt", "string").cast("timestamp").alias("created_at"))


def project_meta_json(rows: DataFrame, folder: str = "folder_id") -> DataFrame:
    """(folder, content): what project_meta() reads, of rows (folder, display_name, created_at); nulls are left out."""
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return rows.select(folder, F.to_json(F.struct(F.col("display_name").alias("displayName"), at.alias("createdAt"))).alias("content"))


def ingest(files: DataFrame, *, max_mb: float = 20.0, used_mb: float = 0.0, quota_mb: float | None = None) -> DataFrame:
    """One row: files taken and refused, their bytes, and whether the whole upload is within the quota."""
    x = uploads(files, max_mb=max_mb)
    total = F.coalesce(F.sum(F.when(F.col("accepted"), F.col("size"))), F.lit(0))
    fits = F.lit(True) if quota_mb is None else total / F.lit(1024.0 * 1024) + used_mb <= quota_mb
    return x.agg(F.count_if("accepted").alias("taken"), F.count_if(~F.col("accepted")).alias("refused"), total.alias("bytes"), fits.alias("allowed"))


def project_files(files: DataFrame, pattern: str = "*.csproj") -> DataFrame:
    """Files whose name fits the glob, outside excluded directories."""
    return files.filter(_name(files).rlike(T.glob_regex(pattern, names_only=True)) & ~T.excluded(F.col("path"), "source"))


def code_files(files: DataFrame) -> DataFrame:
    """The wide scan: code, configuration, markup, scripts and logs, outside its own excluded directories."""
    return files.filter(_extension(files).isin(fixed.CODE_EXTENSIONS) & ~T.excluded(F.col("path"), "code"))


def plain_search_files(files: DataFrame) -> DataFrame:
    """Files of the extensions that the plain line search reads, wherever they lie."""
    return files.filter(_extension(files).isin(fixed.SEARCH_EXTENSIONS))


def search_files(files: DataFrame) -> DataFrame:
    """What a line search reads: everything but documentation, and but .git, bin and obj; hidden files count."""
    return files.filter(~_extension(files).isin(fixed.DOCUMENT_EXTENSIONS) & ~T.excluded(F.col("path"), "search"))

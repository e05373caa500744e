"""Tables that are appended to, or overwritten by key, in versions.

A write puts its rows, and the keys that it replaces, in new folders of their own;
an entry in the table's log then makes them count, all at once. An entry is made
only if there is none of its number yet, so of two writers one is told to try
again. What a failed write leaves behind is in no entry and is never read. A read
takes the rows of all versions except those whose key a later version has replaced.
Keys and rows stay in Spark; the driver sees one small entry a version, and
compact() folds the versions into one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from . import files as S


class Conflict(RuntimeError):
    """Another writer has made the version meanwhile."""


class Folder:
    """Small files of a folder of any file system that Spark knows, on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p.getFileSystem(self._conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made: False if there is one already. A reader sees all of it or none."""
        fs, p = self._at(f".{uuid.uuid4().hex}")
        stream = fs.create(p)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, to = self._at(name)
        fs.mkdirs(to.getParent())
        done = not fs.exists(to) and fs.rename(p, to)
        if not done:
            fs.delete(p, False)
        return done

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)


class Table:
    """A table under root, whose rows are replaced by the columns of keys."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str):
        self.spark, self.keys, self.folder = spark, keys, Folder(spark, root)
        self.schema = spark.createDataFrame([], schema).schema
        self._kept = StructType([*self.schema.fields]).add("_version", "long")

    def versions(self) -> list[dict]:
        """The log's entries, by number, from the last compaction on."""
        entries = [json.loads(self.folder.read(f"_log/{n}")) for n in self.folder.names("_log")]
        base = max((k for k, e in enumerate(entries) if e["base"]), default=0)
        return entries[base:]

    def read(self) -> DataFrame:
        """The rows that count; a table without a version is empty."""
        entries = self.versions()
        data, gone = ([f"{self.folder.root}/{e[k]}" for e in entries if e[k]] for k in ("data", "keys"))
        if not data:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self._kept).parquet(*data)
        if gone:
            last = self.spark.read.schema(StructType([self._kept[c] for c in [*self.keys, "_version"]])).parquet(*gone)
            last = last.groupBy(*self.keys).agg(F.max("_version").alias("_replaced"))
            on = [rows[c].eqNullSafe(last[c]) for c in self.keys]
            rows = rows.join(last, on, "left").where(F.col("_replaced").isNull() | (rows["_version"] >= F.col("_replaced"))).select(*[rows[c] for c in self.schema.names])
        return rows.select(*self.schema.names)

    def _commit(self, data: DataFrame | None, keys: DataFrame | None, base: bool = False) -> int:
        entries = self.versions()
        number = entries[-1]["version"] + 1 if entries else 1
        entry = {"version": number, "base": base, "data": None, "keys": None}
        for name, df in (("data", data), ("keys", keys)):
            if df is not None:
                entry[name] = f"{name}-{number}-{uuid.uuid4().hex}"
                df.withColumn("_version", F.lit(number).cast("long")).write.parquet(f"{self.folder.root}/{entry[name]}")
        if not self.folder.create(f"_log/{number:012d}", json.dumps(entry)):
            for name in ("data", "keys"):
                if entry[name]:
                    self.folder.delete(entry[name])
            raise Conflict(f"version {number} of {self.folder.root} is another writer's")
        return number

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])

    def append(self, rows: DataFrame) -> int:
        """Add rows; the number of the version."""
        return self._commit(self._shaped(rows), None)

    def _keyed(self, keys: DataFrame) -> DataFrame:
        return keys.select(*[F.col(c).cast(self.schema[c].dataType) for c in self.keys]).distinct()

    def overwrite(self, rows: DataFrame, keys: DataFrame | None = None) -> int:
        """Replace all rows of the keys that occur in rows, or of those in keys, by these."""
        rows = self._shaped(rows)
        return self._commit(rows, self._keyed(rows if keys is None else keys))

    def delete(self, keys: DataFrame) -> int:
        """Drop all rows of the keys."""
        return self._commit(None, self._keyed(keys))

    def compact(self) -> int:
        """One version with the rows that count; older folders are deleted, and queries on them have to be made again."""
        old = self.versions()
        number = self._commit(self.read(), None, base=True)
        for e in old:
            for name in ("data", "keys"):
                if e[name]:
                    self.folder.delete(e[name])
        return number


class Uploads:
    """Uploaded files, the folders that hold them, and a report of each upload."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Table(spark, f"{root}/files", ["folder_id", "path"], "folder_id string, path string, size bigint, content string, uploaded_at timestamp")
        self.folders = Table(spark, f"{root}/folders", ["folder_id"], "folder_id string, meta string, file_count bigint, size_mb double")
        self.reports = Table(spark, f"{root}/reports", ["upload_id"], "upload_id string, folder_id string, taken bigint, refused bigint, bytes bigint, allowed boolean, label string, first timestamp, n bigint, `all` bigint")

    def ingest(self, upload: DataFrame, *, max_mb: float = 20.0, quota_mb: float | None = None) -> DataFrame:
        """Store what an upload may bring; per folder: folder_id, taken, refused, bytes, allowed.

        upload: (folder_id, path, size, content), at will display_name, uploaded_at and
        raw (bytes, tested for executables); rows with unsafe folder ids are refused. A
        path that is there already is overwritten, of rows with one path that of the
        largest size stays. A folder that would hold over quota_mb with it takes nothing.
        Each folder's counts and metadata (name and first upload) are written too.
        """
        names = upload.columns
        at = F.col("uploaded_at").cast("timestamp") if "uploaded_at" in names else F.current_timestamp()
        label = F.col("display_name") if "display_name" in names else F.lit(None).cast("string")
        x = S.uploads(upload.withColumns({"uploaded_at": at, "_label": label}), max_mb=max_mb)
        x = x.withColumn("accepted", F.col("accepted") & F.coalesce(T.traversal_safe(F.col("folder_id")), F.lit(False)))
        one = x.where("accepted").groupBy("folder_id", "path").agg(F.max(F.struct("size", "content", "uploaded_at", "_label")).alias("f")).select("folder_id", "path", "f.*")
        held = self.files.read().select("folder_id", "path", "size").join(one.select("folder_id", "path"), ["folder_id", "path"], "left_anti").join(one.select("folder_id").distinct(), "folder_id", "left_semi")
        kept = held.groupBy("folder_id").agg(F.sum("size").alias("held"), F.count("*").alias("n_held"))
        new = one.groupBy("folder_id").agg(F.sum("size").alias("new"), F.count("*").alias("n_new"), F.max("_label").alias("label"), F.min("uploaded_at").alias("first"))
        fate = new.join(kept, "folder_id", "left").withColumns({"all": F.col("new") + F.coalesce("held", F.lit(0)), "n": F.col("n_new") + F.coalesce("n_held", F.lit(0))})
        fate = fate.withColumn("allowed", F.lit(True) if quota_mb is None else F.col("all") <= F.lit(quota_mb * 1024 * 1024))
        # judged once, before anything is written: the same answer holds for files, folders and the report
        refused = x.groupBy("folder_id").agg(F.count_if(~F.col("accepted")).alias("refused"))
        report = refused.join(fate, "folder_id", "left")
        upload_id = uuid.uuid4().hex
        self.reports.append(report.select(F.lit(upload_id).alias("upload_id"), "folder_id", F.coalesce("n_new", F.lit(0)).alias("taken"), "refused", F.coalesce("new", F.lit(0)).alias("bytes"), F.coalesce("allowed", F.lit(False)).alias("allowed"), "label", "first", "n", "all"))
        done = self.reports.read().where(F.col("upload_id") == upload_id)
        good = done.where("allowed")
        self.files.overwrite(one.join(good.select("folder_id"), "folder_id", "left_semi"))
        old = S.project_meta(self.folders.read().select("folder_id", F.col("meta").alias("content")))
        meta = good.join(old, "folder_id", "left").select("folder_id", F.coalesce("label", "display_name", "folder_id").alias("display_name"), F.coalesce("created_at", "first").alias("created_at"), "n", "all")
        text = S.project_meta_json(meta.select("folder_id", "display_name", "created_at")).withColumnRenamed("content", "meta")
        self.folders.overwrite(meta.join(text, "folder_id").select("folder_id", "meta", F.col("n").alias("file_count"), F.round(F.col("all") / (1024.0 * 1024), 2).alias("size_mb")))
        return done.select("folder_id", F.when(F.col("allowed"), F.col("taken")).otherwise(0).alias("taken"), "refused", F.when(F.col("allowed"), F.col("bytes")).otherwise(0).alias("bytes"), "allowed")


class Sessions:
    """Conversation turns by session."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = Table(spark, root, ["session_id"], "session_id string, seq bigint, role string, content string, is_summary boolean")

    def turns(self) -> DataFrame:
        return self.table.read()

    def append(self, new: DataFrame) -> int:
        """Add turns (session_id, seq in the order of the new ones, role, content, is_summary), numbered on from each session's last."""
        from ..operators.sessions import appended

        now = self.turns()
        mine = now.join(new.select("session_id").distinct(), "session_id", "left_semi")
        last = mine.groupBy("session_id").agg(F.max("seq").alias("seq")).select("session_id", "seq", *[F.lit(None).cast(now.schema[c].dataType).alias(c) for c in ("role", "content", "is_summary")])
        rows = appended(last, new.select(*now.columns))
        return self.table.append(rows.join(last.select("session_id", "seq"), ["session_id", "seq"], "left_anti"))

    def replace(self, turns: DataFrame) -> int:
        """Take the sessions of turns from these alone."""
        return self.table.overwrite(turns)

    def clear(self, session_id: str) -> int:
        return self.table.delete(self.table.spark.createDataFrame([(session_id,)], "session_id string"))


class SymbolIndex:
    """Declarations and masked lines of a corpus, kept by file: only changed files are read and folded again."""

    def __init__(self, spark: SparkSession, root: str):
        self.seen = Table(spark, f"{root}/files", ["path"], "path string, mtime timestamp, size bigint")
        self.symbols = Table(spark, f"{root}/symbols", ["path"], "path string, language string, name string, kind string, containing string, start_line int, end_line int, depth int, signature string, comment_line int, head_line int, is_test boolean")
        self.code = Table(spark, f"{root}/code", ["path"], "path string, line_no int, text string")

    def changed(self, files: DataFrame) -> DataFrame:
        """(path) of files (path, mtime, size) that are new, changed, or gone."""
        old = self.seen.read().select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_old"))
        x = files.select("path", "mtime", "size", F.lit(True).alias("_new")).join(old, "path", "full")
        return x.where("_old is null or _new is null or not (mtime <=> _m and size <=> _s)").select("path")

    def refresh(self, files: DataFrame) -> int:
        """Bring the index up to files (path, mtime, size, content); how many files were new, changed or gone.

        What changed is settled first, so that all tables take the same files. They
        count before the list of files does: a refresh that fails halfway is done again.
        """
        from ..operators import symbols
        from ..operators.keep import dropped, settled

        todo = settled(self.changed(files))
        n = todo.count()
        if n:
            fresh = settled(files.select("path", "mtime", "size", "content").join(todo, "path", "left_semi"))
            self.symbols.overwrite(symbols.extract_symbols(fresh), todo)
            self.code.overwrite(symbols.mask_lines(fresh), todo)
            self.seen.overwrite(fresh, todo)
            dropped(fresh)
        dropped(todo)
        return n

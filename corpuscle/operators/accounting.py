"""Storage, quota, activity and language accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MB = 1024 * 1024


def folder_totals(files: DataFrame, by: str, size: str) -> DataFrame:
    """(by, file_count, size_mb rounded half to even); a folder's own metadata file does not count."""
    if "path" in files.columns:
        files = files.filter(~F.col("path").rlike(r"(?:^|/)\.project-meta\.json$"))
    return files.groupBy(by).agg(F.count("*").alias("file_count"), F.bround(F.sum(size) / F.lit(float(MB)), 2).alias("size_mb"))


def quota_check(files: DataFrame, by: str, size: str, *, add_mb: float, quota_mb: float) -> DataFrame:
    """(by, used_mb, allowed): whether add_mb more would stay within the quota."""
    used = files.groupBy(by).agg((F.sum(size) / F.lit(float(MB))).alias("used_mb"))
    return used.withColumn("allowed", F.col("used_mb") + add_mb <= quota_mb)


def dominant(rows: DataFrame, by: str, value: str, first: str) -> DataFrame:
    """(by, value, n): the commonest value; of several the one seen first."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(first).alias("seen"))
    best = n.groupBy(by).agg(F.max(F.struct("n", (-F.col("seen")).alias("s"), F.col(value).alias("v"))).alias("b"))
    return best.select(by, F.col("b.v").alias(value), F.col("b.n").alias("n"))


def last_activity(items: DataFrame, by: str, ts: str, created: DataFrame | None = None) -> DataFrame:
    """(by, last): the latest time, or the creation time of what has no items."""
    seen = items.groupBy(by).agg(F.max(ts).alias("last"))
    if created is None:
        return seen
    return created.join(seen, by, "left").select(by, F.coalesce("last", "created").alias("last"))


def expired(activity: DataFrame, as_of: str, ttl: str) -> DataFrame:
    return activity.filter(F.col("last") < F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {ttl}"))


def common_root(files: DataFrame) -> DataFrame:
    """One row: the only top-level directory, without regard to case, or null."""
    top = F.substring_index("path", "/", 1)
    nested = F.col("path").contains("/")
    x = files.agg(F.count_distinct(F.lower(top)).alias("n"), F.bool_or(nested).alias("nested"), F.min(top).alias("root"))
    return x.select(F.when((F.col("n") == 1) & F.col("nested"), F.col("root")).alias("root"))


def dedupe_hits(hits: DataFrame, order: list) -> DataFrame:
    """The first hit of each (path, line_no) in order."""
    w = Window.partitionBy("path", "line_no").orderBy(*order)
    return hits.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def folders_by_age(folders: DataFrame, created: str = "created_at", name: str = "folder_id") -> DataFrame:
    """Folders, the newest first."""
    return folders.orderBy(F.col(created).desc_nulls_last(), name)

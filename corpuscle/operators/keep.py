"""Results that are read several times: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where nothing names one, one of our own serves a local master, and any other is told to name one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    place = held.get() if held.isDefined() else sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not (sc.master == "local" or sc.master.startswith("local[")):  # "local-cluster[" has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpuscle-"))
        place = sc._jsc.sc().getCheckpointDir().get()
    return place.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a Parquet table, columns pruned; dropped() or release() deletes it."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _kept.append((spark, at))
    out = spark.read.schema(df.schema).parquet(at)
    out._settled_at = at
    return out


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound the Arrow batches of whole files that tasks hand to Python workers, for this session; smaller settings of the session's stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _delete(spark: SparkSession, at: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> bool:
    """Delete the table of a settled DataFrame, which cannot be read after this; whether there was one."""
    at = getattr(df, "_settled_at", None)
    mine = [k for k in _kept if k[1] == at]
    for k in mine:
        _delete(*k)
        _kept.remove(k)
    return bool(mine)


def release(spark: SparkSession) -> int:
    """Delete all settled tables of the session's cluster; how many there were."""
    mine = [k for k in _kept if k[0].sparkContext is spark.sparkContext]
    for k in mine:
        _delete(*k)
        _kept.remove(k)
    return len(mine)

"""Shared scratch tables: how the operators here cut lineage.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which survives the loss of any executor. Only where
that setting is missing (tests on a local master) a folder of our own is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            place = held.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corpuscle-"))
            place = sc._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return place.rstrip("/")


_open: list["Scratch"] = []


class Scratch:
    """Tables of one operator call, each written once and read back.

    They stay until close(), or release() for all, as the DataFrames that the
    operators return read them lazily.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._made = 0
        _open.append(self)

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df to the shared folder, in a folder for each value of by, and return it read back, free of its lineage."""
        at = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._corpuscle_path = at
        return out

    def small(self, table: DataFrame, limit: int = 4 << 20) -> bool:
        """Whether a kept table's files hold at most `limit` bytes, so that it may go to all tasks.

        The answer picks a join's strategy (broadcast or shuffled), never its rows.
        """
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(table._corpuscle_path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() <= limit

    def _delete(self, at: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if at := getattr(t, "_corpuscle_path", None):
                self._delete(at)

    def close(self) -> None:
        """Delete all tables of the call; what it returned cannot be read after this."""
        self._delete(self.root)
        if self in _open:
            _open.remove(self)


def opened() -> list[Scratch]:
    """The operator calls of this process whose tables are still there."""
    return list(_open)


def release(spark: SparkSession, but: list[Scratch] = ()) -> int:
    """Delete the scratch tables of the operator calls of this process on the session, those in `but` excepted; how many calls that were.

    To be called when the returned DataFrames have been written or are not needed.
    """
    mine = [s for s in _open if s not in but and s.spark.sparkContext is spark.sparkContext]
    for s in mine:
        s.close()
    return len(mine)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound the Arrow batches that tasks hand to Python workers, for this session.

    Whole texts travel in them; Spark's defaults of 10,000 rows and 64 MB cost
    each worker several times that. Smaller settings of the session's stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)

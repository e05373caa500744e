"""A sink of event lines that writes each batch once.

Tasks write their part under names of their own. The batch's entry in the log,
made when all tasks are through, lists the parts that count; a batch that has an
entry already (it was written, but the query restarted before it noted that) is
dropped with its new parts. Readers go by the log. The path may be of any file
system that Arrow knows and that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    lines: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system, root.rstrip("/")


class EventWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Part:
        system, root = _place(self.path)
        system.create_dir(f"{root}/parts", recursive=True)
        name, lines, out = f"{uuid.uuid4().hex}.json", 0, None
        try:
            for row in iterator:
                out = out or system.open_output_stream(f"{root}/parts/{name}")
                out.write(row[0].encode() + b"\n")
                lines += 1
        finally:
            if out:
                out.close()
        return Part(name if out else None, lines)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        system, root = _place(self.path)
        system.create_dir(f"{root}/log", recursive=True)
        entry = f"{root}/log/{batchId:012d}"
        if system.get_file_info(entry).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        made = f"{root}/log/.{uuid.uuid4().hex}"
        with system.open_output_stream(made) as out:
            out.write(json.dumps({"batch": batchId, "lines": sum(m.lines for m in messages if m), "parts": [m.name for m in messages if m and m.name]}).encode())
        system.move(made, entry)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        system, root = _place(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/parts/{m.name}")


class EventSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def streamWriter(self, schema, overwrite: bool) -> EventWriter:
        if len(schema.fields) != 1:
            raise ValueError("the sink takes one column of text")
        return EventWriter(self.options["path"])


def write_events(lines: DataFrame, path: str, checkpoint: str):
    """A stream writer of event_json()'s lines to path; start() it. checkpoint is the query's own folder."""
    lines.sparkSession.dataSource.register(EventSink)
    return lines.writeStream.format("event_lines").option("path", path).option("checkpointLocation", checkpoint)


def written_batches(path: str) -> list[dict]:
    """The log's entries (batch, lines, parts) in order."""
    system, root = _place(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
    return sorted((json.loads(system.open_input_stream(f.path).read()) for f in found if not f.base_name.startswith(".")), key=lambda e: e["batch"])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value): the lines of all batches that count."""
    base = path if "://" in path else f"file://{path}"
    entries = written_batches(path)
    files = [f"{base}/parts/{p}" for e in entries for p in e["parts"]]
    of = spark.createDataFrame([(p, e["batch"]) for e in entries for p in e["parts"]], "part string, batch long")
    if not files:
        return spark.createDataFrame([], "batch long, value string")
    lines = spark.read.text(files).withColumn("part", F.substring_index(F.input_file_name(), "/", -1))
    return lines.join(of, "part").select("batch", "value")

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuscle.streaming import sink, stateful
from corpuscle.streaming.activity import event_json

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def _play(spark, tmp_path, batches, schema, make):
    """The rows that a stream gives for batches of rows, one file a batch, in order."""
    names = [f.split()[0] for f in schema.split(", ")]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        text = "\n".join(json.dumps({n: (v.isoformat() if isinstance(v, datetime) else v) for n, v in zip(names, r)}) for r in rows)
        (tmp_path / "in" / f"{k}.json").write_text(text + "\n")
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    got = []
    query = stream.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return got


def test_answers_are_met_or_visibly_refused(rocks, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [("a", "question", at(0), None), ("b", "question", at(0), None), ("c", "question", at(10), None), ("x", "answer", at(5), "who?")],
        [("a", "answer", at(60), "yes"), ("a", "answer", at(70), "no"), ("a", "question", at(80), None), ("b", "answer", at(301), "too late")],
        [("z", "question", at(2000), None)],
        [("c", "answer", at(1990), "much too late"), ("z", "answer", at(2000), "at once")],
        [("y", "question", at(9000), None)],
        [("y", "answer", at(9001), "ok")],
    ]
    rows = _play(rocks, tmp_path, batches, "id string, kind string, ts timestamp, answer string", lambda s: stateful.rendezvous(s, late="10 seconds"))
    got = {(r.id, r.event, r.reason, (r.at - T0).total_seconds(), r.answer) for r in rows}
    assert len(rows) == len(got) == 10 and got == {
        ("x", "rejected", "unknown", 5, "who?"), ("a", "answered", None, 60, "yes"), ("a", "rejected", "duplicate answer", 70, "no"), ("a", "rejected", "duplicate question", 80, None),
        ("b", "rejected", "late", 301, "too late"), ("b", "timed out", None, 300, None), ("c", "timed out", None, 310, None), ("c", "rejected", "late", 1990, "much too late"),
        ("z", "answered", None, 2000, "at once"), ("y", "answered", None, 9001, "ok"),
    }


def test_call_pairs_and_totals(rocks, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [("r", 1, "start", "grep", at(0)), ("r", 2, "start", "read", at(1)), ("q", 9, "end", None, at(0))],
        [("r", 2, "end", None, at(4)), ("r", 1, "end", "grep", at(10)), ("r", 3, "start", "glob", at(11)), ("r", 3, "start", "glob", at(12))],
        [("r", 3, "end", None, at(13)), ("r", 4, "start", "list", at(14))],
        [("s", 1, "start", "x", at(90_000))],
        [("s", 1, "end", "x", at(90_001))],
    ]
    rows = _play(rocks, tmp_path, batches, "run_id string, call_idx long, kind string, tool_name string, ts timestamp", lambda s: stateful.call_totals(s, late="10 seconds"))
    got = {tuple(r) for r in rows}
    assert got == {
        ("r", 2, "read", 3000, "paired", 1, 3000, 0), ("r", 1, "grep", 10_000, "paired", 2, 13_000, 0), ("r", 3, "glob", None, "start only", 2, 13_000, 1),
        ("r", 3, "glob", 1000, "paired", 3, 14_000, 1), ("r", 4, "list", None, "start only", 3, 14_000, 2), ("q", 9, None, None, "end only", 1, 0, 1), ("s", 1, "x", 1000, "paired", 1, 1000, 0),
    }


def test_unused_folders_expire(rocks, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[("a", at(0)), ("b", at(0))], [("a", at(100)), ("a", at(50))], [("c", at(200))], [("a", at(300)), ("c", at(300))], [("d", at(999))], [("d", at(1000))]]
    rows = _play(rocks, tmp_path, batches, "folder_id string, ts timestamp", stateful.expiries)
    assert sorted((r.folder, int((r.ended - T0).total_seconds() / 60)) for r in rows) == [("a", 220), ("a", 420), ("b", 120), ("c", 420)]


def test_sink_writes_each_event_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed = lambda k, *ids: (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"run_id": i, "tool_name": "grep"}) + "\n" for i in ids))

    def run():
        events = spark.readStream.schema("run_id long, tool_name string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = sink.write_events(event_json(events), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    assert sink.read_events(spark, str(tmp_path / "out")).count() == 0
    feed(0, 1, 2, 3)
    run()
    feed(1, 4)
    run()
    # the query dies after the sink has committed its last batch and before it notes that
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    feed(2, 5, 6)
    run()
    got = sink.read_events(spark, str(tmp_path / "out"))
    assert sorted(r.runId for r in got.select(F.from_json("value", "runId long").alias("v")).select("v.*").collect()) == [1, 2, 3, 4, 5, 6]
    assert [b["batch"] for b in sink.written_batches(str(tmp_path / "out"))] == [0, 1, 2]
    assert len(list((tmp_path / "out" / "parts").iterdir())) == sum(len(b["parts"]) for b in sink.written_batches(str(tmp_path / "out")))
    writer = sink.EventWriter(str(tmp_path / "out"))
    part = writer.write(iter([("lost",)]))
    writer.abort([part, None], 9)
    assert not (tmp_path / "out" / "parts" / part.name).exists()

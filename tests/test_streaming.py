from pyspark.sql import functions as F

from corpuscle.streaming import activity


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def stream(spark, tmp_path, name, rows, schema):
    at = str(tmp_path / name)
    spark.createDataFrame(rows, schema).select(*[F.col(c).cast("timestamp") if c.endswith(("ts", "_at")) else F.col(c) for c in [x.split()[0] for x in schema.split(", ")]]).write.parquet(at)
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)


def test_idle_sessions_close(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:04:00"), ("v", "2024-01-01 05:00:00")]
    got = drained(spark, activity.idle_sessions(stream(spark, tmp_path, "e", rows, "user string, ts string"), by="user", ts="ts", late="0 seconds"), "idle")
    assert [(r.user, r.n) for r in got] == [("u", 2)]


def test_answers_time_out(spark, tmp_path):
    q = stream(spark, tmp_path, "q", [("1", "2024-01-01 00:00:00"), ("2", "2024-01-01 00:00:00"), ("z", "2024-01-02 00:00:00")], "id string, asked_at string")
    a = stream(spark, tmp_path, "a", [("1", "2024-01-01 00:04:00", "yes"), ("2", "2024-01-01 00:06:00", "late"), ("z", "2024-01-03 00:00:00", "x")], "id string, answered_at string, answer string")
    got = {r.id: r.answer for r in drained(spark, activity.answers(q, a), "answers")}
    assert got["1"] == "yes" and got.get("2") is None


def test_event_json(spark):
    df = spark.createDataFrame([("start", None, 3)], "event_type string, tool_name string, duration_ms int")
    assert activity.event_json(df).first().value == '{"eventType":"start","durationMs":3}'

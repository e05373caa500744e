"""Streaming twins: idle sessions, answers in time, call pairs, event JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idle_sessions(events: DataFrame, *, by: str, ts: str, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(by, started, ended, n) once a key has been idle for the gap and the watermark has passed."""
    w = F.session_window(ts, gap)
    out = events.withWatermark(ts, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def answers(questions: DataFrame, answered: DataFrame, *, limit: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Questions (id, asked_at) with their answer (id, answered_at, answer) within the limit, else null on time-out."""
    q = questions.withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["id"])
    a = answered.select(F.col("id").alias("a_id"), "answered_at", "answer").withWatermark("answered_at", late)
    on = (F.col("id") == F.col("a_id")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {limit}"))
    return q.join(a, on, "leftOuter").drop("a_id")


def call_durations(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """(run_id, call_idx, tool_name, duration_ms) from start and end events (kind, ts)."""
    start = events.filter("kind = 'start'").select("run_id", "call_idx", "tool_name", F.col("ts").alias("s")).withWatermark("s", late)
    end = events.filter("kind = 'end'").select(F.col("run_id").alias("r"), F.col("call_idx").alias("c"), F.col("ts").alias("e")).withWatermark("e", late)
    on = (F.col("run_id") == F.col("r")) & (F.col("call_idx") == F.col("c")) & (F.col("e") >= F.col("s")) & (F.col("e") <= F.col("s") + F.expr("INTERVAL 1 HOUR"))
    return start.join(end, on).select("run_id", "call_idx", "tool_name", (F.unix_millis("e") - F.unix_millis("s")).alias("duration_ms"))


def running_totals(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """(run_id, tool_calls, duration_ms) so far, of end events: for a sink in update mode."""
    x = events.filter("kind = 'end'").withWatermark("ts", late)
    return x.groupBy("run_id").agg(F.count("*").alias("tool_calls"), F.sum("duration_ms").alias("duration_ms"))


def expired_folders(activity: DataFrame, *, folder: str, ts: str, ttl: str = "120 minutes", late: str = "0 seconds") -> DataFrame:
    """(folder, ended) of folders without activity for the ttl: a session window that closes is an expiry."""
    w = F.session_window(ts, ttl)
    return activity.withWatermark(ts, late).groupBy(folder, w.alias("w")).count().select(folder, F.col("w.end").alias("ended"))


def event_json(events: DataFrame) -> DataFrame:
    """(value): one JSON object an event, keys in camel case, nulls left out."""
    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(x.title() for x in rest)

    return events.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in events.columns])).alias("value"))

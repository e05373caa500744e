"""Stateful streams: questions that wait for an answer, pairs of calls, folders that expire.

Each is a processor of transformWithState over one key's state: a question, a
call that runs, a folder's last use. State goes when its timer fires, so it is
bounded by what is open. Timers are in event time; the watermark that drives them
comes from all input, so a key without further rows still times out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_MS = 1000


def _ms(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


def _stream(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="eventTime")


class _Rendezvous(StatefulProcessor):
    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit, self.keep = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "at long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, state = [], self.asked.get() if self.asked.exists() else None
        every = pd.concat(list(rows))
        every = every.assign(ms=_ms(every["ts"]), after=every["kind"] != "question").sort_values(["ms", "after", "answer"], kind="stable")
        for r in every.itertuples():
            if r.kind == "question":
                if state is None:
                    state = (r.ms, "open")
                    self.handle.registerTimer(r.ms + self.limit)
                else:
                    out.append((key[0], "rejected", "duplicate question", r.ms, None))
                continue
            if state is None:
                fate = ("rejected", "unknown")
            elif state[1] == "answered":
                fate = ("rejected", "duplicate answer")
            elif state[1] == "timed out" or r.ms > state[0] + self.limit:
                fate = ("rejected", "late")
            elif r.ms < state[0]:
                fate = ("rejected", "early")
            else:
                state, fate = (state[0], "answered"), ("answered", None)
                self.handle.deleteTimer(state[0] + self.limit)
                self.handle.registerTimer(state[0] + self.limit + self.keep)
            out.append((key[0], *fate, r.ms, r.answer))
        if state is not None:
            self.asked.update(state)
        yield _fates(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, state = self.asked.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if state == "open":
            self.asked.update((at, "timed out"))
            self.handle.registerTimer(due + self.keep)
            yield _fates([(key[0], "timed out", None, due, None)])
        else:
            self.asked.clear()
            yield from ()


def _fates(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "event", "reason", "at", "answer"])
    return out.assign(at=pd.to_datetime(out["at"], unit="ms"))


def rendezvous(events: DataFrame, *, limit_seconds: int = 300, keep_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(id, event, reason, at, answer) from questions and answers (id string, kind, ts, answer).

    event: answered, by the first answer within the limit; timed out, when the
    watermark passes the limit without one; rejected, with the reason: duplicate
    question, duplicate answer, late, early, or unknown for an answer whose question
    has not come. What became of a question is remembered keep_seconds longer; an
    answer after that is unknown.
    """
    x = events.select(F.col("id").cast("string").alias("id"), "kind", "ts", F.col("answer").cast("string").alias("answer"))
    return _stream(x, "id", _Rendezvous(limit_seconds * _MS, keep_seconds * _MS), "id string, event string, reason string, at timestamp, answer string", late)


class _Calls(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "call_idx long", "kind string, tool_name string, at long")
        self.totals = handle.getValueState("totals", "started long, ended long, unmatched long, duration_ms long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = dict(zip(_COUNTS, self.totals.get() if self.totals.exists() else (0, 0, 0, 0, 0)))
        out = []
        every = pd.concat(list(rows))
        every = every.assign(ms=_ms(every["ts"]), second=every["kind"] == "end").sort_values(["ms", "second", "call_idx"], kind="stable")
        for r in every.itertuples():
            held = self.open.getValue((r.call_idx,)) if self.open.containsKey((r.call_idx,)) else None
            n["last"] = max(n["last"], r.ms)
            n["started" if r.kind == "start" else "ended"] += 1
            if held is not None and held[0] != r.kind:
                took = abs(r.ms - held[2])
                n["duration_ms"] += took
                self.open.removeKey((r.call_idx,))
                out.append(_call(key, r.call_idx, r.tool_name or held[1], took, "paired", n))
            else:
                if held is not None:  # a second start or end of one call: the first stands alone
                    n["unmatched"] += 1
                    out.append(_call(key, r.call_idx, held[1], None, f"{held[0]} only", n))
                self.open.updateValue((r.call_idx,), (r.kind, r.tool_name, r.ms))
        self.totals.update(tuple(n[c] for c in _COUNTS))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(n["last"] + self.wait)
        yield pd.DataFrame(out, columns=_CALL)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, out = dict(zip(_COUNTS, self.totals.get())), []
        for (idx,), (kind, tool, _) in sorted(self.open.iterator()):
            n["unmatched"] += 1
            out.append(_call(key, idx, tool, None, f"{kind} only", n))
        self.open.clear()
        self.totals.clear()
        yield pd.DataFrame(out, columns=_CALL)


_COUNTS = ("started", "ended", "unmatched", "duration_ms", "last")
_CALL = ["run_id", "call_idx", "tool_name", "duration_ms", "status", "tool_calls", "total_ms", "unmatched"]


def _call(key, idx, tool, took, status, n) -> tuple:
    return (key[0], idx, tool, took, status, n["ended"], n["duration_ms"], n["unmatched"])


def call_totals(events: DataFrame, *, wait_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(run_id, call_idx, tool_name, duration_ms, status, tool_calls, total_ms, unmatched) from starts and ends (run_id, call_idx, kind, tool_name, ts).

    One row a call, when its pair is there (status paired), when another of the
    same kind takes its place, or when a run has been silent for wait_seconds (start
    only, end only; no duration). The last three are the run's totals by then: ends
    so far, milliseconds of the pairs, calls without a pair. A run that goes on after
    that counts anew.
    """
    x = events.select(F.col("run_id").cast("string").alias("run_id"), F.col("call_idx").cast("long").alias("call_idx"), "kind", F.col("tool_name").cast("string").alias("tool_name"), "ts")
    return _stream(x, "run_id", _Calls(wait_seconds * _MS), "run_id string, call_idx long, tool_name string, duration_ms long, status string, tool_calls long, total_ms long, unmatched long", late)


class _Expiry(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = last = self.last.get()[0] if self.last.exists() else None
        ended = []
        for t in sorted(t for r in rows for t in _ms(r["ts"])):
            if last is not None and t >= last + self.ttl:  # used again before the watermark had told that it expired
                ended.append(last + self.ttl)
            last = t if last is None else max(last, t)
        if last != first:
            if first is not None:
                self.handle.deleteTimer(first + self.ttl)
            self.last.update((last,))
            self.handle.registerTimer(last + self.ttl)
        if ended:
            yield pd.DataFrame({"folder": key[0], "ended": pd.to_datetime(ended, unit="ms")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"folder": [key[0]], "ended": pd.to_datetime([expiredTimerInfo.getExpiryTimeInMs()], unit="ms")})


def expiries(activity: DataFrame, *, folder: str = "folder_id", ts: str = "ts", ttl_minutes: int = 120, late: str = "0 seconds") -> DataFrame:
    """(folder, ended): each folder once it has not been used for the ttl. A folder used again later expires again."""
    x = activity.select(F.col(folder).cast("string").alias("folder"), F.col(ts).alias("ts"))
    return _stream(x, "folder", _Expiry(ttl_minutes * 60 * _MS), "folder string, ended timestamp", late)

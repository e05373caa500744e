"""Conversation history and tool-call telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def token_estimate(turns: DataFrame, session: str = "session_id", content: str = "content") -> DataFrame:
    """(session, tokens): a third of the code points, rounded down."""
    return turns.groupBy(session).agg(F.floor(F.sum(F.length(content)) / 3).alias("tokens"))


def keep_count(n: Column) -> Column:
    """Turns that a compression leaves: a fifth, two at least, rounded up to even, n at most."""
    k = F.greatest(F.lit(2), F.floor(n / 5))
    return F.least(n, k + k % 2)


def history_split(turns: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """turns with `part`: keep for the latest turns, compress for the others."""
    w = Window.partitionBy(session)
    x = turns.withColumn("_n", F.count("*").over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.col(seq).desc())))
    return x.withColumn("part", F.when(F.col("_back") <= keep_count(F.col("_n")), "keep").otherwise("compress")).drop("_n", "_back")


def run_totals(calls: DataFrame) -> DataFrame:
    """(run_id, tool_calls, iterations, duration_ms, tools), and of calls that tell them: input_tokens, output_tokens, and both by agent, main and sub."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens") if c in calls.columns]
    if "agent" in calls.columns:
        sums += [F.sum(F.when(F.col("agent") == a, F.col(c)).otherwise(0)).alias(f"{a}_{c}") for a in ("main", "sub") for c in ("input_tokens", "output_tokens") if c in calls.columns]
    return calls.groupBy("run_id").agg(F.count("*").alias("tool_calls"), F.count_distinct("iteration").alias("iterations"), F.sum("duration_ms").alias("duration_ms"), F.array_sort(F.collect_set("tool_name")).alias("tools"), *sums)


def session_ring(turns: DataFrame, session: str = "session_id", seq: str = "seq", *, over: int = 20, keep: int = 10) -> DataFrame:
    """turns, of sessions with more than `over` only the last `keep`."""
    w = Window.partitionBy(session)
    x = turns.withColumn("_n", F.count("*").over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.col(seq).desc())))
    return x.filter((F.col("_n") <= over) | (F.col("_back") <= keep)).drop("_n", "_back")


def compressed(turns: DataFrame, summaries: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """turns whose compressed part stands as one summary (session, content) before what is kept; others as they are."""
    split = history_split(turns, session, seq).join(summaries.select(session, F.col("content").alias("_c")), session, "left")
    told = split.filter(F.col("_c").isNotNull() & (F.col("part") == "compress"))
    told = told.groupBy(session).agg(F.min(seq).alias(seq), F.first("_c").alias("content")).withColumn("role", F.lit("system")).withColumn("is_summary", F.lit(True))
    kept = split.filter(F.col("_c").isNull() | (F.col("part") == "keep")).drop("_c", "part")
    kept = kept if "is_summary" in kept.columns else kept.withColumn("is_summary", F.lit(False))
    return kept.unionByName(told.select(*[F.col(c) if c in told.columns else F.lit(None).alias(c) for c in kept.columns]))


_CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
_NATIVE = r"(?s)<\|channel\|>[^<]*?to=(\S+?)\s[^<]*?<\|message\|>\s*(\{.*?\})\s*<\|call\|>"


def tool_calls(messages: DataFrame, content: str = "content", keys: tuple[str, ...] = ("session_id", "seq")) -> DataFrame:
    """(keys, call_idx, tool_name, arguments) of the tool calls written in texts; malformed JSON is skipped.

    Texts without a call of the usual form are read for a model's own tokens, whose
    names and argument keys become those of the registry.
    """
    found = F.regexp_extract_all(content, F.lit(_CALL), F.lit(1))
    x = messages.select(*keys, F.posexplode(found).alias("call_idx", "body")).withColumn("v", F.try_parse_json("body"))
    x = x.withColumn("tool_name", F.try_variant_get("v", "$.name", "string")).filter("trim(tool_name) <> ''")
    args = F.coalesce(F.to_json(F.try_variant_get("v", "$.arguments", "variant")), F.lit("{}"))
    usual = x.select(*keys, "call_idx", "tool_name", args.alias("arguments"))
    bodies = F.transform(found, lambda b: F.try_variant_get(F.try_parse_json(b), "$.name", "string"))
    rest = messages.filter(F.col(content).contains("<|") & ~F.exists(bodies, lambda n: F.coalesce(F.trim(n) != "", F.lit(False))))
    pairs = F.arrays_zip(F.regexp_extract_all(content, F.lit(_NATIVE), F.lit(1)).alias("name"), F.regexp_extract_all(content, F.lit(_NATIVE), F.lit(2)).alias("body"))
    y = rest.select(*keys, F.posexplode(pairs).alias("call_idx", "c"))
    short = F.substring_index("c.name", ".", -1)
    names = F.create_map(*[F.lit(v) for kv in fixed.NATIVE_TOOLS.items() for v in kv])
    renamed = F.create_map(*[F.lit(v) for kv in fixed.NATIVE_KEYS.items() for v in kv])
    named = lambda k: F.coalesce(F.try_element_at(renamed, F.lower(k)), k)
    members = F.map_filter(F.from_json("c.body", "map<string,variant>"), lambda k, v: named(k) != "")
    text = F.to_json(F.transform_keys(members, lambda k, v: named(k)))
    native = y.filter(F.try_parse_json("c.body").isNotNull()).select(*keys, "call_idx", F.coalesce(F.try_element_at(names, F.lower(short)), short).alias("tool_name"), text.alias("arguments"))
    return usual.unionByName(native)


_THINK = r"(?s)<(think|thinking|reasoning)>(.*?)</\1>"


def thinking(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, _THINK, 2))


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _THINK, ""))


def answered_within(events: DataFrame, ask: Column, answer: Column, by: str, ts: str, limit: str) -> DataFrame:
    """Each question with its first answer within the limit, or null (timed out)."""
    # from the latest event back, the answer seen last is the next one at or after the question: one running value
    w = Window.partitionBy(by).orderBy(F.col(ts).desc(), F.when(answer, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last(F.when(answer, F.col(ts)), ignorenulls=True).over(w)
    x = events.withColumn("answered_at", nxt).filter(ask)
    return x.withColumn("answered_at", F.when(F.col("answered_at") <= F.col(ts) + F.expr(f"INTERVAL {limit}"), F.col("answered_at")))


def activity_sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """(by, started, ended, n): runs of events with less than the gap between them."""
    w = Window.partitionBy(by).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    x = events.withColumn("_new", F.when(us - F.lag(us).over(w) < gap_seconds * 1_000_000, 0).otherwise(1))
    x = x.withColumn("_s", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(by, "_s").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("_s")


def appended(turns: DataFrame, new: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """turns and the new ones, numbered on from each session's last."""
    last = turns.groupBy(session).agg(F.max(seq).alias("_last"))
    w = Window.partitionBy(session).orderBy(seq)
    n = new.withColumn(seq, F.row_number().over(w).cast("long")).join(last, session, "left").withColumn(seq, F.col(seq) + F.coalesce("_last", F.lit(0))).drop("_last")
    return turns.unionByName(n.select(*turns.columns))


def replaced(turns: DataFrame, new: DataFrame, session: str = "session_id") -> DataFrame:
    """turns with the sessions of new taken from new alone."""
    return turns.join(new.select(session).distinct(), session, "left_anti").select(*turns.columns).unionByName(new.select(*turns.columns))


def cleared(turns: DataFrame, session_id: str, session: str = "session_id") -> DataFrame:
    return turns.filter(~F.col(session).eqNullSafe(F.lit(session_id)))


def files_touched(calls: DataFrame, path: str = "file_path") -> DataFrame:
    """(run_id, files): the distinct files that a run's tool calls name in their arguments."""
    p = F.try_variant_get(F.try_parse_json("arguments"), f"$.{path}", "string")
    return calls.groupBy("run_id").agg(F.array_sort(F.collect_set(p)).alias("files"))

"""Mixing sources to target weights by entropy balancing.

Each source's documents get rates min(cap, exp(lambda * size / mean size)), the
rates of least entropy cost that meet the source's token target: the convex dual
has one multiplier for each source, and all are solved together by safeguarded
Newton steps, each one aggregation over the corpus. Rates become whole copies:
a document takes its rate's integer part, and one more where its place, the hash
of its content less the rate's fraction, lies below a cut that keeps the source's
tokens within its target. Cuts are found digit by digit, by aggregations; where
the next document ends a source more than a thousandth short, the largest that fit
into the rest fill it, until none fits, by a second and third extra copy too, within
the cap. A last document is taken where that comes nearer to the target.

Sources: the driver holds some hundred bytes for each, whatever their documents.
Up to SOURCES of them (about 5 MB) the solved numbers go to all tasks; beyond
that they are joined by source and a key that depends on it, which lets adaptive
execution split a hot source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near_dedup import spread_join
from .storage import Scratch, small_batches
from .textcore import _SPACE, buffers, chunks

WEIGHTS = (5, 2, 1)
CAP = 3
#: Sources whose parameters go to all tasks.
SOURCES = 50_000
NEWTON_STEPS, FILLS, NEAR = 200, 200, 1e-3
#: Documents of a source that one round of filling brings to the driver.
_FIRST = 16
_BITS, _DIGIT = 53, 12


def count_words(column: pa.Array) -> np.ndarray:
    """Runs of bytes other than space and 0x09-0x0D, by row; null: 0."""
    buf, off = buffers(column)
    out = np.zeros(len(off) - 1, np.int64)
    for i, j in chunks(off):
        part = buf[off[i] : off[j]]
        if len(part) == 0:
            continue
        word = ~_SPACE[part]
        start = word.copy()
        start[1:] &= ~word[:-1]
        edges = off[i:j] - off[i]
        edges = edges[edges < len(part)]
        start[edges] = word[edges]
        run = np.concatenate([[0], np.cumsum(start)])
        out[i:j] = np.diff(run[off[i : j + 1] - off[i]])
    return out


def with_size(docs: DataFrame, text_col: str, name: str, keep_text: bool = True) -> DataFrame:
    """docs with one more column, the words of the whole text; without the text unless keep_text."""
    at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(count_words(b.column(at)))], names=names)

    fields = [docs.schema.fields[k] for k in kept]
    names = [f.name for f in fields] + [name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` long")


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources by code point, null last, take the weights in turn and share the sum
    of all sizes; a source stops at cap times its size, and the excess is shared
    again by weight among the others until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        full = [s for s in free if share[s] > cap * sizes[s]]
        if not full:
            out |= share
            break
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _rate(size: str, cap: float) -> Column:
    """A document's rate, from its source's lam and mean; a null lam stands for the cap."""
    return F.coalesce(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col(size) / F.col("mean"))), F.lit(float(cap)))


def _place(rate: Column) -> Column:
    """Order of taking the extra copy: the hash of h and k less the rate's fraction, 0 to 2**53."""
    u = F.shiftrightunsigned(F.xxhash64("h", "k", F.lit(6)), 11) / F.lit(float(1 << 53))
    return ((u - (rate - F.floor(rate)) + 1) * float(1 << (_BITS - 1))).cast("long")


def _content(*columns: str) -> Column:
    """A hash of the columns, nulls told from values."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with k: 0, or for rows of equal h their running number from 1.

    Rows of equal h are alike, so any order among them gives the same mix. Only
    they are dealt out, in 1,024 parts for each h, with the parts' offsets added.
    """
    again = scratch.keep(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.lit(True).alias("_again")), "again")
    if again.isEmpty():
        return rows.withColumn("k", F.lit(0).cast("long"))
    x = rows.join(F.broadcast(again), "h", "left") if scratch.small(again) else spread_join(rows, again, "h", "left")
    once = x.filter("_again is null").drop("_again").withColumn("k", F.lit(0).cast("long"))
    same = scratch.keep(x.filter("_again").drop("_again").withColumn("_part", F.monotonically_increasing_id() % 1024), "same")
    parts = same.groupBy("h", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("h", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    same = same.withColumn("_at", F.row_number().over(Window.partitionBy("h", "_part").orderBy("h")))
    same = same.join(parts, ["h", "_part"]).withColumn("k", (F.col("_before") + F.col("_at")).cast("long"))
    return once.unionByName(same.select(*once.columns))


def _takes(step: Column, size: str) -> Column:
    """Whether a step (start, cut, limit, level) gives a row its level-th extra copy."""
    return (F.col("place") >= step.start) & (F.col("place") < step.cut) & (F.col(size) <= step.limit)


def _by_source(rows: DataFrame, params: DataFrame, sources: int) -> DataFrame:
    """rows joined with the parameters (key, ...), one row a source; sources: how many there are."""
    return rows.join(F.broadcast(params), "key") if sources <= SOURCES else spread_join(rows, params, "key")


class Mix:
    """A solved mix: one row of parameters for each source."""

    def __init__(self, params: DataFrame, sources: int, cap: float):
        self.params, self.sources, self.cap = params, sources, cap

    def copies(self, docs: DataFrame, source_col: str, size_col: str) -> DataFrame:
        """docs (with h and k) with rate, copies, source_size and target."""
        x = _by_source(docs.withColumn("key", _key(source_col)), self.params, self.sources)
        x = x.withColumn("rate", _rate(size_col, self.cap)).withColumn("place", _place(F.col("rate")))
        whole = F.floor("rate")
        extra = F.size(F.filter("taken", lambda t: _takes(t, size_col) & (whole + t.level <= int(self.cap))))
        return x.withColumn("copies", whole + F.when(F.col("rate") < self.cap, extra).otherwise(0)).drop("key", "lam", "mean", "place", "taken")


def _cuts(part: DataFrame, rest: dict[str, float], known) -> tuple[dict[str, int], dict[str, float]]:
    """The place below which each source's sizes sum to its rest at most, and what then is left of it.

    Found a digit at a time, each by one aggregation over part (key, place,
    size), whose window sees at most 2**_DIGIT rows a source.
    """
    prefix, cut, rest = dict.fromkeys(rest, 0), {}, dict(rest)
    shift = _BITS
    while shift > 0 and len(cut) < len(rest):
        width = min(_DIGIT, shift)
        shift -= width
        live = [k for k in rest if k not in cut]
        here = known(part, prefix={k: prefix[k] for k in live}, rest={k: rest[k] for k in live})
        here = here.filter(F.shiftright("place", shift + width) == F.col("prefix"))
        bins = here.groupBy("key", "rest", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("s"))
        w = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("s").over(w))
        edge = bins.groupBy("key").agg(F.max("upto").alias("whole"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bin", "s", "upto"))).alias("at"))
        found = {r.key: r for r in edge.collect()}
        for k in live:
            r = found.get(k)
            if r is None or r["at"] is None:  # all of it is taken
                cut[k] = (prefix[k] + 1) << (shift + width)
                rest[k] -= r.whole if r else 0
                continue
            prefix[k] = r["at"].bin
            rest[k] -= r["at"].upto - r["at"].s
            if shift == 0:
                cut[k] = prefix[k]
    return cut, {k: max(0.0, v) for k, v in rest.items()}


def solve(sized: DataFrame, scratch: Scratch, *, source_col: str, size_col: str, weights: tuple = WEIGHTS, cap: float = CAP) -> Mix:
    """Fit rates and cuts to documents with known sizes, h and k (see _numbered()).

    RuntimeError if the Newton steps or the rounds of filling have not ended after
    NEWTON_STEPS and FILLS of them.
    """
    spark = sized.sparkSession
    base = scratch.keep(sized.select(_key(source_col).alias("key"), F.col(size_col).alias("size"), "h", "k"), "sizes")
    # equal sizes have equal rates: the Newton steps need no more than their counts
    counts = scratch.keep(base.groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    found = {r.key: (int(r.n), int(r.s)) for r in counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("s")).collect()}
    total = {k: s for k, (_, s) in found.items()}
    named = targets({k[1:] if k[0] == "s" else None: s for k, s in total.items()}, weights, cap)
    want = {k: named[k[1:] if k[0] == "s" else None] for k in total}
    mean = {k: max(s / n, 1e-9) for k, (n, s) in found.items()}

    def params(**columns: dict) -> DataFrame:
        """One row for each source that the first column has."""
        rows = [(k, *(c[k] for c in columns.values())) for k in sorted(next(iter(columns.values())))]
        kinds = {"lam": "double", "mean": "double", "taken": "array<struct<start: long, cut: long, limit: long, level: int>>", "source_size": "long", "target": "double", "prefix": "long", "rest": "double"}
        return spark.createDataFrame(rows, "key string, " + ", ".join(f"{c} {kinds[c]}" for c in columns))

    def known(rows: DataFrame, **columns: dict) -> DataFrame:
        return _by_source(rows, params(**columns), len(total))

    lam: dict[str, float | None] = dict.fromkeys(total, 0.0)
    low, high, open_ = dict.fromkeys(total, -math.inf), dict.fromkeys(total, math.inf), set()
    for k, s in total.items():
        if want[k] >= cap * s * (1 - 1e-12) and s:
            lam[k] = None
        elif s and abs(want[k] - s) > 1e-9 * s:
            open_.add(k)
    x = F.col("size") / F.col("mean")
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        rate = F.exp(F.col("lam") * x)
        mass = F.col("n") * F.col("size")
        step = known(counts, lam={k: lam[k] for k in open_}, mean=mean)
        step = step.groupBy("key").agg(F.sum(mass * F.least(rate, F.lit(float(cap)))).alias("f"), F.sum(F.when(rate < cap, mass * x * rate).otherwise(0.0)).alias("g"))
        for r in step.collect():
            k = r.key
            gap = r.f - want[k]
            if abs(gap) <= 1e-9 * want[k]:
                open_.discard(k)
                continue
            if gap > 0:
                high[k] = min(high[k], lam[k])
            else:
                low[k] = max(low[k], lam[k])
            new = lam[k] - max(-4.0, min(4.0, gap / r.g)) if r.g > 0 else lam[k] + (1.0 if gap < 0 else -1.0)
            if not low[k] < new < high[k]:
                new = (low[k] + high[k]) / 2 if math.isfinite(low[k] + high[k]) else new
            if abs(new - lam[k]) < 1e-14 * max(1.0, abs(new)):
                open_.discard(k)
            lam[k] = new
    if open_:
        raise RuntimeError(f"no rates after {NEWTON_STEPS} steps for sources {sorted(open_)[:5]}")
    lam = {k: v if v is None else float(f"{v:.11e}") for k, v in lam.items()}

    rated = known(base, lam=lam, mean=mean).withColumn("rate", _rate("size", cap))
    rated = rated.select("key", "size", F.floor("rate").alias("whole"), F.when(F.col("rate") < cap, _place(F.col("rate"))).alias("place"))
    rated = scratch.keep(rated, "rated")
    rest = {r.key: max(0.0, want[r.key] - r.s) for r in rated.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("s")).collect()}
    part = rated.filter("place is not null")
    live = {k for k in total if rest[k] > 0}
    cut, left = _cuts(part, {k: rest[k] for k in live}, known) if live else ({}, {})
    rest |= left
    taken: dict[str, list[tuple[int, int, int, int]]] = {k: [(0, cut[k], 1 << 62, 1)] if k in cut else [] for k in total}

    def free(keys, most: float) -> DataFrame:
        """(key, level, size, place) of the extra copies left, of documents of up to most times their source's rest."""
        rows = known(part, taken={k: taken[k] for k in keys}, rest=rest).filter(F.col("size").between(1, most * F.col("rest")))
        rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(int(cap))))).filter(F.col("whole") + F.col("level") <= int(cap))
        return rows.filter(~F.exists("taken", lambda t: _takes(t, "size") & (t.level == F.col("level")))).select("key", "level", "size", "place")

    for _ in range(FILLS):
        live = {k for k in live if rest[k] > NEAR * want[k]}
        if not live:
            break
        first = Window.partitionBy("key").orderBy("level", F.desc("size"), "place")
        found = free(live, 1.0).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= _FIRST).collect()
        live = {r.key for r in found}
        for r in sorted(found, key=lambda r: (r.key, r["at"])):
            if r["size"] <= rest[r.key]:
                taken[r.key].append((r.place, r.place + 1, r["size"], r.level))
                rest[r.key] -= r["size"]
    else:
        raise RuntimeError(f"no end of documents that fit after {FILLS} rounds for sources {sorted(live)[:5]}")
    # nothing fits any more: the smallest document left is taken where that comes nearer to the target
    short = {k for k in total if rest[k] > NEAR * want[k]}
    if short:
        for r in free(short, 2.0).groupBy("key").agg(F.min(F.struct("size", "level", "place")).alias("b")).collect():
            if r.b["size"] < 2 * rest[r.key]:
                taken[r.key].append((r.b.place, r.b.place + 1, r.b["size"], r.b.level))
    out = scratch.keep(params(lam=lam, mean=mean, taken=taken, source_size=total, target=want), "params")
    scratch.drop(base, counts, rated)
    return Mix(out, len(total), cap)


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per row: id_col, size, source_size, target, taken, copies, rate.

    size is the words of the whole text (null and blank: 0); taken is copies *
    size, at most cap times the size. A null source is a source, a null id an id.
    Chance comes from the hash of a row's id, source and text, and of its number
    among rows equal in these, so reruns agree and neither equal ids nor equal
    rows move as one. A source's taken words miss its target by a thousandth or
    half its smallest document below the cap at most. A source without
    words has target 0 and its rows are copied once. An empty table gives an
    empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    narrow = narrow.withColumn("h", _content("id", "source", "text"))
    sized = scratch.keep(with_size(narrow, "text", "size", keep_text=False), "sized")
    sized = _numbered(sized, scratch)
    out = solve(sized, scratch, source_col="source", size_col="size", weights=weights, cap=cap).copies(sized, "source", "size")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def take_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mixed corpus: each row of docs as often as mix_documents() says, all columns kept.

    Nulls, empty texts and empty tables as there. Of rows equal in id, source and
    text any may be the one with an extra copy; other columns may have any name
    and type and are passed on.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mix")
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # whatever docs calls its columns, none clashes
    x = docs.toDF(*names.values()).withColumn("h", _content(names[id_col], names[source_col], names[text_col]))
    sized = _numbered(with_size(x, names[text_col], "size"), scratch)
    out = solve(sized, scratch, source_col=names[source_col], size_col="size", weights=weights, cap=cap).copies(sized, names[source_col], "size")
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select(*(F.col(c).alias(name) for name, c in names.items()))

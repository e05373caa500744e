"""Deletion of repeated line runs, by a suffix array over line-ID sequences.

A document is the sequence of its lines that have a word; a line's ID is the
rank of its 128-bit hash among the repeated ones. Only lines that occur twice or more can belong to a repeated run,
so the array holds suffixes that begin at such lines, cut at the first line that
occurs once. Prefix doubling ranks them: in each round the pair (rank, rank
2**k lines on) is replaced by its place in the sorted order of all pairs.

A run counts from `min_words` words on. The shortest runs of that size, those
that start at each line and those that end at each line, name LCP intervals: a
run of m lines the suffixes whose ranks at the two powers of two that cover m
agree. An interval's first member, by id and line, stays; the lines of all later
members go, but for those that also lie in the first one (a line said over and over
is a run that overlaps itself: its first min_words words stay). A maximal repeated run goes as a whole: with first line i and last
line j, the shortest runs from its lines cover it from i on, up to the last that
ends by j, and any line after that ends a shortest run that begins at i or
later. As a line has a word at least, m is min_words at most, and so are the
doublings bounded: log2(min_words) rounds, however long the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, small_batches
from .textcore import _VALUE, U, _pow, buffers, chunks, mix, odd_numbers

MIN_WORDS = 50
_TWIN = odd_numbers(256, 78)


def line_hashes(column: pa.Array, value: np.ndarray = _VALUE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hash, words, line number, row offsets) of the lines that have a word.

    Lines end at a newline; a row longer than a chunk is hashed alone. Other
    values of the bytes give hashes that are independent.
    """
    from .textcore import _SPACE

    buf, offsets = buffers(column)
    for i, j in chunks(offsets):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = len(part)
        if n == 0:
            yield i, j, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
            continue
        # a line starts with its row and after every newline
        newline = np.flatnonzero(part == 10)
        starts = np.sort(np.concatenate([off[:-1], newline + 1]), kind="stable")
        ends = np.sort(np.concatenate([newline, off[1:]]), kind="stable")
        row = np.repeat(np.arange(j - i), 1 + np.diff(np.searchsorted(newline, off)))
        pw, inv = _pow(n + 1)
        run = np.empty(n + 1, U)
        run[0] = 0
        np.cumsum(value[part] * pw[:n], dtype=U, out=run[1:])
        word = ~_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edge = off[:-1][off[:-1] < n]
        first[edge] = word[edge]
        count = np.concatenate([[0], np.cumsum(first)])
        h = mix((run[ends] - run[starts]) * inv[np.minimum(starts, n)] + (ends - starts).astype(U))
        words = count[ends] - count[starts]
        line = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = words > 0
        yield i, j, h[keep], words[keep], line[keep], np.searchsorted(row[keep], np.arange(j - i + 1))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for (i, j, h, words, line, off), twin in zip(line_hashes(b.column(2)), line_hashes(b.column(2), _TWIN)):
            at = pa.array(np.repeat(np.arange(i, j), np.diff(off)))
            seq = np.arange(len(h)) - np.repeat(off[:-1], np.diff(off))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(seq), pa.array(line), pa.array(h.view(np.int64)), pa.array(twin[2].view(np.int64)), pa.array(words)], names=["id", "th", "seq", "line", "lid", "lid2", "words"])


def _ranked(counts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(r, r2, rank): the place of each pair in the sorted order of counts (r, r2, n: how many there are of a pair).

    Sorted by range over all tasks; each range's first place comes from the
    ranges' sizes, one number for each range.
    """
    parts = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = counts.repartitionByRange(parts, "r", "r2").sortWithinPartitions("r", "r2")
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()), f"{name}-sorted")
    sizes = {r.part: int(r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, base))
        base += sizes[p]
    first = scratch.spark.createDataFrame(rows or [(-1, 0)], "part int, base long")
    w = Window.partitionBy("part").orderBy("r", "r2").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0)) + 1
    return ranged.join(F.broadcast(first), "part").select("r", "r2", rank.alias("rank"))  # first: one row a partition


def repeated_runs(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, lines): the line numbers to delete of each document that loses any.

    th is the text's hash; rows of equal id and text are one document, and among
    texts of one id th orders. Rows with a null id take part like any other, first.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    lines = keyed.mapInArrow(_explode, f"id {kind}, th long, seq long, line long, lid long, lid2 long, words long")
    lines = scratch.keep(lines, "lines")
    # the repeated lines' ranks are their IDs: two lines share one only where both hashes agree
    twice = scratch.keep(lines.groupBy(F.col("lid").alias("r"), F.col("lid2").alias("r2")).agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    twice = _ranked(twice, scratch, "twice").select(F.col("r").alias("lid"), F.col("r2").alias("lid2"), F.col("rank").alias("own"), F.crc32(F.col("r").cast("string").cast("binary")).alias("k2"))
    # k2, a hash of the key, makes the join deal out both sides anew, so that a common line's rows can be split
    dup = lines.withColumn("k2", F.crc32(F.col("lid").cast("string").cast("binary"))).join(twice, ["lid", "lid2", "k2"]).drop("k2", "lid", "lid2")
    by_doc = Window.partitionBy("id", "th").orderBy("seq")
    dup = dup.repartition("id", "th").dropDuplicates(["id", "th", "seq"]).withColumn("seg", F.col("seq") - F.row_number().over(by_doc))
    seg = Window.partitionBy("id", "th", "seg").orderBy("seq")
    dup = dup.withColumn("upto", F.sum("words").over(seg)).withColumn("all", F.max("upto").over(seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # m: lines of the shortest run of min_words from here on; the runs of m to `to` lines, if m is not the
    # only one, are those that are the shortest to end at their last line. All lie in the next min_words lines
    ahead = F.collect_list(F.col("upto")).over(seg.rowsBetween(0, min_words - 1))
    need = F.col("upto") - F.col("words") + min_words
    dup = dup.withColumn("ahead", ahead).filter(F.col("all") >= min_words).withColumn("m", F.size(F.filter("ahead", lambda u: u < need)) + 1)
    dup = dup.withColumn("m", F.when(F.col("all") - F.col("upto") + F.col("words") >= min_words, F.col("m")))
    dup = dup.withColumn("to", F.when(F.col("m").isNotNull(), F.greatest("m", F.size(F.filter("ahead", lambda u: u < F.col("upto") + min_words)))))
    now = scratch.keep(dup.select("id", "th", "seg", "seq", "line", "m", "to", F.col("own").alias("r")), "suffixes-0")
    most = now.agg(F.max("to")).first()[0] or 0
    hit, k, done = None, 0, now
    while (1 << k) <= most:
        # runs of 2**k to 2**(k + 1) - 1 lines: two overlapping powers of two cover them
        step = 1 << k
        nexts = F.collect_list("r").over(seg.rowsBetween(0, step))
        x = now.withColumn("nexts", nexts)
        runs = x.filter((F.col("m") < 2 * step) & (F.col("to") >= step))
        runs = runs.withColumn("m", F.explode(F.sequence(F.greatest("m", F.lit(step)), F.least("to", F.lit(2 * step - 1)))))
        runs = runs.select("id", "th", "seq", "line", "m", "r", F.element_at("nexts", (F.col("m") - step + 1).cast("int")).alias("r2"))
        runs = scratch.keep(runs, f"runs-{k}")
        first = runs.groupBy("m", "r", "r2").agg(F.min(F.struct("id", "th", "seq")).alias("first"), F.count("*").alias("n"), F.max(F.crc32(F.col("r").cast("string").cast("binary"))).alias("k2")).filter("n > 1")
        later = runs.withColumn("k2", F.crc32(F.col("r").cast("string").cast("binary"))).join(first, ["m", "r", "r2", "k2"])
        later = later.filter(~F.struct("id", "th", "seq").eqNullSafe(F.col("first")))
        # a run that repeats within its own length: what lies in the first member stays
        same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
        start = F.when(same, F.greatest("seq", F.col("first.seq") + F.col("m"))).otherwise(F.col("seq"))
        later = later.select("id", "th", start.alias("seq"), (F.col("seq") + F.col("m") - start).cast("int").alias("m"))
        hit = later if hit is None else hit.unionByName(later)
        if 2 * step > most:
            break
        pairs = x.withColumn("r2", F.coalesce(F.try_element_at("nexts", F.lit(step + 1)), F.lit(0))).drop("nexts")
        pairs = scratch.keep(pairs, f"pairs-{k}")
        rank = _ranked(pairs.groupBy("r", "r2").agg(F.count("*").alias("n")), scratch, f"rank-{k}").withColumn("k2", F.crc32(F.col("r").cast("string").cast("binary")))
        now = pairs.withColumn("k2", F.crc32(F.col("r").cast("string").cast("binary"))).join(rank, ["r", "r2", "k2"])
        now = scratch.keep(now.select("id", "th", "seg", "seq", "line", "m", "to", F.col("rank").alias("r")), f"suffixes-{k + 1}")
        k += 1
    if hit is None:
        return done.limit(0).select("id", "th", F.array("line").alias("lines"))
    hit = hit.withColumn("seq", F.explode(F.sequence("seq", F.col("seq") + F.col("m") - 1))).select("id", "th", "seq").distinct()
    return hit.join(done.select("id", "th", "seq", "line"), (hit["th"] == done["th"]) & (hit["seq"] == done["seq"]) & hit["id"].eqNullSafe(done["id"])).groupBy(done["id"], done["th"]).agg(F.array_sort(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: id_col, text without the later copies of repeated runs, n_lines, n_deleted.

    A run is consecutive lines (lines without a word aside) of min_words words or
    more; of equal runs the first by id and line stays, with all its lines, also
    where later ones overlap it. n_lines counts the lines
    with a word. Null texts stay null, empty ones empty, with no lines. Rows of
    equal id and text are one document and share a result. An empty table gives
    an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated_runs(docs, scratch, id_col=id_col, text_col=text_col, min_words=min_words)
    gone = gone.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "lines")
    deleted = scratch.keep(gone, "deleted")
    x = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # the deletions, where their files' size allows, go to the texts; else the texts are dealt out to them
    near = F.broadcast(deleted) if scratch.small(deleted) else deleted
    x = x.join(near, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    part = F.split("text", "\n")
    kept = F.array_join(F.filter(part, lambda v, k: ~F.array_contains("lines", k.cast("long"))), "\n")
    n_lines = F.coalesce(F.size(F.filter(part, lambda v: v.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0))
    return x.select(
        F.col("id").alias(id_col),
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_deleted"),
    )

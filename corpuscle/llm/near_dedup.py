"""MinHash near-duplicate detection with odd sketches.

1. A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents
   with equal sets form a class; only its smallest id goes on.
2. SAMPLES MinHash values give BANDS band keys of ROWS values, and an odd sketch:
   a bitmap in which each sample toggles one bit, so that the XOR of two sketches
   counts, in pairs, the samples that differ.
3. Within a bucket (an equal band key) members pair with two centres, the
   smallest id and a random one: as many pairs as members. Pairs whose sizes or
   sketches rule the similarity out go; the rest are confirmed on full sets.
4. In buckets that the confirmed links leave in several components, pairs across
   components are confirmed too, so that no link is lost to the choice of
   centres. They are found by prefix filtering, which is exact: of two linked
   sets, the rarest n - ceil(threshold * n) + 1 shingles of each have one in
   common. Pages of one template, whose own words are the rare ones, share none,
   so their pairs are never made, however large the bucket.
5. Components come from alternating large-star and small-star joins.

A link shares no band with probability (1 - similarity**4)**24: 2e-8 at 0.85, 3e-6
at 0.80. The sketch filter keeps estimates down to 5.5 deviations of the samples
below the threshold (0.65 at 0.85, 0.575 at 0.80), and loses a link at the
threshold with probability 1e-6 at 0.85 and 2e-6 at 0.80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, small_batches
from .textcore import U, mix, odd_numbers, shingles, words

BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
ROUNDS = 100
_LONGS = SKETCH_BITS // 64
_SLICE = 1 << 15  # shingles permuted at a time, to stay in cache


def _unique_sets(s: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles sorted and distinct, and their offsets."""
    sets = [np.unique(s[a:b]) for a, b in zip(so[:-1], so[1:])]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else s), off


def minhash(s: np.ndarray, so: np.ndarray) -> np.ndarray:
    """(rows, SAMPLES) minima; rows without shingles get the largest value."""
    counts = np.diff(so)
    out = np.full((len(counts), SAMPLES), np.iinfo(np.uint64).max, U)
    rows = np.flatnonzero(counts)
    mult = odd_numbers(SAMPLES, 909)
    i = 0
    while i < len(rows):
        j = int(np.searchsorted(so[rows], so[rows[i]] + _SLICE, "right"))
        j = max(j, i + 1)
        a, b = int(so[rows[i]]), int(so[rows[j - 1] + 1])
        part, starts = s[a:b], so[rows[i:j]] - a
        for k, m in enumerate(mult):
            out[rows[i:j], k] = np.minimum.reduceat(part * m, starts)
        i = j
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bucket keys."""
    step = odd_numbers(ROWS, 31)
    mixed = mix(m).reshape(len(m), BANDS, ROWS)
    return mix((mixed * step).sum(axis=2, dtype=U) + np.arange(1, BANDS + 1, dtype=U)[None, :])


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """(rows, _LONGS) parity bitmaps of the samples."""
    bit = (mix(m + odd_numbers(SAMPLES, 57)[None, :]) >> U(40)).astype(np.int64) % SKETCH_BITS
    rows = np.arange(len(m))
    bits = np.zeros((len(m), SKETCH_BITS), np.uint8)
    for k in range(SAMPLES):
        bits[rows, bit[:, k]] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def _lists(a: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(a).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), flat)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, h, o, _ in words(b.column(1)):
            s, so = _unique_sets(*shingles(h, o))
            n = np.diff(so)
            k1, k2 = np.zeros(len(n), U), np.zeros(len(n), U)
            full = np.flatnonzero(n)
            if len(full):
                k1[full] = np.add.reduceat(s, so[full])
                k2[full] = np.bitwise_xor.reduceat(mix(s + U(7)), so[full])
            m = minhash(s, so)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(n), pa.array(mix(k1).view(np.int64)), pa.array(k2.view(np.int64)), _lists(band_keys(m)), _lists(odd_sketch(m))],
                names=["id", "n", "k1", "k2", "bands", "sketch"],
            )


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[], []]
            for k in (0, 1):
                for _, _, h, o, _ in words(b.column(2 + k)):
                    s, so = _unique_sets(*shingles(h, o))
                    sides[k] += [s[x:y] for x, y in zip(so[:-1], so[1:])]
            keep = np.zeros(b.num_rows, bool)
            for r, (x, y) in enumerate(zip(*sides)):
                if len(x) and len(y):
                    if len(x) > len(y):
                        x, y = y, x
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep[r] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join rows with a table that has one row for each key, which adaptive execution may split.

    A table straight from an aggregation on the key is already partitioned by
    it, and a hot key's partition could not be split then; a second, dependent
    key makes the join deal out both sides anew.
    """
    left = rows.withColumn("_k2", F.crc32(F.col(key).cast("string").cast("binary")))
    right = table.withColumn("_k2", F.crc32(F.col(key).cast("string").cast("binary")))
    return left.join(right, [key, "_k2"], how).drop("_k2")


_FILTER_BITS = 1 << 26
_FILTER_PART = 1 << 15  # bits in one of Spark's bitmaps


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(11)), F.lit(_FILTER_BITS))


def _maybe(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows with `_in`: false where the id is surely not among ids (id); null ids are not.

    A bitmap of hashed ids, of _FILTER_BITS / 8 bytes (8 MB) at most, goes to all
    tasks. Beyond tens of millions of ids it rules out less, and nothing wrongly.
    """
    marks = ids.select(_bit("id").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    x = rows.withColumn("_h", F.when(F.col(column).isNotNull(), _bit(column)))
    x = x.join(F.broadcast(marks), F.bitmap_bucket_number("_h") == F.col("_part"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.bitmap_bit_position("_h") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    x = x.withColumn("_byte", byte).withColumn("_in", F.expr("coalesce(shiftright(_byte, cast(bitmap_bit_position(_h) % 8 as int)) % 2 = 1, false)"))
    return x.drop("_h", "_part", "_bits", "_byte")


def near_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (id, text) whose id is among ids (id, distinct), and few others: a cut of the scan, without a shuffle."""
    return _maybe(rows, ids, "id").filter("_in").drop("_in")


def _allowed(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""
    near = reps.select("id", "n", "sketch")
    x = pairs.join(near.toDF("a", "na", "sa"), "a").join(near.toDF("b", "nb", "sb"), "b")
    x = x.filter(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return x.filter(_differing("sa", "sb") <= _most_bits(_least_estimate(threshold))).select("a", "b")


def _confirmed(kept: DataFrame, texts: DataFrame, scratch: Scratch, threshold: int, name: str) -> DataFrame:
    """The pairs (a, b) of a kept table that full sets confirm."""
    ids = kept.select(F.col("a").alias("id")).union(kept.select(F.col("b").alias("id"))).distinct()
    held = scratch.keep(near_ids(texts, ids), f"{name}-texts")
    near = F.broadcast(kept) if scratch.small(kept) else kept
    both = near.join(held.toDF("a", "ta"), "a").join(held.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    links = scratch.keep(both.mapInArrow(_confirm(threshold), kept.schema), f"{name}-links")
    scratch.drop(held)
    return links


def _differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _least_estimate(threshold: int) -> float:
    """The lowest estimate that a link of the threshold's similarity is given up at: 5.5 deviations below it."""
    t = threshold / 100
    return t - 5.5 * np.sqrt(t * (1 - t) / SAMPLES)


def _most_bits(similarity: float) -> int:
    """Sketch bits that differ, at most, where the estimate is at least similarity."""
    # estimate: similarity = 1 + bits / (4 * samples) * ln(1 - 2 * differing / bits)
    share = np.exp(4 * SAMPLES * (similarity - 1) / SKETCH_BITS)
    return int(np.ceil(SKETCH_BITS * (1 - share) / 2))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) of every linked node; comp is the smallest id reachable.

    links has columns a and b. Alternating large-star and small-star joins; each
    round's edges are written to the shared folder. Empty links give no rows.
    RuntimeError where ROUNDS rounds, far beyond the logarithm of any graph's
    size, do not settle it.
    """
    edges, before, seen = links.select("a", "b").filter("a <> b").distinct(), None, None
    for k in range(ROUNDS):
        # large star: every larger neighbour of u moves to u's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.filter("b > a"), least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = scratch.keep(large, f"large-{k}")
        # small star: u and its smaller neighbours move to the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v")).filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(down, least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b")
        small = scratch.keep(small.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), f"small-{k}")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(large, *([before] if before is not None else []))
        if tuple(state) == seen:
            break
        edges, before, seen = small, small, tuple(state)
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    return small.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("comp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """Per row: id_col, n_shingles, component_id, kept.

    Rows are linked where 100 * intersection >= threshold * union of their sets;
    component_id is the smallest id reachable over links, the row's own included,
    and kept says whether that is the row's id. A text of one to four words has
    its whole sequence as its set; null, empty and blank texts have no set, stand
    alone and are kept. Rows of equal id are one document, linked by any of its
    texts; each row is returned. A row with a null id takes part in no link and stands alone, with a null
    component_id and kept. An empty table gives an empty one; other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = texts.mapInArrow(_sign, f"id {kind}, n long, k1 long, k2 long, bands array<long>, sketch array<long>")
    signed = scratch.keep(signed, "signed")
    usable = signed.filter("n > 0 and id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = scratch.keep(classes, "classes")
    reps = usable.join(classes.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"])
    same = classes.limit(0).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    repeated = scratch.keep(usable.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        reps = reps.dropDuplicates(["k1", "k2", "id"])
        texts = texts.dropDuplicates(["id", "text"])
        several = usable.select("id", "k1", "k2").join(repeated, "id", "left_semi").distinct()
        same = several.join(classes, ["k1", "k2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    reps = scratch.keep(reps.select("id", "n", "bands", "sketch"), "reps")
    return _placed(signed, classes, _linked(texts, reps, same, scratch, threshold), scratch, id_col)


def _linked(texts: DataFrame, reps: DataFrame, same: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(id, comp) of the representatives that have a link."""
    member = reps.select("id", F.explode("bands").alias("key"))
    order = F.xxhash64("id", F.lit(3))
    shared = member.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.min(F.struct(order, "id"))["id"].alias("any"))
    shared = shared.filter("c > 1").drop("c")
    member = scratch.keep(spread_join(member, shared, "key"), "members")
    centres = member.select(F.explode(F.array("low", "any")).alias("x"), "id")
    pairs = centres.filter("x <> id").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    star = scratch.keep(_allowed(pairs, reps, threshold), "star")
    found = _confirmed(star, texts, scratch, threshold, "star").union(same)
    comp = scratch.keep(components(found, scratch), "comp")
    # what the centres left apart
    placed = member.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("c"), F.min(F.struct("id", "comp"))["comp"].alias("home"))
    apart = apart.filter("c > 2 and c0 < c1").select("key", "home")
    rest = spread_join(placed, apart, "key").filter("id <> low and id <> any").select("id", "comp").distinct()
    rest = scratch.keep(rest, "rest")
    if rest.isEmpty():
        return comp
    more = scratch.keep(_across(rest, texts, scratch, threshold), "cross")
    if more.isEmpty():
        return comp
    found = found.union(_confirmed(more, texts, scratch, threshold, "cross"))
    return scratch.keep(components(found, scratch), "comp")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, h, o, _ in words(b.column(2)):
            s, so = _unique_sets(*shingles(h, o))
            part = b.slice(i, j - i)
            lists = pa.LargeListArray.from_arrays(pa.array(so), pa.array(s.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(so)), lists, _lists(odd_sketch(minhash(s, so)))], names=["id", "th", "n", "s", "sketch"])


def _across(rest: DataFrame, texts: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(a, b): the pairs of rest (id, comp), of different components, that prefixes, sizes and sketches leave.

    A set is told by its id and its text's hash, as an id may have several.
    """
    kind = texts.schema["id"].dataType.simpleString()
    own = near_ids(texts, rest.select("id")).select("id", F.xxhash64("text").alias("th"), "text")
    sets = own.mapInArrow(_sets, f"id {kind}, th long, n long, s array<long>, sketch array<long>").filter("n > 0")
    sets = scratch.keep(sets.join(rest, "id"), "rest-sets")
    # shingles that one id alone has are in no intersection; an id with too many of them has no link
    per = sets.select("id", F.explode("s").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    alone = per.filter("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    left = sets.join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    left = scratch.keep(left.filter(100 * (F.col("n") - F.col("alone")) >= threshold * F.col("n")).drop("alone"), "linkable")
    scratch.drop(sets)
    each = left.select("id", "th", "n", "comp", F.explode("s").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("c"))
    each = spread_join(each, counts, "s")
    w = Window.partitionBy("id", "th").orderBy("c", "s")
    prefix = F.col("n") - F.floor((threshold * F.col("n") + 99) / 100) + 1
    each = each.withColumn("at", F.row_number().over(w)).filter((F.col("at") <= prefix) & (F.col("c") > 1)).select("s", "id", "th", "n", "comp", "at")
    each = scratch.keep(each, "prefixes")
    mixed = each.groupBy("s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("id", "comp"))["comp"].alias("home"))
    each = spread_join(each, mixed.filter("c0 < c1").select("s", "home"), "s")
    each = scratch.keep(each.join(left.select("id", "th", "sketch"), ["id", "th"]), "meeting")
    moving = each.filter("comp <> home").select(*(F.col(c).alias(f"{c}_") for c in each.columns if c != "home"))
    # what two sets may share at most, if this is the first shingle they share: it and the fewer of those after it
    most = F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_")) + 1
    cross = moving.join(
        each,
        (F.col("s_") == F.col("s"))
        & (F.col("comp") != F.col("comp_"))
        & ((100 + threshold) * most >= threshold * (F.col("n") + F.col("n_")))
        & (_differing("sketch", "sketch_") <= _most_bits(_least_estimate(threshold))),
    )
    return cross.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def _placed(signed: DataFrame, classes: DataFrame, comp: DataFrame, scratch: Scratch, id_col: str) -> DataFrame:
    moved = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").filter("rows > 1 or comp is not null")
    moved = scratch.keep(moved.select("k1", "k2", F.least(F.coalesce("comp", "rep"), "rep").alias("to")), "moved")
    plain = signed.select("id", "n", "k1", "k2")
    out = plain.join(moved, ["k1", "k2"], "left")
    own = (F.col("n") > 0) & F.col("id").isNotNull()
    out = out.withColumn("comp", F.when(own, F.coalesce("to", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id, with all its columns.

    Decided as in near_duplicates(), with its results for nulls, empty texts and
    empty tables. Of rows with equal id one stays; rows with a null id and rows
    without words all stay. Other columns may have any name and are passed on.
    """
    scratch = Scratch(docs.sparkSession, "first")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    found = scratch.keep(found.select(F.col(id_col).alias("_id"), "n_shingles", "kept"), "found")
    gone = scratch.keep(found.filter("not kept").select(F.col("_id").alias("id")).distinct(), "gone")
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever docs calls its columns, none clashes
    own = names[docs.columns.index(id_col)]
    x = docs.toDF(*names)
    if scratch.small(gone):
        out = x.join(F.broadcast(gone), F.col(own) == gone["id"], "left_anti").toDF(*docs.columns)
    else:  # only rows that the bitmap does not clear are dealt out for the join
        x = _maybe(x, gone, own)
        out = x.filter("not _in").drop("_in").unionByName(x.filter("_in").drop("_in").join(gone, F.col(own) == gone["id"], "left_anti")).toDF(*docs.columns)
    again = found.filter("kept and n_shingles > 0 and _id is not null").groupBy("_id").count().filter("count > 1").select("_id")
    again = scratch.keep(again, "again")
    if again.isEmpty():
        return out
    once = out.join(again, out[id_col] == again["_id"], "left_semi").dropDuplicates([id_col])
    return out.join(again, out[id_col] == again["_id"], "left_anti").unionByName(once)

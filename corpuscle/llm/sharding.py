"""Sharding by balanced label propagation, in DataFrame operations throughout.

Documents of equal text are linked. Each starts on a shard by hash; in each
round (ROUNDS at most, fewer once no part wants to move; what still does is
logged), joins tell the shards where a group's bytes lie, and its documents
elsewhere move to the fullest of them that has room for the rest, while that
shard's quota lasts. A group larger than a
quota keeps as many of its fullest shards as it needs. Documents of one
group are moved in up to ATOMS parts, so that a group of any size is spread
over tasks. At last the documents without links fill every shard up to the same
number of bytes: the few that are large one by one, largest first, the rest by
their place in a running sum.

No step holds a group in one task: groups are summed before they are shuffled,
and running sums are over hash buckets with the buckets' offsets added.
"""

from __future__ import annotations

import heapq
import logging
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

log = logging.getLogger(__name__)
ATOMS = 1024
ROUNDS = 8
#: A filler above 1 / (shards * FINE) of all bytes is placed one by one, on the driver: shards * FINE of them at most.
#: Every row is placed either way; FINE decides only how evenly large ones lie.
FINE = 256
_GROUP = ["th", "crc", "size"]


def _bucket(n: int, seed: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(n))


def _upto(table: DataFrame, by: str, bucket: str, value: str) -> DataFrame:
    """table (one row for each by and bucket) with the sum of value before each bucket, in `before`."""
    w = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def propagate(rows: DataFrame, scratch: Scratch, n_shards: int, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """(th, crc, size, atom, label) of the linked documents' parts; a null label: its shard is full.

    rows: id, th, crc, size of the documents in groups of two or more. A part that
    still wants to move after the last round stays where it is: its links are cut,
    and its bytes are logged.
    """
    atoms = rows.groupBy(*_GROUP, _bucket(ATOMS, 1, "id").alias("atom")).agg(F.count("*").alias("n"))
    atoms = atoms.withColumn("bytes", F.col("n") * F.col("size"))
    now = scratch.keep(atoms.withColumn("label", _bucket(n_shards, 2, "th", "atom").cast("int")), "labels-0")
    for k in range(1, rounds + 1):
        load = {r.label: int(r.b) for r in now.groupBy("label").agg(F.sum("bytes").alias("b")).collect()}
        quota = F.create_map(*[F.lit(x) for s in range(n_shards) for x in (s, max(0, int(capacity) - load.get(s, 0)))])
        # where each group's bytes lie: at most a row for each group and shard; a shard with room for the
        # rest of the group comes before those without, so that groups turn away from full shards
        order = [(quota[F.col("label")] >= F.col("all") - F.col("had")).desc(), F.col("had").desc(), F.col("label")]
        held = now.groupBy(*_GROUP, "label").agg(F.sum("bytes").alias("had"))
        held = held.withColumn("all", F.sum("had").over(Window.partitionBy(*_GROUP)))
        held = held.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*order)))
        held = held.filter(F.col("rank") <= F.ceil(F.col("all") / (0.8 * capacity)))
        homes = held.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("rank", "label")))["label"].alias("homes"), F.crc32(F.first("th").cast("string").cast("binary")).alias("k2"))
        # the hash of the key, as a key of its own, lets adaptive execution split a hot group
        placed = now.withColumn("k2", F.crc32(F.col("th").cast("string").cast("binary"))).join(homes, [*_GROUP, "k2"])
        placed = placed.withColumn("to", F.when(F.array_contains("homes", F.col("label")), F.col("label")).otherwise(F.element_at("homes", (F.floor(F.col("atom") * F.size("homes") / ATOMS) + 1).cast("int"))))
        placed = scratch.keep(placed.select(*_GROUP, "atom", "n", "bytes", "label", "to", _bucket(64, 3, "th").alias("gb"), F.floor(F.col("atom") / 64).alias("ab")), f"wish-{k}")
        # quotas: movers in order of two hash digits, as long as the shard they go to has room
        movers = placed.filter("to <> label").withColumn("slice", F.col("gb") * 16 + F.col("ab"))
        wish = movers.groupBy("to", "slice").agg(F.sum("bytes").alias("s"))
        if wish.isEmpty():
            break
        room = _upto(wish, "to", "slice", "s").filter(F.col("before") + F.col("s") <= quota[F.col("to")])
        room = room.select(F.col("to").alias("to_"), F.col("slice").alias("slice_"))  # at most 1,024 rows for each shard
        x = placed.withColumn("slice", F.col("gb") * 16 + F.col("ab")).join(F.broadcast(room), (F.col("to") == F.col("to_")) & (F.col("slice") == F.col("slice_")), "left")
        x = x.withColumn("label", F.when(F.col("to_").isNotNull(), F.col("to")).otherwise(F.col("label")))
        after = scratch.keep(x.select(*_GROUP, "atom", "n", "bytes", "label"), f"labels-{k}")
        if k == rounds:
            log.info("%s bytes of linked documents still want to move after %s rounds", x.filter("to <> label").agg(F.sum("bytes")).first()[0] or 0, rounds)
        scratch.drop(now, placed)
        now = after
    # what exceeds a shard's share even so is dealt out with the fillers
    sliced = now.withColumn("slice", _bucket(4096, 4, "th", "atom"))
    loads = sliced.groupBy("label", "slice").agg(F.sum("bytes").alias("s"))
    fits = _upto(loads, "label", "slice", "s").filter(F.col("before") + F.col("s") <= capacity).select("label", "slice", F.lit(True).alias("fits"))
    out = sliced.join(fits, ["label", "slice"], "left")
    return scratch.keep(out.select(*_GROUP, "atom", F.when(F.col("fits"), F.col("label")).alias("label")), "labels")


def _fill(fillers: DataFrame, scratch: Scratch, n_shards: int, load: dict[int, int], total: int) -> DataFrame:
    """fillers (fid, bytes, ...) with a shard, so that all shards' bytes come out even.

    fid tells fillers apart, up to rows that are equal in all respects.
    """
    limit = max(1, total // (n_shards * FINE))
    big = fillers.filter(F.col("bytes") > limit).groupBy("fid", "bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes"), "fid").collect()
    heap = [(load.get(s, 0), s) for s in range(n_shards)]
    heapq.heapify(heap)
    own: list[tuple[str, int]] = []
    for r in big:  # at most n_shards * FINE, as each is above that share of the total
        b, s = heapq.heappop(heap)
        own.append((r.fid, s))
        heapq.heappush(heap, (b + r.bytes * r.n, s))
    load = {s: b for b, s in heap}
    rest = fillers.filter(F.col("bytes") <= limit)
    buckets = max(1024, min(65536, total // (1 << 24)))
    rest = rest.withColumn("fb", _bucket(buckets, 5, "fid"))
    sums = {r.fb: int(r.s) for r in rest.groupBy("fb").agg(F.sum("bytes").alias("s")).collect()}
    # level: the height to which the rest fills the shards; those above it get nothing
    left, heights = sum(sums.values()), sorted(load.values())
    level = heights[-1]
    for k in range(1, n_shards + 1):
        level = (left + sum(heights[:k])) / k
        if k == n_shards or level <= heights[k]:
            break
    ends = list(accumulate(max(0.0, level - load[s]) for s in range(n_shards)))
    starts = dict(zip(sorted(sums), accumulate([0, *(sums[b] for b in sorted(sums))])))
    spark = fillers.sparkSession
    # one row a bucket: 65,536 at most
    offset = spark.createDataFrame([(int(b), int(v)) for b, v in starts.items()] or [(-1, 0)], "fb long, start long")
    w = Window.partitionBy("fb").orderBy("fid").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.join(F.broadcast(offset), "fb").withColumn("mid", F.col("start") + F.sum("bytes").over(w) - F.col("bytes") / 2)
    bounds = F.array(*[F.lit(float(e)) for e in ends[:-1]])
    rest = rest.withColumn("shard", F.size(F.filter(bounds, lambda e: e <= F.col("mid"))).cast("int")).drop("fb", "start", "mid")
    chosen = spark.createDataFrame(own or [("", 0)], "fid string, shard int")
    return rest.unionByName(fillers.filter(F.col("bytes") > limit).join(F.broadcast(chosen), "fid"))


def shard_documents(docs: DataFrame, *, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: id_col, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 16; shards come out near equal in bytes.
    Null and empty texts have size 16 and crc32 0, and are equal texts; slots
    count from 0 in each shard without a gap. Repeated rows are rows of their
    own; a null id counts as a value. An empty table gives an empty one; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.crc32(text.cast("binary")).alias("crc"), (F.octet_length(text).cast("long") + 16).alias("size"))
    rows = scratch.keep(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = total / n_shards
    groups = rows.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.max(F.crc32(F.col("th").cast("string").cast("binary"))).alias("k2")).filter("n > 1").drop("n")
    groups = scratch.keep(groups.withColumn("linked", F.lit(True)), "groups")
    rows = rows.withColumn("k2", F.crc32(F.col("th").cast("string").cast("binary"))).join(groups, [*_GROUP, "k2"], "left").drop("k2")
    rows = scratch.keep(rows.withColumn("atom", F.when(F.col("linked"), _bucket(ATOMS, 1, "id"))), "marked")
    labels = propagate(rows.filter("linked").drop("linked", "atom"), scratch, n_shards, capacity, rounds)
    x = rows.filter("linked").drop("linked").join(labels, [*_GROUP, "atom"])
    linked = scratch.keep(x.drop("atom").withColumn("th", F.col("th")), "linked")
    held = linked.filter("label is not null").withColumn("shard", F.col("label")).drop("label")
    load = {r.shard: int(r.b) for r in held.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    free = rows.filter("linked is null").drop("linked", "atom").unionByName(linked.filter("label is null").drop("label"))
    free = free.withColumn("bytes", F.col("size")).withColumn("fid", F.concat_ws(":", F.col("th").cast("string"), F.col("crc").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("-"))))
    placed = _fill(free, scratch, n_shards, load, total).drop("bytes", "fid").unionByName(held)
    placed = scratch.keep(placed, "placed")
    # slots: within a hash bucket of a shard, after the shard's buckets before it
    per = max(16, min(4096, total // (n_shards * (1 << 24))))
    placed = placed.withColumn("b", _bucket(int(per), 7, "id", "th"))
    before = _upto(placed.groupBy("shard", "b").agg(F.count("*").alias("n")), "shard", "b", "n").drop("n")
    w = Window.partitionBy("shard", "b").orderBy("id", "th", "crc")
    out = placed.withColumn("at", F.row_number().over(w)).join(before, ["shard", "b"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: links, the pairs of documents of equal text, and cut, those whose two shards differ.

    sharded is a result of shard_documents(); texts are told apart by size and
    CRC-32, which is enough for a measure.
    """
    per = sharded.groupBy("size", "text_crc32", "shard").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    per = per.groupBy("size", "text_crc32").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    pairs = lambda c: F.coalesce(F.sum(c / 2), F.lit(0)).cast("long")
    return per.agg(pairs(F.col("n") * (F.col("n") - 1)).alias("links"), pairs(F.col("n") * F.col("n") - F.col("sq")).alias("cut"))

"""Trie of conversation prefixes by chained digests.

A turn's digest is a SHA-256 of its role and text; a prefix's digest is chained
from the digests of its turns, so that equal prefixes have equal digests and no
text is compared or shuffled again. Every prefix of every conversation is
exploded and grouped by (depth, digest): a group is a node, represented by the
smallest conversation in it. A node's own values are then exploded to all its
ancestors and summed there. The nodes which one conversation represents are a
stretch of its prefixes, so they are summed per ancestor before the explosion.

Long conversations are chained in segments of SEGMENT turns: within a segment
from its start, across segments over the segments' last digests by the same rule.
The prefix of depth d has the digest of the d / SEGMENT whole segments before it,
chained with that inside its own. No row holds more than a segment, and a
conversation with a large share of all turns is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

SEGMENT = 32
_BLOCK = 12  # conversations are listed in blocks of 2 ** _BLOCK identifiers


def _segment(depth: str) -> Column:
    return F.floor((F.col(depth) - 1) / SEGMENT).cast("long")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def turn_rows(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, item, points): each turn's digest and the code points of its text.

    Null roles and texts are empty; rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        _digest(F.char_length(role).cast("string"), F.lit(":"), role, text).alias("item"),
        F.char_length(text).cast("long").alias("points"),
    )


def in_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, item, points): turn_rows' rows with their position, from 1, by turn; nulls first, ties by digest.

    Sorted by range of all three, so a long conversation is dealt out; what of it
    lies in earlier partitions is added from a table of at most two rows a partition.
    """
    rows = scratch.keep(rows, "turns")
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("item")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("i", F.monotonically_increasing_id())
    ranged = scratch.keep(ranged.withColumn("part", F.shiftright("i", 33)), "ranged")
    here = Window.partitionBy("conv_id", "part")
    local = ranged.select("conv_id", "part", "item", "points", (F.col("i") - F.min("i").over(here) + 1).alias("k"))
    # only a partition's first and last conversation can go on in another one
    ends = ranged.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("z"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("a", "z"))).alias("conv_id"))
    parts = ranged.join(F.broadcast(ends), ["conv_id", "part"]).groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.sum("count").over(before)).where("before > 0").select("conv_id", "part", "before")
    out = local.join(F.broadcast(parts), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), "item", "points")


def shared_starts(ordered: DataFrame, scratch: Scratch, *, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share their starts: (conv_id, depth, item, points), and (conv_id, length) of each.

    Conversation c gets the first h turns of conversation c - c % group (what there
    is of them), then its own turns after its first h; h is crc32(c in decimal) % most.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % group
    ordered = scratch.keep(ordered, "ordered")
    lengths = ordered.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = ordered.where((F.col("conv_id") == base) & (F.col("pos") < most)).groupBy("conv_id")
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "item", "points"))).alias("head")).withColumnRenamed("conv_id", "base")
    convs = lengths.withColumns({"h": h, "base": base}).join(heads, "base", "left")
    none = F.array().cast("array<struct<pos:bigint,item:string,points:bigint>>")
    convs = convs.withColumn("head", F.filter(F.coalesce("head", none), lambda t: t.pos <= F.col("h")))
    convs = scratch.keep(convs.select("conv_id", "head", (F.col("h") - F.size("head")).alias("gap"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")), "convs")
    # both sides are dealt out, so that adaptive execution can split a long conversation
    own = ordered.where(F.col("pos") > h).join(convs.select("conv_id", "gap"), "conv_id").select("conv_id", (F.col("pos") - F.col("gap")).alias("depth"), "item", "points")
    start = convs.select("conv_id", F.inline("head")).select("conv_id", F.col("pos").alias("depth"), "item", "points")
    return own.unionByName(start), convs.select("conv_id", "length")


def prefix_digests(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, seg, prefixes): turns (conv_id, depth, item, points) as arrays of (depth, digest, parent, points), a segment a row."""
    packs = turns.groupBy("conv_id", _segment("depth").alias("seg")).agg(F.array_sort(F.collect_list(F.struct("depth", "item", "points"))).alias("turns"))
    step = lambda out, t: F.concat(out, F.array(_digest(F.coalesce(F.get(out, F.size(out) - 1), F.lit("")), t.item)))
    packs = scratch.keep(packs.withColumn("inner", F.aggregate("turns", F.array().cast("array<string>"), step)), "packs")
    last = F.element_at("inner", -1)
    longer = packs.where("seg > 0")
    whole = lambda after: F.when(F.size("inner") == SEGMENT, after)
    first = packs.where("seg = 0").select("conv_id", "seg", "turns", "inner", F.lit("").alias("before"), whole(_digest(_digest(last))).alias("after"))
    if longer.isEmpty():
        return _prefixes(first)
    deep = longer.select("conv_id").distinct()
    ends = packs.join(deep, "conv_id").select("conv_id", (F.col("seg") + 1).alias("depth"), last.alias("item"), F.lit(0).cast("long").alias("points"))
    outer = prefix_digests(ends, scratch).select("conv_id", F.inline("prefixes")).select("conv_id", (F.col("depth") - 1).alias("seg"), F.col("parent").alias("before"), F.col("digest").alias("after"))
    rest = longer.join(outer, ["conv_id", "seg"]).select("conv_id", "seg", "turns", "inner", "before", whole(F.col("after")).alias("after"))
    return _prefixes(first.unionByName(rest))


def _prefixes(packs: DataFrame) -> DataFrame:
    """Packs of chained turns, with the digest before them and, if whole, the one that closes them."""
    last = F.size("turns") - 1
    digests = F.transform("inner", lambda d, k: F.when((k == last) & F.col("after").isNotNull(), F.col("after")).otherwise(_digest(F.col("before"), d)))
    packs = packs.withColumn("digests", digests)
    one = lambda t, k: F.struct(
        t.depth.alias("depth"), F.get("digests", k).alias("digest"), F.when(k == 0, F.col("before")).otherwise(F.get("digests", k - 1)).alias("parent"), t.points.alias("points")
    )
    return packs.select("conv_id", "seg", F.transform("turns", one).alias("prefixes"))


def _listed(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): of (depth, digest, conv_id), each node's identifiers ascending, joined by commas and hashed.

    Identifiers are packed in blocks; a task streams a node's blocks in order
    through the hash and holds one batch of them.
    """
    packed = ends.groupBy("depth", "digest", F.shiftright("conv_id", _BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for b in batches:
            for depth, digest, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, digest) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "digest", "ends_sha256"), d)) for d in done], schema=kind)
                done = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "digest", "ends_sha256"), (*at, state.hexdigest())))], schema=kind)

    kind = pa.schema([("depth", pa.int64()), ("digest", pa.string()), ("ends_sha256", pa.string())])
    ordered = packed.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "block")
    return ordered.select("depth", "digest", "ids").mapInArrow(run, "depth long, digest string, ends_sha256 string")


def _to_ancestors(nodes: DataFrame, packs: DataFrame) -> DataFrame:
    """(depth, digest, n_leaves, saved_tokens): every node's leaf and savings, exploded to the node and all its ancestors, and summed.

    A conversation's nodes go to the prefixes of that conversation: to each, one
    row with the sum of those at its depth or deeper.
    """
    own = nodes.where("depth > 0").select("conv_id", _segment("depth").alias("seg"), F.struct("depth", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved").alias("o"))
    own = own.groupBy("conv_id", "seg").agg(F.collect_list("o").alias("own"))
    total = lambda name, least=None: F.aggregate(F.transform("own" if least is None else F.filter("own", lambda o: o.depth >= least), lambda o: o[name]), F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.array().cast("array<struct<depth:bigint,leaf:bigint,saved:bigint>>")
    packs = packs.select("conv_id", "seg", F.transform("prefixes", lambda p: F.struct(p.depth.alias("depth"), p.digest.alias("digest"))).alias("prefixes"))
    packs = packs.join(own, ["conv_id", "seg"], "left").withColumn("own", F.coalesce("own", none))
    later = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    packs = packs.withColumns({n: F.coalesce(F.sum(total(n)).over(later), F.lit(0).cast("long")) for n in ("leaf", "saved")})
    up = packs.select(F.explode(F.transform("prefixes", lambda p: F.struct(p.depth.alias("depth"), p.digest.alias("digest"), (F.col("leaf") + total("leaf", p.depth)).alias("leaf"), (F.col("saved") + total("saved", p.depth)).alias("saved")))).alias("u")).select("u.*")
    return up.where("leaf > 0 or saved > 0").groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct prefix of the conversations in turns (conv_id, depth, item, points).

    lengths (conv_id, length) names every conversation, also those without turns.
    conv_id is the smallest member's and, with depth, identifies the node.
    """
    zero = F.lit(0).cast("long")
    packs = scratch.keep(prefix_digests(turns, scratch), "prefixes")
    nodes = packs.select("conv_id", F.inline("prefixes")).groupBy("depth", "digest")
    nodes = nodes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("points").alias("points"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), F.lit("").alias("digest"), "conv_id", "n_convs", F.lit(None).cast("string").alias("parent"), zero.alias("points"))
    nodes = scratch.keep(nodes.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("points")).drop("points"), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.join(children, ["depth", "digest"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "with-children")
    top = nodes.agg(zero.alias("depth"), F.lit("").alias("digest"), F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    sums = _to_ancestors(nodes, packs).unionByName(top)

    ends = packs.join(lengths.where("length > 0").select("conv_id", _segment("length").alias("seg")), ["conv_id", "seg"])
    ends = ends.select(F.element_at("prefixes", -1).alias("p"), "conv_id").select("p.depth", "p.digest", "conv_id")
    ended = _listed(ends.unionByName(lengths.where("length = 0").select(zero.alias("depth"), F.lit("").alias("digest"), "conv_id")))

    # the root is the parent of all nodes of depth 1; other parents meet their children, which adaptive execution may split
    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    first = nodes.where("depth = 0").select("conv_id").head()
    out = nodes.join(sums, ["depth", "digest"], "left").join(ended, ["depth", "digest"], "left").join(above, ["depth", "parent"], "left")
    return out.select(
        "conv_id", "depth",
        F.when(F.col("depth") == 1, F.lit(first.conv_id if first else None).cast("long")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def shared_start_trie(conversations: DataFrame, *, group: int = 100, most: int = 6, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations, each rebuilt to start as the first of its group does (shared_starts).

    Per node: conv_id, its smallest member; depth; parent_conv_id, the parent's
    conv_id (root: null); n_convs, members; n_children; n_leaves, childless nodes
    in its subtree, itself included; saved_tokens, over its subtree the sum of
    (n_convs - 1) times the code points of a node's last text; ends_sha256, the
    hash of the members that end there, in decimal, ascending, comma-joined.

    Turns are ordered with nulls first; equal turns by the digest of role and text.
    Null roles and texts are empty ones; repeated rows are turns of their own; rows
    with a null conversation are left out; an empty table gives no node; other
    columns are not read. Conversations may be of any length.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    rows = turn_rows(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    turns, lengths = shared_starts(in_order(rows, scratch), scratch, group=group, most=most)
    return trie(turns, lengths, scratch)


def conversation_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations as they are; columns and rules of shared_start_trie."""
    scratch = Scratch(conversations.sparkSession, "trie")
    rows = turn_rows(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    ordered = scratch.keep(in_order(rows, scratch), "ordered")
    return trie(ordered.withColumnRenamed("pos", "depth"), ordered.groupBy("conv_id").agg(F.count("*").alias("length")), scratch)

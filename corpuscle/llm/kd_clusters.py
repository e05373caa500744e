"""Centroid clustering by filtering with kd-trees, in exact integers.

Vectors are written once as blocks of under 2 * BLOCK rows. Each block is a
kd-tree: its vectors in the order of the leaves, and of every node the box, the
count and the sum of its vectors. A round reads the blocks and sends the
candidate centroids down the trees. Of a node's candidates the one nearest to the
middle of the box is kept, and another is pruned if it is strictly farther than
that one from every point of the box, which its corner in the direction from the one to
the other decides. A node with one candidate left is assigned whole, by its count and
sum; in leaves the vectors are compared with the candidates left. Ties prune
nothing, so the smaller number wins them, as without the tree.

Boxes, sums and distances are integers, so results do not depend on how vectors
fall into blocks. Only counts and sums of each centroid leave a round's tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .storage import Scratch, small_batches

BLOCK = 1 << 13
LEAF = 32
#: Components may be of this size at most, so that squared distances fit 64 bits.
LARGEST = 1 << 26


def _tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the points, the nodes (first, end, left child or -1; the right one follows it) and their boxes."""
    order, spans, boxes, todo = np.arange(len(points)), [[0, len(points), -1]], [], 0
    while todo < len(spans):
        a, b, _ = spans[todo]
        mine = points[order[a:b]]
        lo, hi = mine.min(axis=0), mine.max(axis=0)
        boxes.append((lo, hi))
        axis = int(np.argmax(hi - lo))
        if b - a > LEAF and hi[axis] > lo[axis]:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(mine[:, axis], mid)]
            spans[todo][2] = len(spans)
            spans += [[a, a + mid, -1], [a + mid, b, -1]]
        todo += 1
    return order, np.array(spans, np.int64), np.array(boxes, np.int64)


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in doubles (one matrix product) where every term stays below 2**53, else in integers."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * points.shape[1] * top * top < 1 << 53:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _filtered(spans: np.ndarray, boxes: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level, (nodes, candidates): the nodes that need no further descent, and which centroids each has left."""
    k = len(centroids)
    norm = (centroids * centroids).sum(axis=1)
    nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(nodes):
        lo, hi = boxes[nodes, 0], boxes[nodes, 1]
        far = np.iinfo(np.int64).max
        best = np.where(left, _distances(lo + hi, 2 * centroids), far).argmin(axis=1)
        # the least over the box of distance(z, x) - distance(best, x), linear in x
        gap = norm[None, :] - norm[best][:, None]
        for z in range(k):
            u = centroids[z] - centroids[best]
            gap[:, z] -= 2 * np.maximum(u * lo, u * hi).sum(axis=1)
        left &= ~(gap > 0)
        child = spans[nodes, 2]
        stop = (left.sum(axis=1) == 1) | (child < 0)
        yield nodes[stop], left[stop]
        on = child[~stop]
        nodes, left = np.concatenate([on, on + 1]), np.concatenate([left[~stop], left[~stop]])


class Block:
    """A kd-tree over packed vectors."""

    def __init__(self, points: bytes, spans: bytes, boxes: bytes, sums: bytes, width: int):
        self.points = np.frombuffer(points, np.int32).reshape(-1, width)
        self.spans = np.frombuffer(spans, np.int64).reshape(-1, 3)
        self.boxes = np.frombuffer(boxes, np.int64).reshape(-1, 2, width)
        self.sums = np.frombuffer(sums, np.int64).reshape(-1, width)

    @staticmethod
    def pack(points: np.ndarray) -> tuple[np.ndarray, tuple[bytes, bytes, bytes, bytes]]:
        order, spans, boxes = _tree(points)
        points = points[order]
        run = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        sums = run[spans[:, 1]] - run[spans[:, 0]]
        return order, (points.astype(np.int32).tobytes(), spans.tobytes(), boxes.tobytes(), sums.tobytes())

    def _leaf(self, node: int, left: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The points of a leaf, and of each the nearest of the candidates and its distance."""
        a, b, _ = self.spans[node]
        mine, tags = self.points[a:b].astype(np.int64), np.flatnonzero(left)
        d = _distances(mine, centroids[tags])
        at = d.argmin(axis=1)
        return mine, tags[at], d[np.arange(len(d)), at]

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the vectors nearest to each centroid."""
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, centroids.shape[1]), np.int64)
        for nodes, left in _filtered(self.spans, self.boxes, centroids):
            one = left.sum(axis=1) == 1
            tag = left[one].argmax(axis=1)
            np.add.at(counts, tag, self.spans[nodes[one], 1] - self.spans[nodes[one], 0])
            np.add.at(sums, tag, self.sums[nodes[one]])
            for node, cand in zip(nodes[~one], left[~one]):
                mine, tags, _ = self._leaf(node, cand, centroids)
                np.add.at(counts, tags, 1)
                np.add.at(sums, tags, mine)
        return counts, sums

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and squared distance."""
        tags, dist = np.empty(len(self.points), np.int32), np.empty(len(self.points), np.int64)
        for nodes, left in _filtered(self.spans, self.boxes, centroids):
            for node, cand in zip(nodes, left):
                a, b, _ = self.spans[node]
                _, tags[a:b], dist[a:b] = self._leaf(node, cand, centroids)
        return tags, dist


def whole_vectors(vectors: DataFrame, *, id_col: str, vec_col: str, width: int) -> DataFrame:
    """(id, vec): the vectors of exactly width components, none null, infinite or not a number."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where((F.size("vec") == width) & finite)


def tree_blocks(vectors: DataFrame, *, width: int, scale: int) -> DataFrame:
    """whole_vectors' rows as kd-tree blocks: (ids, points, spans, boxes, sums), components floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            cells = np.floor(flat.reshape(-1, width) * float(scale))
            if np.abs(cells).max(initial=0) > LARGEST:
                raise ValueError(f"a component is above {LARGEST} in size after scaling")
            for at in range(0, b.num_rows, BLOCK):
                ids.append(b.column(0).slice(at, BLOCK))
                held.append(cells[at : at + BLOCK].astype(np.int64))
                if sum(map(len, held)) >= BLOCK:
                    yield made(ids, held)
                    ids, held = [], []
        if held:
            yield made(ids, held)

    def made(ids: list[pa.Array], held: list[np.ndarray]) -> pa.RecordBatch:
        order, packed = Block.pack(np.concatenate(held))
        moved = pa.concat_arrays(ids).take(pa.array(order))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), moved), *(pa.array([x], pa.binary()) for x in packed)], names=["ids", "points", "spans", "boxes", "sums"]
        )

    schema = StructType([StructField("ids", ArrayType(vectors.schema["id"].dataType)), *(StructField(n, BinaryType()) for n in ("points", "spans", "boxes", "sums"))])
    return vectors.mapInArrow(run, schema)


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[Block]:
    names = ("points", "spans", "boxes", "sums")
    for row in zip(*(batch.column(batch.schema.get_field_index(n)) for n in names)):
        yield Block(*(x.as_buffer() for x in row), width)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each non-empty one at its vectors' mean, rounded down."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for block in _blocks(b, width):
                c, s = block.totals(centroids)
                counts += c
                sums += s
        names = ["c", "n", *(f"s{i}" for i in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), *(pa.array(sums[:, i]) for i in range(width))], names=names)

    schema = "c int, n long, " + ", ".join(f"s{i} long" for i in range(width))
    parts = blocks.select("points", "spans", "boxes", "sums").mapInArrow(run, schema)
    out = centroids.copy()
    for r in parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect():  # one row a centroid
        if r.n:
            out[r.c] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, block in enumerate(_blocks(b, width)):
                tags, dist = block.nearest(centroids)
                yield pa.RecordBatch.from_arrays([b.column(0)[at].values, pa.array(tags), pa.array(dist)], names=["id", "cluster", "distance"])

    schema = StructType([StructField("id", blocks.schema["ids"].dataType.elementType), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    return blocks.select("ids", "points", "spans", "boxes", "sums").mapInArrow(run, schema)


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are the vectors of exactly width components, none null or non-finite;
    components become floor(scale * x). The k first centroids are the vectors with
    the smallest SHA-256 of "seed:id" (null ids last, equal ids by vector), fewer where
    there are fewer vectors. rounds times every vector goes to the nearest centroid
    (the smaller number on ties) and every centroid with vectors to their mean, rounded
    down; then vectors are assigned once more. Repeated rows are vectors of their own.
    An empty table, or one without a whole vector, gives an empty one. Other columns
    are not read. A scaled component above LARGEST in size raises, as its distances
    would not fit. The driver holds the k centroids and nothing else; tasks hold a
    block of vectors at a time.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kd")
    small_batches(spark)
    whole = whole_vectors(vectors, id_col=id_col, vec_col=vec_col, width=width)
    blocks = scratch.keep(tree_blocks(whole, width=width, scale=scale), "blocks")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    cells = F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    first = whole.select(draw.alias("d"), cells.alias("v")).orderBy(F.col("d").asc_nulls_last(), "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, width)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(blocks, centroids)
        found = scratch.keep(assigned(blocks, centroids), "assigned")
    else:
        found = spark.createDataFrame([], StructType([StructField("id", whole.schema["id"].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType())]))
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    per = [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(sums)]
    facts = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

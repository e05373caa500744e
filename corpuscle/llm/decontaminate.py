"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size into classes (powers of two of shingles). A
document is cut, for each class, into windows of twice the class's size that
overlap by half, so that every passage of an item's length lies whole in some
window and the two sets are of similar size. Windows and items are MinHashed;
equal minima name candidates, which exact containment of the item's shingles in
the whole document then decides.

An item of n shingles, 8 or more, shares 0.8 * n of them with a window of 4 * n at
most, so a minimum agrees with a probability of 0.19 or more and all PERMUTATIONS
differ with one under 2e-9, and about 1e-12 for an item that stands whole in the
document; where it stands does not matter. Items of under 8 shingles, whose windows would be too wide, are looked
up by each of their shingles, and none is missed. tests/llm measure this by size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .textcore import U, odd_numbers, shingles, words

PERMUTATIONS = 96
#: Items whose texts go to the executors at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 8 << 20
_BASE = 16  # shingles of the smallest class
_FEW = 8  # items of fewer shingles are looked up by each of them


class ItemIndex:
    """The MinHash index of one block of test items, by size class."""

    def __init__(self, ids: list, texts: list[str], threshold: float, width: int):
        self.ids, self.threshold, self.width = ids, threshold, width
        sets: list[np.ndarray] = []
        for _, _, h, o, _ in words(pa.array(texts, pa.large_string())):
            s, so = shingles(h, o, width)
            sets += [np.unique(s[a:b]) for a, b in zip(so[:-1], so[1:])]
        self.sets = sets
        self.mult = odd_numbers(PERMUTATIONS, 1010)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            if len(s) >= _FEW:
                by.setdefault(max(0, int(np.ceil(np.log2(len(s) / _BASE)))), []).append(k)
        for c, items in by.items():
            # one permutation at a time: an item's size bounds what is held, not that times the permutations
            minima = np.stack([np.array([(sets[k] * m).min() for m in self.mult], U) for k in items])
            flat, owner = minima.ravel(), np.repeat(np.array(items), PERMUTATIONS)
            order = np.argsort(flat, kind="stable")
            self.classes[c] = (flat[order], owner[order])
        few = [k for k, s in enumerate(sets) if 0 < len(s) < _FEW]
        flat = np.concatenate([np.zeros(0, U), *(sets[k] for k in few)])
        owner, order = np.repeat(np.array(few, np.int64), [len(sets[k]) for k in few]), np.argsort(flat, kind="stable")
        self.few = (flat[order], owner[order])
        self.filter = np.zeros(1 << 22, bool)
        for keys, _ in [self.few, *self.classes.values()]:
            self.filter[(keys >> U(42)).astype(np.int64)] = True

    def _hits(self, values: np.ndarray, rows: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
        """(row, item) of the values, one permutation's minima or shingles, that equal an item's."""
        maybe = np.flatnonzero(self.filter[(values >> U(42)).astype(np.int64)])
        if len(maybe):
            keys, owner = table
            lo = np.searchsorted(keys, values[maybe], "left")
            hi = np.searchsorted(keys, values[maybe], "right")
            for m, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
                for k in owner[a:b]:
                    yield int(rows[m]), int(k)

    def candidates(self, h: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs to verify, of rows with shingle hashes h."""
        out: set[tuple[int, int]] = set()
        if len(h) == 0:
            return out
        counts = np.diff(offsets)
        if len(self.few[0]):
            out.update(self._hits(h, np.repeat(np.arange(len(counts)), counts), self.few))
        if not self.classes:
            return out
        n_blocks = -(-counts // _BASE)
        rows = np.repeat(np.arange(len(counts)), n_blocks)
        first = np.cumsum(n_blocks) - n_blocks
        starts = offsets[:-1][rows] + (np.arange(len(rows)) - first[rows]) * _BASE
        levels = self._levels(n_blocks)
        for a in self.mult:
            block = np.minimum.reduceat(h * a, starts)
            for c in range(max(self.classes) + 1):
                if c:
                    idx, has = levels[c - 1][2:]
                    block = np.where(has, np.minimum(block[idx], block[np.minimum(idx + 1, len(block) - 1)]), block[idx])
                if c in self.classes:
                    row, pair = levels[c][:2]
                    out.update(self._hits(np.minimum(block, block[pair]), row, self.classes[c]))
        return out

    def _levels(self, n_blocks: np.ndarray) -> list[tuple]:
        """By class: each block's row, the next block of that row (else itself), and how the next class pairs blocks."""
        levels = []
        for _ in range(max(self.classes) + 1):
            row = np.repeat(np.arange(len(n_blocks)), n_blocks)
            first = np.cumsum(n_blocks) - n_blocks
            within = np.arange(len(row)) - first[row]
            pair = np.arange(len(row)) + (within + 1 < n_blocks[row])
            idx = np.flatnonzero(within % 2 == 0)
            levels.append((row, pair, idx, (within + 1 < n_blocks[row])[idx]))
            n_blocks = -(-n_blocks // 2)
        return levels

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the items contained in whole texts."""
        for i, _, h, o, _ in words(column):
            s, so = shingles(h, o, self.width)
            sets: dict[int, np.ndarray] = {}
            for r, k in sorted(self.candidates(s, so)):
                if r not in sets:
                    sets = {r: np.unique(s[so[r] : so[r + 1]])}
                doc, item = sets[r], self.sets[k]
                at = np.minimum(np.searchsorted(doc, item), len(doc) - 1)
                shared = int((doc[at] == item).sum())
                if shared >= self.threshold * len(item) - 1e-9:
                    yield i + r, k, shared


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """The test items in blocks of at most BLOCK_BYTES (or one item), whatever their number."""
    ids, texts, held = [], [], 0
    narrow = benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for r in narrow.toLocalIterator():
        if held and held + len(r.t) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        held += len(r.t)
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One row per (document, test item) with at least threshold of the item's shingles in the document.

    Columns: id_col, item_id, item_shingles, shared_shingles, containment.
    Words are lower-cased (A-Z); a text of fewer than width words has its whole
    sequence as one shingle; null and empty texts, on either side, match nothing.
    Repeated documents or items each give their own rows. An empty benchmark or
    table gives no rows. The documents are scanned once per block of
    BLOCK_BYTES of items, without a shuffle; a task holds one Arrow batch and
    one block.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, item_shingles long, shared_shingles long"
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sc, found = docs.sparkSession.sparkContext, None
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        held = sc.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*held.value, threshold, width)
            for b in batches:
                got = list(index.matches(b.column(1)))
                rows = pa.array([g[0] for g in got], pa.int64())
                items = [g[1] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(rows),
                        pa.array([index.ids[k] for k in items]).cast(item_type) if items else pa.array([], item_type),
                        pa.array([len(index.sets[k]) for k in items], pa.int64()),
                        pa.array([g[2] for g in got], pa.int64()),
                    ],
                    names=["id", "item", "item_shingles", "shared_shingles"],
                )

        item_type = _arrow_type(item_kind)
        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select(
        F.col("id").alias(id_col),
        F.col("item").alias("item_id"),
        "item_shingles",
        "shared_shingles",
        (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"),
    )


def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that contain no test item, with all their columns and rows.

    Decided as in contained_items(), row by row in the scan: null and empty texts
    stay, repeated rows are each judged, and so are rows with a null id. An empty
    benchmark leaves all rows, an empty table gives an empty one; other columns
    may have any name and are passed on.
    """
    item_col, item_text_col = how.get("item_col", "item_id"), how.get("item_text_col", "text")
    threshold, width = how.get("threshold", 0.8), how.get("width", 5)
    small_batches(docs.sparkSession)
    out = docs
    at = docs.columns.index(text_col)
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*held.value, threshold, width)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in index.matches(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out

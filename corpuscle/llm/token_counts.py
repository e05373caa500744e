"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as its UTF-8 bytes, one symbol each. A heap holds the
adjacent pairs that have a merge rank; the lowest rank, leftmost first, is
popped and merged in a doubly linked list until none is left. The count is the
initial symbols minus the merges; no identifier is emitted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

# The byte-level pre-tokenizer's pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, nxt = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(nxt))
            nxt += 1
    return out


class _Straddles(Exception):
    """A white-space run goes on beyond the unit."""


class _Units(dict):
    """Bounded cache: the tokens of a unit, a space and what follows up to the next space.

    Between two single spaces no pre-token looks past the unit's ends, unless
    the unit is empty or itself begins or ends with white space.
    """

    def __init__(self, counter: "BpeCounter", limit: int):
        super().__init__()
        self.counter, self.limit = counter, limit

    def __missing__(self, unit: str) -> int:
        if not unit or self.counter.space(unit[0]) or self.counter.space(unit[-1]):
            raise _Straddles
        n = self.counter.pieces(" " + unit)
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = n
        return n


class BpeCounter(dict):
    """Counts tokens of texts; itself the bounded cache from pre-token to count."""

    def __init__(self, path: str, cache: int = 400_000):
        super().__init__()
        self.units = _Units(self, 2 * cache)
        self.space = regex.compile(r"\s").match
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE vocabulary")
        self.cache = cache
        self.lead = " " if spec["pre_tokenizer"].get("add_prefix_space") else ""
        ids = spec["model"]["vocab"]
        self.first = [ids[c] for c in _byte_characters()]
        self.rank = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((ids[a], ids[b]), (k, ids[a + b]))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self) >= self.cache:
                self.clear()
            self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        """Symbols left after all merges."""
        n, rank = len(piece), self.rank
        sym = [self.first[b] for b in piece]
        heap = [(*r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1])))]
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, new, i, a, b = heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if r := rank.get((new, sym[k])):
                    heappush(heap, (*r, i, new, sym[k]))
            p = before[i]
            if p >= 0 and (r := rank.get((sym[p], new))):
                heappush(heap, (*r, p, sym[p], new))
        return n - merges

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string counts as one token."""
        if not text:
            return 0
        if self.special and (cuts := len(self.special.findall(text))):
            return cuts + sum(self._plain(t) for t in self.special.split(text) if t)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if self.lead and not text[0].isspace():
            text = self.lead + text
        head, *rest = text.split(" ")
        try:
            if head and self.space(head[-1]):
                raise _Straddles
            return self.pieces(head) + sum(map(self.units.__getitem__, rest))
        except _Straddles:
            return self.pieces(text)

    def pieces(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pattern.findall(text)))


_counters: dict[str, BpeCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer is the path of a byte-level BPE vocabulary file that every
    executor can open. Null and empty texts have 0 bytes and 0 tokens; repeated
    rows are each counted; an empty table gives an empty table; other columns
    are neither read nor returned. Texts are counted whole, a row at a time, so
    the largest row bounds a task's memory; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer)
        if counter is None:
            counter = _counters[tokenizer] = BpeCounter(tokenizer)
        for b in batches:
            counts = [counter.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

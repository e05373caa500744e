"""Quality rules as a short-circuit cascade.

Each rule is a predicate over rows of a batch that computes what it needs for
the rows still alive, and no others. A sample gives each rule's cost and the
share of rows it rejects; the cascade runs in falling order of rejections per
cost. The verdict is the conjunction of the rules, so the order changes the
time and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import line_hashes
from .storage import small_batches
from .textcore import _SPACE, U, buffers, chunks, mix, odd_numbers, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[192:] = True  # the first byte of any character beyond ASCII
WINDOW = 8


def _sums(column: pa.Array, *tables: np.ndarray) -> list[np.ndarray]:
    """By row, how many bytes each table marks."""
    buf, off = buffers(column)
    out = [np.zeros(len(off) - 1, np.int64) for _ in tables]
    for i, j in chunks(off):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        for t, to in zip(tables, out):
            if j == i + 1:
                to[i] = np.count_nonzero(t[part])
                continue
            run = np.concatenate([[0], np.cumsum(t[part])])
            to[i:j] = np.diff(run[o])
    return out


_CHARACTER = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)


@dataclass
class Base:
    """What the contract's columns hold, by row."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def base_columns(column: pa.Array) -> Base:
    """The base measures of whole texts; null is empty."""
    n = len(column)
    n_words, repeat, dup = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    chars, symbols = _sums(column, _CHARACTER, _SYMBOL)
    for i, j, h, o, _ in words(column, lower=False):
        n_words[i:j] = np.diff(o)
        repeat[i:j] = _repeated(h, o)
    for i, j, h, _, _, o in line_hashes(column):
        row = np.repeat(np.arange(j - i), np.diff(o))
        _, first = np.unique(mix(h) ^ mix(row.astype(U) + U(1)), return_index=True)
        dup[i:j] = np.diff(o) - np.bincount(row[first], minlength=j - i)
    return Base(n_words, chars, symbols, dup, repeat)


_STEP = odd_numbers(WINDOW, 88)


def _repeated(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """By row, the words inside 8-word windows that its text has twice or more."""
    n = np.diff(o)
    windows = np.maximum(n - WINDOW + 1, 0)
    if not windows.any():
        return np.zeros(len(n), np.int64)
    full = np.zeros(len(h) - WINDOW + 1, U)
    for k in range(WINDOW):
        full += h[k : k + len(full)] * _STEP[k]
    row = np.repeat(np.arange(len(n)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + o[:-1][row]
    keys = mix(full[at]) ^ mix(row.astype(U) + U(1))  # the row is part of the key
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hits = at[twice]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return np.diff(inside[o])


@dataclass(frozen=True)
class Rule:
    """rejects(texts, base columns of the same rows) -> a mask of rejected rows."""

    name: str
    rejects: Callable[[pa.Array, Base], np.ndarray]


def _no_letters(texts: pa.Array, b: Base) -> np.ndarray:
    (letters,) = _sums(texts, _LETTER)
    return 2 * letters < b.word_chars


def _shouting(texts: pa.Array, b: Base) -> np.ndarray:
    upper, letters = _sums(texts, _UPPER, _LETTER)
    return (letters > 40) & (2 * upper > letters)


def _exclaiming(texts: pa.Array, b: Base) -> np.ndarray:
    mark = np.zeros(256, bool)
    mark[33] = True
    (marks,) = _sums(texts, mark)
    return 2 * marks > b.n_words


def _stutter(texts: pa.Array, b: Base) -> np.ndarray:
    again = np.zeros(len(texts), np.int64)
    for i, j, h, o, _ in words(texts, lower=False):
        same = np.concatenate([[0], h[1:] == h[:-1]])[: len(h)]
        starts = o[:-1]
        same[starts[starts < len(h)]] = 0  # a row's first word follows none
        again[i:j] = np.diff(np.concatenate([[0], np.cumsum(same)])[o])
    return 10 * again > 3 * b.n_words


#: Thresholds that running prose stays well clear of.
RULES = (
    Rule("symbols", lambda t, b: 10 * b.n_symbols > b.n_words),
    Rule("word_length", lambda t, b: (b.word_chars > 15 * b.n_words) | (b.word_chars < 2 * b.n_words)),
    Rule("no_letters", _no_letters),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("stutter", _stutter),
)


def _take(b: Base, alive: np.ndarray) -> Base:
    return Base(*(getattr(b, f)[alive] for f in Base.__dataclass_fields__))


def cascade(texts: pa.Array, base: Base, rules: tuple[Rule, ...], alive: np.ndarray) -> np.ndarray:
    """The mask of rows that pass all rules; each rule sees only what the ones before it left."""
    left = np.flatnonzero(alive)
    for rule in rules:
        if len(left) == 0:
            break
        left = left[~rule.rejects(texts.take(pa.array(left)), _take(base, left))]
    out = np.zeros(len(alive), bool)
    out[left] = True
    return out


def base_failed(b: Base) -> np.ndarray:
    return (b.n_words < 20) | (100 * b.n_repeat_words > 30 * b.n_words)


def order_rules(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> tuple[Rule, ...]:
    """rules by estimated rejections per cost, from about `sample` rows of docs, four times that at most.

    The rows are those whose text's hash leaves 0 modulo rows / sample (at
    least 1), a scan of the texts; the number of rows is read from the files'
    footers. They are timed in one task, each rule over all of them. Ties, and an
    empty sample, keep the given order.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    every = max(1, docs.count() // sample)
    rows = texts.filter(F.pmod(F.xxhash64("text", F.lit(8)), F.lit(every)) == 0).limit(4 * sample).coalesce(1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits = [0.0] * len(rules), [0] * len(rules)
        for b in batches:
            base = base_columns(b.column(0))
            live = np.flatnonzero(~base_failed(base))
            texts, base = b.column(0).take(pa.array(live)), _take(base, live)
            for k, rule in enumerate(rules):
                began = time.thread_time()
                hits[k] += int(rule.rejects(texts, base).sum())
                cost[k] += time.thread_time() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(hits, pa.int64()), pa.array(cost, pa.float64())], names=["rule", "hits", "cost"])

    got = sorted(rows.mapInArrow(measure, "rule int, hits long, cost double").collect(), key=lambda r: (-r.hits / max(r.cost, 1e-9), r.rule))
    seen = list(dict.fromkeys(r.rule for r in got))
    return tuple(rules[k] for k in seen) + tuple(r for k, r in enumerate(rules) if k not in seen)


def quality_verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Whole texts, row by row, in one scan without a shuffle, after order_rules()'s
    of a sample. The measures are columns of the result and so computed for every
    row; the rules that need no more than these cost nothing beside, and the others
    are computed only for rows that the rules before them left. Null and empty texts
    have zeros, fail the base rules and are not kept. Repeated rows are each
    judged; an empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    ordered = order_rules(docs, text_col=text_col, rules=rules)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = base_columns(b.column(1))
            failed = base_failed(base)
            kept = cascade(b.column(1), base, ordered, ~failed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(getattr(base, f)) for f in Base.__dataclass_fields__), pa.array(failed), pa.array(kept)],
                names=["id", *Base.__dataclass_fields__, "base_failed", "kept"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)

"""A convolutional text classifier in numpy, with thresholds calibrated by language.

A word is the sum of two hashed embeddings: of the whole word and of its first
bytes, so that unseen forms of a known stem are near it. Filters of several
widths slide over the words, each keeps its maximum over the whole text, and a
logistic unit weighs the maxima. Only words enter a score: labels, language,
source and id never do. The language picks the threshold that `flagged` uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import near_ids
from .storage import small_batches
from .textcore import U, words

WORD_BITS, HEAD_BITS, HEAD_BYTES = 15, 13, 4
DIM, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
_PAD = max(WIDTHS) - 1
_SLICE = 1 << 14
_BINS = 64  # bins of logits a unit, in which calibration counts


def _encode(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word buckets, head buckets, offsets), rows padded by _PAD zeros.

    Bucket 0 is the padding's. ASCII punctuation stays part of a word; the head
    bucket carries over what it splits.
    """
    for i, j, h, o, p in words(column, lower=True, prefix=HEAD_BYTES):
        n = np.diff(o)
        off = np.concatenate([[0], np.cumsum(n + _PAD)])
        at = np.arange(len(h)) + np.repeat(np.arange(len(n)) * _PAD, n)
        w, head = np.zeros(off[-1], np.int32), np.zeros(off[-1], np.int32)
        w[at] = (h >> U(64 - WORD_BITS)).astype(np.int32) | 1
        head[at] = (p >> U(64 - HEAD_BITS)).astype(np.int32) | 1
        yield i, j, w, head, off


@dataclass
class ToxicityModel:
    """Weights; thresholds by language, 0.5 for any other."""

    word: np.ndarray
    head: np.ndarray
    filters: np.ndarray  # (DIM, sum(WIDTHS) * FILTERS)
    shift: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 4) -> "ToxicityModel":
        r = np.random.default_rng(seed)
        f = np.float32
        word = r.normal(0, 0.1, (1 << WORD_BITS, DIM)).astype(f)
        head = r.normal(0, 0.1, (1 << HEAD_BITS, DIM)).astype(f)
        word[0] = head[0] = 0
        k = len(WIDTHS) * FILTERS
        return ToxicityModel(word, head, r.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(f), np.zeros(k, f), r.normal(0, 0.3, k).astype(f), 0.0)

    def _maps(self, w: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embeddings, and each width's filter outputs at every position that has the width."""
        x = self.word[w] + self.head[head]
        a = x @ self.filters
        maps, col = [], 0
        for width in WIDTHS:
            z = a[: len(a) - width + 1, col : col + FILTERS].copy()
            for k in range(1, width):
                z += a[k : len(a) - width + 1 + k, col + k * FILTERS : col + (k + 1) * FILTERS]
            maps.append(z)
            col += width * FILTERS
        return x, maps

    def _pooled(self, w: np.ndarray, head: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(rows, filters) maxima over each whole row, in slices of bounded size."""
        rows = len(off) - 1
        best = np.full((rows, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for lo in range(0, int(off[-1]), _SLICE):
            hi = min(lo + _SLICE, int(off[-1]))
            end = min(hi + _PAD, int(off[-1]))
            _, maps = self._maps(w[lo:end], head[lo:end])
            first = int(np.searchsorted(off, lo, "right")) - 1
            last = int(np.searchsorted(off, hi, "left"))
            for k, (width, z) in enumerate(zip(WIDTHS, maps)):
                z = z[: hi - lo]
                if width > 1:  # positions whose window runs past the row
                    past = off[first + 1 : last + 1, None] - np.arange(1, width)[None, :] - lo
                    past = past[(past >= 0) & (past < len(z))]
                    z[past] = -np.inf
                starts = np.maximum(off[first:last] - lo, 0)
                inside = starts < len(z)
                if inside.any():
                    got = np.maximum.reduceat(z, starts[inside], axis=0)
                    at = np.arange(first, last)[inside]
                    best[at, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best[at, k * FILTERS : (k + 1) * FILTERS], got)
        return best

    def logits(self, w: np.ndarray, head: np.ndarray, off: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self._pooled(w, head, off) + self.shift, 0)
        return hidden.astype(np.float64) @ self.out.astype(np.float64) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, w, head, off in _encode(column):
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.logits(w, head, off), -30, 30)))
        return out


def train(w: list[np.ndarray], head: list[np.ndarray], y: np.ndarray, *, steps: int = 400, batch: int = 48, rate: float = 0.01, seed: int = 4) -> ToxicityModel:
    """Fit by Adam, the same number of steps for any sample; w and head are the padded bucket sequences of the rows."""
    m, r = ToxicityModel.fresh(seed), np.random.default_rng(seed)
    params = [m.word, m.head, m.filters, m.shift, m.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_state, step = np.zeros(2), 0
    lengths = np.array([len(x) for x in w])
    while step < steps:
        order = r.permutation(len(w))
        # rows of like length together, in shuffled groups, keep a step's memory even
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        for g in groups:
            off = np.concatenate([[0], np.cumsum(lengths[g])])
            cw, ch = np.concatenate([w[k] for k in g]), np.concatenate([head[k] for k in g])
            x, maps = m._maps(cw, ch)
            n = len(g)
            pooled, where = np.empty((n, len(WIDTHS) * FILTERS), np.float32), np.empty((n, len(WIDTHS) * FILTERS), np.int64)
            for k, (width, z) in enumerate(zip(WIDTHS, maps)):
                for d in range(n):
                    part = z[off[d] : off[d + 1] - width + 1]
                    top = part.argmax(axis=0)
                    where[d, k * FILTERS : (k + 1) * FILTERS] = top + off[d]
                    pooled[d, k * FILTERS : (k + 1) * FILTERS] = part[top, np.arange(FILTERS)]
            hidden = np.maximum(pooled + m.shift, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.bias, -30, 30)))
            err = ((p - y[g]) / n).astype(np.float32)
            g_out, g_bias = hidden.T @ err + 1e-4 * m.out, float(err.sum())
            back = (err[:, None] * m.out[None, :]) * (hidden > 0)
            g_filters, g_x, col = np.zeros_like(m.filters), {}, 0
            touched_pos, touched_val = [], []
            for k, width in enumerate(WIDTHS):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                pos = where[:, k * FILTERS : (k + 1) * FILTERS]
                for s in range(width):
                    cols = slice(col + s * FILTERS, col + (s + 1) * FILTERS)
                    at = x[pos + s]  # (n, FILTERS, DIM)
                    g_filters[:, cols] += np.einsum("nf,nfd->df", b, at)
                    touched_pos.append((pos + s).ravel())
                    touched_val.append((b[:, :, None] * m.filters[:, cols].T[None, :, :]).reshape(-1, DIM))
                col += width * FILTERS
            pos, val = np.concatenate(touched_pos), np.concatenate(touched_val)
            g_word, g_head = np.zeros_like(m.word), np.zeros_like(m.head)
            np.add.at(g_word, cw[pos], val)
            np.add.at(g_head, ch[pos], val)
            g_word[0] = g_head[0] = 0
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for q, grad, u, v in zip(params, [g_word, g_head, g_filters, back.sum(axis=0), g_out], first, second):
                u *= 0.9
                u += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                q -= rate * (u / fix1) / (np.sqrt(v / fix2) + 1e-7)
            bias_state = bias_state * [0.9, 0.999] + [0.1 * g_bias, 0.001 * g_bias**2]
            m.bias -= rate * (bias_state[0] / fix1) / (np.sqrt(bias_state[1] / fix2) + 1e-7)
    return m


def _best_cut(score: np.ndarray, clean: np.ndarray, toxic: np.ndarray, fallback: float) -> float:
    """The middle of the widest gap among cuts with the fewest errors; score: ascending, clean and toxic: rows at each."""
    if min(clean.sum(), toxic.sum()) < 10:
        return fallback
    errors = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    edges = np.concatenate([[0.0], score, [1.0]])
    cuts, gaps = (edges[:-1] + edges[1:]) / 2, np.diff(edges)
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[np.argmax(gaps[best])]])


def _counts(rows: list[tuple[int, int, int]], shift: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ascending, of the bins in rows (bin, label, rows), and their clean and toxic rows; logits moved by shift."""
    bins = np.array(sorted({r[0] for r in rows}))
    n = np.zeros((2, len(bins)))
    for b, y, c in rows:
        n[y, np.searchsorted(bins, b)] += c
    return 1 / (1 + np.exp(-np.clip((bins + 0.5) / _BINS + shift, -30, 30))), n[0], n[1]


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", sample: int = 2400, max_words: int = 4096) -> ToxicityModel:
    """Train on a bounded sample of labelled rows outside the held-out fifth.

    sample: labelled rows at most, half of each label, the first by hash of the
    id, of three quarters by another hash; max_words: longer texts are not
    fitted. Both bound what the driver holds. All labelled rows that neither the
    fit nor the held-out fifth has calibrate, whole and at their own mix of
    labels: the score's 0.5 globally, the threshold of each language that has
    ten of them of each label. They are scored in one scan and counted in bins;
    rows of repeated ids each count; of several texts of one id the first by hash
    is fitted. Null or repeated labels: null ones are left out, of several for one
    id the larger counts. Without both labels the scores are constant.
    """
    small_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    marked = marked.filter(~held_out("id")).groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    picked = None
    for y in (0, 1):
        part = marked.filter((F.col("y") == y) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) != 3)).orderBy(F.xxhash64("id"), "id").limit(sample // 2)
        picked = part if picked is None else picked.unionByName(part)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "id")  # at most `sample` rows of two numbers
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text", "lang")).alias("t"), F.max("y").alias("y")).select("id", "t.lang", "t.text", "y")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w, head, off in _encode(b.column(2)):
                o = pa.array(off.astype(np.int32))
                part = b.slice(i, j - i)
                short = pa.array(np.diff(off) <= max_words + _PAD)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.ListArray.from_arrays(o, pa.array(w)), pa.ListArray.from_arrays(o, pa.array(head))], names=["id", "lang", "y", "w", "h"]).filter(short)

    kind = texts.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(encode, f"id {kind}, lang string, y int, w array<int>, h array<int>").toArrow().sort_by("id")
    y = np.array(got["y"].to_pylist(), np.float32)
    if len(np.unique(y)) < 2:
        m = ToxicityModel.fresh()
        m.out[:], m.bias = 0, 20.0 if len(y) and y[0] else -20.0
        return m
    w = [x.values.to_numpy() for x in got["w"]]
    head = [x.values.to_numpy() for x in got["h"]]
    m = train(w, head, y)
    del w, head  # views of what got holds
    fitted = docs.sparkSession.createDataFrame([(k,) for k in got["id"].to_pylist()], f"id {kind}")
    del got
    pa.default_memory_pool().release_unused()
    other = marked.join(F.broadcast(fitted), "id", "left_anti")  # fitted: at most `sample` ids
    found = _binned(near_ids(texts, other.select("id")), m, kind).join(other, "id")
    # bins and languages bound what the driver gets
    counted = [(r.lang or "", r.bin, r.y, r.n) for r in found.groupBy("lang", "bin", "y").agg(F.count("*").alias("n")).collect()]
    cut = np.clip(_best_cut(*_counts([r[1:] for r in counted]), 0.5), 0.02, 0.98)
    shift = -float(np.log(cut / (1 - cut)))
    m.bias += shift
    for name in sorted({r[0] for r in counted} - {""}):
        m.thresholds[name] = float(np.clip(_best_cut(*_counts([r[1:] for r in counted if r[0] == name], shift), 0.5), 0.2, 0.8))
    return m


def _binned(texts: DataFrame, model: ToxicityModel, kind: str) -> DataFrame:
    """(id, lang, bin): the bin of each text's logit, in a scan of whole texts."""
    held = texts.sparkSession.sparkContext.broadcast(model)  # about 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for i, j, w, head, off in _encode(b.column(2)):
                out[i:j] = np.floor(np.clip(m.logits(w, head, off), -30, 30) * _BINS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["id", "lang", "bin"])

    return texts.select("id", "lang", "text").mapInArrow(run, f"id {kind}, lang string, bin long")


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id_col, held_out, score, predicted (score >= 0.5), threshold, flagged.

    Whole texts are scored in one scan without a shuffle; null, empty and blank
    texts get the score of a text without words; flagged compares the score with
    the language's threshold (0.5 for a null or unknown language). Repeated rows
    are each scored; an empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(model)  # of a fixed size, about 3 MB
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            score = m.scores(b.column(3))
            cut = np.array([m.thresholds.get(x, 0.5) for x in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(cut), pa.array(score >= cut)], names=["id", "held_out", "score", "predicted", "threshold", "flagged"])

    narrow = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), lang.alias("lang"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, threshold double, flagged boolean")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that their language's threshold does not flag, with all their columns.

    Judged row by row in the scan, as in toxicity_scores(): null and empty texts
    by the score of a text without words, repeated rows each, null languages by a
    threshold of 0.5; an empty table gives an empty one; other columns may have
    any name and are passed on.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    lang_at = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            langs = b.column(lang_at).cast(pa.string()).to_pylist() if lang_at is not None else [None] * b.num_rows
            cut = np.array([m.thresholds.get(x, 0.5) for x in langs], float)
            yield b.filter(pa.array(m.scores(b.column(at)) < cut))

    return docs.mapInArrow(run, docs.schema)

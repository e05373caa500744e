"""Word and shingle hashes of whole text columns, in numpy over Arrow buffers.

Words are the maximal runs of bytes other than space and 0x09-0x0D. A batch's
UTF-8 buffer is hashed in one sweep: with P the running sum of value(byte) *
R**position (mod 2**64), the word over [s, e) is (P[e] - P[s]) * R**-s, then
mixed. No Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 19  # bytes of text hashed at a time
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD1B54A32D192ED03) + U(seed)) | U(1)


_VALUE = odd_numbers(256, 77)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(n, r, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a row."""
    n = len(buf)
    word = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= edge[1:n] | ~word[:-1]
    ends = word
    ends[:-1] &= edge[1:n] | ~word[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _piece(buf: np.ndarray, offsets: np.ndarray, value: np.ndarray, prefix: int):
    if len(buf) == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64), np.zeros(0, U)
    starts, ends = _spans(buf, offsets)
    pw, inv = _pow(len(buf) + 1)
    run = np.empty(len(buf) + 1, U)
    run[0] = 0
    np.cumsum(value[buf] * pw[: len(buf)], dtype=U, out=run[1:])
    back = inv[starts]
    hashes = mix((run[ends] - run[starts]) * back)
    heads = mix((run[np.minimum(starts + prefix, ends)] - run[starts]) * back) if prefix else hashes[:0]
    return hashes, np.searchsorted(starts, offsets), heads


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about limit bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(column: pa.Array, lower: bool = True, prefix: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets by row, hashes of the words' first bytes).

    Rows come in chunks, so memory is bounded by CHUNK and by the longest row;
    a row longer than CHUNK is hashed in parts that are cut at spaces.
    """
    value = _VALUE_LOWER if lower else _VALUE
    buf, offsets = buffers(column)
    for i, j in chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * CHUNK:
            h, o, p = _piece(buf[a:b], offsets[i : j + 1] - a, value, prefix)
            yield i, j, h, o, p
            continue
        got = []
        while a < b:
            e = min(a + CHUNK, b)
            while e < b:  # cut after a space, wherever the next one is
                cut = np.flatnonzero(_SPACE[buf[e : e + CHUNK]])
                if len(cut):
                    e += int(cut[0]) + 1
                    break
                e = min(e + CHUNK, b)
            got.append(_piece(buf[a:e], np.array([0, e - a]), value, prefix))
            a = e
        h, p = np.concatenate([g[0] for g in got]), np.concatenate([g[2] for g in got])
        yield i, j, h, np.array([0, len(h)]), p


_STEP = odd_numbers(64, 5)


def shingles(h: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row offsets of the word shingles.

    A row of 1 to width - 1 words has its whole sequence as one shingle; a row
    without words has none.
    """
    n = np.diff(offsets)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(counts)])
    if len(h) == 0:
        return h, out_off
    full = np.zeros(max(len(h) - width + 1, 0), U)
    for k in range(width):
        full += h[k : k + len(full)] * _STEP[k]
    out = np.empty(int(out_off[-1]), U)
    long = n >= width
    # positions of the long rows' shingles in the sequence of words
    take = np.repeat(offsets[:-1][long] - out_off[:-1][long], counts[long])
    at = np.flatnonzero(np.repeat(long, counts))
    out[at] = full[at + take]
    for r in np.flatnonzero((n > 0) & ~long):
        part = h[offsets[r] : offsets[r + 1]]
        out[out_off[r]] = (part * _STEP[: len(part)]).sum(dtype=U) + U(len(part))
    return mix(out), out_off

"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

No tokenizer is trained. The ranks of a byte-level vocabulary are written as a
sentencepiece BPE model, field by field in protobuf's wire format: each token is
a piece whose bytes are mapped to characters (byte b to U+0100 + b), its score is
the negative rank, and the normaliser is the identity (no prefix, no squeezed or
escaped spaces). Sentencepiece merges the adjacent pair of the highest score,
leftmost first, which is the lowest rank. Texts are cut into pre-tokens by the
vocabulary's pattern and each is encoded by itself; a pre-token that is itself a
token is that token. Decoding looks up each identifier's bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .storage import small_batches

# Fixed value: the vocabularies' pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MAPPED = {b: 0x100 + b for b in range(256)}
_STEP = 1 << 20  # characters of text whose pre-tokens are looked up together


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_MAPPED)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: pieces by rank, then the unknown piece, which no byte of a text needs."""
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    if len(set(ranks.values())) < len(ranks):
        raise ValueError("two tokens have one rank")
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece(_mapped(t), -float(r), 1) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks))  # BPE, size, unk_id
    identity = _block(1, b"identity") + _block(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + piece("<unk>", 0.0, 2) + _block(2, trainer) + _block(3, identity)


class ByteBpe:
    """Encoder and decoder, with bounded caches of packed int32 identifiers.

    pieces holds pre-tokens. units holds what stands between two single spaces,
    with the space before it: where a unit is not empty and neither begins nor
    ends with white space, no pre-token looks past its ends, so its pre-tokens
    are those of the text. A text with other units is cut as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PRE_TOKEN, cache: int = 400_000):
        self.cache = cache
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, bytes | None] = {}
        self.pattern = regex.compile(pattern)
        self.space = regex.compile(r"\s").match
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of = [r for _, r in ordered]
        self.token_of = {r: t for t, r in ordered}
        tokens = pa.array([self.token_of.get(r) for r in range(max(self.rank_of) + 1)], pa.large_binary())
        self.tokens = tokens
        self.whole = {t: struct.pack("=i", r) for t, r in ordered}

    def _of(self, cut: list[list[str]]) -> list[bytes]:
        """The identifiers of lists of pre-tokens; those not in the cache go to the model at once."""
        known = self.pieces
        seen = set().union(*cut)
        new = [p for p in seen if p not in known]
        if len(known) + len(new) > self.cache:
            known.clear()
            new = list(seen)
        merged = []
        for p in new:
            if one := self.whole.get(p.encode("utf-8")):
                known[p] = one
            else:
                merged.append(p)
        for p, ids in zip(merged, self.model.encode([_mapped(p.encode("utf-8")) for p in merged], num_threads=1)):
            known[p] = struct.pack(f"={len(ids)}i", *map(self.rank_of.__getitem__, ids))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed identifiers of each text; null and empty texts have none."""
        known, split = self.units, [(t or "").split(" ") for t in texts]
        seen = set().union(*(u[1:] for u in split))
        new = [u for u in seen if u not in known]
        if len(known) + len(new) > self.cache:
            known.clear()
            new = list(seen)
        whole = [u for u in new if u and not self.space(u[0]) and not self.space(u[-1])]
        known.update(dict.fromkeys(new))
        known.update(zip(whole, self._of([self.pattern.findall(" " + u) for u in whole])))
        # the part before the first space, or the whole text where a unit straddles
        heads, rests = [], []
        for text, (head, *rest) in zip(texts, split):
            ids = list(map(known.__getitem__, rest))
            if None in ids or (head and self.space(head[-1])):
                head, ids = text, []
            heads.append(self.pattern.findall(head))
            rests.append(ids)
        return [head + b"".join(ids) for head, ids in zip(self._of(heads), rests)]

    def decode(self, ids: list[int] | None) -> bytes:
        """The bytes of identifiers; an unknown one raises."""
        return b"".join(map(self.token_of.__getitem__, ids or ()))

    def decode_rows(self, ids: pa.Array) -> pa.Array:
        """The bytes of each row of identifiers, a column at a time: tokens are taken one after another, and a row is where its own begin and end."""
        counts = pc.fill_null(pc.list_value_length(ids), 0)
        flat = ids.flatten()  # without the values of null rows
        if flat.null_count or (len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(self.tokens))):
            raise KeyError("an identifier that the vocabulary lacks")
        taken = self.tokens.take(flat)
        if taken.null_count:
            raise KeyError("an identifier that the vocabulary lacks")
        starts = np.frombuffer(taken.buffers()[1], np.int64, len(flat) + 1, 8 * taken.offset) if len(flat) else np.zeros(1, np.int64)
        ends = np.concatenate(([0], np.cumsum(counts.to_numpy(zero_copy_only=False), dtype=np.int64)))
        data = taken.buffers()[2] if len(flat) else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts[ends]), data])


_made: dict[str, ByteBpe] = {}


def _coder(path: str) -> ByteBpe:
    """The worker's coder for a vocabulary, made once."""
    if path not in _made:
        _made[path] = ByteBpe(read_ranks(path))
    return _made[path]


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col and ids, the token identifiers of the whole text, as array<int>.

    vocabulary is the path of a rank file that every executor can open. Null and
    empty texts have an empty array; repeated rows are each encoded; an empty
    table gives an empty one; other columns, whatever their names, are not read.
    A row at a time is held, so the largest row bounds a task's memory; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for b in batches:
            at, n = 0, b.num_rows
            while at < n:
                texts, size, k = [], 0, at
                while k < n and size < _STEP:
                    texts.append(b.column(1)[k].as_py())
                    size += len(texts[-1] or "")
                    k += 1
                packed = coder.encode(texts)
                offsets = [0]
                for p in packed:
                    offsets.append(offsets[-1] + len(p) // 4)
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k - at), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["id", "ids"])
                at = k

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", narrow.schema["id"].dataType), StructField("ids", ArrayType(IntegerType()))])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """encoded with one more column, out_col: the bytes that the identifiers of ids_col stand for.

    Bytes, not a string, as identifiers may end within a character. Null and
    empty arrays give no bytes; an identifier that the vocabulary lacks raises.
    A column named out_col must not be there yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for b in batches:
            at = b.schema.get_field_index(ids_col)
            out = coder.decode_rows(b.column(at)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, out_col])

    if out_col in encoded.columns:
        raise ValueError(f"there is a column {out_col} already")
    small_batches(encoded.sparkSession)
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out_col, BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256 of the decimal identifiers joined by a space, decoded_sha256 of the decoded bytes."""
    ids = encode(docs, vocabulary, id_col=id_col, text_col=text_col)
    return decode(ids, vocabulary).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )

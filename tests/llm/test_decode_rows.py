"""Decoding a column of identifiers at once gives what decoding each row gives."""

import random

import pyarrow as pa
import pytest

from corpuscle.llm.byte_bpe import ByteBpe

RANKS = {bytes([b]): b for b in range(256)} | {b"ab": 256, " é".encode(): 260}


def test_rows_are_those_of_single_decoding():
    coder, draw = ByteBpe(RANKS), random.Random(5)
    ids = [None, [], *([draw.choice(list(RANKS.values())) for _ in range(draw.randrange(9))] for _ in range(300)), None, []]
    rows = pa.array(ids, pa.list_(pa.int32()))
    assert coder.decode_rows(rows).to_pylist() == [coder.decode(x) for x in ids]
    assert coder.decode_rows(rows.slice(7, 50)).to_pylist() == [coder.decode(x) for x in ids[7:57]]
    for few in (rows.slice(0, 0), rows.slice(0, 1), rows.slice(0, 2)):
        assert coder.decode_rows(few).to_pylist() == [b""] * len(few)


@pytest.mark.parametrize("bad", [-1, 258, 261, None])
def test_unknown_identifiers_raise(bad):
    with pytest.raises(KeyError):
        ByteBpe(RANKS).decode_rows(pa.array([[1], [2, bad]], pa.list_(pa.int32())))

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpuscle.llm.byte_bpe import PRE_TOKEN, ByteBpe, decode, encode, model_bytes, read_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def _texts():
    rng = random.Random(3)
    pool = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "᠎", "​", "▁", "\xa0", "é", "你", "🙂", "1", "²", "'s", "'S", "<|endoftext|>", "\x00", "_", "́", "the", "ing"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 15))) for _ in range(2000)]


def test_ids_are_the_librarys_and_decode_to_the_text(spark, library):
    assert PRE_TOKEN == public_tokenizers.PATTERN
    texts = [None, "", "x" * 50_000, " " * 50_000, *_texts()]
    docs = spark.createDataFrame([(k, t, 7, "z") for k, t in enumerate(texts)], "doc_id long, text string, ids int, bytes string")
    got = {r.doc_id: r for r in decode(encode(docs, PATH), PATH).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k].ids == library.encode_ordinary(t or ""), repr(t)
        assert bytes(got[k].bytes) == (t or "").encode()


def test_query_columns(spark, library):
    docs = spark.createDataFrame([(1, "Hello wörld"), (1, "Hello wörld"), (2, None)], "doc_id long, text string")
    rows = sorted(round_trip(docs, PATH).collect())
    ids = library.encode_ordinary("Hello wörld")
    want = (1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256("Hello wörld".encode()).hexdigest())
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in rows] == [want, want, (2, 0, none, none)]
    assert round_trip(docs.limit(0), PATH).collect() == []


def test_small_caches_change_nothing(library):
    coder = ByteBpe(read_ranks(PATH), cache=3)
    for t in _texts()[:200]:
        assert memoryview(coder.encode([t])[0]).cast("i").tolist() == library.encode_ordinary(t)


def test_every_token_is_reached_by_merges():
    ranks = read_ranks(PATH)
    coder, tokens = ByteBpe(ranks), list(ranks)
    merged = coder.model.encode([t.decode("latin-1").translate({b: 0x100 + b for b in range(256)}) for t in tokens], num_threads=1)
    assert [coder.rank_of[i[0]] for i in merged if len(i) == 1] == list(ranks.values())


def test_ranks_with_gaps_and_bad_vocabularies(spark):
    ranks = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 601, b"abc": 603, b"bc": 600}
    coder = ByteBpe(ranks)
    assert memoryview(coder.encode(["abcab"])[0]).cast("i").tolist() == [603, 601]  # bc first, then a with it
    with pytest.raises(ValueError):
        model_bytes({b"a": 0})
    with pytest.raises(ValueError):
        model_bytes(ranks | {b"zz": 600})
    with pytest.raises(ValueError):
        decode(spark.range(1).select(F.array(F.lit(1)).alias("ids"), F.lit(1).alias("bytes")), PATH)

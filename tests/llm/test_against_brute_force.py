"""The operators against plain versions on small inputs."""

import glob
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import mixing, near_dedup, pii, textcore, toxicity
from corpuscle.llm.token_counts import BpeCounter

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: top(i) for i in ids}


def test_near_duplicates_of_one_large_loose_group(spark):
    """Copies with many or few edits of one text, where most pairs are no links."""
    r, texts = random.Random(5), {}
    base = [f"b{k}" for k in range(150)]
    for i in range(160):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts[i * 3 + r.randrange(3)] = " ".join(w)
    texts |= {1000 + k: " ".join(f"c{k}-{j}" for j in range(40)) for k in range(20)}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, threshold=85).collect()}
    assert got == components(texts)


def test_odd_sketch_estimates():
    r = np.random.default_rng(1)
    for share in (0.95, 0.85, 0.7):
        s = r.integers(0, 1 << 63, 4000).astype(np.uint64)
        t = s.copy()
        n = int(len(s) * (1 - share) / (1 + share))
        t[:n] = r.integers(0, 1 << 63, n).astype(np.uint64)
        m = near_dedup.minhash(np.concatenate([s, t]), np.array([0, len(s), 2 * len(s)]))
        bits = near_dedup.odd_sketch(m)
        differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        guess = 1 + near_dedup.SKETCH_BITS / (4 * near_dedup.SAMPLES) * np.log(1 - 2 * differ / near_dedup.SKETCH_BITS)
        assert abs(guess - share) < 0.15


def test_token_counts_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, mine, r = Tokenizer.from_file(path), BpeCounter(path), random.Random(2)
    pieces = [*"ab 'strell\n\t\x1c\x85 　é1²½中😀<|>_-\x0b\x0c\r", "<|endoftext|>", "  ", " the", "'ll", "1234"]
    texts = ["".join(r.choices(pieces, k=r.randrange(40))) for _ in range(3000)] + ["ab" * 5000, "\n" * 300, "<|endoftext|>" * 3]
    assert [mine.count(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_equal_the_pattern():
    r = random.Random(3)
    texts = ["".join(r.choices("aB é\t\n\x0b\x0c\r 😀", k=r.randrange(30))) for _ in range(500)] + [None, ""]
    seen = {}
    for i, j, h, o, _ in textcore.words(pa.array(texts), lower=True):
        for k in range(i, j):
            want = re.findall(rb"[^\x20\x09-\x0D]+", (texts[k] or "").encode())
            assert o[k - i + 1] - o[k - i] == len(want)
            for w, x in zip(want, h[o[k - i] : o[k - i + 1]]):
                assert seen.setdefault(w.lower(), x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_rows_hash_like_short_ones(monkeypatch):
    text = pa.array([" ".join(f"w{k}" for k in range(5000))])
    whole = next(textcore.words(text))[2]
    monkeypatch.setattr(textcore, "CHUNK", 1000)
    assert (np.concatenate([x[2] for x in textcore.words(text)]) == whole).all()


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[name]
            if ok():
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_pii_base_spans(spark):
    r = random.Random(3)
    pieces = [*"0123456789....@@@++--  ()ab_%é😀", "a@b.c", "1.2.3.4", "4111111111111111", "+1 (123) 555-1234", "255.256.1.1", "4111 1111-1111 1111"]
    rows = [(k, "".join(r.choices(pieces, k=r.randrange(40)))) for k in range(1500)] + [(9000, "a@b.c_x@d.com"), (9001, "0001.2.3.0255 1.2.3.4.5.6.7.8"), (9002, "1 " * 20_000), (9003, "a" * 50_000 + "@")]
    texts = dict(rows)
    for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = plain_spans(texts[x.doc_id])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert {f"{n}:{a}:{e}" for a, _, e, n in spans} <= set(x.spans.split(","))
        if not x.n_added:
            assert x.spans == ",".join(f"{n}:{a}:{e}" for a, _, e, n in spans)


def test_mix_meets_targets(spark):
    r = random.Random(1)
    rows = [(k, " ".join("w" * r.randrange(1, 200)), "abc"[k % 3]) for k in range(900)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * g.target.iloc[0]
    assert (got.copies <= 3).all() and (got.taken == got.copies * got["size"]).all()


@pytest.mark.skipif(not glob.glob(f"{SF}/documents*"), reason="needs the test tables")
def test_toxicity_on_held_out_rows(spark):
    r = random.Random(7)
    rows, labels = [], []
    for k in range(900):
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(30, 90))]
        y = int(r.random() < 0.3)
        if y:
            w[r.randrange(len(w))] = r.choice(["vile", "scumbag", "vequ" + r.choice("abcdef")])
        rows.append((k, " ".join(w), "en"))
        labels.append((k, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = dict(labels)
    got = [x for x in toxicity.toxicity_scores(docs, m).collect() if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == want[x.doc_id] for x in got) >= 0.95 * len(got)

"""Toxicity, sharding, mixing, archives and containment against plain versions of the same rules."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from corpuscle.llm import decontaminate, mixing, quality, sharding, storage, toxicity, warc
from corpuscle.llm.textcore import U, words


def plain_logit(m, text):
    """A text's logit by the definition: all filters over all positions of the padded text, the largest output of each."""
    (_, _, h, _, p), *_ = list(words(pa.array([text]), lower=True, prefix=toxicity.HEAD_BYTES)) or [(0, 0, np.zeros(0, U), 0, np.zeros(0, U))]
    pad = [np.zeros(toxicity.DIM, np.float32)] * toxicity._PAD
    x = [m.word[int(a >> U(64 - toxicity.WORD_BITS)) | 1] + m.head[int(b >> U(64 - toxicity.HEAD_BITS)) | 1] for a, b in zip(h, p)] + pad
    pooled, col = [], 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            weights = [m.filters[:, col + k * toxicity.FILTERS + f] for k in range(width)]
            fits = range(len(x) - width + 1)  # no word, no place for the widest
            pooled.append(max((sum(float(x[i + k] @ weights[k]) for k in range(width)) for i in fits), default=-np.inf))
        col += width * toxicity.FILTERS
    hidden = np.maximum(np.array(pooled) + m.shift, 0)
    return float(hidden @ m.out + m.bias)


def test_pooling_over_slices_equals_the_definition(monkeypatch):
    r, m = random.Random(4), toxicity.ToxicityModel.fresh(7)
    texts = ["", None, "one", "one two", *(" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(1, 120))) for _ in range(40))]
    want = [plain_logit(m, t) for t in texts]
    for size in (7, 16, 64, toxicity._SLICE):
        monkeypatch.setattr(toxicity, "_SLICE", size)
        got = np.concatenate([m.logits(w, h, o) for _, _, w, h, o in toxicity._encode(pa.array(texts))])
        assert np.allclose(got, want, atol=1e-4), size


def test_a_fit_on_repeated_ids_is_the_same_again(spark):
    r = random.Random(2)
    rows = [(k % 150, " ".join(f"w{r.randrange(50)}" for _ in range(30)) + (" vile" if k % 3 == 0 else ""), "en") for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int")
    fits = [toxicity.fit(spark.createDataFrame(x, "doc_id long, text string, lang string"), labels) for x in (rows, rows[::-1])]
    assert (fits[0].word == fits[1].word).all() and fits[0].bias == fits[1].bias


def sharded(spark, rows, **how):
    return sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), **how)


def test_shards_are_even_and_cut_few_links(spark):
    """Sizes and CRCs by zlib, loads and cut links counted plainly."""
    r = random.Random(6)
    base = [" ".join(f"g{g}w{k}" for k in range(r.randrange(5, 60))) for g in range(120)]
    rows = [(k, base[r.randrange(120)] if k % 2 else f"own {k} " + "x" * r.randrange(300)) for k in range(4000)]
    out = sharded(spark, rows)
    got = out.collect()
    texts = dict(rows)
    assert all(x["size"] == len(texts[x.doc_id].encode()) + 16 and x.text_crc32 == zlib.crc32(texts[x.doc_id].encode()) and x.law == "bytes" and x.grown_shard is None for x in got)
    load = collections.Counter()
    for x in got:
        load[x.shard] += x["size"]
    mean = sum(load.values()) / 40
    assert set(load) == set(range(40)) and max(load.values()) < 1.02 * mean and min(load.values()) > 0.98 * mean
    groups = collections.defaultdict(list)
    for x in got:
        groups[texts[x.doc_id]].append(x.shard)
    links = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    cut = links - sum(n * (n - 1) // 2 for g in groups.values() for n in collections.Counter(g).values())
    assert tuple(sharding.cut_links(out).first()) == (links, cut)
    # by chance 39 of 40 links would be cut
    assert cut < 0.02 * links, cut / links
    assert tuple(sharding.cut_links(sharded(spark, rows, rounds=0)).first())[1] > 0.9 * links


def test_mix_of_equal_ids_and_rows(spark):
    """Neither equal ids nor equal rows move as one block."""
    text = " ".join(["w"] * 100)
    for first, second in (("a", "b"), ("b", "a")):
        rows = [(None, text, first)] * 200 + [(k, text, second) for k in range(200)]
        got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
        for _, g in got.groupby("target"):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 50
        assert len(got) == 400 and (got.taken <= 300).all()


def test_mix_on_few_documents_of_uneven_size(spark):
    r = random.Random(12)
    rows = [(k, " ".join(["w"] * int(10 ** r.uniform(0.5, 3))), "abcdef"[k % 6]) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(df).toPandas()
    for (_, target), g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= max(1e-3 * target, g[g.copies < 3]["size"].min() / 2 + 1)
    assert mixing.take_copies(df).count() == got.copies.sum()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, mixing.mix_documents(df.repartition(7)).toPandas().values.tolist()))


def test_rates_that_do_not_settle_raise(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(mixing, "NEWTON_STEPS", 1)
    rows = [(k, " ".join(["w"] * (k + 1)), "ab"[k % 2]) for k in range(40)]
    with pytest.raises(RuntimeError):
        mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_archives_of_repeated_ids(spark, tmp_path):
    a, b = "<p>" + "a" * 358, "b" * 364
    rows = [(9, "u", a), (9, "u", b), (10, "v", a), (11, None, b), (9, "u", a), (9, "w", a), (None, "q", a), (None, "q", a)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS digest", "2 AS copy")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive_round_trip(df, segment=100).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((i or 0, len(t), sha(t), "response" if i == 9 else "revisit", 0 if i == 9 else 9) for i, _, t in rows)
    # what a revisit names is a record of the archive
    warc.write_archives(df, str(tmp_path / "w"), segment=100)
    import glob
    import gzip

    fields = [f for p in glob.glob(str(tmp_path / "w" / "part-*")) for f, _ in warc.parse(gzip.open(p).read())]
    ids = collections.Counter(f["warc-record-id"] for f in fields)
    assert max(ids.values()) == 1 and all(f["warc-refers-to"] in ids for f in fields if f["warc-type"] == "revisit")


def test_text_ids_come_back_as_they_were(spark):
    rows = [("", "u", "x" * 200), (" a ", "u", "x" * 200), ("é%/\r\nB: c", "u", "y"), (None, "u", "z")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {r.page_id for r in got} == {i for i, _, _ in rows} and {r.refers_to for r in got} == {None, ""}


def test_items_of_every_size_are_found():
    """Items of 1 to 300 shingles, whole and at a containment of 0.8, anywhere in longer texts."""
    r = random.Random(21)
    sizes = [1, 2, 5, 7, 8, 9, 12, 16, 17, 24, 32, 33, 50, 64, 65, 100, 128, 129, 200, 300]
    items = [" ".join(f"i{k}w{j}" for j in range(n + 4)) for k, n in enumerate(sizes * 20)]
    whole = [" ".join([*(f"a{k}b{j}" for j in range(r.randrange(900))), x, *(f"c{k}d{j}" for j in range(r.randrange(900)))]) for k, x in enumerate(items)]
    index = decontaminate.ItemIndex(list(range(len(items))), items, 0.8, 5)
    assert sorted((i, k) for i, k, _ in index.matches(pa.array(whole, pa.large_string()))) == [(k, k) for k in range(len(items))]
    parts = []
    for k, x in enumerate(items):
        w = x.split(" ")
        parts.append(" ".join([*(f"a{k}b{j}" for j in range(r.randrange(300))), *w[: -(-(len(w) - 4) * 4 // 5) + 4], *(f"c{k}d{j}" for j in range(r.randrange(300)))]))
    assert sorted((i, k) for i, k, _ in index.matches(pa.array(parts, pa.large_string()))) == [(k, k) for k in range(len(items))]


def test_the_order_of_rules_changes_no_verdict(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choices(["word", "WORD", "a", "#", "!", "!!!", "x" * 40, "12"], k=r.randrange(60)))) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ways = [{x.doc_id: x.kept for x in quality.quality_verdicts(df, rules=rules).collect()} for rules in (quality.RULES, quality.RULES[::-1])]
    assert ways[0] == ways[1] and 0 < sum(ways[0].values()) < 500
    assert set(quality.order_rules(df, sample=50)) == set(quality.RULES)


def test_release_deletes_the_scratch_tables(spark, tmp_path):
    import os

    kept = storage.Scratch(spark, "gone").keep(spark.range(3), "x")
    at = kept._corpuscle_path.removeprefix("file:")
    at = "/" + at.lstrip("/")
    assert kept.count() == 3 and os.path.isdir(at)
    assert storage.release(spark) >= 1 and not os.path.exists(at)

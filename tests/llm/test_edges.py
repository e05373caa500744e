"""Empty tables, nulls, empty and long texts, ties, repeated rows and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, line_dedup, mixing, near_dedup, pii, quality, sharding, token_counts, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, id string, score double"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
BASE = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, BASE, "en", "a", 1, 9, "t", "i", 0.5),
    (2, BASE, "en", "a", 1, 9, "t", "i", 0.5),
    (2, BASE, "en", "a", 1, 9, "t", "i", 0.5),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "de", "b", 0, 1, "t", "i", 0.1),
    (5, " \n\t ", "de", "b", 0, 1, "t", "i", 0.1),
    (6, LONG, "fr", "b", 0, 1, "t", "i", 0.1),
    (None, BASE + " more", None, "c", 0, 1, "t", "i", 0.1),
    (7, "é😀 ok", "xx", "", 0, 1, "t", "i", 0.1),
    (8, "x" * 300_000, "xx", "c", 0, 1, "t", "i", 0.1),
]
LABELS = "doc_id long, toxic int"
ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(docs, none, bpe):
    got = token_counts.token_counts(docs, bpe).collect()
    assert len(got) == len(ROWS) and token_counts.token_counts(none, bpe).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[3].n_bytes, by[3].n_tokens, by[3].over_limit) == (0, 0, False) and by[4].n_tokens == 0
    assert by[6].over_limit and by[8].n_bytes == 300_000


def test_quality(docs, none):
    by = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert by[3].base_failed and not by[3].kept and by[1].kept and by[6].n_repeat_words == 60_000
    assert quality.quality_verdicts(none).count() == 0


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and near_dedup.near_duplicates(none).count() == 0
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept and by[1].n_shingles == 56
    assert by[None].component_id is None and by[None].kept
    assert all(by[k].kept and by[k].n_shingles == 0 for k in (3, 4, 5))
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8]


def test_equal_ids_with_other_texts_are_one_document(spark):
    other = " ".join(f"other{k}" for k in range(60))
    df = spark.createDataFrame([(5, BASE), (5, other), (9, other), (3, BASE)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {5: 3, 9: 3, 3: 3}


def test_line_dedup(docs, none, spark):
    assert line_dedup.dedup_lines(none).count() == 0
    by = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert by[3].text is None and by[4].text == "" and by[1].text == BASE and by[2].text == "" and by[2].n_deleted == 1
    assert by[6].text == LONG and by[5].n_lines == 0
    run = ["one " * 20, "two " * 20, "three " * 20]
    df = spark.createDataFrame([(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", run[0], "", *run[1:], "d"])), (3, "\n".join(["one " * 20, "two " * 20]))], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup_lines(df).collect()}
    assert got[1][1] == 0 and got[2] == ("c\n\nd", 3) and got[3][1] == 0  # 40 words are too few


def test_contained_items(docs, none, spark):
    items = spark.createDataFrame([(1, BASE[: len(BASE) // 2]), (2, None), (3, ""), (4, "é😀 OK"), (4, "é😀 OK"), (9, " ".join(f"w{k % 977}" for k in range(400, 430)))], ITEMS)
    got = sorted({(r.doc_id or 0, r.item_id) for r in decontaminate.contained_items(docs, items).collect()})
    assert got == [(0, 1), (1, 1), (2, 1), (6, 9), (7, 4)]
    assert decontaminate.contained_items(none, items).count() == 0
    assert decontaminate.contained_items(docs, spark.createDataFrame([], ITEMS)).count() == 0
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 8]


def test_blocks_of_items_do_not_change_the_result(docs, spark, monkeypatch):
    items = spark.createDataFrame([(1, BASE), (2, LONG[:500])], ITEMS)
    one = sorted(map(tuple, decontaminate.contained_items(docs, items).na.fill(0).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    assert sorted(map(tuple, decontaminate.contained_items(docs, items).na.fill(0).collect())) == one


def test_mixing(docs, none):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix_documents(none).count() == 0 and mixing.take_copies(none).count() == 0
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.take_copies(docs).columns == docs.columns and mixing.take_copies(docs).count() == sum(r.copies for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs).collect()))


def test_targets():
    assert mixing.targets({"a": 10, "b": 10, None: 10}) == {"a": 18.75, "b": 7.5, None: 3.75}
    assert mixing.targets({"a": 1, "b": 100}) == {"a": 3.0, "b": 98.0}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, n_shards=4).collect()
    assert len(got) == len(ROWS) and sharding.shard_documents(none).count() == 0
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by = {r.doc_id: r for r in got}
    assert by[3]["size"] == 16 and by[3].text_crc32 == 0 and by[7]["size"] == len("é😀 ok".encode()) + 16


def test_hot_group_is_spread_and_even(spark):
    rows = [(k, BASE if k % 3 == 0 else f"{BASE} {k}") for k in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 40 and total.max() < 1.05 * total.mean() and total.min() > 0.95 * total.mean()
    hot = got[got.doc_id % 3 == 0].groupby("shard").size()
    assert len(hot) < 40  # gathered on some shards, not dealt out over all


def test_pii(docs, none):
    by = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert by[3].spans == "" and by[3].base_sha256 == hashlib.sha256(b"").hexdigest() and by[4].n_email == 0
    assert pii.find_pii(none).count() == 0


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (6, 0), (None, 1)], LABELS)
    m = toxicity.fit(docs, labels)
    got = toxicity.toxicity_scores(docs, m).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity_scores(none, m).count() == 0
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, spark.createDataFrame([], LABELS))).count() == len(ROWS)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1


def test_warc(spark):
    big = "<p>é</p>" * 40_000
    fake = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", fake), (8, "u", fake), (9, "u", big + "1"), (9, "u", big + "2"), (None, "u", big + "3")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment=1000)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i or 0, len((t or "").encode()), sha(t), *(("revisit", {2: 1, 8: 7}[i]) if i in (2, 8) else ("response", None))) for i, _, t in rows]
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_segments_fail():
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    assert warc.unchunked(warc.chunked(b"x" * 20_000)) == b"x" * 20_000


def test_columns_of_other_names(docs):
    other = docs.select(F.col("doc_id").alias("rate"), F.col("text").alias("copies"), F.col("source").alias("cut"), F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    assert mixing.take_copies(other, id_col="rate", text_col="copies", source_col="cut").columns == other.columns
    assert near_dedup.near_duplicates(other, id_col="rate", text_col="copies").count() == len(ROWS)
    assert line_dedup.dedup_lines(other, id_col="rate", text_col="copies").count() == len(ROWS)

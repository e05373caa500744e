"""The corpus pipeline: every stage on its own input, against its operator's rules applied plainly."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import mixing, toxicity

from .test_against_brute_force import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Copies, near copies, test items inside texts, toxic texts, and rows with nulls and no text."""
    r, at = random.Random(3), str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    items = [" ".join(f"item{k}x{j}" for j in range(12 + k)) for k in range(4)]
    for k in range(700):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 90))]
        toxic = k % 7 == 3
        if toxic:
            w[r.randrange(len(w))] = r.choice(["vile", "scumbag"])
        if k % 50 == 5:
            w[4:4] = items[k // 50 % 4].split(" ")
        rows.append((k, " ".join(w), "en" if k % 3 else "de", f"s{k % 4}", 0))
        labels.append((k, int(toxic)))
    rows += [(1000 + k, rows[k][1], "en", "s1", 0) for k in range(40)]
    for k in range(40, 80):  # one word in the middle changed
        w = rows[k][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((1000 + k, " ".join(w), "en", "s2", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, " \n", "en", None, 0), (None, "no id " + rows[1][1], "en", "s3", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


@pytest.fixture(scope="module")
def tables(spark, corpus):
    """Each stage's input, the stages' names and the last result."""
    at, _ = corpus
    held = [spark.read.parquet(f"{at}/documents.parquet").toPandas()]
    schema = spark.read.parquet(f"{at}/documents.parquet").schema
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(f"{at}/stage-{k}.parquet") if k else spark.read.parquet(f"{at}/documents.parquet")
        out = stage(spark, docs, at)
        out.write.parquet(f"{at}/stage-{k + 1}.parquet")
        out = spark.read.parquet(f"{at}/stage-{k + 1}.parquet")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema]
        held.append(out.toPandas())
    return held


def ids(table):
    return sorted(-1 if x != x or x is None else int(x) for x in table.doc_id)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_toxicity_stage(spark, corpus, tables):
    at, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))).filter("not flagged")
    assert ids(scores.toPandas()) == ids(tables[1])
    left = set(ids(tables[1]))
    assert sum(k in left for k in range(700) if k % 7 != 3) >= 0.98 * 600 and sum(k in left for k in range(700) if k % 7 == 3) <= 10


def test_near_dedup_stage(tables):
    """One document of each component at 0.80, by all pairs."""
    rows = [(i, shingle_set(t)) for i, t in zip(tables[1].doc_id, tables[1].text)]
    up = {k: k for k in range(len(rows))}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, (i, s) in enumerate(rows):
        for b in range(a):
            j, t = rows[b]
            if i == i and j == j and s and t and len(s & t) * 100 >= 80 * len(s | t):
                up[top(a)] = top(b)
    best = {}
    for k, (i, s) in enumerate(rows):
        g = top(k) if i == i and s else ("own", k)
        best[g] = min(best.get(g, i), i) if i == i else i
    assert ids(tables[2]) == sorted(-1 if i != i else int(i) for i in best.values())


def test_decontamination_stage(corpus, tables):
    _, items = corpus
    sets = [shingle_set(x) for x in items]
    clean = tables[2][[not any(5 * len(shingle_set(t) & s) >= 4 * len(s) for s in sets) for t in tables[2].text]]
    assert ids(clean) == ids(tables[3]) and len(tables[3]) < len(tables[2])


def test_mixing_stage(spark, corpus, tables):
    at, _ = corpus
    before = spark.read.parquet(f"{at}/stage-3.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(before).collect()}
    assert ids(tables[4]) == sorted(-1 if i is None else i for i, n in copies.items() for _ in range(n))
    n_words = lambda t: len((t or "").split())
    size = {s: sum(n_words(t) for t, q in zip(tables[3].text, tables[3].source) if q == s) for s in set(tables[3].source)}
    want = mixing.targets(size)
    for s in size:
        taken = sum(n_words(t) for t, q in zip(tables[4].text, tables[4].source) if q == s)
        assert abs(taken - want[s]) <= max(0.01 * want[s], 60)


def test_sharding_stage(tables):
    out = tables[5]
    assert len(out) == len(tables[4])
    load = out.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.1 * load.mean() + out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_run_applies_the_stages(spark, corpus, tables):
    got = corpus_pipeline.run(spark, corpus[0]).agg(F.count("*"), F.sum("size")).first()
    assert tuple(got) == (len(tables[5]), tables[5]["size"].sum())


def test_run_leaves_the_last_stages_tables_alone(spark, corpus):
    from corpuscle.llm.storage import opened, release

    before = opened()
    rows = corpus_pipeline.run(spark, corpus[0])
    assert rows.count() > 0
    left = [s for s in opened() if s not in before]
    assert {s.root.rsplit("/", 1)[1].split("-")[0] for s in left} == {"pipeline", "shard"}
    stages = next(s for s in left if "pipeline" in s.root.rsplit("/", 1)[1])
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stages.root)
    held = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)
    assert [p.getPath().getName().split("-")[-1] for p in held] == ["mixing"]
    release(spark, but=before)

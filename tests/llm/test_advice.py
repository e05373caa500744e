"""Cases in which an operator once did less than the whole job."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa

from corpuscle.llm import decontaminate, line_dedup, near_dedup, toxicity


def test_near_dedup_stage_links_at_080(spark):
    """Two texts of similarity 0.82 (50 shingles each, 45 shared): op9's 0.85 parts them, the stage does not."""
    a = [f"w{k}" for k in range(54)]
    b = [*a[:49], *(f"x{k}" for k in range(5))]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline._near_dedup(spark, df, "").collect()] == [1]
    assert near_dedup.near_duplicates(df, threshold=85).filter("kept").count() == 2


def test_sketch_margin_follows_the_threshold():
    assert near_dedup._most_bits(near_dedup._least_estimate(85)) == near_dedup._most_bits(0.65)
    for t in (80, 85):
        below = t / 100 - near_dedup._least_estimate(t)
        assert below >= 5 * np.sqrt(t * (100 - t) / 1e4 / near_dedup.SAMPLES)


def repeated_lines(texts, min_words=50):
    """By the definition: lines of runs of min_words words that an earlier place has too."""
    seen, gone = set(), {k: set() for k in texts}
    for k in sorted(texts):
        lines = texts[k].split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(len(x.split()) for x in lines[i : j + 1]) >= min_words:
                    run = tuple(lines[i : j + 1])
                    if run in seen:
                        gone[k] |= set(range(i, j + 1))
                    seen.add(run)
    return {k: len(v) for k, v in gone.items()}


def test_the_end_of_a_repeated_run_goes_too(spark):
    """A shared line of 60 words, then a shared one of 10; and random runs against the definition."""
    r = random.Random(11)
    pool = [" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate([60, 10, 3, 25, 30, 48, 1, 1, 70, 5])]
    texts = {1: f"a\n{pool[0]}\n{pool[1]}\nb", 2: f"c\n{pool[0]}\n{pool[1]}\nd"}
    for k in range(3, 120):
        at = r.randrange(len(pool))
        run = [(pool * 2)[at + j] for j in range(r.randrange(1, 9))]
        texts[k] = "\n".join([f"own{k}", *run, *r.choices(pool, k=2), f"end{k}"])
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.n_deleted for x in line_dedup.dedup_lines(df).collect()}
    assert got[2] == 2 and got == repeated_lines(texts)


def test_thresholds_count_all_labelled_rows(spark, monkeypatch):
    """A sample of 60 rows only: every other labelled row outside the held-out fifth is counted, in each language."""
    r, rows, labels = random.Random(9), [], []
    for k in range(900):
        y = int(r.random() < 0.2)
        w = [f"w{r.randrange(200)}" for _ in range(40)] + ["vile"] * y
        rows.append((k, " ".join(w), "es" if k % 3 == 0 else "en"))
        labels.append((k, y))
    seen, plain = [], toxicity._best_cut
    monkeypatch.setattr(toxicity, "_best_cut", lambda s, c, t, f: seen.append((c.sum(), t.sum())) or plain(s, c, t, f))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=60)
    used = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    assert seen[0] == (sum(not y for _, y in used) - 30, sum(y for _, y in used) - 30)
    assert seen[1][0] + seen[2][0] == seen[0][0] and seen[1][1] + seen[2][1] == seen[0][1]
    assert sorted(m.thresholds) == ["en", "es"] and seen[2][1] >= 10


def test_short_items_are_never_missed():
    """Items of five to eleven words, each in one of 3,000 texts among the first 16 shingles."""
    r = random.Random(10)
    items = [" ".join(f"i{k}w{j}" for j in range(5 + k % 7)) for k in range(3000)]
    texts = [" ".join([f"a{k}b{j}" for j in range(r.randrange(10))] + [x] + [f"c{k}d{j}" for j in range(60)]) for k, x in enumerate(items)]
    index = decontaminate.ItemIndex(list(range(3000)), items, 0.8, 5)
    got = sorted((i, k) for i, k, _ in index.matches(pa.array(texts, pa.large_string())))
    assert got == [(k, k) for k in range(3000)]

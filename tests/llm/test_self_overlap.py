import random

from corpuscle.llm.line_dedup import dedup_lines


def _kept(docs, least):
    """By the definition: every run of consecutive lines of `least` words or more that is the shortest from its first or up to its last line."""
    lines = {d: [x for x in t.split("\n") if x.split()] for d, t in docs.items()}
    members = {}
    for d, ls in lines.items():
        n = [len(x.split()) for x in ls]
        spans = set()
        for i in range(len(ls)):
            e = next((j for j in range(i, len(ls)) if sum(n[i : j + 1]) >= least), None)
            b = next((j for j in range(i, -1, -1) if sum(n[j : i + 1]) >= least), None)
            spans |= {(i, e)} if e is not None else set()
            spans |= {(b, i)} if b is not None else set()
        for a, e in spans:
            members.setdefault(tuple(ls[a : e + 1]), []).append((d, a, e))
    gone = set()
    for run in members.values():
        (fd, _, fe), *later = sorted(run)
        gone |= {(d, k) for d, a, e in later for k in range(a, e + 1) if d != fd or k > fe}
    return {d: "\n".join(x for k, x in enumerate(ls) if (d, k) not in gone) for d, ls in lines.items()}


def test_periodic_documents_keep_their_first_run(spark):
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    a, b, c = line("a", 25), line("b", 20), line("c", 60)
    docs = {1: [a] * 4, 2: [b, a] * 5, 3: [c] * 3, 4: ["x", a, a, "y", a, a], 5: [line("e", 1)] * 120, 6: [line("f", 49)] * 2}
    rng = random.Random(4)
    docs |= {10 + k: [rng.choice([a, b, line("g", 10), line("h", 5)]) for _ in range(rng.randint(1, 25))] for k in range(25)}
    docs = {d: "\n".join(ls) for d, ls in docs.items()}
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == _kept(docs, 50)
    assert got[1] == f"{a}\n{a}" and got[3] == c and len(got[5].split()) == 50 and got[6] == docs[6]

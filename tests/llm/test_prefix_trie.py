import hashlib
import random
import zlib
from collections import defaultdict

from corpuscle.llm import prefix_trie
from corpuscle.llm.prefix_trie import conversation_trie, shared_start_trie

SCHEMA = "conv_id long, turn long, role string, text string, digest string"


def _turns(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[c].append(((turn is not None, turn or 0, tie), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in by.items()}


def _shared(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def _trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, m in members.items():
        listed = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], listed))
    return sorted(rows, key=str)


def _rows(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in [*range(0, n), *range(250, 280), -5, -105, 5000, 99_999]:
        if rng.random() < 0.1:
            continue
        for turn in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok 🙂", None, "", "long " * 9])))
    return rows + rows[:7] + [(None, 1, "user", "x")]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "d") for r in rows], SCHEMA).repartition(5)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = _rows(seed)
        assert _got(shared_start_trie(_frame(spark, rows))) == _trie(_shared(_turns(rows)))
    assert _got(conversation_trie(_frame(spark, _rows(3)))) == _trie(_turns(_rows(3)))


def test_long_conversations_share_segments(spark, monkeypatch):
    rows = []
    for c, n in {1: 64, 2: 65, 3: 70, 4: 70, 101: 31, 102: 32, 103: 33, 200: 300, 201: 300, 202: 299}.items():
        rows += [(c, t, "user", "same" if t % 7 or c < 200 else "other") for t in range(n)]
    rows += [(4, 65, "user", "more")]
    want = _trie(_turns(rows))
    assert _got(conversation_trie(_frame(spark, rows))) == want
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)  # four levels of segments
    assert _got(conversation_trie(_frame(spark, rows))) == want


def test_copies_are_listed_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_BLOCK", 3)
    rows = [(c, t, "user", "same") for c in range(100) for t in range(2)]
    assert _got(conversation_trie(_frame(spark, rows))) == _trie(_turns(rows))


def test_turnless_and_empty(spark):
    # 107 keeps no turn of its own: its base is absent and it has one turn
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(short, 0, "user", "gone"), (300, 0, "user", "x")]
    assert _got(shared_start_trie(_frame(spark, rows))) == _trie(_shared(_turns(rows)))
    assert _got(shared_start_trie(_frame(spark, rows).limit(0))) == []
    assert _got(shared_start_trie(_frame(spark, rows[:1]))) == _trie(_shared(_turns(rows[:1])))

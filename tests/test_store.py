import pytest

from corpuscle.functions import text as T
from corpuscle.sources.store import Conflict, Folder, Sessions, Table, Uploads


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_table_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], "k int, v string")
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v string, extra int")
    assert _rows(t.read()) == []
    assert t.append(make((1, "a", 0), (2, "b", 0))) == 1
    t.append(make((1, "c", 0)))
    before = t.read()
    assert _rows(before) == [(1, "a"), (1, "c"), (2, "b")]
    t.overwrite(make((1, "d", 0), (3, "e", 0)))
    assert _rows(t.read()) == [(1, "d"), (2, "b"), (3, "e")] and _rows(before) == [(1, "a"), (1, "c"), (2, "b")]
    t.overwrite(make((None, "n", 0)))
    t.overwrite(make((None, "m", 0)))
    t.delete(spark.createDataFrame([(2,)], "k int"))
    t.append(make((2, "z", 0)))
    want = {(1, "d"), (3, "e"), (None, "m"), (2, "z")}
    assert {tuple(r) for r in t.read().collect()} == want
    t.compact()
    assert {tuple(r) for r in t.read().collect()} == want and len(t.versions()) == 1
    t.overwrite(make((3, "f", 0)))
    assert {tuple(r) for r in t.read().collect()} == want - {(3, "e")} | {(3, "f")}
    assert sorted(n for n in Folder(spark, f"file://{tmp_path}/t").names("") if n.startswith("data")) == sorted(e["data"] for e in t.versions())


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], "k int")
    one = spark.createDataFrame([(1,)], "k int")
    t.append(one)
    stale = t.versions()
    t.append(one)
    monkeypatch.setattr(t, "versions", lambda: stale)
    with pytest.raises(Conflict):
        t.append(one)
    monkeypatch.undo()
    assert t.read().count() == 2 and sum(n.startswith("data") for n in t.folder.names("")) == 2


def test_ingest_twice(spark, tmp_path):
    up = Uploads(spark, f"file://{tmp_path}/up")
    cols = "folder_id string, path string, size bigint, content string, display_name string, uploaded_at string, raw binary"
    mb = 1024 * 1024
    first = [
        ("f1", "a.py", 10, "one", "First", "2024-01-01", b"abcd"), ("f1", "b.py", 2 * mb, "two", "First", "2024-01-01", b""), ("f1", "bin/x.py", 1, "", None, "2024-01-01", b""),
        ("f1", "run.py", 4, "", None, "2024-01-01", b"MZ\x00\x00"), ("f1", "huge.py", 30 * mb, "", None, "2024-01-01", b""), ("../f", "a.py", 1, "", None, "2024-01-01", b""), ("f2", "a.py", 9 * mb, "", None, "2024-01-01", b""),
    ]
    got = _rows(up.ingest(spark.createDataFrame(first, cols), quota_mb=5))
    assert got == [("../f", 0, 1, 0, False), ("f1", 2, 3, 10 + 2 * mb, True), ("f2", 0, 0, 0, False)]
    second = [("f1", "b.py", 20, "three", None, "2024-02-02", b""), ("f1", "c.py", 30, "four", None, "2024-02-02", b""), ("f1", "c.py", 30, "four", None, "2024-02-02", b"")]
    assert _rows(up.ingest(spark.createDataFrame(second, cols), quota_mb=5)) == [("f1", 2, 0, 50, True)]
    assert _rows(up.files.read().select("folder_id", "path", "content")) == [("f1", "a.py", "one"), ("f1", "b.py", "three"), ("f1", "c.py", "four")]
    (folder,) = up.folders.read().collect()
    assert (folder.folder_id, folder.file_count, folder.size_mb) == ("f1", 3, 0.0)
    assert '"displayName":"First"' in folder.meta and '"createdAt":"2024-01-01' in folder.meta


def test_sessions(spark, tmp_path):
    s = Sessions(spark, f"file://{tmp_path}/s")
    turn = lambda *rows: spark.createDataFrame([(*r, False) for r in rows], "session_id string, seq bigint, role string, content string, is_summary boolean")
    s.append(turn(("a", 1, "user", "q1"), ("a", 2, "assistant", "r1"), ("b", 7, "user", "x")))
    s.append(turn(("a", 1, "user", "q2"), ("c", 1, "user", "y")))
    assert _rows(s.turns().select("session_id", "seq", "content")) == [("a", 1, "q1"), ("a", 2, "r1"), ("a", 3, "q2"), ("b", 1, "x"), ("c", 1, "y")]
    s.replace(turn(("a", 1, "system", "summary")))
    s.clear("b")
    s.append(turn(("a", 5, "user", "q3"), ("b", 1, "user", "again")))
    assert _rows(s.turns().select("session_id", "seq", "content")) == [("a", 1, "summary"), ("a", 2, "q3"), ("b", 1, "again"), ("c", 1, "y")]


def test_malformed_xml_has_no_attributes(spark):
    good = '﻿<?xml version="1.0" encoding="utf-16"?><p:Project xmlns:p="u"><p:Ref Include="a &amp; b"/><Ref p:Include="no" Include="c"></Ref><Other Include="d"/></p:Project>'
    bad = ["<Project><A></B></Project>", '<P><Ref Include="a & b"/></P>', "<P><Ref x=1/></P>", '<Ref Include="a"/><Ref/>', "", "no xml", '<P><Ref Include="a"/></P> tail', '<!DOCTYPE r [<!ENTITY e "x">]><r>&f;</r>', "<P>\x00</P>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([good, *bad, None])], "k int, t string")
    got = {r.k: r.a for r in df.select("k", T.xml_attributes(df["t"], "Ref", "Include").alias("a")).collect()}
    assert got == {0: ["a & b", "c"], **{k: [] for k in range(1, len(bad) + 1)}, len(bad) + 1: None}

"""Rules that no other test held: listings, soft hints, groups of references, counts and orders."""

from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import accounting, references, search


def test_listings_of_twenty_and_thirty(spark):
    files = spark.createDataFrame([(f"a/F{k:02d}.py",) for k in range(25)] + [("a/b/c/d/deep.py",), ("top.py",)], "path string")
    for k in (20, 30):
        rows = search.tree(files, k=k, max_depth=3).collect()
        shown = [r for r in rows if r.dir == "a" and r.kind == "file"]
        assert len(shown) == min(k, 25) and {r.more for r in shown} == {max(25 - k, 0)}
        assert {(r.dir, r.name) for r in rows if r.kind == "dir"} == {("", "a"), ("a", "b"), ("a/b", "c")}
        assert not [r for r in rows if r.name == "deep.py"] and [r.name for r in rows if r.dir == "" and r.kind == "file"] == ["top.py"]


def test_identifiers_that_leave_their_folder(spark):
    df = spark.createDataFrame([("ok",), ("a..b",), ("a/b",), ("a\\b",), ("",)], "i string")
    assert [r.s for r in df.select(T.traversal_safe(F.col("i")).alias("s")).collect()] == [True, False, False, False, True]


def test_hints_apply_only_where_they_leave_any(spark):
    sy = spark.createDataFrame([("run", "a.py", "function", "def run(x)", 1), ("Run", "b.py", "function", "def Run(y)", 5)], "name string, path string, kind string, signature string, start_line int")
    names = lambda **how: [r.path for r in references.find_definitions(sy, "run", **how).collect()]
    assert names() == ["a.py", "b.py"] and names(hint="(Y)") == ["b.py"] and names(hint="nothing") == ["a.py", "b.py"]
    assert names(file="B.py") == ["b.py"] and names(file="c.py") == ["a.py", "b.py"]


def test_references_in_groups(spark):
    refs = spark.createDataFrame([("b.py", k, "call", "f") for k in range(15, 0, -1)] + [("A.py", 3, "import", "(global)")], "path string, line_no int, kind string, containing string")
    assert [(r.path, r.n, list(r.lines), r.more) for r in references.references_by_file(refs).collect()] == [("A.py", 1, [3], 0), ("b.py", 15, list(range(1, 13)), 3)]
    held = {r.path: r.refs for r in references.reference_index(refs).collect()}
    assert [x.line_no for x in held["b.py"]] == list(range(1, 16)) and held["A.py"][0].kind == "import"


def test_edges_in_groups_and_as_text(spark):
    rows = [(1, "main", "load", "a.py", 3, ""), (1, "Main", "LOAD", "a.py", 2, ""), (2, "load", "main", "a.py", 9, "cycle")]
    graph = spark.createDataFrame(rows, "depth int, src string, dst string, path string, line int, label string")
    got = {(r.dst, r.src, r.line, r.n) for r in references.callers(graph).collect()}
    assert got == {("LOAD", "Main", 2, 2), ("main", "load", 9, 1)}
    assert references.render_tree(graph.filter("line <> 2"), "main").split("\n") == ["main", "  load (line 3)", "    main (line 9) [cycle]"]


def test_mentions_folders_and_context(spark):
    df = spark.createDataFrame([("run rerun run_x (run) RUN",)], "t string")
    assert df.select(T.mention_count(F.col("t"), "run")).first()[0] == 2
    folders = spark.createDataFrame([("a", "2024-01-01"), ("b", None), ("c", "2024-02-01"), ("d", "2024-02-01")], "folder_id string, created_at string")
    assert [r.folder_id for r in accounting.folders_by_age(folders).collect()] == ["c", "d", "a", "b"]
    context = spark.createDataFrame([("f", "definition", "a.py", 1, "def f"), ("f", "caller", "b.py", 2, "g")], "name string, relation string, path string, line int, text string")
    assert references.context_text(context).first().text == "caller b.py:2 g\ndefinition a.py:1 def f"

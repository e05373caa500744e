from pyspark.sql import functions as F

from corpuscle.operators import accounting, modules, references, search, sessions, symbols
from corpuscle.plans import fixtures
from corpuscle.plans.registry import Corpus, call
from corpuscle.sources import files as source


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lines_of_mixed_ends(spark):
    df = spark.createDataFrame([("a", "x\r\ny\rz\n"), ("b", ""), ("c", None), ("d", "q")], "path string, content string")
    got = sorted(rows(search.explode_lines(df)))
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("d", 1, "q")]


def test_grep_takes_a_broken_pattern_literally(spark):
    df = spark.createDataFrame([("a", 1, "f(x"), ("a", 2, "fx")], "path string, line_no int, text string")
    assert rows(search.grep(df, "F(", order=[F.col("line_no")])) == [("a", 1, "f(x")]


def test_missing_parameter_is_a_value_error(spark):
    import pytest

    with pytest.raises(ValueError):
        call("grep_search", Corpus(fixtures.files(spark)))
    with pytest.raises(ValueError):
        call("nothing", Corpus(fixtures.files(spark)))


def test_tools_run(spark):
    c = Corpus(fixtures.files(spark))
    assert [r.path for r in call("GLOB_SEARCH", c, pattern="*.py").collect()] == sorted(fixtures.MINI)
    assert call("read_symbol", c, symbol="load").count() == 4
    assert call("list_directory", c).filter("kind = 'dir'").count() == 2
    assert call("grep_search", c, pattern="store", include="*.py").count() == 3
    assert call("find_definition", c, symbol="STORE").first().path == "core/store.py"
    assert call("read_file", c, file_path="app.py", offset=3, max_lines=2).count() == 2


def test_references_by_scope(spark):
    c = Corpus(fixtures.files(spark))
    assert call("find_references", c, symbol="load", scope="production").count() == 1
    assert call("find_references", c, symbol="load", scope="tests").count() == 2


def test_languages(spark):
    files = fixtures.files(spark, {
        "a.ts": "export class A {\n  run() {\n    go();\n  }\n}\nexport const f = (x) => x;\n",
        "b.go": "package b\nfunc (s *S) Run() {\n}\ntype S struct {\n}\n",
        "c.rs": "struct P {}\nimpl P {\n    pub fn new() -> P {\n    }\n}\n#[test]\nfn works() {}\n",
        "D.java": "public class D {\n  /* x */\n  @Test\n  public void runs() {\n  }\n}\n",
        "e.cpp": "namespace n {\nint add(int a) {\n  return a;\n}\n}\nTEST(A, b) {}\n",
    })
    got = {(r.path, r.name, r.kind, r.containing) for r in symbols.extract_symbols(files).collect()}
    assert {("a.ts", "A", "class", "(global)"), ("a.ts", "run", "method", "A"), ("a.ts", "f", "function", "(global)")} <= got
    assert {("b.go", "Run", "function", "(global)"), ("b.go", "S", "type", "(global)")} <= got
    assert {("c.rs", "P", "struct", "(global)"), ("c.rs", "new", "method", "P"), ("c.rs", "works", "function", "(global)")} <= got
    assert {("D.java", "D", "class", "(global)"), ("D.java", "runs", "method", "D")} <= got
    assert ("e.cpp", "n", "namespace", "(global)") in got
    cases = {(r.path, r.name) for r in symbols.extract_test_cases(files).collect()}
    assert cases == {("c.rs", "works"), ("D.java", "runs"), ("e.cpp", "A, b")}


def test_history_split(spark):
    for n, keep in ((1, 1), (2, 2), (3, 2), (11, 2), (16, 4), (30, 6)):
        t = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"))
        assert sessions.history_split(t).filter("part = 'keep'").count() == keep, n


def test_common_root_and_project(spark):
    one = spark.createDataFrame([("A/x",), ("a/y",)], "path string")
    assert accounting.common_root(one).first().root == "A"
    two = spark.createDataFrame([("A/x",), ("b",)], "path string")
    assert accounting.common_root(two).first().root is None
    f = spark.createDataFrame([("package.json", '{"dependencies": {"a": "1", "b": "2"}}'), ("go.mod", "module x")], "path string, content string")
    assert tuple(modules.project_type(f).first()) == ("package.json", "Node.js", ["a", "b"])


def test_repo_source(spark, tmp_path):
    for p, text in (("src/Foo.cs", "class Foo {}"), ("src/readme.md", "x"), ("node_modules/Excluded.js", "x"), (".env", "A=1"), ("__init__.py", ""), ("obj/A.GlobalUsings.g.cs", "x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    files = source.scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"src/Foo.cs", "src/readme.md", ".env", "__init__.py"}
    assert {r.path for r in source.supported(files).collect()} == {"src/Foo.cs", "__init__.py"}
    every = source.scan(spark, str(tmp_path), profile="none")
    assert {r.path for r in source.csharp(every).collect()} == {"src/Foo.cs", "obj/A.GlobalUsings.g.cs"}


def test_uploads(spark):
    f = spark.createDataFrame([("a.py", 10), ("../a.py", 10), ("x.exe", 10), ("big.py", 30 << 20), ("bin/a.py", 1), ("Dockerfile", 1)], "path string, size long")
    assert {r.path: r.reason for r in source.uploads(f).collect()} == {"a.py": None, "../a.py": "path", "x.exe": "type", "big.py": "size", "bin/a.py": "type", "Dockerfile": None}


def test_ambiguous_symbol(spark):
    s = symbols.extract_symbols(fixtures.files(spark, {"a.py": "def f(x):\n    pass\n", "b.py": "def f(y):\n    pass\n"}))
    assert references.resolve(s, "f").first().status == "ambiguous"
    assert references.resolve(s, "g").first().status == "missing"

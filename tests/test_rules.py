"""Rules of single operators on a few lines, each beside what it must give."""

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import accounting, config, modules, references, search, sessions, symbols
from corpuscle.plans import fixtures
from corpuscle.plans.registry import TOOLS, Corpus, call
from corpuscle.sources import files as source
from corpuscle.streaming import activity


def files(spark, content):
    return fixtures.files(spark, content)


def names(content, lang):
    return [d[0] for d in symbols.declarations(content, lang)]


@pytest.mark.parametrize("lang, line", [("typescript", 'const g = "src/**/*.ts";'), ("java", 'String g = "a/**/b";'), ("csharp", 'var g = "/**/*.cs";'), ("rust", 'let g = "a/**/*.rs";'), ("cpp", 'auto g = "/*";')])
def test_a_glob_in_a_string_opens_no_comment(lang, line):
    assert "Shown" in names(f"{line}\nclass Shown {{\n}}\n" if lang != "rust" else f"{line}\nstruct Shown {{\n}}\n", lang)


def test_comments_and_docstrings_hide_what_is_in_them():
    assert names("/*\nclass A {\n}\n*/\nclass B {\n}\n", "java") == ["B"]
    assert names('def f(): """one"""\nX = \'\'\'a\'\'\'\ndef g():\n    """\n    def h(): pass\n    """\n', "python") == ["f", "X", "g"]


def test_imports_stop_where_code_begins():
    assert symbols.import_lines("using A;\nusing static B;\n// c\nnamespace X;\nusing C;\n", "csharp") == [(1, "A")]
    assert symbols.import_lines("package p;\nimport a.B;\nclass X {}\nimport c.D;\n", "java") == [(2, "a.B")]
    assert symbols.import_lines('import (\n  "a/b"\n  x "c"\n)\nimport "d"\nvar s = "e"\n', "go") == [(2, "a/b"), (3, "c"), (5, "d")]
    assert symbols.import_lines("import a.b\nx = 1\nfrom c import d\n", "python") == [(1, "a.b"), (3, "c")]


@pytest.mark.parametrize("pattern, hits", [("lo+ad", 1), ("(?P<n>load)", 0), ("a{,3}load", 0), ("load(", 1)])
def test_patterns_that_java_refuses_are_taken_literally(spark, pattern, hits):
    df = spark.createDataFrame([("a", 1, "x = load(y)")], "path string, line_no int, text string")
    assert search.grep(df, pattern, order=[F.col("line_no")]).count() == hits


def test_calls_of_the_language_are_none(spark):
    c = Corpus(files(spark, {
        "a.py": "def f(x):\n    print(len(x))\n    os.path.join(x)\n    g(x)\n    g(x)\n",
        "b.go": 'package b\nfunc F() {\n  fmt.Println(G())\n  strings.Trim(G())\n  own.Run()\n}\n',
        "c.ts": "function f() {\n  String(x);\n  console.log(h());\n}\n",
    }))
    got = {(r.path, r.dst) for r in references.call_sites(c.lines, c.symbols).collect()}
    assert got == {("a.py", "join"), ("a.py", "g"), ("b.go", "G"), ("b.go", "Run"), ("c.ts", "h")}


def test_fifty_callees_a_declaration(spark):
    c = Corpus(files(spark, {"a.py": "def f():\n" + "".join(f"    g{k}()\n" for k in range(80))}))
    assert references.call_sites(c.lines, c.symbols).agg(F.max("seq")).first()[0] == 50


def test_dispatch_labels(spark):
    c = Corpus(files(spark, {"a.cs": "interface IRun\n{\n    void Go();\n}\nclass A\n{\n    public virtual void Walk()\n    {\n        Go();\n        Console.WriteLine(1);\n        missing();\n    }\n    void B()\n    {\n        Walk();\n    }\n}\n"}))
    assert {(r.dst, r.label) for r in references.call_edges(c.lines, c.symbols).collect()} == {("Go", "interface dispatch"), ("WriteLine", "external"), ("missing", "unresolved"), ("Walk", "virtual dispatch")}


def test_a_line_below_all_declarations_belongs_to_the_nearest(spark):
    c = Corpus(files(spark, {"a.py": "x()\ndef f():\n    pass\n\ny(1)\n"}))
    hits = spark.createDataFrame([("a.py", 1), ("a.py", 3), ("a.py", 5)], "path string, line_no int")
    assert {r.line_no: r.containing for r in references.enclosing(hits, c.symbols).collect()} == {1: "(global)", 3: "f", 5: "f"}


def test_tests_inside_sources_and_by_name(spark):
    c = Corpus(files(spark, {
        "src/lib.rs": "pub fn load(x: i32) -> i32 {\n    x\n}\n#[test]\nfn load_works() {\n    load(1);\n}\n",
        "tests/load_test.py": "# nothing of it\n",
        "src/Loader.cs": "class Loader\n{\n    public int load(int x)\n    {\n        return x;\n    }\n}\n",
    }))
    got = {r.path: r for r in call("find_tests", c, symbol="load", file_path="src/lib.rs").collect()}
    rust, named = got["src/lib.rs"], got["tests/load_test.py"]
    assert (rust.score, rust.framework, [tuple(x) for x in rust.cases]) == (16 + 35, "Rust test", [(5, "load_works", 55)])
    assert named.score == 20 and named.reasons == ["file name matches 'load'"] and named.confidence == "low"
    with pytest.raises(ValueError):
        call("find_tests", c)


def test_a_test_of_a_type_reaches_high(spark):
    c = Corpus(files(spark, {"store.py": "class Store:\n    def get(self):\n        return 1\n", "tests/test_store.py": "from store import Store\ndef test_store():\n    assert Store().get()\n    Store()\n"}))
    r = call("find_tests", c, symbol="Store", test_framework="unittest").first()
    # 20 for the file's name, 30 for six mentions (as name and as owner), 35 for the best case
    assert (r.path, r.score, r.confidence, r.framework) == ("tests/test_store.py", 85, "high", "unittest")
    assert call("find_tests", c, file_path="store.py").first().path == "tests/test_store.py"


def test_json_of_any_depth_and_number():
    deep = config.json_members('{"a":' * 40 + "1.0" + "}" * 40)
    assert len(deep) == 40 and deep[-1][2] == "1.0"
    assert config.json_members('{"x":1e3,"y":[1,{"z":0.10}]}') == [("x", "x", "1e3"), ("y", "y", "[2 items]"), ("y[1]:z", "z", "0.10")]
    assert config.json_members("{bad") is None and config.json_members('{"x":NaN}') is None


def test_configs_folder_comes_before_config(spark):
    f = files(spark, {"a.go": "package a\n", "config/x.yaml": "a: 1\n", "configs/y.yaml": "a: 2\n"})
    assert [r.path for r in config.config_files(f).collect()] == ["configs/y.yaml"]


def test_read_symbol_with_and_without_body_and_comments(spark):
    c = Corpus(files(spark, {"a.ts": "// about\nfunction f() {\n  g();\n}\n"}))
    lines = lambda **how: [r.line_no for r in call("read_symbol", c, symbol="f", **how).collect()]
    assert lines() == [1, 2, 3, 4] and lines(include_comments=False) == [2, 3, 4] and lines(include_body=False) == [1, 2]


def test_every_tool_and_a_question(spark):
    want = "grep_search read_file read_symbol list_directory glob_search get_file_outline find_definition find_references find_tests get_related_files repo_map call_graph config_lookup ask_user".split()
    assert set(want) <= set(TOOLS)
    r = call("ask_user", Corpus(files(spark, {"a.py": ""})), question="Which?", options=["a", "b"], asked_at="2024-01-01 00:00:00").first()
    assert (r.question, r.options, len(r.id)) == ("Which?", ["a", "b"], 32)


def test_references_by_file_glob_and_csharp_forms(spark):
    c = Corpus(files(spark, {"a.cs": "class Base\n{\n}\n", "b.cs": "[Base]\nclass B : Base\n{\n    public B(Base x)\n    {\n        var y = new Base();\n    }\n    Base z;\n}\n", "c.py": "Base()\n"}))
    got = {(r.path, r.line_no): r.kind for r in call("find_references", c, symbol="Base").collect()}
    assert got == {("b.cs", 1): "attribute", ("b.cs", 2): "inheritance", ("b.cs", 4): "constructor injection", ("b.cs", 6): "construction", ("b.cs", 8): "type reference", ("c.py", 1): "reference"}
    assert {r.path for r in call("find_references", c, symbol="Base", include="*.py").collect()} == {"c.py"}


def test_a_solution_with_projects_gives_modules(spark):
    f = files(spark, {"x.sln": "", "Web/Web.csproj": "<Project/>", "Web/Controllers/A.cs": "", "Data/Data.csproj": "<Project/>", "Data/B.cs": "", "tools/t.py": ""})
    assert {tuple(r) for r in call("repo_map", Corpus(f), include_dependencies=False).collect()} == {("Web", "Other", 1), ("Data", "Data Layer", 1)}


def test_repo_map_with_scope_and_dependencies(spark):
    f = files(spark, {"s/a/x.py": "import b.y\n", "s/b/y.py": "", "t/z.py": ""})
    got = {r.module: r.dependencies for r in call("repo_map", Corpus(f), scope="s").collect()}
    assert set(got) == {"a", "b"} and [tuple(d) for d in got["a"]] == [("b", 1)]


def test_projects_and_versions(spark):
    x = spark.createDataFrame([("a.csproj", '<p:Project xmlns:p="u"><p:PackageReference Include="xunit" Version="2.1"/></p:Project>'), ("b.csproj", "<Project><PackageReference Include='q'></Project>"), ("package.json", '{"dependencies": {"a": "^1"}}'), ("requirements.txt", "x==1\ny\n")], "path string, content string")
    got = x.select("path", modules.is_test_project(F.col("path"), F.col("content")).alias("t")).collect()
    assert {r.path for r in got if r.t} == {"a.csproj"}
    assert {(r.path, r.name, r.version) for r in modules.dependency_versions(x.filter("path not like '%csproj'")).collect()} == {("package.json", "a", "^1"), ("requirements.txt", "x", "==1"), ("requirements.txt", "y", None)}


def test_results_are_held_while_files_stay(spark):
    held, made = modules.Cached(), []
    f = spark.createDataFrame([("a", 1)], "path string, mtime int")
    make = lambda: made.append(1) or f.select("path")
    assert held.get("x", f, make).count() == 1 and held.get("x", f, make).count() == 1 and len(made) == 1
    held.get("x", f.withColumn("mtime", F.lit(2)), make)
    assert len(made) == 2


def test_plain_reader_and_upload_totals(spark):
    f = files(spark, {"a.py": "x\ny\nz\n", "b.png": "x", "c.py": "a\0b"})
    assert search.read_plain(f, "a.py", max_lines=2).first().content == "x\ny"
    assert search.read_plain(f, "b.png").first().content is None and search.read_plain(f, "c.py").first().content is None
    up = spark.createDataFrame([("a.py", 10), ("x.exe", 10)], "path string, size long")
    assert tuple(source.ingest(up, quota_mb=1.0).first()) == (1, 1, 10, True)


def test_folders_without_their_metadata_file(spark):
    f = spark.createDataFrame([("d", "d/a", 1 << 20), ("d", "d/.project-meta.json", 1 << 20)], "folder string, path string, size long")
    assert tuple(accounting.folder_totals(f, "folder", "size").first()) == ("d", 1, 1.0)


def test_compressed_history(spark):
    t = spark.createDataFrame([("s", k, "user", f"t{k}") for k in range(11)] + [("u", 0, "user", "x")], "session_id string, seq long, role string, content string")
    got = sessions.compressed(t, spark.createDataFrame([("s", "so far")], "session_id string, content string")).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.content, r.is_summary) for r in got] == [("s", 0, "so far", True), ("s", 9, "t9", False), ("s", 10, "t10", False), ("u", 0, "x", False)]


def test_call_durations_and_totals_of_a_stream(spark, tmp_path):
    rows = [("r", 1, "grep", k, f"2024-01-01 00:00:0{s}", d) for k, s, d in (("start", 0, None), ("end", 2, 2000))]
    at = str(tmp_path / "e")
    spark.createDataFrame(rows, "run_id string, call_idx int, tool_name string, kind string, ts string, duration_ms long").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(at)
    stream = lambda: spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    for name, df, mode, want in (("durations", activity.call_durations(stream()), "append", ("r", 1, "grep", 2000)), ("totals", activity.running_totals(stream()), "update", ("r", 1, 2000))):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()] == [want]


def test_rendering_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.detail_items(F.lit("a\n\n b \nc"), 2)) == ["a", "b"]
    assert one(T.distinct_in_order(F.array(F.lit("b"), F.lit("A"), F.lit("B")))) == ["b", "A"]
    assert one(T.preview(F.lit("x" * 600))) == "x" * 500 + "..." and len(one(T.new_id())) == 32


def test_one_folder_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(30):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / f"f{k}.py").write_text("x = 1\n")
    reader = source.RepoReader({"path": str(tmp_path)})
    monkeypatch.setattr(source, "BUNDLE", 1 << 18)
    parts = reader.partitions()
    assert len(parts) > 5 and sum(len(list(reader.read(p))) for p in parts) == 30

import pytest
from pyspark.sql import functions as F

from corpuscle.functions.lexer import FORMS, code_lines, masked
from corpuscle.operators import references, symbols
from corpuscle.operators.symbols import declarations
from corpuscle.plans.registry import Corpus

CASES = {
    "python": ('x = f("g(1) # no") # h(2)\ns = """\nk(3)\n"""\nm(\'\\\'n(4)\')\n', ["f", "m"]),
    "javascript": ("f('g(1)'); // h(2)\nlet t = `k(3)\n${m(4)}`; /* n(5)\n o(6) */ p(7);\n", ["f", "p"]),
    "java": ('f("g(1)"); /* h(2) */ k(3); char c = \'(\'; String s = """\n m(4)\n""";\nn(5);\n', ["f", "k", "n"]),
    "csharp": ('f(@"g(1)""h(2)"); k($"{m(3)}"); var s = """\n n(4)\n"""; o(5); // p(6)\n', ["f", "k", "o"]),
    "go": ("f(`g(1)\nh(2)`) ; k('\\'') // m(3)\nn(\"\\\"o(4)\")\n", ["f", "k", "n"]),
    "rust": ("f(r#\"g(1)\"h(2)\"#); let x: &'a str = k('('); m::<T>(\"\\\nn(3)\"); /* o(4) */\n", ["f", "k", "m"]),
    "cpp": ('f(R"x(g(1))" h(2))x"); int n = 1\'000; k(\'(\'); /* m(3)\n */ n("o(4)");\n', ["f", "k", "n"]),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_strings_and_comments_hold_no_calls(spark, lang):
    text, want = CASES[lang]
    code = masked(text, lang)
    assert len(code) == len(text) and [k for k, c in enumerate(code) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]
    line = spark.createDataFrame([(" ".join(code_lines(text, lang)),)], "t string")
    (row,) = line.select(references._calls(F.col("t"), F.lit(lang)).alias("c")).collect()
    assert [c.d for c in row.c if len(c.d) == 1] == want


def test_open_ends_and_lengths():
    for lang in FORMS:
        for text in ("/* (", '"abc(', "'", "`x(\n", '"""\n(', "#", "//", "", None, "é🙂 // ü(\n", '@"', 'R"(', 'r#"', "a'b"):
            assert len(masked(text, lang)) == len(text or "")
    long = '"' + "a(" * 200_000 + '" /*' + "*(" * 200_000 + "*/ f("
    assert masked(long, "java").strip().endswith("f(") and masked(long, "java").count("(") == 1


def _named(text, lang):
    return [(d[0], d[1], d[2], d[3], d[4]) for d in declarations(text, lang)]


def test_declarations_of_the_grammars():
    assert _named("func F[T any](x T) {\n}\nfunc (s *S) G() {\n}\n", "go") == [("F", "function", "(global)", 1, 2), ("G", "function", "(global)", 3, 4)]
    rust = "fn b<T>(x: T) {\n}\npub unsafe fn a() {\n}\npub(crate) const extern \"C\" fn c() {\n}\nimpl<T: Into<U>> fmt::Tr<T> for m::S<T> {\n    fn d<'a>(&self) {\n    }\n}\nimpl<T> Own<T> {\n    async fn e(&self) {\n    }\n}\n"
    assert [(n, k, c) for n, k, c, *_ in _named(rust, "rust")] == [("b", "function", "(global)"), ("a", "function", "(global)"), ("c", "function", "(global)"), ("d", "method", "S"), ("e", "method", "Own")]
    cpp = "class A {\n  int get() const { return f(1); }\n  ~A() noexcept;\n  bool operator==(const A& o) const;\n};\nint A::size() const {\n  return 1;\n}\nstd::vector<int> *make(int n)\n{\n}\n"
    assert [n for n, *_ in _named(cpp, "cpp")][:5] == ["A", "get", "~A", "operator==", "size"]
    js = "class A {\n  static async *walk<T>(x) {\n    if (x) {\n      f(x);\n    }\n  }\n  #own() {\n  }\n}\n"
    assert [(n, k) for n, k, *_ in _named(js, "typescript")] == [("A", "class"), ("walk", "method"), ("own", "method")]


def test_csharp_members():
    text = "namespace N;\npublic delegate int Op<T>(T a);\nclass A\n{\n    int a = 1, b = F(2, 3), c;\n    Dictionary<int, string> d;\n    public int this[int i] => a;\n    public static A operator +(A x, A y) => x;\n    public static implicit operator int(A x) => 1;\n    event Action On, Off;\n    delegate void Inner();\n    void M()\n    {\n        int local = 1, other = 2;\n        Action f = delegate { };\n    }\n}\n"
    got = [(n, k) for n, k, *_ in _named(text, "csharp")]
    assert got == [("N", "namespace"), ("Op", "delegate"), ("A", "class"), ("a", "field"), ("b", "field"), ("c", "field"), ("d", "field"), ("this", "indexer"), ("+", "operator"), ("int", "operator"), ("On", "event"), ("Off", "event"), ("Inner", "delegate"), ("M", "method")]


def test_callers_are_rendered_in_two_levels(spark):
    text = "def a():\n    b()\n\ndef b():\n    c()\n\ndef c():\n    d()\n\ndef d():\n    pass\n\ndef e():\n    d()\n"
    c = Corpus(spark.createDataFrame([("m.py", text)], "path string, content string"))
    graph = references.call_graph(c.code, c.symbols, "d", depth=3, direction="upstream", edges=c.edges)
    assert references.render_callers(graph, "d").split("\n") == ["d is called by:", "  c (m.py:8)", "    b (m.py:5)", "  e (m.py:14)"]


def test_python_signatures_over_lines_and_strings():
    text = 'def f(\n    a="def x(",\n    b=2,\n):\n    s = """\ndef no():\n"""\n    return g(a)\n\nclass C:\n    def h(self):\n        """Doc\n  out of line\n"""\n        return 1\n'
    assert _named(text, "python") == [("f", "function", "(global)", 1, 9), ("C", "class", "(global)", 10, 15), ("h", "function", "C", 11, 15)]


def test_calls_in_strings_make_no_edges(spark):
    text = 'def f(\n    a,\n):\n    log("g(1)")\n    g(2)  # k(3)\n    """k(4)"""\n\ndef g(x):\n    pass\n\ndef k(x):\n    pass\n'
    c = Corpus(spark.createDataFrame([("a.py", text)], "path string, content string"))
    assert sorted((r.src, r.dst, r.line, r.label) for r in c.edges.collect()) == [("f", "g", 5, ""), ("f", "log", 4, "unresolved")]


def test_edges_of_a_common_name_make_no_pairs(spark):
    decl = spark.range(10_000).selectExpr("concat('d', id % 4000, '.', element_at(array('py', 'js'), cast(id % 2 + 1 as int))) path", "element_at(array('python', 'javascript'), cast(id % 2 + 1 as int)) language", "case when id % 3 = 0 then 'Get' else 'get' end name", "'function' kind", "'(global)' containing", "cast(id div 4000 * 10 + 1 as int) start_line", "cast(id div 4000 * 10 + 9 as int) end_line", "'def' signature")
    lines = spark.range(4000).selectExpr("concat('d', id, '.', element_at(array('py', 'js'), cast(id % 2 + 1 as int))) path", "5 line_no", "'  x.get(1)' text").unionByName(spark.createDataFrame([("u.py", 5, "get(2)"), ("v.go", 5, "Get(3)")], "path string, line_no int, text string"))
    more = spark.createDataFrame([("u.py", "python", "u", "function", "(global)", 1, 9, "def u"), ("v.go", "go", "v", "function", "(global)", 1, 9, "func v")], decl.schema)
    rows = references.call_edges(lines, decl.unionByName(more)).collect()
    by = {r.path: r for r in rows if r.dst.lower() == "get"}
    assert len(by) == 4002 and all(r.label == "ambiguous" for r in by.values())
    assert all(r.dst_path == p for p, r in by.items() if p.startswith("d"))
    names = {}
    for r in decl.collect():
        names.setdefault((r.path, r.name), r.start_line)
    assert all(r.dst_line == (names.get((p, "get")) or names[p, "Get"]) for p, r in by.items() if p.startswith("d"))
    first = lambda lang, name: min((r.path.lower(), r.start_line) for r in decl.collect() if (lang is None or r.language == lang) and r.name == name)
    assert (by["u.py"].dst_path, by["u.py"].dst_line) == first("python", "get") and (by["v.go"].dst_path, by["v.go"].dst_line) == first(None, "Get")


def test_mask_lines_number_as_lines_do(spark):
    files = spark.createDataFrame([("a.py", "x = 1\r\n# c\rf()\n"), ("b.txt", "f()"), ("c.go", None)], "path string, content string")
    assert [tuple(r) for r in symbols.mask_lines(files).orderBy("path", "line_no").collect()] == [("a.py", 1, "x = 1"), ("a.py", 2, "   "), ("a.py", 3, "f()")]

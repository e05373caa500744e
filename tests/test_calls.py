"""Calls found by one fold of the files: the same as those of lines that meet declarations, and no file is folded twice."""

import os
import re

import pytest

from corpuscle.functions.lexer import FORMS, masked
from corpuscle.operators import references, symbols
from corpuscle.plans import synthetic
from corpuscle.plans.queries import QUERIES
from corpuscle.plans.registry import Corpus, call

SF = "/root/testdata/sf0.001"
MORE = [
    ("n.py", "class A:\n    def f(self):\n        Go(1); go(2); x.run(y.run(3))\n        def g():\n            h(f(4))\n    k(5)\nz(6)\n" + "def many():\n" + "".join(f"    c{k}(C{k}(d))\n" for k in range(40))),
    ("s.cs", "class A\n{\n    void M()\n    {\n        Own.Call<List<int>>(1); new B(2); if (x) Walk();\n        // No(1)\n        var s = @\"No(2)\";\n    }\n    int a = F(1), b = G(2);\n}\n"),
    ("t.ts", "class A {\n  run() {\n    a?.b(1); this.$c(2); JSON.parse(`no(${x(3)})`);\n  }\n}\n"),
    ("u.rs", "fn f() {\n    a::b::<T>(1); vec(2); x.y(3);\n}\n"),
    ("v.cpp", "int f(int x) {\n  return g(x) + p->h(2) + printf(\"no(1)\");\n}\n"),
    ("w.go", "func F() {\n\tfmt.Println(G(1)); own.Run[int](2)\n}\n"),
    ("e.py", ""),
    ("x.txt", "f(1)"),
]


def rows(df):
    return sorted(map(repr, df.select("path", "src", "src_line", "seq", "dst", "qualifier", "line").collect()))


def test_one_fold_finds_the_calls_of_the_lines(spark):
    files = spark.createDataFrame([*MORE, ("null.py", None)], "path string, content string")
    d = synthetic.ids(spark.range(7).toDF("doc_id"), "doc_id")
    for lang in synthetic.LANGUAGES:
        files = files.unionByName(synthetic.language_files(d, lang))
    files = files.unionByName(synthetic.python_files(d))
    got = symbols.extract_calls(files)
    assert rows(references.scanned_sites(got)) == rows(references.call_sites(symbols.mask_lines(files), symbols.extract_symbols(files)))
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(got.drop("calls")) == plain(symbols.extract_symbols(files))


def test_files_of_one_path_count_as_one(spark):
    text = lambda a, b: "def f():\n" + "".join(f"    c{k}(1)\n" for k in range(a, b))
    files = spark.createDataFrame([("a.py", text(0, 40)), ("a.py", text(20, 70)), ("a.py", text(20, 70)), ("b.py", text(0, 3))], "path string, content string")
    got = references.scanned_sites(symbols.extract_calls(files))
    assert rows(got) == rows(references.call_sites(symbols.mask_lines(files), symbols.extract_symbols(files)))


# the forms as they were, a character at a time
_SLOW = {
    "python": [r"#[^\r\n]*", r'"""(?:\\.|(?!""")[^\\])*(?:""")?', r"'''(?:\\.|(?!''')[^\\])*(?:''')?", r'"(?:\\.|[^"\\\r\n])*"?', r"'(?:\\.|[^'\\\r\n])*'?"],
    "java": [r"/\*(?:[^*]|\*(?!/))*(?:\*/)?", r"//[^\r\n]*", r'"""(?:\\.|(?!""")[^\\])*(?:""")?', r'"(?:\\.|[^"\\\r\n])*"?', r"'(?:\\.|[^'\\\r\n])*'?"],
}


@pytest.mark.parametrize("lang", sorted(_SLOW))
def test_masks_are_those_of_single_characters(lang):
    import random

    slow = re.compile("|".join(_SLOW[lang]), re.S)
    ink = lambda m: re.sub(r"\S", " ", m[0]) if m[0][0] in "/#" else m[0][0] + re.sub(r"\S", " ", m[0][1:])
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choice("'\"\\#/*\n\r\t x(é\u3000\u00a0\x1f") for _ in range(draw.randrange(30)))
        assert masked(text, lang) == slow.sub(ink, text), repr(text)
    assert set(_SLOW) <= set(FORMS)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_calls_beside_strings_joins_no_lines(spark):
    plan = _plan(QUERIES["calls_beside_strings"](spark, SF))
    assert "Join" not in plan and plan.count("MapInArrow") == 1


@needs_tables
def test_edges_fold_the_files_once(spark):
    assert "MapInArrow" not in _plan(QUERIES["call_edges"](spark, SF))


def test_graphs_of_a_corpus_read_one_fold(spark, monkeypatch):
    folds = []
    monkeypatch.setattr(symbols, "_fold", lambda *a, _f=symbols._fold, **b: folds.append(a[0]) or _f(*a, **b))
    c = Corpus(synthetic.python_files(synthetic.ids(spark.range(3).toDF("doc_id"), "doc_id")))
    assert call("call_graph", c, symbol="main1").count() == 6
    assert call("call_graph", c, symbol="save1", depth=1, direction="upstream").count() == 3
    assert call("expand_context", c, symbols=["nothing", "save1"]).count() == 8
    assert folds == [symbols.declared_calls]

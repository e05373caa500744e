import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("path, want", [("Foo.cs", "csharp"), ("Foo.tsx", "typescript"), ("foo.js", "javascript"), ("foo.py", "python"), ("Foo.java", "java"), ("main.go", "go"), ("main.rs", "rust"), ("main.cpp", "cpp"), ("main.c", "c"), ("readme.md", None), ("Makefile", None)])
def test_language(spark, path, want):
    assert one(spark, T.language(F.col("p")), p=path) == want


@pytest.mark.parametrize("path, want", [("FooTests.cs", True), ("Foo.Spec.ts", True), ("foo_test.py", True), ("tests/Helper.cs", True), ("Foo.cs", False), ("src/Helper.cs", False)])
def test_test_paths(spark, path, want):
    assert one(spark, T.is_test_path(F.col("p")), p=path) is want


@pytest.mark.parametrize("path, pattern, want", [("a/b.py", "*.py", True), ("a/b.py", "a/**", True), ("a/b/c.py", "a/*.py", False), ("a/b.PY", "a/?.py", True), ("a+b.py", "a+b.py", True)])
def test_globs(spark, path, pattern, want):
    assert one(spark, T.glob_matches(F.col("p"), pattern), p=path) is want


@pytest.mark.parametrize("q, want", [("Where is OrderService defined?", "Simple"), ("How does login work end-to-end?", "Complex"), ("List users", "Standard"), ("", "Standard"), (None, "Standard")])
def test_complexity(spark, q, want):
    assert one(spark, T.complexity(F.col("q")), q=q) == want


def test_keywords_and_candidates(spark):
    assert one(spark, T.keywords(F.col("q")), q="Please show the token parser and the Token cache") == ["token", "parser", "cache"]
    assert one(spark, T.symbol_candidates(F.col("q")), q="Does `run` call OrderService or fooBar via HTTP?") == ["run", "OrderService", "fooBar"]


def test_paths(spark):
    assert one(spark, T.normalize_path(F.col("p")), p="a/./b/../c\\d") == "a/c/d"
    assert one(spark, T.confined(F.col("p"), "Root"), p="root/x/../y") == "root/y"
    assert one(spark, T.confined(F.col("p"), "root"), p="root/../y") is None


def test_rendering(spark):
    assert one(spark, T.numbered(F.col("n"), F.lit("x")), n=7) == "    7| x"
    assert one(spark, T.numbered(F.col("n"), F.lit("x")), n=1234567) == "1234567| x"
    assert one(spark, T.truncate_single_line(F.col("t"), 5), t=" a \n b cde ") == "a b c..."
    assert one(spark, T.mermaid_id(F.col("t")), t="(a.b)") == "a_b"
    assert one(spark, T.method_name(F.col("t")), t="A.B.run(x.y)") == "run"


@pytest.mark.parametrize("raw, want", [(b"MZ..", True), (b"\x7fELF", True), (b"MZ", False), (b"text", False)])
def test_executables(spark, raw, want):
    assert one(spark, T.executable(F.col("b")), b=raw) is want


@pytest.mark.parametrize("raw, want", [(b"a\0b", True), (b"plain text\n", False), (b"\x01\x02\x03ab", True)])
def test_binary(spark, raw, want):
    assert one(spark, T.binary_content(F.col("b")), b=raw) is want

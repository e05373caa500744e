from pyspark.sql import functions as F

from corpuscle.operators import keep, modules
from corpuscle.operators.symbols import extract_symbols, imports
from corpuscle.sources.store import SymbolIndex


def _files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_namespaces_lead_to_modules(spark):
    f = _files(spark, {
        "Core/Data/Store.cs": "namespace Acme.Data;\nclass Store { }\n", "Core/Data/Row.cs": "namespace Acme.Data\n{\n}\nnamespace Acme.Data.Rows { }\n", "Web/Odd.cs": "namespace Acme.Data;\n",
        "Web/Page.cs": "using Acme.Data;\nusing Acme.Data.Rows.Deep;\nusing Acme.Database;\nusing System;\nnamespace Acme.Web;\n",
        "lib/org/x/A.java": "package org.x;\nclass A { }\n", "app/B.java": "package app;\nimport org.x.A;\nimport static org.x.A.f;\nimport org.xyz.C;\n",
    })
    mods = spark.createDataFrame([("Core/Data",), ("Web",), ("lib",), ("app",)], "module string")
    got = {(r.path, r.target, r.dst) for r in modules.import_modules(imports(f), f, mods).collect()}
    # a prefix ends at a dot: Acme.Database is no part of Acme.Data, org.xyz none of org.x
    assert got == {("Web/Page.cs", "Acme.Data", "Core/Data"), ("Web/Page.cs", "Acme.Data.Rows.Deep", "Core/Data"), ("app/B.java", "org.x.A", "lib"), ("app/B.java", "org.x.A.f", "lib")}
    assert [tuple(r) for r in modules.module_edges(imports(f), f, mods).collect()] == [("Web", "Core/Data", 2), ("app", "lib", 2)]


def test_relative_python_imports(spark):
    f = _files(spark, {"p/a.py": "from .b import x\nfrom ..q import y\nfrom ...r import z\nfrom . import c\nfrom .sub.d import e\n", "p/b.py": "", "q/__init__.py": "", "r.py": "", "p/__init__.py": "", "p/sub/d.py": ""})
    got = {(r.target, r.to) for r in modules.import_files(imports(f), f).collect()}
    assert got == {(".b", "p/b.py"), ("..q", "q/__init__.py"), (".", "p/__init__.py"), (".sub.d", "p/sub/d.py")}


def test_cache_expires_and_deletes(spark):
    now, made = [0.0], []
    files = _files(spark, {"a.py": "x"}).withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    other = files.withColumn("mtime", F.lit("2024-01-02").cast("timestamp"))
    cache = modules.Cached(absolute=300, sliding=100, clock=lambda: now[0])
    tables = lambda: len(keep._kept)
    before = tables()

    def get(at, f=files):
        now[0] = at
        return cache.get("x", f, lambda: (made.append(at), spark.range(3))[1]).count()

    assert get(0) == get(90) == get(180) == get(270) == 3 and made == [0]
    get(300)  # five minutes after it was made, however often it was used
    get(399)
    get(500)  # unused for too long
    get(501, other)  # the corpus changed
    assert made == [0, 300, 500, 501] and tables() == before + 1
    now[0] = 700
    assert cache.sweep() == ["x"] and tables() == before


def test_only_changed_files_are_folded_again(spark, tmp_path):
    at = lambda k: F.lit(f"2024-01-0{k}").cast("timestamp")
    make = lambda texts, k=1: _files(spark, texts).withColumns({"mtime": at(k), "size": F.length("content").cast("long")})
    index = SymbolIndex(spark, f"file://{tmp_path}/index")
    first = {"a.py": "def f():\n    g(1)\n", "b.py": "def h():\n    pass\n", "c.py": "def k():\n    pass\n", "d.txt": "no code"}
    assert index.refresh(make(first)) == 4 and index.refresh(make(first)) == 0
    same = make({p: t for p, t in first.items() if p in ("b.py", "d.txt")})
    new = same.unionByName(make({"a.py": "x = 1\n", "e.py": "def m():\n    pass\n"}, 2))
    assert sorted(r.path for r in index.changed(new).collect()) == ["a.py", "c.py", "e.py"]
    assert index.refresh(new) == 3
    whole = extract_symbols(new)
    assert sorted(map(tuple, index.symbols.read().collect())) == sorted(map(tuple, whole.select(*index.symbols.schema.names).collect()))
    assert {(r.path, r.text) for r in index.code.read().where("line_no = 1").collect()} == {("a.py", "x = 1"), ("b.py", "def h():"), ("e.py", "def m():")}
    assert sorted(r.path for r in index.seen.read().collect()) == ["a.py", "b.py", "d.txt", "e.py"]

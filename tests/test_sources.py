import os

import pytest
from pyspark.sql import functions as F

from corpuscle.sources import files as S


@pytest.fixture
def tree(tmp_path):
    made = {
        "src/a.py": "x = 1\n", "src/B.CS": "class B { }\n", "src/note.md": "# n\n", "src/.hidden/c.go": "package c\n", "obj/x/P.GlobalUsings.g.cs": "global using System;\n",
        "obj/skip.cs": "class Skip { }\n", "app/App.csproj": "<Project/>", "app/app.config": "k=v\n", "big.txt": "y" * 5000,
    }
    for at, text in made.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    # a link to nothing cannot be opened or measured: whatever touches it fails
    os.symlink(tmp_path / "gone", tmp_path / "src" / "dead.bin")
    return tmp_path


def _paths(df):
    return sorted(r.path for r in df.select("path").collect())


def _opened(tree, **options):
    reader = S.RepoReader({"path": str(tree), "profile": "none", **options})
    return sorted(os.path.relpath(at, tree) for part in reader.partitions() for at in part.value)


def test_unwanted_files_are_not_planned(tree):
    assert _opened(tree, extensions=".py .CS", names="^[^a]") == ["obj/skip.cs", "obj/x/P.GlobalUsings.g.cs", "src/B.CS"]
    assert _opened(tree, extensions=".rs") == []
    assert _opened(tree, without=".bin .md .cs .txt .go", changed_after="0") == ["app/App.csproj", "app/app.config", "src/a.py"]
    assert _opened(tree, without=".bin", changed_after="99999999999") == []


def test_named_scans_open_only_what_they_want(spark, tree):
    got = {k: _paths(S.scan_for(spark, str(tree), k)) for k in ("supported", "csharp", "projects", "code", "plain_search")}
    assert got["supported"] == ["src/.hidden/c.go", "src/B.CS", "src/a.py"]
    assert got["csharp"] == ["obj/x/P.GlobalUsings.g.cs", "src/B.CS"]
    assert got["projects"] == ["app/App.csproj"]
    assert got["code"] == ["app/app.config", "big.txt", "src/.hidden/c.go", "src/B.CS", "src/a.py"]
    assert got["plain_search"] == ["obj/skip.cs", "obj/x/P.GlobalUsings.g.cs", "src/.hidden/c.go", "src/B.CS", "src/a.py"]
    with pytest.raises(Exception, match="dead.bin"):
        S.scan_for(spark, str(tree), "search").count()  # wants every file that is no document
    assert "big.txt" in _paths(S.scan_for(spark, str(tree), "search", without=[".bin", ".md"]))
    with pytest.raises(ValueError):
        S.scan_for(spark, str(tree), "everything")


def test_named_scans_agree_with_filters_of_a_whole_scan(spark, tree):
    (tree / "src" / "dead.bin").unlink()
    whole = S.scan(spark, str(tree), "none")
    for what, keep in {"supported": S.supported, "csharp": S.csharp, "projects": S.project_files, "code": S.code_files, "plain_search": S.plain_search_files, "search": S.search_files}.items():
        assert _paths(S.scan_for(spark, str(tree), what)) == _paths(keep(whole)), what
    assert whole.filter(F.col("size") >= 5000).count() == 1 and whole.count() == 9  # one query's filter does not stay


def test_listing_without_content(spark, tree):
    rows = S.scan(spark, str(tree), "none", content=False, without=[".bin"]).collect()
    assert {r.path: r.size for r in rows}["big.txt"] == 5000 and all(r.content is None for r in rows)

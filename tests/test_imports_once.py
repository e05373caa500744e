"""An import that many files share is looked up once, with the results of looking up each."""

from corpuscle.operators import modules
from corpuscle.operators.symbols import imports


def test_shared_imports_are_tried_once(spark):
    sharp = {f"m{k % 3}/F{k}.cs": f"using System;\nusing Corp.m0.Deep;\nusing m1.F1;\nnamespace Corp.m{k % 3};\n" for k in range(60)}
    python = {f"p{k}/{name}": text for k in range(20) for name, text in (("a.py", "from .b import x\nimport m1.F1\nimport none.such\n"), ("b.py", "import p0.b\n"))}
    f = spark.createDataFrame([*sharp.items(), *python.items()], "path string, content string")
    found = imports(f)
    named = modules._named_files(modules._asked(found), f)
    # the file m1/F1.cs, the relative import of each of 20 folders, and p0/b.py
    assert named.count() == 1 + 20 + 1
    files = sorted((r.path, r.target, r.to) for r in modules.import_files(found, f).collect())
    want = [(p, "m1.F1", "m1/F1.cs") for p in [*sharp, *(p for p in python if p.endswith("a.py"))] if p != "m1/F1.cs"]
    want += [(f"p{k}/a.py", ".b", f"p{k}/b.py") for k in range(20)] + [(f"p{k}/b.py", "p0.b", "p0/b.py") for k in range(1, 20)]
    assert files == sorted(want)
    mods = modules.modules(f)
    edges = [tuple(r) for r in modules.module_edges(found, f, mods).collect()]
    assert edges == sorted([("m0", "m1", 20), ("m1", "m0", 20), ("m2", "m0", 20), ("m2", "m1", 20), *((f"p{k}", "m1", 1) for k in range(20)), *((f"p{k}", "p0", 1) for k in range(1, 20))])

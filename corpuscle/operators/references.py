"""Symbol resolution, references, call graphs and test discovery."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .keep import settled


def definition_order(name: str | Column) -> list[Column]:
    """Exact case first, then path without case, then line."""
    want = F.lit(name) if isinstance(name, str) else name
    return [(F.col("name") == want).desc(), F.lower("path"), F.col("path"), F.col("start_line")]


def find_definitions(symbols: DataFrame, name: str, *, hint: str | None = None, file: str | None = None, limit: int = 20) -> DataFrame:
    """Declarations of a name without regard to case, best first; a hint or file applies only where it leaves any."""
    hits = symbols.filter(F.lower("name") == name.lower())
    every = Window.partitionBy(F.lower("name"))
    tests = []
    if file:
        tests.append(F.lower("path").endswith(file.lower()))
    if hint:
        tests.append(F.contains(F.lower("signature"), F.lit(hint.lower())))
    for test in tests:
        hits = hits.withColumn("_hit", test).withColumn("_any", F.bool_or("_hit").over(every)).filter("_hit or not _any").drop("_hit", "_any")
    return hits.orderBy(*definition_order(name)).limit(limit)


def resolve(symbols: DataFrame, name: str, **how) -> DataFrame:
    """One row: status (found, ambiguous, missing), the match and up to ten candidates."""
    hits = find_definitions(symbols, name, limit=10, **how)
    n = F.count("*")
    best = F.min(F.struct(F.col("name") != name, F.lower("path"), "start_line", "path"))
    out = hits.agg(n.alias("n"), F.count_if(F.col("name") == name).alias("exact"), best.alias("b"), F.array_sort(F.collect_list(F.struct("path", "start_line"))).alias("candidates"))
    status = F.when(F.col("n") == 0, "missing").when((F.col("n") == 1) | (F.col("exact") == 1), "found").otherwise("ambiguous")
    return out.select(F.lit(name).alias("query"), status.alias("status"), F.when(status == "found", F.col("b.path")).alias("path"), F.when(status == "found", F.col("b.start_line")).alias("start_line"), "candidates")


def enclosing(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hits (path, line_no, ...) with `containing`: the innermost declaration around the line, else the nearest above it.

    One file's declarations travel as an array, so that no pair of line and
    declaration is made.
    """
    held = symbols.groupBy(F.col("path").alias("_p")).agg(F.collect_list(F.struct("start_line", "end_line", "name")).alias("_d"))
    x = hits.join(held, hits["path"] == held["_p"], "left")
    above = F.filter("_d", lambda d: d.start_line <= F.col("line_no"))
    inside = F.filter(above, lambda d: d.end_line >= F.col("line_no"))
    best = F.coalesce(F.array_max(inside)["name"], F.array_max(above)["name"], F.lit("(global)"))
    return x.withColumn("containing", best).drop("_p", "_d")


def classify(text: Column, kind: Column, name: str, path: Column | None = None) -> Column:
    """What a mention is: the first form that fits, by the kind of what is mentioned; C# files have forms of their own."""
    n, t = re.escape(name), F.trim(text)
    plain = (
        F.when(t.rlike(r"(?i)^(import|from|using|use|require|#include)\b"), "import")
        .when(kind.isin("function", "method") & t.rlike(rf"\b{n}\s*\("), "call")
        .when(kind.isin("class", "struct", "type") & t.rlike(rf"\bnew\s+{n}\s*\("), "construction")
        .when((kind == "class") & t.rlike(rf"\b(extends|implements|:|for)\b.*\b{n}\b"), "inheritance")
        .when(kind.isin("interface", "trait") & t.rlike(rf"\b(extends|implements|:|for)\b.*\b{n}\b"), "implementation")
        .when(t.rlike(rf"\b{n}\b\s*[<>,*&\[\]]*\s+[A-Za-z_]\w*"), "type reference")
        .otherwise("reference")
    )
    if path is None:
        return plain
    types = kind.isin("class", "struct", "interface", "enum", "record")
    sharp = (
        F.when(t.rlike(rf"^\[[^\]]*\b{n}(?:Attribute)?\b"), "attribute")
        .when(kind.isin("method", "function", "constructor") & t.rlike(rf"\b{n}\s*(?:<[^>]*>)?\s*\("), "call")
        .when(types & t.rlike(rf"\bnew\s+(?:[\w.]+\.)?{n}\b\s*(?:<[^>]*>)?\s*[({{]"), "construction")
        .when(types & t.rlike(rf"\b(?:class|struct|record|interface)\s+\w+[^:{{]*:[^{{]*\b{n}\b"), F.when(kind == "interface", "implementation").otherwise("inheritance"))
        .when(types & t.rlike(rf"^(?:public|internal|protected|private)\s+[A-Z]\w*\s*\([^)]*\b{n}\b"), "constructor injection")
        .when(t.rlike(r"^(?:global\s+)?using\b"), "import")
        .when(t.rlike(rf"\b{n}\b(?:<[^>]*>)?[?\[\]]*\s+[A-Za-z_]\w*"), "type reference")
        .otherwise("reference")
    )
    return F.when(T.language(path) == "csharp", sharp).otherwise(plain)


def find_references(lines: DataFrame, symbols: DataFrame, name: str, *, scope: str = "all", limit: int = 200, file: str | None = None, include: str | None = None, hint: str | None = None) -> DataFrame:
    """(path, line_no, text, kind, containing, is_test) of the mentions of a name beside its definitions.

    file and hint choose which definition of the name is meant, include is a glob
    of the files that are searched.
    """
    kind = find_definitions(symbols.filter(F.col("name") == name), name, hint=hint, file=file, limit=1).select("kind")
    if include:
        lines = lines.filter(T.glob_matches(F.col("path"), include))
    own = symbols.filter(F.col("name") == name).select("path", F.col("start_line").alias("line_no"))
    hits = lines.select("path", "line_no", "text").filter(F.col("text").rlike(rf"\b{re.escape(name)}\b"))
    hits = enclosing(hits.join(own, ["path", "line_no"], "left_anti"), symbols).withColumn("is_test", T.is_test_path(F.col("path")))
    if scope.strip().lower() in ("tests", "test", "production", "prod", "source"):
        hits = hits.filter(F.col("is_test") == (scope.strip().lower() in ("tests", "test")))
    hits = hits.join(F.broadcast(kind.withColumnRenamed("kind", "_kind")), how="left")  # one row
    hits = hits.withColumn("kind", classify(F.col("text"), F.coalesce("_kind", F.lit("")), name, F.col("path")))
    return hits.select("path", "line_no", T.truncate_single_line(F.col("text")).alias("text"), "kind", "containing", "is_test").orderBy(F.lower("path"), "path", "line_no").limit(limit)


def _calls(text: Column, language: Column) -> Column:
    """(q, d) of each call in a line, by the form of its language; lines of other files have none."""
    found = None
    for form in dict.fromkeys(fixed.CALLS.values()):
        test = language.isin([k for k, v in fixed.CALLS.items() if v == form])
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(form), F.lit(1)).alias("q"), F.regexp_extract_all(text, F.lit(form), F.lit(2)).alias("d"))
        found = F.when(test, pairs) if found is None else found.when(test, pairs)
    return found


def call_sites(lines: DataFrame, symbols: DataFrame, callees: int = fixed.CALLEES_PER_SYMBOL) -> DataFrame:
    """(path, src, src_line, seq, dst, qualifier, line): names called within each declaration, at their first line.

    lines are best mask_lines(), in which strings and comments are blank; of others,
    comment lines and quoted ones hold no calls. Declaration lines hold none either;
    words of the languages themselves are none, nor what is called on a built-in
    module or object of the file's language. Of each declaration the first
    `callees` names count.
    """
    own = symbols.select("path", F.col("start_line").alias("line_no")).distinct()
    code = lines.filter(~F.col("text").rlike(r"^\s*(//|#|/\*|\*|[\"'`])") & F.contains(F.col("text"), F.lit("("))).join(own, ["path", "line_no"], "left_anti")
    found = _calls(F.col("text"), T.language(F.col("path")))
    skip = F.try_element_at(F.create_map(*[x for k, v in fixed.SKIP_CALLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]), T.language(F.col("path")))
    code = code.select("path", "line_no", skip.alias("skip"), F.posexplode(found).alias("pos", "c")).filter(~F.lower("c.d").isin(fixed.GLOBAL_SKIP_CALLS))
    code = code.filter(~F.coalesce(F.array_contains("skip", F.col("c.d")) | F.array_contains("skip", F.col("c.q")), F.lit(False)))
    bodies = symbols.filter(F.col("kind").isin("function", "method", "constructor", "class", "struct", "type")).select(F.col("path").alias("_p"), F.col("name").alias("src"), F.col("start_line").alias("src_line"), "end_line")
    x = code.join(bodies, (F.col("path") == F.col("_p")) & F.col("line_no").between(F.col("src_line"), F.col("end_line")))
    first = x.groupBy("path", "src", "src_line", F.lower("c.d").alias("_d")).agg(F.min(F.struct("line_no", "pos", "c.d", "c.q")).alias("f"))
    w = Window.partitionBy("path", "src", "src_line").orderBy("f.line_no", "f.pos", "f.d")
    out = first.select("path", "src", "src_line", F.row_number().over(w).alias("seq"), F.col("f.d").alias("dst"), F.nullif("f.q", F.lit("")).alias("qualifier"), F.col("f.line_no").alias("line"))
    return out.filter(F.col("seq") <= callees)


def scanned_sites(scanned: DataFrame, callees: int = fixed.CALLEES_PER_SYMBOL) -> DataFrame:
    """call_sites() of symbols.extract_calls(): no line meets a declaration, and a row for each declaration is shuffled.

    Files that share a path count as one: of a name the first call, of a declaration the first `callees` names.
    """
    own = scanned.filter(F.col("calls").isNotNull()).groupBy("path", F.col("name").alias("src"), F.col("start_line").alias("src_line")).agg(F.collect_list("calls").alias("held"))
    every = F.array_sort(F.array_distinct(F.flatten("held")))
    own = own.withColumn("all", F.when(F.size("held") > 1, every)).withColumn("names", F.transform("all", lambda c: F.lower(c.dst)))
    merged = F.slice(F.filter("all", lambda c, k: F.array_position("names", F.lower(c.dst)) == k + 1), 1, callees)
    x = own.select("path", "src", "src_line", F.posexplode(F.when(F.size("held") == 1, F.get("held", F.lit(0))).otherwise(merged)).alias("k", "c"))
    return x.select("path", "src", "src_line", (F.col("k") + 1).alias("seq"), F.col("c.dst").alias("dst"), F.nullif("c.qualifier", F.lit("")).alias("qualifier"), F.col("c.line").alias("line"))


def _best(d: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each of keys: `name` holds the number of declarations, and the best one of each language and spelling."""
    by = d.groupBy(*keys, "language", "d_name").agg(F.count("*").alias("n"), F.min(F.struct(F.lower("dst_path").alias("o"), "dst_line", "dst_path", "dispatch")).alias("b"))
    return by.groupBy(*keys).agg(F.struct(F.sum("n").alias("n"), F.collect_list(F.struct("language", "d_name", "b")).alias("spelt")).alias(name))


def call_edges(lines: DataFrame, symbols: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """call_sites with the best declaration of each name: the same file, then the same language, then path and line.

    In each of these the name as it is written goes first. Declarations are ranked
    before they meet calls, to one row a name and file and one a name, which holds
    the best of each language, so a common name makes no pairs. sites: the
    call_sites(), where a caller has them; lines are not read then. label: unresolved (external for a C#
    member of a type the corpus lacks), ambiguous, interface dispatch for members of
    an interface and abstract ones, virtual dispatch for virtual and overriding
    ones, or empty.
    """
    sites = (call_sites(lines, symbols) if sites is None else sites).withColumns({"language": T.language(F.col("path")), "_n": F.lower("dst")})
    holders = symbols.filter("kind = 'interface'").select(F.col("path").alias("_hp"), F.col("name").alias("_hn")).distinct()
    d = symbols.join(holders, (F.col("path") == F.col("_hp")) & (F.col("containing") == F.col("_hn")), "left")
    kind = F.when((F.col("kind").isin("interface", "abstract")) | F.col("_hn").isNotNull() | F.col("signature").rlike(r"\babstract\b"), "interface dispatch").when(F.col("signature").rlike(r"\b(?:virtual|override)\b"), "virtual dispatch").otherwise("")
    d = d.select(F.lower("name").alias("_n"), F.col("name").alias("d_name"), F.col("path").alias("dst_path"), F.col("start_line").alias("dst_line"), "language", kind.alias("dispatch"))
    x = sites.join(_best(d.withColumn("path", F.col("dst_path")), ["_n", "path"], "here"), ["_n", "path"], "left")
    x = x.join(_best(d, ["_n"], "all"), "_n", "left")
    best = lambda held, test: F.array_min(F.transform(F.filter(held, test), lambda v: v.b))
    pick = lambda held: F.coalesce(best(held, lambda v: v.d_name == F.col("dst")), F.array_min(F.transform(held, lambda v: v.b)))
    near = F.filter("all.spelt", lambda v: v.language == F.col("language"))
    x = x.withColumn("b", F.coalesce(pick(F.col("here.spelt")), pick(near), pick(F.col("all.spelt"))))
    missing = F.when((F.col("language") == "csharp") & F.col("qualifier").rlike("^[A-Z]"), "external").otherwise("unresolved")
    label = F.when(F.col("b").isNull(), missing).when(F.col("b.dispatch") != "", F.col("b.dispatch")).when(F.col("all.n") > 1, "ambiguous").otherwise("")
    return x.select("path", "src", "src_line", "seq", "dst", "line", F.col("b.dst_path").alias("dst_path"), F.col("b.dst_line").alias("dst_line"), label.alias("label"))


def call_graph(lines: DataFrame, symbols: DataFrame, name: str, *, depth: int = 2, direction: str = "downstream", limit: int = 200, file: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(depth, src, dst, path, line, label, is_true_cycle): edges in breadth-first order from the best definition of a name.

    A level is a join of the frontier with the edges; what earlier levels reached
    is not expanded again. The frontier holds `limit` edges at most, the visited
    set depth times that, so both stay small whatever the corpus. edges:
    settled call_edges(), where a caller has them; else they are made once here.
    """
    depth = max(1, min(5, depth))
    root = find_definitions(symbols, name, file=file, limit=1).select("path", "name", "start_line").collect()
    spark = symbols.sparkSession
    schema = "depth int, src string, dst string, path string, line int, label string, is_true_cycle boolean"
    if not root:
        return spark.createDataFrame([], schema)
    edges = settled(call_edges(lines, symbols)) if edges is None else edges
    here = [(root[0].path, root[0].name, root[0].start_line)]
    seen, rows, parents = set(here), [], {here[0]: set()}
    for level in range(1, depth + 1):
        front = spark.createDataFrame([(k, *h) for k, h in enumerate(here)], "pos int, f_path string, f_name string, f_line int")
        f = F.broadcast(front)  # at most `limit` rows
        if direction == "downstream":
            step = edges.join(f, (F.col("path") == F.col("f_path")) & (F.col("src") == F.col("f_name")) & (F.col("src_line") == F.col("f_line"))).orderBy("pos", "seq")
        else:
            step = edges.join(f, (F.col("dst_path") == F.col("f_path")) & (F.col("dst_line") == F.col("f_line"))).orderBy("pos", F.lower("path"), "line", "src_line")
        found, here = step.limit(limit - len(rows)).collect(), []
        for r in found:
            near, far = (r.path, r.src, r.src_line), (r.dst_path, r.dst, r.dst_line)
            start, new = (near, far) if direction == "downstream" else (far, near)
            start = (r.f_path, r.f_name, r.f_line)
            label, loop = r.label, new == start or new in parents.get(start, set())
            if new == start:
                label = "recursive"
            elif new[0] is not None and new in seen:
                label = label or "cycle"
            elif new[0] is not None:
                seen.add(new)
                here.append(new)
                parents[new] = parents.get(start, set()) | {start}
            rows.append((level, r.src, r.dst, r.path, r.line, label, loop))
        if not here or len(rows) >= limit:
            break
    return spark.createDataFrame(rows, schema)


def confidence(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def owner_of(symbols: DataFrame) -> Column:
    """The type a declaration belongs to: itself, what contains it, or null."""
    last = F.element_at(F.split("containing", r"\."), -1)
    return F.when(F.col("kind").isin(fixed.TYPE_KINDS), F.col("name")).when(F.col("containing") == "(global)", F.lit(None)).otherwise(last)


def test_targets(symbols: DataFrame, name: str | None, file: str | None) -> list[tuple[str, str | None]]:
    """(name, owner) of what tests are sought for: a name's best definition, or a file's first five declarations."""
    x = symbols.withColumn("owner", owner_of(symbols))
    if name is not None:
        x = find_definitions(x, name, file=file, limit=1)
    else:
        x = x.filter(F.lower("path").endswith(file.lower())).orderBy(F.lower("path"), "path", "start_line").limit(5)
    found = [(r.name, r.owner) for r in x.select("name", "owner").collect()]  # five rows at most
    return found or ([(name, None)] if name is not None else [])


def candidate_test_files(files: DataFrame, cases: DataFrame) -> DataFrame:
    """(path) of files with a test's path, with test cases, or under a folder whose project file names a test framework."""
    p = F.col("path")
    marked = files.filter(T.is_test_path(p)).select("path").union(cases.select("path"))
    home = files.filter(p.endswith(".csproj") & F.exists(T.xml_attributes(F.col("content"), "PackageReference", "Include"), lambda v: v.rlike("(?i)xunit|nunit|mstest|fluentassertions")))
    home = home.select(F.array_join(T.directories(p), "/").alias("dir")).filter("dir <> ''")
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(T.directories(p)), F.lit(1))), lambda k: F.array_join(F.slice(T.directories(p), 1, k), "/"))).alias("dir"))
    return marked.union(up.join(home, "dir", "left_semi").select("path")).distinct()


def tests_for(lines: DataFrame, cases: DataFrame, symbols: DataFrame, name: str | None = None, *, file: str | None = None, framework: str | None = None, limit: int = 20, per_file: int = 10) -> DataFrame:
    """(path, framework, score, confidence, reasons, cases): test files by their evidence for a name, or a file's names.

    A file counts if its path is a test's or it holds test cases. For each target
    it scores 20 if it is named after it or its owner, and 8 a mention of either up
    to 30 (C#: 25 a line that mentions it, up to 45); its best case adds up to 35.
    A case scores 20 for a target in its own name (C#: 15) and 35 for a mention in
    the ten lines around it (C#: 40).
    """
    if (name is None) == (file is None) and name is None:
        raise ValueError("symbol or file_path is needed")
    spark, p = symbols.sparkSession, F.col("path")
    targets = test_targets(symbols, name, file)
    sharp = T.language(p) == "csharp"
    files = lines.filter(T.is_test_path(p)).select("path").union(cases.select("path")).distinct()
    out = None
    for target, owner in targets:
        names = [target, *([owner] if owner else [])]
        word = "|".join(rf"\b{re.escape(x)}\b" for x in dict.fromkeys(names))
        stem = F.lower(F.regexp_replace(T.file_name(p), r"\.[^.]*$", ""))
        named = F.lit(False)
        for x in names:
            named = named | F.contains(stem, F.lit(x.lower()))
        named = named & stem.rlike("test|spec")
        hits = lines.join(files, "path", "left_semi").filter(F.col("text").rlike(word))
        hits = hits.select("path", "line_no", sum((F.regexp_count("text", F.lit(rf"\b{re.escape(x)}\b")) for x in names), F.lit(0)).alias("n"))
        said = hits.groupBy("path").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        near = cases.join(hits.select(F.col("path").alias("_p"), "line_no"), (p == F.col("_p")) & F.col("line_no").between(F.col("line") - 10, F.col("line") + 10), "left")
        near = near.groupBy("path", "name", "line").agg(F.count("line_no").alias("near"))
        own = F.lit(False)
        for x in names:
            own = own | F.contains(F.lower("name"), F.lit(x.lower()))
        score = F.when(own, F.when(sharp, 15).otherwise(20)).otherwise(0) + F.when(F.col("near") > 0, F.when(sharp, 40).otherwise(35)).otherwise(0)
        part = near.withColumn("score", score).filter("score > 0").groupBy("path").agg(F.collect_list(F.struct("line", "name", "score")).alias("cases"))
        x = files.join(said, "path", "left").join(part, "path", "left")
        mentions = F.when(sharp, F.least(F.lit(45), 25 * F.coalesce("rows", F.lit(0)))).otherwise(F.least(F.lit(30), 8 * F.coalesce("n", F.lit(0))))
        x = x.select("path", (F.when(named, 20).otherwise(0) + mentions).alias("score"), F.coalesce("cases", F.array().cast("array<struct<line:int,name:string,score:int>>")).alias("cases"), F.array_compact(F.array(F.when(named, F.lit(f"file name matches '{owner or target}'")), F.when(F.col("n") > 0, F.lit("direct symbol mentions found in test file")))).alias("reasons"))
        out = x if out is None else out.unionByName(x)
    if out is None:
        return spark.createDataFrame([], "path string, framework string, score int, confidence string, reasons array<string>, cases array<struct<line:int,name:string,score:int>>")
    out = out.groupBy("path").agg(F.sum("score").alias("score"), F.flatten(F.collect_list("cases")).alias("cases"), F.flatten(F.collect_list("reasons")).alias("reasons"))
    # a file's few cases, the best first, then by line
    best = F.transform(F.array_sort(F.transform("cases", lambda c: F.struct((-c.score).alias("s"), c.line.alias("line"), c["name"].alias("name")))), lambda c: F.struct(c.line.alias("line"), c["name"].alias("name"), (-c.s).alias("score")))
    top = F.coalesce(F.array_max(F.transform("cases", lambda c: c.score)), F.lit(0))
    out = out.withColumn("reasons", T.distinct_in_order(F.concat("reasons", F.when(top > 0, F.array(F.lit("contains matching test cases"))).otherwise(F.array().cast("array<string>")))))
    out = out.withColumn("score", (F.col("score") + F.least(F.lit(35), top)).cast("int")).withColumn("cases", F.slice(best, 1, per_file)).filter("score > 0")
    known = F.try_element_at(F.create_map(*[F.lit(v) for kv in fixed.TEST_FRAMEWORKS.items() for v in kv]), T.language(p))
    out = out.withColumn("framework", F.lit(framework) if framework else F.coalesce(known, F.lit("unknown")))
    return out.select("path", "framework", "score", confidence(F.col("score")).alias("confidence"), "reasons", "cases").orderBy(F.col("score").desc(), F.lower("path"), "path").limit(limit)


def reference_index(refs: DataFrame) -> DataFrame:
    """(path, refs): each file's references, by line."""
    return refs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "containing"))).alias("refs"))


def references_by_file(refs: DataFrame, shown: int = 12) -> DataFrame:
    """(path, n, lines, more): references grouped by file, the first `shown` line numbers of each."""
    per = refs.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line_no")).alias("all"))
    return per.select("path", "n", F.slice("all", 1, shown).alias("lines"), F.greatest(F.col("n") - shown, F.lit(0)).alias("more")).orderBy(F.lower("path"), "path")


def edge_summary(graph: DataFrame) -> DataFrame:
    """One row: edges, and how many are unresolved, ambiguous, recursive or lead back."""
    n = lambda label: F.count_if(F.col("label") == label).alias(label.replace(" ", "_"))
    return graph.agg(F.count("*").alias("edges"), *map(n, ("unresolved", "external", "ambiguous", "interface dispatch", "virtual dispatch", "recursive", "cycle")))


def callers(graph: DataFrame) -> DataFrame:
    """(dst, src, path, line, n): a graph's edges by what calls what, without regard to case, at the first call."""
    x = graph.groupBy(F.lower("dst").alias("d"), F.lower("src").alias("s"), "path").agg(F.min(F.struct("line", "dst", "src")).alias("f"), F.count("*").alias("n"))
    return x.select("f.dst", "f.src", "path", "f.line", "n")


def context_text(context: DataFrame, limit: int = 3000) -> DataFrame:
    """One row: expand_context() as text, cut back to a line end at `limit` characters."""
    row = F.concat(F.col("relation"), F.lit(" "), F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("text"))
    x = context.agg(F.array_sort(F.collect_list(F.struct("name", "relation", "path", "line", row.alias("row")))).alias("r"))
    return x.select(T.truncate_context(F.array_join(F.col("r.row"), "\n"), limit).alias("text"))


def render_tree(graph: DataFrame, root: str) -> str:
    """An indented text of a call graph; the graph has a few hundred edges at most (see call_graph)."""
    children: dict[str, list] = {}
    for r in graph.collect():
        children.setdefault(r.src, []).append(r)
    out, seen = [root], {root}

    def add(name: str, depth: int) -> None:
        for r in children.get(name, []):
            out.append("  " * depth + f"{r.dst} (line {r.line})" + (f" [{r.label}]" if r.label else ""))
            if r.dst not in seen:
                seen.add(r.dst)
                add(r.dst, depth + 1)

    add(root, 1)
    return "\n".join(out)


def render_callers(graph: DataFrame, root: str) -> str:
    """An indented text of an upstream call graph: the callers of the root with their places, and under each its own callers; a few hundred edges at most."""
    rows = graph.collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.dst.lower(), []).append(r)
    line = lambda r, depth: "  " * depth + f"{r.src} ({r.path}:{r.line})" + (f" [{r.label}]" if r.label else "")
    out = [f"{root} is called by:"]
    for r in by.get(root.lower(), []):
        out += [line(r, 1), *(line(q, 2) for q in by.get(r.src.lower(), []))]
    return "\n".join(out)


def expand_context(lines: DataFrame, symbols: DataFrame, names: list[str], *, most: int = 2, edges: int = 10, refs: int = 8, made: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(name, relation, path, line, text) around up to `most` names that resolve: definition, callees, callers, references.

    made: gives settled call_edges(), where a caller has them; asked once a name resolves.
    """
    out, used, edges_of = None, 0, None
    for name in names:
        best = find_definitions(symbols, name, limit=1)
        if used >= most or best.isEmpty():
            continue
        used += 1
        if edges_of is None:
            edges_of = made() if made else settled(call_edges(lines, symbols))
        row = lambda df, relation, path, line, text: df.select(F.lit(name).alias("name"), F.lit(relation).alias("relation"), path.alias("path"), line.cast("int").alias("line"), text.alias("text"))  # noqa: E731, B023
        parts = [
            row(best, "definition", F.col("path"), F.col("start_line"), F.col("signature")),
            row(call_graph(lines, symbols, name, depth=1, limit=edges, edges=edges_of), "callee", F.col("path"), F.col("line"), F.col("dst")),
            row(call_graph(lines, symbols, name, depth=1, direction="upstream", limit=edges, edges=edges_of), "caller", F.col("path"), F.col("line"), F.col("src")),
            row(find_references(lines, symbols, name, limit=refs), "reference", F.col("path"), F.col("line_no"), F.col("text")),
        ]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    if out is None:
        return symbols.sparkSession.createDataFrame([], "name string, relation string, path string, line int, text string")
    return out

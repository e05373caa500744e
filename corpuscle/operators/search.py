"""Lines, search with ranked results, bounded slices and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def explode_lines(files: DataFrame, content: str = "content", keys: tuple[str, ...] = ("path",), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, keep, line_no from 1, text); a last newline opens no line; null content has no lines."""
    out = files.select(*keys, *keep, F.posexplode(T.line_array(F.col(content))).alias("k", "text"))
    return out.select(*keys, *keep, (F.col("k") + 1).alias("line_no"), "text")


def grep(lines: DataFrame, pattern: str, *, order: list[Column], limit: int | None = 100, where: Column | None = None) -> DataFrame:
    """Lines that match without regard to case, long ones capped, the first `limit` in order."""
    hits = lines.filter(F.col("text").rlike(T.search_regex(pattern)))
    hits = hits.filter(where) if where is not None else hits
    hits = hits.withColumn("text", T.cap_line(F.col("text")))
    return hits.orderBy(*order).limit(limit) if limit else hits


def glob(files: DataFrame, pattern: str, *, order: list[Column], limit: int = 100) -> DataFrame:
    return files.filter(T.glob_matches(F.col("path"), pattern)).orderBy(*order).limit(limit)


def line_counts(files: DataFrame, content: str = "content", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, n_lines, longest) of files that have a line; a file's lines lie in one row, so nothing is shuffled."""
    lines = T.line_array(F.col(content))
    x = files.select(*keys, lines.alias("_l")).filter(F.size("_l") > 0)
    return x.select(*keys, F.size("_l").cast("long").alias("n_lines"), F.array_max(F.transform("_l", F.length)).alias("longest"))


def read_slice(files: DataFrame, *, content: str = "content", keys: tuple[str, ...] = ("path",), offset: int = 0, max_lines: int = 500, budget: int | None = 51200) -> DataFrame:
    """Per file the numbered lines after offset, while their bytes and line ends fit the budget.

    The slice and its running sum are array functions over a file's row: no
    window, no shuffle, and max_lines bounds the sum.
    """
    part = F.slice(T.line_array(F.col(content)), offset + 1, max_lines)
    shown = F.transform(part, lambda t, k: F.struct((k + offset + 1).alias("line_no"), T.numbered(k + offset + 1, T.cap_line(t)).alias("rendered")))
    kind = "array<struct<line_no:int,rendered:string,used:int>>"
    step = lambda a, v: F.struct(
        (a.at + F.octet_length(v.rendered) + 1).alias("at"),
        F.concat(a.out, F.array(F.struct(v.line_no.alias("line_no"), v.rendered.alias("rendered"), (a.at + F.octet_length(v.rendered) + 1).alias("used")))).alias("out"),
    )
    run = F.aggregate("_s", F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a.out)
    x = files.select(*keys, shown.alias("_s")).select(*keys, F.explode(run).alias("r")).select(*keys, "r.*")
    return x.filter(F.col("used") <= budget) if budget else x


def read_plain(files: DataFrame, path: str, *, max_lines: int = 1000) -> DataFrame:
    """(path, content): the first lines without numbers, long ones capped; null content for a binary file."""
    x = files.filter(F.col("path") == path)
    text = F.array_join(F.transform(F.slice(T.line_array(F.col("content")), 1, max_lines), lambda t: T.cap_line(t)), "\n")
    binary = T.binary_path(F.col("path")) | F.coalesce(T.binary_content(F.col("content").cast("binary")), F.lit(False))
    return x.select("path", F.when(~binary, text).alias("content"))


def clamped_depth(files: DataFrame, opens: str, closes: str, *, content: str = "content", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, line_no, depth): after each line, the opens less the closes so far, never below 0 at a line's end."""
    lines = explode_lines(files, content, keys)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    x = lines.withColumn("_s", F.sum(count(opens) - count(closes)).over(w))
    return x.select(*keys, "line_no", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("long").alias("depth"))


def tree(files: DataFrame, *, k: int = 30, max_depth: int = 3) -> DataFrame:
    """(dir, kind, name, more): each directory's subdirectories, then its first k files, and how many more it has."""
    f = files.select(F.col("path")).distinct()
    parts = F.split("path", "/")
    f = f.select("path", T.file_name(F.col("path")).alias("name"), F.array_join(T.directories(F.col("path")), "/").alias("dir"), (F.size(parts) - 1).alias("depth"))
    w = Window.partitionBy("dir").orderBy(F.lower("name"), "name", "path")
    ranked = f.filter(F.col("depth") < max_depth).withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("dir")))
    shown = ranked.filter(F.col("rank") <= k).select("dir", F.lit("file").alias("kind"), "name", F.greatest(F.col("n") - k, F.lit(0)).alias("more"))
    ups = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda d: F.struct(F.array_join(F.slice(F.split("path", "/"), 1, d - 1), "/").alias("dir"), F.element_at(F.split("path", "/"), d).alias("name"), d.alias("depth"), (d < F.size(F.split("path", "/"))).alias("is_dir")))).alias("s"))
    dirs = ups.filter("s.is_dir").filter(F.col("s.depth") <= max_depth).select("s.dir", F.lit("dir").alias("kind"), "s.name", F.lit(0).cast("long").alias("more")).distinct()
    return dirs.unionByName(shown)


def explorer_grep(lines: DataFrame, text: str, *, name_glob: str = "*", limit: int = 100) -> DataFrame:
    """Lines that match in files whose name fits the glob, in order of path and line, the first `limit`."""
    where = T.file_name(F.col("path")).rlike(T.glob_regex(name_glob, names_only=True))
    return grep(lines, text, order=[F.lower("path"), F.col("path"), F.col("line_no")], limit=limit, where=where)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank, and more: how many the group has beyond them."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - k, F.lit(0)))
    return out.filter(F.col("rank") <= k)


#: Names or needles, and bytes of them, that go to all tasks; more are joined by hash.
NAMES, NAMES_SIZE = 100_000, 16 << 20


def _nearby(df: DataFrame, text: str) -> DataFrame:
    """df, to be sent to all tasks if it is counted and measured to be small; only the two numbers reach the driver."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return F.broadcast(df) if n <= NAMES and size <= NAMES_SIZE else df


def mentions(lines: DataFrame, names: DataFrame, *, keys: tuple[str, ...]) -> DataFrame:
    """(keys, name, line_no, n): word mentions of each name, by an equi-join on the lines' words.

    Names are counted and measured first: up to NAMES of them go to all tasks, and
    only words that are names are shuffled.
    """
    words = lines.select(*keys, "line_no", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name"))
    names = names.select("name").distinct()
    return words.join(_nearby(names, "name"), "name").groupBy(*keys, "line_no", "name").agg(F.count("*").alias("n"))


def containing(docs: DataFrame, needles: DataFrame, *, id_col: str, text_col: str, needle_id: str, needle_col: str, width: int = 3) -> DataFrame:
    """(needle_id, id_col) of texts that contain a whole needle.

    A text that contains a needle has the needle's inner words in a row, so the
    pairs to compare come from an equi-join on one run of `width` such words, the
    needle's rarest-looking (longest) one; needles of fewer inner words are joined
    by what they have. contains() then decides on whole texts.
    """
    inner = F.expr("slice(w, 2, greatest(size(w) - 2, 0))")
    n = needles.select(F.col(needle_id).alias("_i"), F.col(needle_col).alias("_n"), F.split(needle_col, r"\s+").alias("w")).withColumn("w", inner)
    n = n.withColumn("k", F.least(F.size("w"), F.lit(width))).filter("_n is not null")

    def runs(c: Column, k: int) -> Column:
        """The runs of k words, by zipping k shifted copies, so that a text is split once and not once a word."""
        shifted = [F.slice(c, j + 1, F.greatest(F.size(c), F.lit(1))).alias(f"w{j}") for j in range(k)]
        whole = F.filter(F.arrays_zip(*shifted), lambda z: z[f"w{k - 1}"].isNotNull())
        return F.transform(whole, lambda z: F.concat_ws(" ", *[z[f"w{j}"] for j in range(k)]))

    best = F.lit(None).cast("string")
    for k in range(1, width + 1):
        longest = F.array_max(F.transform(runs(F.col("w"), k), lambda r: F.struct(F.length(r).alias("l"), r.alias("r"))))["r"]
        best = F.when(F.col("k") == k, longest).otherwise(best)
    n = n.withColumn("anchor", best).drop("w")
    n = _nearby(n, "_n")
    d = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    sizes = [r.k for r in needles.select(F.least(F.greatest(F.size(F.split(needle_col, r"\s+")) - 2, F.lit(0)), F.lit(width)).alias("k")).distinct().collect() if r.k is not None]  # width + 1 values at most
    out = None
    for k in sorted(sizes):
        part = n.filter(F.col("k") == k)
        if k == 0:  # of one or two words: no inner word to look up
            x = d.join(part, F.contains(F.col("_t"), F.col("_n")))
        else:
            x = d.withColumn("anchor", F.explode(F.array_distinct(runs(F.split("_t", r"\s+"), k)))).join(part, "anchor").filter(F.contains(F.col("_t"), F.col("_n")))
        x = x.select(F.col("_i").alias(needle_id), id_col)
        out = x if out is None else out.unionByName(x)
    if out is None:
        return d.join(n, F.lit(False)).select(F.col("_i").alias(needle_id), id_col)
    return out.distinct()


def result_summary(hits: DataFrame) -> DataFrame:
    """One row: matches and files of search results, and the width of their longest path."""
    return hits.agg(F.count("*").alias("matches"), F.count_distinct("path").alias("files"), F.coalesce(F.max(F.length("path")), F.lit(0)).alias("path_width"))


# What a definition of a name looks like, by language family; {} is the name.
DEFINITION_FORMS = {
    "csharp": [r"\b(class|interface|struct|enum|record|delegate|namespace)\s+{}\b", r"[\w<>\[\],?]+\s+{}\s*[({{=;]"],
    "javascript": [r"\b(function|class|interface|type|enum|const|let|var)\s+{}\b", r"\b{}\s*[:=]\s*(async\s+)?(function|\()"],
    "python": [r"\b(def|class)\s+{}\b", r"^\s*{}\s*="],
    "java": [r"\b(class|interface|enum|record)\s+{}\b", r"[\w<>\[\],?]+\s+{}\s*\("],
    "go": [r"\bfunc\s+(\([^)]*\)\s*)?{}\b", r"\b(type|var|const)\s+{}\b"],
}


def definition_search(lines: DataFrame, name: str, *, extension: str | None = None, limit: int = 20) -> DataFrame:
    """Lines that look like a definition of the name in any family, or in that of the extension (as in '*.py')."""
    import re

    families = list(DEFINITION_FORMS)
    if extension:
        lang = T.fixed.LANGUAGE_BY_EXTENSION.get("." + extension.rsplit(".", 1)[-1].lower())
        lang = "javascript" if lang == "typescript" else lang
        families = [lang] if lang in DEFINITION_FORMS else families
        lines = lines.filter(F.lower("path").endswith("." + extension.rsplit(".", 1)[-1].lower()))
    forms = "|".join(f.format(re.escape(name)) for k in families for f in DEFINITION_FORMS[k])
    hits = lines.filter(F.col("text").rlike(f"(?i){forms}"))
    return hits.select("path", "line_no", F.left(F.trim("text"), F.lit(200)).alias("text")).orderBy(F.lower("path"), "path", "line_no").limit(limit)


def explore(lines: DataFrame, words: list[str], *, per_word: int = 30, limit: int = 50) -> DataFrame:
    """Hits of up to ten words, per_word files each, merged, a line once: newest first where times are known."""
    words = words[:10]
    if not words:
        return lines.limit(0)
    x = lines.withColumn("word", F.explode(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.col("text")), F.lower(w)))))
    newest = [F.col("mtime").desc()] * ("mtime" in lines.columns)
    w = Window.partitionBy("word").orderBy(*newest, F.lower("path"), "path")
    x = x.withColumn("k", F.dense_rank().over(w)).filter(F.col("k") <= per_word)
    return x.drop("word", "k").dropDuplicates(["path", "line_no"]).orderBy(*newest, F.lower("path"), "path", "line_no").limit(limit)

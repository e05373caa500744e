"""The registered queries, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounting, config, modules, references, search, sessions, symbols
from ..sources import files as source
from . import synthetic
from .registry import Corpus, call

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.explode_lines(table(spark, sf_dir, "documents"), "text", keys=("doc_id",))


#: Lines by number from 1; a last newline opens none.
_LINES = r"""l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM documents WHERE text IS NOT NULL),
    l1 AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM l0),
    lines AS (SELECT doc_id, unnest(p) AS text, CAST(unnest(range(1, len(p) + 1)) AS INT) AS line_no FROM l1)"""


@query(f"""WITH {_LINES} SELECT doc_id, line_no, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text
    FROM lines WHERE regexp_matches(text, 'TION|heit', 'i') ORDER BY doc_id, line_no LIMIT 100""")
def grep_lines(spark, sf_dir):
    return search.grep(doc_lines(spark, sf_dir), "TION|heit", order=[F.col("doc_id"), F.col("line_no")])


@query(f"""WITH {_LINES} SELECT doc_id, count(*) AS n_lines, CAST(max(length(text)) AS INT) AS longest FROM lines GROUP BY doc_id""")
def line_counts(spark, sf_dir):
    return search.line_counts(table(spark, sf_dir, "documents"), "text", ("doc_id",))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, lpad(CAST(line_no AS VARCHAR), CAST(greatest(length(CAST(line_no AS VARCHAR)), 5) AS INT), ' ') || '| ' || CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS rendered
        FROM lines WHERE line_no > 2 AND line_no <= 42),
    b AS (SELECT *, CAST(sum(strlen(rendered) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS used FROM s)
    SELECT doc_id, line_no, rendered, used FROM b WHERE used <= 2048""")
def read_slice(spark, sf_dir):
    out = search.read_slice(table(spark, sf_dir, "documents"), content="text", keys=("doc_id",), offset=2, max_lines=40, budget=2048)
    return out.select("doc_id", "line_no", "rendered", F.col("used").cast("long").alias("used"))


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(t) > 180 THEN left(t, 180) || '...' ELSE t END AS preview FROM c""")
def truncate_preview(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncate_single_line(F.col("text")).alias("preview"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE (CASE WHEN contains(left(text, 500), chr(10)) AND 500 - strpos(reverse(left(text, 500)), chr(10)) > 400
    THEN left(text, CAST(500 - strpos(reverse(left(text, 500)), chr(10)) AS INT)) ELSE left(text, 500) END) || chr(10) || chr(10) || '[... context truncated for length ...]' END AS context FROM documents""")
def context_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_context(F.col("text"), 500).alias("context"))


def _paths(spark, sf_dir) -> DataFrame:
    p = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", p.alias("path"))


_PATHS = "paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages)"


@query(f"""WITH {_PATHS}, d AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM paths),
    r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY lower(name), name, path) AS rank, count(*) OVER (PARTITION BY dir) AS n FROM d)
    SELECT dir, name, CAST(rank AS INT) AS rank, greatest(n - 3, 0) AS more FROM r WHERE rank <= 3""")
def url_dir_topk(spark, sf_dir):
    f = _paths(spark, sf_dir).select("path").distinct()
    f = f.select("path", T.file_name(F.col("path")).alias("name"), F.array_join(T.directories(F.col("path")), "/").alias("dir"))
    return search.top_per_group(f, ["dir"], [F.lower("name"), F.col("name"), F.col("path")], 3).select("dir", "name", "rank", "more")


@query(f"""WITH {_PATHS}, s AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM paths),
    u AS (SELECT p, unnest(range(1, len(p))) AS k FROM s)
    SELECT DISTINCT array_to_string(p[1:k - 1], '/') AS dir, p[k] AS name FROM u WHERE k <= 3""")
def url_tree(spark, sf_dir):
    return search.tree(_paths(spark, sf_dir)).filter("kind = 'dir'").select("dir", "name")


@query(f"""WITH {_PATHS} SELECT page_id, path FROM paths WHERE regexp_matches(path, '(?i)^blog\\..*/en/[^/]*$') OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)^blog\\..*/en/[^/]*$') ORDER BY path, page_id LIMIT 100""")
def glob_urls(spark, sf_dir):
    return search.glob(_paths(spark, sf_dir), "blog.**/en/*", order=[F.col("path"), F.col("page_id")])


@query("""SELECT source, count(*) AS file_count, round_even(sum(strlen(text)) / 1048576.0, 2) AS size_mb FROM documents GROUP BY source""")
def storage_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("size"))
    return accounting.folder_totals(d, "source", "size")


@query("""SELECT source, sum(strlen(text)) / 1048576.0 AS used_mb, sum(strlen(text)) / 1048576.0 + 0.4 <= 0.5 AS allowed FROM documents GROUP BY source""")
def quota_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("size"))
    return accounting.quota_check(d, "source", "size", add_mb=0.4, quota_mb=0.5)


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL)
    SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS k FROM c) WHERE k = 1""")
def dominant_lang(spark, sf_dir):
    return accounting.dominant(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("""SELECT user_id, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 120 MINUTE""")
def expired_users(spark, sf_dir):
    return accounting.expired(accounting.last_activity(table(spark, sf_dir, "events"), "user_id", "ts"), "2024-01-31 00:00:00", "120 MINUTES")


@query("""SELECT c_custkey, left(sha256(lower(c_name)), 16) AS user_hash FROM customer""")
def user_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.user_hash(F.col("c_name")).alias("user_hash"))


_LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)"""


def _links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


@query(f"""WITH {_LINKS} SELECT page_id, target, count(*) AS n FROM links GROUP BY ALL""")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages),
    e AS (SELECT src, regexp_extract(target, '^/([^/]*)', 1) AS dst FROM l WHERE target LIKE '/%')
    SELECT src, dst, count(*) AS refs FROM e WHERE src <> dst GROUP BY ALL ORDER BY src, refs DESC, dst""")
def site_edges(spark, sf_dir):
    e = _links(spark, sf_dir).filter(F.col("target").startswith("/"))
    e = e.select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("src"), F.regexp_extract("target", r"^/([^/]*)", 1).alias("dst"))
    return e.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("refs")).orderBy("src", F.col("refs").desc(), "dst")


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS v,
        CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS p, user_id FROM events)
    SELECT user_id, arg_min(v, (p, event_id)) AS value, min(p) AS precedence FROM e GROUP BY user_id""")
def config_props(spark, sf_dir):
    p = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "props", p.alias("precedence"))
    found = config.config_entries(e.select(F.col("event_id").cast("string").alias("path"), F.lit("json").alias("format"), "precedence", F.col("props").alias("content")), formats=("json",))
    found = found.filter("key = 'k'").join(e.select(F.col("event_id").cast("string").alias("path"), "user_id", "event_id"), "path")
    return found.groupBy("user_id").agg(F.min_by(F.col("value").cast("bigint"), F.struct("precedence", "event_id")).alias("value"), F.min("precedence").alias("precedence"))


@query(f"""WITH {_LINES}, n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM benchmark),
    w AS (SELECT d.lang, unnest(regexp_extract_all(l.text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM lines l JOIN documents d USING (doc_id))
    SELECT lang, name, count(*) AS n FROM w JOIN n USING (name) GROUP BY ALL""")
def mentions_by_lang(spark, sf_dir):
    """How often each word of the benchmark is mentioned in each language."""
    docs = table(spark, sf_dir, "documents")
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name"))
    lines = search.explode_lines(docs, "text", keys=("doc_id", "lang"))
    return search.mentions(lines, names, keys=("doc_id", "lang")).groupBy("lang", "name").agg(F.sum("n").alias("n"))


@query(f"""WITH {_LINES}, n AS (SELECT DISTINCT lower(unnest(string_split(name, ' '))) AS name FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'the und la')),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM lines)
    SELECT doc_id, name, CAST(least(30, 8 * count(*)) AS INT) AS score FROM w JOIN n USING (name) GROUP BY ALL""")
def mention_score(spark, sf_dir):
    """Eight a mention up to 30, of the words of regions and nations, and three that occur."""
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).union(table(spark, sf_dir, "nation").select("n_name")).union(spark.createDataFrame([("the und la",)], "name string"))
    names = names.select(F.explode(F.split(F.lower("name"), " ")).alias("name"))
    found = search.mentions(doc_lines(spark, sf_dir), names, keys=("doc_id",)).groupBy("doc_id", "name").agg(F.sum("n").alias("n"))
    return found.select("doc_id", "name", F.least(F.lit(30), 8 * F.col("n")).cast("int").alias("score"))


@query("""SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def dependents_semi(spark, sf_dir):
    """Documents that contain a whole test item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search.containing(docs, items, id_col="doc_id", text_col="text", needle_id="item_id", needle_col="text")


@query("""SELECT conv_id, CAST(floor(sum(length(text)) / 3) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def history_tokens(spark, sf_dir):
    return sessions.token_estimate(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("""WITH n AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    k AS (SELECT *, greatest(2, CAST(floor(n / 5) AS BIGINT)) AS k FROM n)
    SELECT conv_id, turn, CASE WHEN back <= least(n, k + k % 2) THEN 'keep' ELSE 'compress' END AS part FROM k""")
def history_split(spark, sf_dir):
    return sessions.history_split(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "part")


@query(r"""WITH q AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(text, '\b[A-Za-z_][a-z0-9]*[A-Z][A-Za-z0-9_]*\b')) AS names FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^\s*$') THEN 'Standard' WHEN regexp_matches(text, '(?i)how does .* work|trace|end[- ]to[- ]end|explain the flow|what happens when|impact of|architecture|walk me through|流程|架構|為什麼') OR words > 40 OR names >= 3 THEN 'Complex'
    WHEN regexp_matches(text, '(?i)^\s*(where is|what is|which file|what does|show me the definition of|find the definition of|哪個檔案|在哪|是什麼|定義在哪)\b') AND words < 20 AND names <= 1 THEN 'Simple' ELSE 'Standard' END AS complexity FROM q""")
def complexity_class(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return q.select("conv_id", "turn", T.complexity(F.col("text")).alias("complexity"))


_STOP = ", ".join(f"'{w}'" for w in T.fixed.KEYWORD_STOP_WORDS)


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r,.?!:;()\\[\\]{{}}"'']+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], lower(w))) AS ws FROM conversations WHERE role = 'user'),
    u AS (SELECT conv_id, turn, ws, list_transform(ws, lambda x: lower(x)) AS ls FROM w)
    SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(ls, lower(x)) = i)[1:5], ' ') AS keywords FROM u""")
def keywords_top5(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return q.select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, s""")
def session_activity(spark, sf_dir):
    return sessions.activity_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 300)


@query("""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), a AS (SELECT user_id, ts FROM events WHERE event_type = 'click')
    SELECT q.event_id, q.user_id, q.ts, min(a.ts) AS answered_at FROM q LEFT JOIN a ON a.user_id = q.user_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 5 MINUTE GROUP BY ALL""")
def answer_within_5m(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = sessions.answered_within(e, F.col("event_type") == "view", F.col("event_type") == "click", "user_id", "ts", "5 MINUTES")
    return out.select("event_id", "user_id", "ts", "answered_at")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return e.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


_ROLES = " ".join(f"WHEN folder IN ({', '.join(repr(n.lower()) for n in names)}) THEN '{label}'" for names, label in T.fixed.ROLE_RULES)


@query(f"""WITH {_PATHS}, d AS (SELECT lower(unnest(string_split(path, '/'))) AS folder FROM paths UNION ALL SELECT lower(unnest(['Services', 'api', 'DAL', 'Specs', 'x'])))
    SELECT folder, CASE {_ROLES} ELSE 'Other' END AS role, count(*) AS n FROM d GROUP BY ALL""")
def role_of_path(spark, sf_dir):
    """The role of every segment of the pages' addresses, and of five that have one."""
    d = _paths(spark, sf_dir).select(F.explode(F.split("path", "/")).alias("folder")).union(spark.createDataFrame([(x,) for x in ("Services", "api", "DAL", "Specs", "x")], "folder string"))
    return d.groupBy(F.lower("folder").alias("folder")).agg(F.first(modules.role(F.col("folder"))).alias("role"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, text, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 4 OR back <= 2""")
def session_ring(spark, sf_dir):
    return sessions.session_ring(table(spark, sf_dir, "conversations"), "conv_id", "turn", over=4, keep=2).select("conv_id", "turn", "text", "role")


@query(f"""WITH {_LINES}, b AS (SELECT doc_id, line_no, length(regexp_replace(text, '[^e]', '', 'g')) - length(regexp_replace(text, '[^a]', '', 'g')) AS net FROM lines),
    s AS (SELECT *, sum(net) OVER w AS s FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT doc_id, line_no, CAST(s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line_no)) AS BIGINT) AS depth FROM s""")
def clamped_depth(spark, sf_dir):
    """A running balance that never falls below 0, here of two letters."""
    return search.clamped_depth(table(spark, sf_dir, "documents"), "e", "a", content="text", keys=("doc_id",))


def _corpus(spark, sf_dir) -> Corpus:
    """A package for each document."""
    return Corpus(synthetic.python_files(synthetic.ids(table(spark, sf_dir, "documents"), "doc_id")))


def _first(spark, sf_dir) -> int:
    return table(spark, sf_dir, "documents").agg(F.min("doc_id")).first()[0]


#: The IDs d, their extra functions n, and the first ID m.
_IDS = "d AS (SELECT doc_id AS d, CAST(doc_id % 3 AS INT) AS n, CAST(doc_id AS VARCHAR) AS t FROM documents), m AS (SELECT d AS m, t, n FROM d ORDER BY d LIMIT 1), x AS (SELECT d, t, n, unnest(range(1, n + 1)) AS k FROM d)"
#: The declarations of the packages: path, name, kind, containing, start_line, end_line.
_SYMBOLS = """sy AS (SELECT 'pkg' || t || v.p AS path, v.f || CASE WHEN v.f = 'get' THEN '' ELSE t END AS name, v.k AS kind, CASE WHEN v.f = 'get' THEN 'Store' || t ELSE '(global)' END AS containing, v.a AS start_line,
        CASE WHEN v.f = 'parse' AND n > 0 THEN 18 ELSE v.e END AS end_line
    FROM d, (VALUES ('/app.py', 'main', 'function', 3, 7), ('/app.py', 'load', 'function', 8, 12), ('/app.py', 'save', 'function', 13, 15), ('/app.py', 'parse', 'function', 16, 17), ('/store.py', 'Store', 'class', 1, 3), ('/store.py', 'get', 'function', 3, 3), ('/tests/test_app.py', 'test_load', 'function', 2, 3)) AS v(p, f, k, a, e)
    UNION ALL SELECT 'pkg' || t || '/app.py', 'extra' || t || '_' || k, 'function', '(global)', 16 + 3 * k, 17 + 3 * k + CASE WHEN k < n THEN 1 ELSE 0 END FROM x)"""
#: Their calls: path, src, seq, dst, line, dst_path, label.
_CALLS = """ca AS (SELECT 'pkg' || t || v.p AS path, v.s || t AS src, v.q AS seq, v.c || t AS dst, v.l AS line, CASE WHEN v.o IS NOT NULL THEN 'pkg' || t || v.o END AS dst_path, CASE WHEN v.o IS NULL THEN 'unresolved' ELSE '' END AS label
    FROM d, (VALUES ('/app.py', 'main', 1, 'Store', 4, '/store.py'), ('/app.py', 'main', 2, 'load', 5, '/app.py'), ('/app.py', 'main', 3, 'save', 6, '/app.py'), ('/app.py', 'load', 1, 'parse', 9, '/app.py'), ('/app.py', 'load', 2, 'save', 10, '/app.py'), ('/app.py', 'save', 1, 'flush', 14, NULL), ('/app.py', 'parse', 1, 'parse', 17, '/app.py'), ('/tests/test_app.py', 'test_load', 1, 'load', 3, '/app.py')) AS v(p, s, q, c, l, o)
    UNION ALL SELECT 'pkg' || t || '/app.py', 'extra' || t || '_' || k, 1, 'save' || t, 17 + 3 * k, 'pkg' || t || '/app.py', '' FROM x)"""


@query(f"WITH {_IDS}, {_SYMBOLS} SELECT path, name, kind, containing, start_line, end_line FROM sy")
def symbols_py(spark, sf_dir):
    return _corpus(spark, sf_dir).symbols.select("path", "name", "kind", "containing", "start_line", "end_line")


@query(f"WITH {_IDS}, {_CALLS} SELECT path, src, seq, dst, line, dst_path, label FROM ca")
def call_edges(spark, sf_dir):
    """Every call of every package; print and len are the language's own."""
    return _corpus(spark, sf_dir).call_edges().select("path", "src", "seq", "dst", "line", "dst_path", "label")


_DOWN = """SELECT v.s || t AS src, v.c || t AS dst, v.l AS line, v.b AS label, v.r AS is_true_cycle FROM m, (VALUES ('main', 'Store', 4, '', false), ('main', 'load', 5, '', false), ('main', 'save', 6, '', false),
    ('load', 'parse', 9, '', false), ('load', 'save', 10, 'cycle', false), ('save', 'flush', 14, 'unresolved', false){}) AS v(s, c, l, b, r)"""


@query(f"WITH {_IDS} {_DOWN.format('')}")
def call_graph_down(spark, sf_dir):
    return call("call_graph", _corpus(spark, sf_dir), symbol=f"main{_first(spark, sf_dir)}").select("src", "dst", "line", "label", "is_true_cycle")


_DEEP = _DOWN.format(", ('parse', 'parse', 17, 'recursive', true)")


@query(f"WITH {_IDS} {_DEEP}")
def call_graph_deep(spark, sf_dir):
    return call("call_graph", _corpus(spark, sf_dir), symbol=f"main{_first(spark, sf_dir)}", depth=3).select("src", "dst", "line", "label", "is_true_cycle")


@query(f"WITH {_IDS}, {_CALLS} SELECT src, dst, line FROM ca, m WHERE dst = 'save' || m.t")
def call_graph_up(spark, sf_dir):
    return call("call_graph", _corpus(spark, sf_dir), symbol=f"save{_first(spark, sf_dir)}", depth=1, direction="upstream").select("src", "dst", "line")


@query(f"WITH {_IDS} SELECT count(*) AS edges, 1 AS unresolved, 1 AS cycle, 0 AS recursive FROM ({_DOWN.format('')})")
def graph_summary(spark, sf_dir):
    graph = call("call_graph", _corpus(spark, sf_dir), symbol=f"main{_first(spark, sf_dir)}")
    return references.edge_summary(graph).select("edges", F.col("unresolved").cast("int").alias("unresolved"), F.col("cycle").cast("int").alias("cycle"), F.col("recursive").cast("int").alias("recursive"))


_REFS = "SELECT 'pkg' || t || v.p AS path, v.l AS line_no, v.k AS kind, CASE WHEN v.c = '' THEN '(global)' ELSE v.c || t END AS containing, v.e AS is_test FROM m, (VALUES ('/app.py', 5, 'call', 'main', false), ('/tests/test_app.py', 1, 'import', '', true), ('/tests/test_app.py', 3, 'call', 'test_load', true)) AS v(p, l, k, c, e)"


@query(f"WITH {_IDS} {_REFS}")
def refs(spark, sf_dir):
    return call("find_references", _corpus(spark, sf_dir), symbol=f"load{_first(spark, sf_dir)}").drop("text")


@query(f"WITH {_IDS}, r AS ({_REFS}) SELECT path, count(*) AS n, 0 AS more FROM r GROUP BY path")
def refs_by_file(spark, sf_dir):
    found = call("find_references", _corpus(spark, sf_dir), symbol=f"load{_first(spark, sf_dir)}")
    return references.references_by_file(found).select("path", "n", F.col("more").cast("int").alias("more"))


@query(f"""WITH {_IDS}, s AS (SELECT 'pkg' || d.t || '/tests/test_app.py' AS path, 'test_load' || d.t AS name, CASE WHEN d.d = m.m THEN 55 ELSE 20 END AS c, CASE WHEN d.d = m.m THEN 16 + 35 ELSE 20 END AS score
        FROM d, m WHERE contains('test_load' || d.t, 'load' || m.t))
    SELECT path, 'pytest' AS framework, score, CASE WHEN score >= 40 THEN 'medium' ELSE 'low' END AS confidence, name AS case_name, 2 AS line, c AS case_score FROM s ORDER BY score DESC, path LIMIT 20""")
def tests_scored(spark, sf_dir):
    t = call("find_tests", _corpus(spark, sf_dir), symbol=f"load{_first(spark, sf_dir)}").select("path", "framework", "score", "confidence", F.explode("cases").alias("c"))
    return t.select("path", "framework", "score", "confidence", F.col("c.name").alias("case_name"), F.col("c.line").alias("line"), F.col("c.score").cast("int").alias("case_score"))


@query(f"WITH {_IDS} SELECT 'pkg' || t || p AS module, r AS role, CAST(c AS BIGINT) AS file_count FROM d, (VALUES ('', 'Other', 3), ('/tests', 'Tests', 1)) AS v(p, r, c)")
def module_map(spark, sf_dir):
    return call("repo_map", _corpus(spark, sf_dir), include_dependencies=False)


@query(f"WITH {_IDS} SELECT 'pkg' || t || '/tests' AS src, 'pkg' || t AS dst, CAST(1 AS BIGINT) AS refs FROM d")
def module_dependencies(spark, sf_dir):
    return call("module_dependencies", _corpus(spark, sf_dir))


@query(f"""WITH {_IDS}, f AS (SELECT 'pkg' || d.t || p AS path FROM d, m, (VALUES ('/app.py'), ('/store.py')) AS v(p) WHERE contains('Store' || d.t, 'Store' || m.t) AND NOT (d.d = m.m AND p = '/store.py'))
    SELECT 'dependent' AS relation, path FROM (SELECT path FROM f ORDER BY path LIMIT 20)""")
def related_files(spark, sf_dir):
    """The store imports nothing; the files that name its class depend on it."""
    return call("get_related_files", _corpus(spark, sf_dir), file_path=f"pkg{_first(spark, sf_dir)}/store.py")


@query(f"WITH {_IDS} SELECT 'pkg' || t || v.p AS path, 'python' AS language, 1 AS line_no, 'pkg' || t || v.i AS target FROM d, (VALUES ('/app.py', '.store'), ('/tests/test_app.py', '.app')) AS v(p, i)")
def import_lines(spark, sf_dir):
    return _corpus(spark, sf_dir).imports


@query(f"WITH {_IDS} SELECT 'found' AS status, 'pkg' || t || '/app.py' AS path, 8 AS start_line FROM m")
def resolve_symbol(spark, sf_dir):
    return references.resolve(_corpus(spark, sf_dir).symbols, f"load{_first(spark, sf_dir)}").select("status", "path", "start_line")


@query(f"""WITH {_IDS} SELECT v.l AS line_no, 0 AS depth, 'def ' || v.f || t || v.a || ':' AS signature FROM m, (VALUES (3, 'main', '()'), (8, 'load', '(s)'), (13, 'save', '(s)'), (16, 'parse', '(s)')) AS v(l, f, a)
    UNION ALL SELECT 16 + 3 * k, 0, 'def extra' || x.t || '_' || k || '():' FROM x, m WHERE x.d = m.m""")
def file_outline(spark, sf_dir):
    return call("get_file_outline", _corpus(spark, sf_dir), file_path=f"pkg{_first(spark, sf_dir)}/app.py")


@query(f"WITH {_IDS} SELECT 'pkg' || t || '/app.py' AS path, 8 AS line_no, 'def load' || t || '(s):' AS text FROM m")
def definition_lines(spark, sf_dir):
    return call("definition_search", _corpus(spark, sf_dir), symbol=f"load{_first(spark, sf_dir)}", include="*.py")


@query(f"""WITH {_IDS}, {_CALLS} SELECT 'save' || m.t AS name, v.r AS relation, 'pkg' || m.t || '/app.py' AS path, v.l AS line FROM m, (VALUES ('definition', 13), ('callee', 14)) AS v(r, l)
    UNION ALL SELECT dst, r, path, line FROM ca, m, (VALUES ('caller'), ('reference')) AS w(r) WHERE dst = 'save' || m.t""")
def symbol_context(spark, sf_dir):
    return call("expand_context", _corpus(spark, sf_dir), symbols=["nothing", f"save{_first(spark, sf_dir)}"]).drop("text")


@query(f"""WITH {_IDS} SELECT 'pkg' || t || '/app.py' AS path, v.l AS line_no, lpad(CAST(v.l AS VARCHAR), 5, ' ') || '| ' || replace(v.x, '#', t) AS text FROM m, (VALUES (8, 'def load#(s):'), (9, '    parse#(s)'), (10, '    save#(s)'), (11, '    print(len(s))'), (12, '')) AS v(l, x)""")
def read_symbol(spark, sf_dir):
    return call("read_symbol", _corpus(spark, sf_dir), symbol=f"load{_first(spark, sf_dir)}")


@query(f"WITH {_IDS}, {_SYMBOLS} SELECT path, name FROM sy WHERE kind = 'class'")
def exported_types(spark, sf_dir):
    return symbols.exported_types(_corpus(spark, sf_dir).symbols)


@query(f"""WITH {_IDS} SELECT 'pkg' || t || '/app.py' AS path, l AS line_no, CASE WHEN l < 3 THEN '(global)' WHEN l < 8 THEN 'main' || t WHEN l < 13 THEN 'load' || t WHEN l < 16 THEN 'save' || t ELSE 'parse' || t END AS containing
    FROM d, (SELECT unnest(range(1, 18)) AS l)""")
def containing_declaration(spark, sf_dir):
    """What holds each of the first 17 lines of the applications; a line above all declarations is global."""
    c = _corpus(spark, sf_dir)
    hits = c.lines.filter("path like '%/app.py' and line_no <= 17").select("path", "line_no")
    return references.enclosing(hits, c.symbols)


def _languages(language: str) -> None:
    """Registers the declarations of a language's template, one file a document."""
    name, _ = synthetic.LANGUAGES[language]
    fill = lambda c: f"replace({c}, '{{d}}', CAST(doc_id AS VARCHAR))"
    rows = ", ".join(f"('{n}', '{k}', '{c}', {a}, {e})" for n, k, c, a, e in synthetic.DECLARED[language])
    path = fill(f"'{name}'")

    def declared(spark, sf_dir):
        files = synthetic.language_files(synthetic.ids(table(spark, sf_dir, "documents"), "doc_id"), language)
        return symbols.extract_symbols(files).select("path", "name", "kind", "containing", "start_line", "end_line")

    declared.__name__ = f"declared_{language}"
    query(f"SELECT {path} AS path, {fill('v.n')} AS name, v.k AS kind, {fill('v.c')} AS containing, v.a AS start_line, v.e AS end_line FROM documents, (VALUES {rows}) AS v(n, k, c, a, e)")(declared)


for _language in synthetic.LANGUAGES:
    _languages(_language)


def _configs(language: str) -> None:
    """Registers the lookup of a key in a language's configuration files, whose values are counts of documents."""
    _, files = synthetic.CONFIGS[language]
    value = lambda k, text: f"CAST((SELECT count(*) FROM documents) + {k} AS VARCHAR)" + (" || '.0'" if "{v}.0" in text else "")
    rows = " UNION ALL ".join(f"SELECT '{path}' AS path, {n} AS precedence, '{key}' AS key, {value(k, text)} AS value, {line} AS line_no" for k, (path, n, text, key, line) in enumerate(files))

    def effective(spark, sf_dir):
        counted = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
        found = config.config_lookup(synthetic.config_corpus(counted, language), "KEY")
        return found.select("path", "precedence", "key", "value", "line_no", "is_effective")

    effective.__name__ = f"config_{language}"
    query(f"WITH f AS ({rows}) SELECT path, precedence, key, value, line_no, row_number() OVER (ORDER BY precedence, path, line_no) = 1 AS is_effective FROM f")(effective)


for _language in synthetic.CONFIGS:
    _configs(_language)


_FORMATS = [
    ("json", '{"Logging":{"Level":{"Default":"W{d}"}},"Hosts":["a","b"],"N":{d},"F":1.0,"E":1e3,"Z":null}', [("Logging", "{...}"), ("Logging:Level", "{...}"), ("Logging:Level:Default", "W{d}"), ("Hosts", "[2 items]"), ("N", "{d}"), ("F", "1.0"), ("E", "1e3"), ("Z", "null")]),
    ("ini", "[db]\nhost = x{d} ; y\n", [("db:host", "x{d} ; y")]),
    ("toml", '[a.b]\nk = "v{d}" # c\n', [("a.b.k", '"v{d}" # c')]),
    ("yaml", 'a:\n  b: "v{d}" # c\n', [("a", "(section)"), ("a.b", "v{d}")]),
    ("python", "  X = 'y{d}'\n", [("X", "y{d}")]),
    ("env", "# no\nA_{d}='b=c'\n", [("A_{d}", "b=c")]),
    ("properties", "! no\nk{d}: v\n", [("k{d}", "v")]),
    ("c-define", "#define N {d} // c\nset(A b{d})\n", [("N", "{d}"), ("A", "b{d}")]),
    ("xml", "<a>{d}</a>", []),
]
_quoted = lambda t: t.replace("'", "''")


@query("SELECT 'f' || doc_id || '.' || v.f AS path, replace(v.k, '{d}', CAST(doc_id AS VARCHAR)) AS key, replace(v.v, '{d}', CAST(doc_id AS VARCHAR)) AS value FROM documents, (VALUES " + ", ".join(f"('{f}', '{_quoted(k)}', '{_quoted(v)}')" for f, _, rows in _FORMATS for k, v in rows) + ") AS v(f, k, v)")
def section_carry(spark, sf_dir):
    """What the readers make of a file of every format for each document."""
    d = synthetic.ids(table(spark, sf_dir, "documents"), "doc_id")
    row = F.array(*[F.struct(F.concat(F.lit("f"), F.col("d").cast("string"), F.lit(f".{f}")).alias("path"), F.lit(f).alias("format"), F.lit(1).alias("precedence"), synthetic.filled(text).alias("content")) for f, text, _ in _FORMATS])
    return config.config_entries(d.select(F.explode(row).alias("f")).select("f.*")).select("path", "key", "value")


_CALL_TEXT = ('x <tool_call>{"name": "read_file", "arguments": {"path": "p{t}"}}</tool_call> <tool_call>{bad</tool_call> <tool_call>{"name":"grep"}</tool_call>', 'y <|channel|>commentary to=repo.search code<|message|>{"query":"p{t}","max_results":3}<|call|>')


@query("""SELECT conv_id, turn, v.i AS call_idx, v.n AS tool_name, replace(v.a, '{t}', CAST(turn AS VARCHAR)) AS arguments FROM conversations, (VALUES (0, 0, 'read_file', '{"path":"p{t}"}'), (0, 2, 'grep', '{}'), (1, 0, 'grep_search', '{"pattern":"p{t}"}')) AS v(p, i, n, a) WHERE turn % 2 = v.p""")
def parse_tool_calls(spark, sf_dir):
    """Calls written in either form, one text a turn."""
    text = F.when(F.col("turn") % 2 == 0, F.lit(_CALL_TEXT[0])).otherwise(F.lit(_CALL_TEXT[1]))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(text, F.lit("{t}"), F.col("turn").cast("string")).alias("content"))
    return sessions.tool_calls(turns, keys=("conv_id", "turn"))


@query("""WITH s AS (SELECT conv_id, turn, '<think>a ' || turn || '</think> b <reasoning>c</reasoning>' || text AS x FROM conversations) SELECT conv_id, turn, 'a ' || turn AS thought, trim('b ' || text, chr(32)) AS said FROM s JOIN conversations USING (conv_id, turn)""")
def thinking_tags(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    x = F.concat(F.lit("<think>a "), F.col("turn").cast("string"), F.lit("</think> b <reasoning>c</reasoning>"), F.col("text"))
    return t.select("conv_id", "turn", sessions.thinking(x).alias("thought"), sessions.without_thinking(x).alias("said"))


@query("""SELECT user_id AS run_id, count(*) AS tool_calls, count(DISTINCT event_type) AS iterations, CAST(sum(event_id) AS BIGINT) AS duration_ms, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tools, CAST(sum(CASE WHEN event_type = 'view' THEN event_id ELSE 0 END) AS BIGINT) AS main_input_tokens,
    CAST(sum(CASE WHEN event_type <> 'view' THEN event_id ELSE 0 END) AS BIGINT) AS sub_input_tokens FROM events GROUP BY user_id""")
def run_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("long")
    calls = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("iteration"), F.col("event_type").alias("tool_name"), n.alias("duration_ms"), n.alias("input_tokens"), F.when(F.col("event_type") == "view", "main").otherwise("sub").alias("agent"))
    return sessions.run_totals(calls).drop("input_tokens").withColumn("tools", F.array_join("tools", ","))


@query("""SELECT user_id AS run_id, array_to_string(list_sort(list(DISTINCT event_type || '.py')), ',') AS files FROM events GROUP BY user_id""")
def files_touched(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    args = F.to_json(F.struct(F.concat("event_type", F.lit(".py")).alias("file_path")))
    return sessions.files_touched(e.select(F.col("user_id").alias("run_id"), args.alias("arguments"))).withColumn("files", F.array_join("files", ","))


@query("""WITH p AS (SELECT source AS folder_id, min(doc_id) AS n FROM documents GROUP BY source) SELECT folder_id, CASE WHEN n % 2 = 0 THEN 'Name ' || n ELSE folder_id END AS display_name, CASE WHEN n % 2 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS created_at FROM p""")
def project_meta(spark, sf_dir):
    """Names and times from metadata; what does not parse leaves the folder's own name."""
    p = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("folder_id")).agg(F.min("doc_id").alias("n"))
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    meta = source.project_meta_json(p.select("folder_id", F.concat(F.lit("Name "), F.col("n").cast("string")).alias("display_name"), at.alias("created_at")))
    x = p.join(meta, "folder_id").select("folder_id", F.when(F.col("n") % 2 == 0, F.col("content")).otherwise("{broken").alias("content"))
    return source.project_meta(x).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, line_no, CASE WHEN contains(lower(text), 'heit') THEN 1 ELSE 2 END AS w FROM lines WHERE contains(lower(text), 'heit') OR contains(lower(text), 'tion')),
    f AS (SELECT doc_id, word FROM (SELECT DISTINCT doc_id, word FROM lines, (VALUES ('heit'), ('tion')) AS v(word) WHERE contains(lower(text), word)) QUALIFY row_number() OVER (PARTITION BY word ORDER BY lower('d' || doc_id), 'd' || doc_id) <= 30)
    SELECT DISTINCT 'd' || doc_id AS path, line_no FROM lines JOIN f USING (doc_id) WHERE contains(lower(text), word) ORDER BY lower('d' || doc_id), 'd' || doc_id, line_no LIMIT 50""")
def explore_words(spark, sf_dir):
    """Hits of two words, thirty files each, merged, a line once."""
    lines = doc_lines(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "line_no", "text")
    return search.explore(lines, ["heit", "tion"]).select("path", "line_no")


@query("""WITH t AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, last + 1, 'user', 'more' FROM t""")
def session_append(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    new = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("more").alias("text"))
    return sessions.appended(turns, new, "conv_id", "turn")


_EXTENSIONS = [".py", ".exe", ".cs", ".md", ".TOML"]


@query("""WITH f AS (SELECT doc_id, ['.py', '.exe', '.cs', '.md', '.TOML'][1 + doc_id % 5] AS e, CASE WHEN doc_id % 7 = 0 THEN 'bin/' WHEN doc_id % 11 = 0 THEN '../' ELSE 'a/' END AS dir, strlen(coalesce(text, '')) AS size FROM documents)
    SELECT doc_id, CASE WHEN dir = '../' THEN 'path' WHEN e = '.exe' OR dir = 'bin/' THEN 'type' WHEN size > 1048.576 THEN 'size' END AS reason FROM f""")
def upload_gate(spark, sf_dir):
    """Paths, types and sizes that an upload refuses."""
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 0, "bin/").when(F.col("doc_id") % 11 == 0, "../").otherwise("a/")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("f"), ext).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return source.uploads(d, max_mb=0.001).select("doc_id", "reason")


@query("""WITH f AS (SELECT doc_id, ['.py', '.exe', '.cs', '.md', '.TOML'][1 + doc_id % 5] AS e FROM documents)
    SELECT doc_id, CASE e WHEN '.py' THEN 'python' WHEN '.cs' THEN 'csharp' END AS language, e = '.exe' AS is_binary, e IN ('.py', '.cs', '.TOML') AS is_code, e IN ('.py', '.cs', '.exe', '.TOML') AS is_searched, e IN ('.py', '.cs') AS is_plain FROM f""")
def file_kinds(spark, sf_dir):
    """The language of a path, and which scans take it."""
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/f"), F.col("doc_id").cast("string"), ext).alias("path"))
    out = d.select("doc_id", T.language(F.col("path")).alias("language"), T.binary_path(F.col("path")).alias("is_binary"))
    for name, scan in (("is_code", source.code_files), ("is_searched", source.search_files), ("is_plain", source.plain_search_files)):
        out = out.join(scan(d).select("doc_id", F.lit(True).alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query("""WITH h AS (SELECT source AS path, doc_id % 9 AS line_no, doc_id FROM documents) SELECT path, CAST(line_no AS BIGINT) AS line_no, min(doc_id) AS doc_id FROM h GROUP BY ALL""")
def first_hits(spark, sf_dir):
    """One hit a place, the first."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), (F.col("doc_id") % 9).cast("long").alias("line_no"), "doc_id")
    return accounting.dedupe_hits(d, [F.col("doc_id")])


@query(f"""WITH {_IDS} SELECT count(*) * 3 AS matches, count(*) * 3 AS files, max(length('pkg' || t || '/tests/test_app.py')) AS path_width FROM d""")
def search_summary(spark, sf_dir):
    """Matches, files and the widest path of a search for the lines that define what has the ID in its name first."""
    c = _corpus(spark, sf_dir)
    hits = c.symbols.filter("(path like '%/app.py' and name like 'main%') or kind = 'class' or name like 'test_load%'")
    return search.result_summary(hits.select("path")).select("matches", "files", F.col("path_width").cast("long").alias("path_width"))


@query(f"""WITH {_IDS} SELECT 'pkg' || t || '/tests/test_app.py' AS path FROM d""")
def candidate_tests(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return references.candidate_test_files(c.files, c.cases)


@query(f"""WITH {_IDS} SELECT path, CASE regexp_extract(path, '([^/]*)$', 1) WHEN 'app.py' THEN 'Python application entry' END AS description FROM (SELECT 'pkg' || t || '/app.py' AS path FROM d)""")
def entry_points(spark, sf_dir):
    return modules.entry_points(_corpus(spark, sf_dir).files)


@query("""SELECT page_id, url AS package FROM pages WHERE length(html) % 2 = 0 AND NOT contains(url, '&')""")
def page_packages(spark, sf_dir):
    """Package references of a project file made of each page: its address is not escaped, and some close no element, so many are malformed."""
    x = table(spark, sf_dir, "pages")
    end = F.when(F.length("html") % 2 == 0, "</p:Project>").otherwise("<open></p:Project>")
    content = F.concat(F.lit('<?xml version="1.0"?><p:Project xmlns:p="urn:p"><PackageReference Version="1" Include="'), F.col("url"), F.lit('"/><Package Include="no"/>'), end)
    return x.select("page_id", F.explode(T.xml_attributes(content, "PackageReference", "Include")).alias("package"))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[a-z]{4,}')"


@query(f"""
    WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS d, {_WORDS} AS w FROM documents),
         c AS (SELECT d, w, unnest(range(1, len(w) // 3 + 1)) AS k FROM w),
         e AS (SELECT 'd' || d || '.py' AS path, 'f' || d AS src, w[3 * k - 1] || '_' || d AS dst, k FROM c)
    SELECT path, src, dst, CAST(2 + 3 * (min(k) - 1) AS INT) AS line FROM e GROUP BY path, src, dst
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY min(k)) <= 50""")
def calls_beside_strings(spark, sf_dir):
    """Calls in a function made of each document's words: of three words one is called, one stands in a string and one in a comment."""
    d = F.col("doc_id").cast("string")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{4,}"), F.lit(0))
    x = table(spark, sf_dir, "documents").select(d.alias("d"), words.alias("w"))
    name = lambda k: F.concat(F.get("w", k), F.lit("_"), F.col("d"))
    part = lambda k: F.concat(F.lit("    "), name(3 * k - 2), F.lit('(1)\n    s = "'), name(3 * k - 3), F.lit('(2)"  # '), name(3 * k - 1), F.lit('(3)\n    """'), name(3 * k - 3), F.lit('(4)"""\n'))
    body = F.when(F.size("w") >= 3, F.array_join(F.transform(F.sequence(F.lit(1), F.floor(F.size("w") / 3).cast("int")), part), "")).otherwise("    pass\n")
    files = x.select(F.concat(F.lit("d"), F.col("d"), F.lit(".py")).alias("path"), F.concat(F.lit("def f"), F.col("d"), F.lit("():\n"), body).alias("content"))
    return references.scanned_sites(symbols.extract_calls(files)).select("path", "src", "dst", "line")


@query("""
    WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s, l || '/' || s AS module FROM documents),
         held AS (SELECT DISTINCT module FROM d)
    SELECT d.module AS src, held.module AS dst, count(*) AS refs FROM d JOIN held ON held.module = 'en/' || d.s WHERE d.module <> held.module GROUP BY ALL""")
def namespace_edges(spark, sf_dir):
    """Edges between the folders of a C# file a document, by the namespaces that the files declare and use."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("l"), F.coalesce("source", F.lit("none")).alias("s"))
    content = F.concat(F.lit("using System;\nusing Corp.en."), F.col("s"), F.lit(".Deep.Down;\nusing Corp.en."), F.col("s"), F.lit("x;\n\nnamespace Corp."), F.col("l"), F.lit("."), F.col("s"), F.lit(";\n\nclass C"), F.col("doc_id").cast("string"), F.lit("\n{\n}\n"))
    files = x.select(F.concat_ws("/", "l", "s", F.concat(F.lit("F"), F.col("doc_id").cast("string"), F.lit(".cs"))).alias("path"), content.alias("content"))
    return modules.module_edges(symbols.imports(files), files, modules.modules(files))


@query("""
    WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, text, coalesce(role = 'system', false) AS system, bool_or(coalesce(role = 'system', false)) OVER (PARTITION BY conv_id) AS replaced FROM conversations)
    SELECT session_id, count(*) AS turns, CASE WHEN any_value(replaced) THEN max(turn) ELSE count(*) END AS last_seq, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars
    FROM t WHERE system OR NOT replaced GROUP BY session_id""")
def session_store(spark, sf_dir):
    """Conversations in a versioned store: appended in two parts, then those with a system turn replaced by it alone."""
    import uuid

    from ..operators.keep import shared_folder
    from ..sources.store import Sessions

    store = Sessions(spark, f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}")
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.col("text").alias("content"), (F.col("role") == "system").alias("is_summary"))
    store.append(x.where("seq < 2"))
    store.append(x.where("seq >= 2"))
    store.replace(x.where("is_summary"))
    return store.turns().groupBy("session_id").agg(F.count("*").alias("turns"), F.max("seq").alias("last_seq"), F.sum(F.char_length(F.coalesce("content", F.lit("")))).alias("chars"))

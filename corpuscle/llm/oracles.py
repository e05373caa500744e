"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"


def _shingle_sets(table: str, key: str) -> str:
    """A query of (key, s): the distinct 5-word shingles, lower-cased; shorter texts whole."""
    words = _WORDS.format(_LOWER.format("text"))
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
              FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"""


def _trie_sql() -> str:
    """The trie from whole prefixes, compared as lists of turns."""
    crc = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'),
        lambda c: list_prepend(CAST(ascii(c) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
        lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""
    return f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
             h AS (SELECT conv_id, own, xor({crc}, 4294967295) % 6 AS h FROM c),
             r AS (SELECT h.conv_id, coalesce(b.own, [])[:h.h] || h.own[h.h + 1:] AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
             p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
             m AS (SELECT depth, turns[:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                          string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends FROM p GROUP BY ALL),
             k AS (SELECT prefix[:depth - 1] AS prefix, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
             n AS (SELECT m.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(m.prefix[depth].t) ELSE 0 END AS saved FROM m LEFT JOIN k USING (prefix)),
             u AS (SELECT prefix[:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
                   FROM (SELECT *, unnest(range(depth + 1)) AS up FROM n) GROUP BY ALL)
        SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM n JOIN u USING (prefix) LEFT JOIN m a ON n.depth > 0 AND a.prefix = n.prefix[:n.depth - 1]"""


def _clusters_sql(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """The rounds one after the other, every vector against every centroid."""
    nearest = lambda c: f"""SELECT i, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
            SELECT i, cluster, CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM e CROSS JOIN {c}) GROUP BY i"""
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY s NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS w
            FROM (SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS s FROM e ORDER BY s NULLS LAST, v LIMIT {k}))""",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})",
            f"""s{r} AS (SELECT cluster, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range({width})) AS p FROM a{r} JOIN e USING (i)) GROUP BY ALL)""",
            f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.w, c{r}.w) AS w FROM c{r} LEFT JOIN (SELECT cluster, list(x ORDER BY p) AS w FROM s{r} GROUP BY cluster) m USING (cluster))""",
        ]
    return f"""
        WITH {", ".join(parts)}, f AS ({nearest(f"c{rounds}")})
        SELECT vec_id, f.cluster, f.distance, CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(f.distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(w, ',')) AS centroid_sha256
        FROM f JOIN e USING (i) JOIN c{rounds} c ON c.cluster = f.cluster"""


ORACLES: dict[str, str] = {
    "op12_prefix_trie": _trie_sql(),
    "op13_kd_clusters": _clusters_sql(),
    "op10_contained_items": f"""
        WITH d AS ({_shingle_sets("documents", "doc_id")}),
             b AS ({_shingle_sets("benchmark", "item_id")}),
             n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
             x AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM d JOIN b USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment
        FROM x JOIN n USING (item_id) WHERE 5 * shared_shingles >= 4 * item_shingles""",
    "op9_near_duplicates": f"""
        WITH RECURSIVE d AS ({_shingle_sets("documents", "doc_id")}),
             n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
             x AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM d p JOIN d q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
             links AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
        FROM documents JOIN reach ON a = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op1_line_dedup": r"""
        WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             l AS (SELECT doc_id, ln, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
                   FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM a)),
             c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS upto FROM l WHERE w > 0),
             d AS (SELECT doc_id, list(line ORDER BY ln) AS ls, list(ln ORDER BY ln) AS lns, list(w ORDER BY ln) AS ws, list(upto ORDER BY ln) AS us FROM c GROUP BY doc_id),
             p AS (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM d),
             e AS (SELECT *, p AS s, len(list_filter(us, lambda u: u < us[p] - ws[p] + 50)) + 1 AS e FROM p),
             -- every run of 50 words or more is covered by the shortest ones from its lines on and the shortest ones up to them
             f AS (SELECT *, len(list_filter(us, lambda u: u <= us[p] - 50)) + 1 AS s, p AS e FROM p WHERE us[p] >= 50),
             x AS (SELECT DISTINCT doc_id, s, ls[s:e] AS run, lns[s:e] AS gone FROM (SELECT doc_id, s, e, ls, lns FROM e WHERE e <= len(ls) UNION ALL SELECT doc_id, s, e, ls, lns FROM f)),
             r AS (SELECT doc_id, gone, row_number() OVER same AS k, first_value(doc_id) OVER same AS d, first_value(gone) OVER same AS f FROM x WINDOW same AS (PARTITION BY run ORDER BY doc_id, s)),
             -- of a member that overlaps the first one, what lies in that stays
             g AS (SELECT DISTINCT doc_id, ln FROM (SELECT doc_id, d, f, unnest(gone) AS ln FROM r WHERE k > 1) WHERE doc_id <> d OR ln > f[-1])
        SELECT l.doc_id, CAST(count(*) FILTER (w > 0) AS BIGINT) AS n_lines, count(g.ln) AS n_deleted,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY l.ln) FILTER (g.ln IS NULL), '')) AS text_sha256
        FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.ln = l.ln GROUP BY l.doc_id""",
    "op8_quality": r"""
        WITH a AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             t AS (SELECT doc_id, ws[i:i + 7] AS g, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM a)),
             twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
             r AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
             l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM a)
                   WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
             b AS (SELECT doc_id, text, len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS again, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.c, 0) AS n_dup_lines, coalesce(r.c, 0) AS n_repeat_words,
                          length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters,
                          length(regexp_replace(text, '[^!]', '', 'g')) AS marks
                   FROM a LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
             f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 2 * letters < word_chars
               OR (letters > 40 AND 2 * upper > letters) OR 2 * marks > n_words OR 10 * again > 3 * n_words) AS kept
        FROM f""",
    "op2_warc_round_trip": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
}

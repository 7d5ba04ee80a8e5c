"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
b AS (SELECT *, (sum(source_size) OVER () * 150)::DOUBLE AS total,
        coalesce(sum(source_size) OVER o, 0) AS before_s, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
      FROM p WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, source IS NULL, source::BLOB ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total / 100 - 2 * before_s::DOUBLE) / rest::DOUBLE AS level FROM b),
f AS (SELECT *, level * w < 2 * source_size AS free FROM l),
h AS (SELECT (SELECT arg_min(level, (2 * source_size)::DOUBLE / w) FROM f WHERE free) AS held),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(held * w, (2 * source_size)::DOUBLE)) AS target FROM f, h),
r AS (SELECT d.*, t.source_size, t.target,
        row_number() OVER (PARTITION BY d.source ORDER BY size, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3), doc_id) AS rk,
        ('0x' || substr(md5('mix-1:' || coalesce(d.source, '') || CASE WHEN d.source IS NULL THEN 'n' ELSE 's' END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each FROM r),
c AS (SELECT *, (floor(rk * each + u) - floor((rk - 1) * each + u))::BIGINT AS copies FROM e)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS again FROM g WHERE w2 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM m, (SELECT unnest(range(3)) AS k) WHERE again GROUP BY doc_id),
x AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
        len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper,
        len(list_filter(ws, lambda v: lower(v) IN ({{stop}})))::BIGINT AS n_stop,
        list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
y AS (SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars::DOUBLE / nullif(n_words, 0) BETWEEN 2 AND 20, true)
  AND coalesce(n_symbols::DOUBLE / nullif(n_words, 0) <= 0.25, true) AND coalesce(n_upper::DOUBLE / nullif(word_chars, 0) <= 0.5, true)
  AND coalesce(n_exclaims::DOUBLE / nullif(n_words, 0) <= 0.5, true) AND coalesce(n_stop::DOUBLE / nullif(n_words, 0) >= 0.01, true)
  AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0) <= 0.5, true) AS kept
FROM y
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM d),
g AS (SELECT doc_id, n, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS e, lead(w, 4) OVER o AS f FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, e, f) AS s FROM g WHERE f IS NOT NULL OR (n < 5 AND i = 0)),
k AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP9 = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text <> ''),
k AS (SELECT doc_id, i, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w FROM l),
g AS (SELECT doc_id, i, l AS a, lead(l, 1) OVER o AS b, lead(l, 2) OVER o AS c, w AS w1, w + lead(w, 1) OVER o AS w2 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, 3 AS n FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM g WHERE c IS NOT NULL) WHERE k > 1
  UNION ALL SELECT doc_id, i, 2 FROM (SELECT doc_id, i, w2, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS k FROM g WHERE b IS NOT NULL) WHERE k > 1 AND w2 >= 50
  UNION ALL SELECT doc_id, i, 1 FROM (SELECT doc_id, i, w1, row_number() OVER (PARTITION BY a ORDER BY doc_id, i) AS k FROM g) WHERE k > 1 AND w1 >= 50),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM f, (SELECT unnest(range(3)) AS k) WHERE k < n),
m AS (SELECT l.doc_id, l.l, l.i, gone.i IS NOT NULL AS x FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i),
t AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (x)::BIGINT AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT x), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""


#: crc32 of a text of ASCII characters, as an expression; the table _crc, made from its rule, is joined to where it is used.
CRC = """_crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, _crc.t[(xor(c, b) & 255) + 1])))"


def _merkle(name: str, levels: int) -> str:
    """Levels <name>0 (g, i, n, h), <name>1 ... of a Merkle tree, runs of 16 as <name>k0 (g, p, kids) ..., and last nodes as <name>top."""
    out = []
    for k in range(levels):
        out.append(f"{name}k{k} AS MATERIALIZED (SELECT g, i // 16 AS p, (any_value(n) + 15) // 16 AS n, list(h ORDER BY i) AS kids FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16)")
        out.append(f"{name}{k + 1} AS (SELECT g, p AS i, n, sha256(array_to_string(kids, '')) AS h FROM {name}k{k})")
    return ", ".join(out) + f", {name}top AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")"


def _folds(source: str, name: str, levels: int, start: int, group: str, place: str) -> tuple[str, int]:
    """Tables f<start + 1> ... that add a level's siblings to `proof` and fold `h` with them."""
    out = []
    for k in range(levels):
        at = f"(x.{place} // {16**k} % 16)"
        out.append(f"""f{start + 1} AS (SELECT x.* EXCLUDE (proof, h), x.proof || coalesce(array_to_string(t.kids[1:{at}], '') || array_to_string(t.kids[{at} + 2:], ''), '') AS proof,
          CASE WHEN t.kids IS NULL THEN x.h ELSE sha256(array_to_string(t.kids[1:{at}], '') || x.h || array_to_string(t.kids[{at} + 2:], '')) END AS h
        FROM {source} x LEFT JOIN {name}k{k} t ON t.g = {group} AND t.p = x.{place} // {16 ** (k + 1)})""")
        start += 1
        source = f"f{start}"
    return ", ".join(out), start


def _op12() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower, last = _folds("f0", "s", 6, 0, "x.g", "i")
    upper, end = _folds(f"f{last}", "r", 3, last, "''", "gi")
    return f"""
WITH {CRC},
d AS (SELECT *, CASE WHEN {crc("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown FROM documents, _crc),
a AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS g, {leaf("text")} AS leaf, {leaf("shown")} AS other FROM d),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM a),
s0 AS (SELECT g, i, n, leaf AS h FROM b), {_merkle("s", 6)},
r0 AS MATERIALIZED (SELECT '' AS g, g AS of_, row_number() OVER (ORDER BY g::BLOB) - 1 AS i, count(*) OVER () AS n, h FROM stop), {_merkle("r", 3)},
f0 AS (SELECT b.doc_id, b.g, b.i, b.leaf, r0.i AS gi, r0.h AS subroot, '' AS proof, b.other AS h FROM b JOIN r0 ON r0.of_ = b.g), {lower}, {upper}
SELECT doc_id, leaf, subroot, (SELECT h FROM rtop) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM rtop) AS verified FROM f{end}
"""


def _op13() -> str:
    from grainmill.llm import url_filters as u
    from grainmill.llm.queries import URL_RULES

    q = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({q(r.verdict)}, {q(r.host)}, {q(r.path)})" for r in URL_RULES)
    lower = lambda c: f"translate({c}, '{u.UPPER}', '{u.LOWER}')"
    host, path = lambda c: f"coalesce({lower(f'regexp_extract({c}, {q(u.HOST)}, 1)')}, '')", lambda c: f"coalesce(regexp_extract({c}, {q(u.PATH)}, 1), '')"
    key = lambda c: f"CASE WHEN contains({c}, '://') THEN {lower(f'regexp_extract({c}, {q('(?s)^(.*?)://')}, 1)')} || '://' || {host(c)} || CASE WHEN {path(c)} = '' THEN '/' ELSE {path(c)} END || regexp_extract({c}, {q('(?s)^[^?#]*([?][^#]*)')}, 1) END"
    best = lambda t: f"(SELECT max_by({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) FROM r WHERE ({t}.host = r.host OR ends_with({t}.host, '.' || r.host)) AND starts_with({t}.path, r.path))"
    tags = lambda tag, kind, value: f"list_transform(list_filter(regexp_extract_all(h, {q(tag)}), lambda t: regexp_matches(t, {q(kind)})), lambda t: regexp_extract(t, {q(value)}, 1))"
    site = f"regexp_extract(url, {q('(?s)^(.*?://[^/?#]*)')}, 1)"
    folder = f"coalesce(nullif(regexp_extract({path('url')}, '(?s)^(.*/)', 1), ''), '/')"
    whole = f"""CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN starts_with(l, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || l WHEN starts_with(l, '/') THEN {site} || l
      WHEN starts_with(l, '?') THEN {site} || {path('url')} || l WHEN starts_with(l, '#') THEN url ELSE {site} || {folder} || l END"""
    return f"""
WITH RECURSIVE r AS (SELECT * FROM (VALUES {rules}) v(verdict, host, path)),
p AS (SELECT page_id, url, {host('url')} AS host, {path('url')} AS path, {key('url')} AS k FROM pages),
t AS (SELECT url, regexp_replace(html, {q(u.UNREAD)}, ' ', 'g') AS h FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|refresh')),
l AS (SELECT url, replace(unnest(list_concat({tags(u.LINK, u.CANONICAL, u.HREF)}, {tags(u.META, u.REFRESH, u.CONTENT)})), '&amp;', '&') AS l FROM t),
w AS (SELECT {key('url')} AS a, w FROM (SELECT url, {whole} AS w FROM l WHERE l <> '')),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, {key('w')} AS b FROM w) WHERE a <> b),
n AS (SELECT k, {host('k')} AS host, {path('k')} AS path FROM (SELECT a AS k FROM e UNION SELECT b FROM e)),
m AS MATERIALIZED (SELECT k, {best('n')} AS best FROM n),
x AS (SELECT k FROM m WHERE best.verdict = 'block' UNION SELECT CASE WHEN e.a = x.k THEN e.b ELSE e.a END FROM x JOIN e ON e.a = x.k OR e.b = x.k),
y AS (SELECT *, {best('p')} AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN k IN (SELECT k FROM x) THEN 'block' ELSE 'allow' END) AS verdict, best IS NULL AND coalesce(k IN (SELECT k FROM x), false) AS alias FROM y
"""


def oracle_sql() -> dict[str, str]:
    from grainmill.llm.quality_rules import STOP_WORDS

    return {
        "op2_mixing": OP2,
        "op3_quality_rules": OP3.replace("{stop}", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))),
        "op6_jaccard_join": OP6,
        "op9_topk_search": OP9,
        "op10_line_dedup": OP10,
        "op12_manifest": _op12(),
        "op13_url_filters": _op13(),
    }

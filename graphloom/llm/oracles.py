"""SQL for the results that SQL can say, for DuckDB over the same tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(c: str = "text") -> str:
    return f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lowered()}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lowered()}, '{_ALNUM}') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS p FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM pat),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS p FROM d, sizes, unnest(range(1, len(w) - size + 2)) u(i)),
hit AS (SELECT DISTINCT doc_id, i, size, item_id FROM dw JOIN pat USING (size, p)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n FROM hit, unnest(range(i, i + size)) u(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s COLLATE C) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2 = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, a[i] AS line, greatest(1, len(regexp_extract_all(a[i], '[^\x20\x09-\x0D]+'))) AS w FROM a, unnest(range(1, len(a) + 1)) u(i)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS cum, sum(w) OVER (PARTITION BY doc_id)::BIGINT AS total FROM l),
f AS (SELECT doc_id, pos, cum, total, cum - w AS begin_,
  count(*) OVER (PARTITION BY doc_id ORDER BY cum - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS fwd, count(*) OVER (PARTITION BY doc_id ORDER BY cum RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS bwd FROM c),
win AS (SELECT doc_id, pos AS p, fwd AS m FROM f WHERE total - begin_ >= 50 UNION SELECT doc_id, pos - bwd + 1, bwd FROM f WHERE cum >= 50),
keyed AS (SELECT doc_id, p, m, array_to_string(a[p + 1:p + m], chr(10)) AS s FROM win JOIN a USING (doc_id)),
first_ AS (SELECT m, s, min(struct_pack(d := doc_id, q := p)) AS e FROM keyed GROUP BY m, s),
gone AS (SELECT DISTINCT doc_id, k AS pos FROM keyed JOIN first_ USING (m, s), unnest(range(p, p + m)) u(k) WHERE doc_id <> e.d OR p >= e.q + m),
left_ AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS t
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_deleted, length(t)::BIGINT AS n_chars_left, sha256(t) AS text_sha256 FROM left_
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lowered()}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
ties AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM ties UNION SELECT r.x, b.y FROM reach r JOIN ties b ON r.y = b.x),
least_ AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON x = d.doc_id
"""

OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lowered()}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 3) + 1)) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
ties AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM ties UNION SELECT r.x, b.y FROM reach r JOIN ties b ON r.y = b.x),
least_ AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON x = d.doc_id
"""

OP12 = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, pos, md5(md5(r) || md5(x)) AS k, strlen(x) AS bytes FROM o),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS b),
crc AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, s: xor(c >> 8, b[1 + (xor(c, s) & 255)]))) AS crc
  FROM (SELECT DISTINCT conv_id FROM t), bits),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, crc % 9 AS h FROM crc),
lent AS (SELECT c.conv_id, t.pos, k, bytes FROM c JOIN t ON t.conv_id = base AND pos < h),
got AS (SELECT conv_id, count(*) AS got FROM lent GROUP BY conv_id),
rebuilt AS (FROM lent UNION ALL SELECT conv_id, pos - h + coalesce(got, 0), k, bytes FROM t JOIN c USING (conv_id) LEFT JOIN got USING (conv_id) WHERE pos >= h),
p AS (SELECT conv_id, pos + 1 AS depth, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key, bytes FROM rebuilt UNION ALL SELECT conv_id, 0, '', 0 FROM c),
u AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p),
node AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, min(up) AS up FROM u GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, key)),
sums AS (SELECT a.depth, a.key, sum((n_convs - 1) * w.bytes)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM whole w JOIN p a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY ALL),
ends AS (SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) JOIN p USING (conv_id, depth) GROUP BY ALL)
SELECT w.conv_id, w.depth, m.conv_id AS parent_conv_id, w.n_convs, w.n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole w JOIN sums USING (depth, key) LEFT JOIN ends USING (depth, key) LEFT JOIN node m ON m.depth = w.depth - 1 AND m.key = w.up
"""

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lowered()}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, w[i:i + k - 1] AS g, k FROM p, unnest([1, 2, 3]) s(k), unnest(range(1, len(w) - k + 2)) u(i)),
f AS (SELECT lang, g, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10 OR k = 1),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, g, k, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, s.i, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c, unnest(range(1, k)) s(i) JOIN f x ON x.lang = c.lang AND x.g = c.g[:i] JOIN f y ON y.lang = c.lang AND y.g = c.g[i + 1:]),
best AS (SELECT lang, g, k, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, i := i)) AS b FROM cut GROUP BY ALL),
inner_ AS (SELECT lang, unnest([g[:2], g[2:]]) AS g, a AS longer FROM c WHERE k = 3),
most AS (SELECT lang, g, max(longer) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, b.b.l AS l, b.b.r AS r, b.b.score AS score FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def _spans(kinds: list[tuple[str, str, int, int]]) -> str:
    parts = []
    for at, (kind, pattern, group, least) in enumerate(kinds):
        p = pattern.replace("'", "''")
        found = ", ".join(f"regexp_extract_all(t, '(?s)(.*?)(?:({p})|\\z)', {g})" for g in (1, 2, 2 + group))
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {at} AS nth, stop - len(m) AS start, stop FROM (SELECT doc_id, m, v, sum(len(g) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
            FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS g, unnest(b) AS m, unnest(c) AS v FROM (SELECT doc_id, a[1] AS a, a[2] AS b, a[3] AS c FROM (SELECT doc_id, [{found}] AS a FROM d))))
            WHERE m <> '' AND len(v) >= {least}""")
    return " UNION ALL ".join(parts)


def op6() -> str:
    from .secret_scan import BASE, MORE

    kinds = [(r.kind, r.pattern, r.group, r.least) for r in (*BASE, *MORE)]
    count = lambda k: f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}"
    text = "kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, nth"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_spans(kinds)}),
g AS (SELECT doc_id, {', '.join(count(r.kind) for r in BASE)}, string_agg({text}) FILTER (nth < {len(BASE)}) AS base, string_agg({text}) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

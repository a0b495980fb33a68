"""The operators' results in DuckDB SQL, where SQL can express them. The plain quadratic forms; for small tables."""

from __future__ import annotations

from .chat import CONTROL, MARKS, OTHER

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win, least(10, len(w)) AS n FROM (SELECT item, w, unnest(range(0, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item, i, g.n FROM grams g JOIN wins USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM documents JOIN reach ON x = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _escaped(column: str) -> str:
    for i, c in enumerate(CONTROL):  # the escape's own mark first; no control string overlaps another
        column = f"replace({column}, {_quoted(c)}, '&ctl:{i};')"
    return column


_MARKS = " ".join(f"WHEN '{r}' THEN {len(a + z)}" for r, (a, z) in MARKS.items())
_CONFLICT = " OR ".join(f"contains(text, {_quoted(c)})" for c in CONTROL)
OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(CASE WHEN {_CONFLICT} THEN {_escaped("text")} ELSE text END) + CASE role {_MARKS} ELSE {sum(map(len, OTHER))} + length({_escaped("role")}) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP12 = """
WITH shipped AS (SELECT sale_id, min(epoch(date_trunc('minute', shipped_at))) AS first FROM sale_lines WHERE shipped_at IS NOT NULL AND sale_id IS NOT NULL GROUP BY 1),
nations AS (SELECT client_id, min(nation_id) AS nation FROM clients WHERE client_id IS NOT NULL GROUP BY 1),
open AS (SELECT coalesce(nation, -1) AS nation, CAST(epoch(date_trunc('minute', sold_at)) AS BIGINT) AS s, CAST(first AS BIGINT) + 604800 AS e, CAST(floor(100 * coalesce(total, 0) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS c
  FROM sales LEFT JOIN shipped USING (sale_id) LEFT JOIN nations USING (client_id) WHERE sold_at IS NOT NULL),
valid AS (SELECT * FROM open WHERE e IS NULL OR e > s),
steps AS (SELECT nation, s AS t, 1 AS n, c FROM valid UNION ALL SELECT nation, e, -1, -c FROM valid WHERE e IS NOT NULL),
each AS (SELECT nation, t, n, c FROM steps UNION ALL SELECT -2, t, n, c FROM steps),
change AS (SELECT nation, t, sum(n) AS n, sum(c) AS c FROM each GROUP BY 1, 2 HAVING sum(n) <> 0 OR sum(c) <> 0),
state AS (SELECT nation, t, sum(n) OVER w AS n, sum(c) OVER w AS c, lead(t) OVER w AS nxt FROM change WINDOW w AS (PARTITION BY nation ORDER BY t))
SELECT CAST(nation AS INTEGER) AS nation_id, t AS from_s, nxt AS to_s, CAST(n AS BIGINT) AS n_open, CAST(c AS BIGINT) AS open_cents, CAST(max(n) OVER (PARTITION BY nation ORDER BY t) AS BIGINT) AS high_open, c = max(c) OVER (PARTITION BY nation) AS is_peak
FROM state
"""

# crc32 (reversed polynomial 0xEDB88320), a byte at a time over all distinct features at once
OP13 = rf"""
WITH RECURSIVE steps AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
hexes AS (SELECT map_from_entries(list((printf('%02X', i), i))) AS h FROM range(256) t(i)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
own AS (SELECT doc_id, unnest(w || list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
aim AS (SELECT unnest(w || list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
one AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM own UNION SELECT f FROM aim)),
codes AS (SELECT f, list_transform(range(0, len(x) // 2), lambda i: h[x[2 * i + 1 : 2 * i + 2]]) AS codes, t FROM one, tab, hexes),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(codes, lambda c: CAST(c AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM codes),
per AS (SELECT doc_id, bucket, count(*) AS n FROM own JOIN crc USING (f) GROUP BY 1, 2),
s AS (SELECT bucket, sum(n) AS s FROM per GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN crc USING (f) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM s) AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT sum(t) FROM t) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
mean AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM per JOIN gain USING (bucket) GROUP BY 1),
weight AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN mean USING (doc_id)),
scored AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weight),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM drawn) THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""

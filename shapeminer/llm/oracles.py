"""The corpus queries that SQL can express, in DuckDB's SQL over whole tables."""

from __future__ import annotations

from . import secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT DISTINCT item_id, s, unnest(string_split(s, ' ')) AS x FROM bw), k AS (SELECT item_id, s, count(*) AS kinds FROM t GROUP BY 1, 2),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d), px AS (SELECT * FROM p WHERE x IN (SELECT x FROM t)),
full_ AS (SELECT doc_id, item_id, s, kinds FROM (SELECT DISTINCT doc_id, x FROM px) JOIN t USING (x) JOIN k USING (item_id, s) GROUP BY 1, 2, 3, 4 HAVING count(*) = kinds),
span AS (SELECT doc_id, item_id, kinds, count(DISTINCT px.x) OVER (PARTITION BY doc_id, item_id, full_.s ORDER BY i RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS c FROM full_ JOIN t USING (item_id, s) JOIN px USING (doc_id, x)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM span WHERE c = kinds GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, least(len(w), 4) || ':' || array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_KINDS = [*((k, p, n) for k, p, n in secrets.BASE), ("live", secrets.MORE, 1), ("live", secrets.BEARER, 1)]
_EACH = " UNION ALL ".join(
    f"SELECT *, '{k}' AS kind, {min(r, len(secrets.BASE))} AS rank, {n} AS least, string_split_regex(x, {_quoted(p)}) AS gaps, regexp_extract_all(x, {_quoted(p)}, 0) AS m, regexp_extract_all(x, {_quoted(p)}, 2) AS v FROM t WHERE regexp_matches(x, {_quoted(p)})"
    for r, (k, p, n) in enumerate(_KINDS)
)

SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS x, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
k AS ({_EACH}),
s AS (SELECT row, owner, repo, kind, rank, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0) AS INTEGER) AS start, length(m[i]) AS n, v[i] AS value, least
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
c AS (SELECT * FROM s WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT owner) AS owners, CAST(count(DISTINCT (owner, repo)) AS BIGINT) AS repos FROM c GROUP BY 1),
j AS (SELECT c.*, owners, repos, kind || ':' || start || ':' || (start + n) AS span, CASE WHEN owners > {secrets.MOST_OWNERS} OR repos > {secrets.MOST_REPOS} THEN 'copied'
  WHEN len(list_distinct(string_split(value, ''))) >= least(8, length(value) / 2) AND CAST(regexp_matches(value, '[0-9]') AS INT) + CAST(regexp_matches(value, '[a-z]') AS INT) + CAST(regexp_matches(value, '[A-Z]') AS INT) >= 2 THEN 'live' ELSE 'plain' END AS verdict
  FROM c JOIN o USING (value)),
g AS (SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, rank, n) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank, n) FILTER (WHERE rank < 3 OR verdict = 'live') AS spans,
  string_agg(start || ':' || (start + n) || ':' || owners || ':' || repos || ':' || verdict, ',' ORDER BY start, rank, n) FILTER (WHERE rank < 3 OR verdict = 'live') AS ownership,
  count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied' AND rank < 3) AS n_copied FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ownership, '') AS ownership, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM t LEFT JOIN g USING (row)"""

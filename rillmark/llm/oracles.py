"""DuckDB SQL for the queries that SQL can express."""

# rules, and classes of one url: no links are read here, as the tables' html has none
_OP3 = r"""
WITH p AS (
  SELECT page_id, url, html,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
q AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (
  SELECT page_id, url, html, host, path,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM q),
s AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own,
         regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) AS head FROM r),
n AS (
  SELECT *, CASE WHEN position('://' IN url) > 0 THEN
              translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ||
              CASE WHEN regexp_extract(substr(url, length(head) + 1), '^([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(substr(url, length(head) + 1), '^([^#]*)', 1) END END AS node
  FROM s),
votes AS (SELECT node AS component_id, max(CASE WHEN own = 'allow' THEN 1 ELSE 0 END) AS a, max(CASE WHEN own = 'block' THEN 1 ELSE 0 END) AS b FROM n WHERE node IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, component_id,
       coalesce(own, CASE WHEN a = 1 THEN 'allow' WHEN b = 1 THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN votes ON n.node = votes.component_id
"""

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) u),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM inter JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 75 * (cx.n + cy.n - k)),
reach AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON r.other = e.x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS kept
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, c.n
"""

#: op3: the tables' html holds no canonical or refresh link, so its classes are single urls; the classes that links
#: make are held against a brute-force version in the tests.
SQL: dict[str, str] = {"op3_url_filter": _OP3, "op4_minhash_near_dups": _OP4}

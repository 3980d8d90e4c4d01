"""DuckDB SQL for the queries that SQL can express."""

from quarry.llm.url_filter import CUT, LOWER, STRENGTH, TWO_LABEL_SUFFIXES, UPPER, Z

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), firsts AS (
  SELECT k, min(doc_id) AS d0 FROM win GROUP BY k
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN firsts USING (k) WHERE doc_id > d0
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS txt, count(*) AS n
  FROM word ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hit AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_LAST2, _LAST3 = "array_to_string(string_split(host, '.')[-2:], '.')", "array_to_string(string_split(host, '.')[-3:], '.')"


def _strength(level: str) -> str:
    spread = "sum(n * pow(k / n - mean, 2)) / sum(n) - mean * (1 - mean) * count(*) / sum(n)"
    return f"(SELECT coalesce(least(greatest(mean * (1 - mean) / greatest({spread}, 1e-6) - 1, {STRENGTH[0]}), {STRENGTH[1]}), {STRENGTH[0]}) FROM {level}, whole WHERE n > 0 GROUP BY mean)"


URL_FILTER = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), lab AS (
  SELECT doc_id AS page_id, max(CAST(quality = 1 AND toxic = 0 AS INTEGER)) AS good FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, CASE WHEN {_LAST2} IN ({_TWO}) THEN {_LAST3} ELSE {_LAST2} END AS domain,
    CASE WHEN {_LAST2} IN ({_TWO}) THEN {_LAST2} ELSE array_to_string(string_split(host, '.')[-1:], '.') END AS suffix
  FROM h LEFT JOIN lab USING (page_id) GROUP BY host
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain
), suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix
), whole AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0.5 END AS mean FROM suffixes
), strength AS (SELECT mean, {_strength("suffixes")} AS s0, {_strength("domains")} AS s1, {_strength("hosts")} AS s2 FROM whole
), prior AS (
  SELECT host, n, k, s2, (dk - k + s1 * ((sk - dk + s0 * mean) / (sn - dn + s0))) / (dn - n + s1) AS m
  FROM (SELECT hosts.*, domains.n AS dn, domains.k AS dk, suffixes.n AS sn, suffixes.k AS sk FROM hosts JOIN domains USING (suffix, domain) JOIN suffixes USING (suffix)), strength
), own AS (
  SELECT host, CASE WHEN a / (a + b) + {Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) < {CUT} THEN 'block' ELSE 'allow' END AS verdict
  FROM (SELECT host, k + s2 * m AS a, n - k + s2 * (1 - m) AS b FROM prior)
), rules AS (
  SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, position('/' IN rule)) AS start
  FROM (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) t(verdict, rule)
), hit AS (
  SELECT page_id, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS verdict
  FROM h JOIN rules ON (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(path, start) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, hit.rule, coalesce(hit.verdict, own.verdict) AS verdict FROM h JOIN own USING (host) LEFT JOIN hit USING (page_id)
"""


# CRC-32 of the decimal digits of a number, byte by byte, from the table of its 256 remainders.
_CRC_TABLE = """crc_table AS (
  SELECT list(t ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS t FROM range(256) r(i))
)"""


def _crc(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


PREFIX_TRIE = rf"""
WITH {_CRC_TABLE}, t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS o,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT c, c - c % 20 AS head, {_crc("c")} % 4 AS h FROM (SELECT DISTINCT c FROM t), crc_table
), r AS (
  SELECT s.c, t.o, t.k, t.w FROM s JOIN t ON t.c = s.head AND t.o < s.h
  UNION ALL SELECT s.c, t.o + 3, t.k, t.w FROM s JOIN t ON t.c = s.c AND t.o >= s.h
), seq AS (
  SELECT c, list_filter(list(struct_pack(k := r.k, w := r.w) ORDER BY o), lambda x: x.k IS NOT NULL) AS q FROM s LEFT JOIN r USING (c) GROUP BY c
), nodes AS (
  SELECT q[1:d] AS p, d, count(*) AS n_convs, min(c) AS conv_id FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM seq) GROUP BY ALL
), kids AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * p[d].w ELSE 0 END AS saved FROM nodes LEFT JOIN kids USING (p)
), sub AS (
  SELECT p[1:a] AS p, count(*) AS n_nodes, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS a FROM own) GROUP BY ALL
), ends AS (
  SELECT q AS p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM seq GROUP BY q
), placed AS (
  SELECT *, row_number() OVER (ORDER BY list_transform(p, lambda x: x.k)) AS position FROM own
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(h, sha256('')) AS ends_sha256, position, position + n_nodes - 1 AS subtree_end
FROM placed n JOIN sub USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.p = n.p[1:n.d - 1]
"""


PERIODIC_RUNS = rf"""
WITH {_CRC_TABLE}, raw AS (
  SELECT doc_id, {_crc("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents, crc_table
), planned AS (
  SELECT *, h // 10 AS g, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM raw
), made AS (
  SELECT doc_id, n, ws, a, 1 + (n - a) // (3 + g % 8) AS p FROM planned
), word AS (
  SELECT doc_id, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM made)
), same AS (
  SELECT u.doc_id, v.i - u.i AS q, u.i FROM word u JOIN word v ON u.doc_id = v.doc_id AND u.x = v.x AND u.i < v.i
), island AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k
), run AS (
  SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), told AS (
  SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS txt FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM raw LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


MINHASH_NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y USING (k) WHERE x.doc_id < y.doc_id GROUP BY ALL)
  JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * common >= 80 * (sa.n + sb.n - common)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.doc_id
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d LEFT JOIN size USING (doc_id) JOIN least ON least.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    found = {"op2_substring_dedup": SUBSTRING_DEDUP, "op5_benchmark_decontamination": DECONTAMINATION, "op6_url_filter": URL_FILTER}
    return found | {"op11_prefix_trie": PREFIX_TRIE, "op12_periodic_runs": PERIODIC_RUNS, "op13_minhash_near_dedup": MINHASH_NEAR_DEDUP}

"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from gridcells.llm import quality_rules as q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM v),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM n WHERE k > 1),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT t.doc_id, string_agg(t.w[t.i], ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS gone
      FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.gone, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS m FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(m, page_id) AS refers_to
FROM r
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
v AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS k FROM v),
c AS (SELECT r, count(DISTINCT i) AS n_repeat FROM (SELECT r, unnest(range(i, i + 3)) AS i FROM n WHERE k > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT r, line, len(line) AS size,
        (len(line) - len(regexp_replace(line, '[#*$%&<>]', '', 'g'))) * 5 > n
        OR (len(line) - len(regexp_replace(line, '[{q.SEPARATORS}]', '', 'g'))) * 5 > n
        OR (n < 12 AND NOT regexp_matches(line, '{q.MARKS}'))
        OR (n < 40 AND regexp_matches(translate(line, '{q.UPPER}', '{q.LOWER}'), '{"|".join(q.PHRASES)}')) AS bad FROM m),
s AS (SELECT r, count(*) - count(DISTINCT line) AS dup, sum(size) AS chars, coalesce(sum(size) FILTER (WHERE bad), 0) AS lost
      FROM f GROUP BY r),
b AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
        coalesce(n_repeat, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * chars AS kept
FROM b
"""

DECONTAMINATE = r"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS key
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
v AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM d, z WHERE len(w) >= size),
o AS (SELECT v.r, v.k, p.size, p.item FROM v JOIN p ON p.size = v.size AND p.key = array_to_string(v.w[v.k:v.k + v.size - 1], ' ')),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS k FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

URL_FILTERS = r"""
WITH p AS (SELECT page_id, url, DATE '2021-01-01' + ((page_id * 7919) % 1100)::INTEGER AS fetched_on,
             regexp_replace(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '')), '\.$', '') AS host,
             [x FOR x IN string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') IF x <> ''] AS seg
           FROM pages),
h AS (SELECT host, seg[1] AS first, string_split(host, '.') AS l FROM p WHERE host <> ''),
k AS (SELECT DISTINCT unnest([host, array_to_string(l[greatest(len(l) - 1, 1):], '.'), concat_ws('/', host, first)]) AS pattern FROM h),
e AS (SELECT pattern, list_name, blocks, i,
        DATE '2021-01-01' + (('0x' || substr(md5(pattern || list_name || i), 1, 7))::BIGINT % 250 + 250 * i)::INTEGER AS day
      FROM k, (VALUES ('spam', true), ('trusted', false)) v(list_name, blocks), range(4) r(i)
      WHERE ('0x' || substr(md5(pattern || list_name || 'x'), 1, 7))::BIGINT % 3 = 0),
d AS (SELECT pattern, list_name, blocks, day, bool_and(i % 2 = 0) AS adds FROM e GROUP BY ALL),
v AS (SELECT pattern, list_name, blocks, day AS valid_from, adds,
        lead(day) OVER (PARTITION BY pattern, list_name, blocks ORDER BY day) AS valid_to FROM d),
c AS (SELECT page_id, url, fetched_on, host, unnest(
        [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)]
        || [host || '/' || array_to_string(seg[1:i], '/') FOR i IN range(1, len(seg) + 1)]) AS pattern FROM p WHERE host <> ''),
m AS (SELECT c.page_id, c.url, c.fetched_on, v.* FROM c JOIN v ON v.pattern = c.pattern AND v.adds
        AND c.fetched_on >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_on < v.valid_to)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, blocks DESC, list_name DESC, pattern DESC, valid_from DESC) AS n,
        count(*) OVER (PARTITION BY page_id, url) AS n_active FROM m)
SELECT p.page_id, p.host, CASE WHEN b.pattern IS NULL THEN 'none' WHEN b.blocks THEN 'block' ELSE 'allow' END AS verdict,
       b.pattern, b.list_name, b.valid_from::DATE AS listed_since, coalesce(b.n_active, 0)::BIGINT AS n_active
FROM p LEFT JOIN b ON b.page_id = p.page_id AND b.url = p.url AND b.n = 1
"""


def centroid_rounds(k: int = 8, rounds: int = 10) -> str:
    """Centroid clustering: one pair of tables (assignment, centroids) for each round.  An assignment is packed as distance * k + cluster."""
    near = """a{i} AS MATERIALIZED (SELECT r, min(list_sum(list_transform(list_zip(p.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {k} + c) AS m
    FROM kept p, c{i} GROUP BY r)"""
    move = """s{i} AS MATERIALIZED (SELECT m % {k} AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n
    FROM a{i} JOIN kept USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY m % {k}, i),
c{j} AS MATERIALIZED (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY c
    UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM s{i}))"""
    steps = [(near + ",\n" + move).format(i=i, j=i + 1, k=k) for i in range(rounds)] + [near.format(i=rounds, k=k)]
    return f"""WITH usable AS (SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN floor(1024 * x::DOUBLE)::BIGINT END) AS v FROM usable),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}),
{(","+chr(10)).join(steps)},
done AS (SELECT vec_id, (m % {k})::INTEGER AS cluster, (m // {k})::BIGINT AS distance FROM a{rounds} JOIN kept USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
    (SELECT sha256(array_to_string(c{rounds}.v, ',')) FROM c{rounds} WHERE c{rounds}.c = cluster) AS centroid_sha256 FROM done"""


CENTROIDS = centroid_rounds()

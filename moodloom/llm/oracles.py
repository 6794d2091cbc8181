"""SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

MIXING = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 AS weight
  FROM d GROUP BY source),
u AS (
  SELECT *, ((SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS unit
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, unit * weight > 3 * source_size AS capped FROM u),
t AS (
  SELECT *, CASE WHEN capped THEN 3.0 * source_size ELSE
    ((SELECT sum(size) FROM d) - coalesce((SELECT sum(3 * source_size) FROM capped WHERE capped), 0))::DOUBLE
    / (SELECT sum(weight) FROM capped WHERE NOT capped) * weight END::DOUBLE AS target
  FROM capped),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN round_even(target, 0)::BIGINT % source_size ELSE 0 END AS need FROM t),
r AS (
  SELECT doc_id, size, source, row_number() OVER (PARTITION BY doc_id ORDER BY size, source IS NULL, source) AS row FROM d),
p AS (SELECT *, md5(concat('mix|', coalesce(doc_id::VARCHAR, ''), '|', row)) AS pick FROM r),
f1 AS (
  SELECT p.*, q.need, coalesce(sum(size) OVER w, 0) + size <= need AND size > 0 AND size <= need AS got
  FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
  WINDOW w AS (PARTITION BY p.source, size > 0 AND size <= need ORDER BY pick, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n1 AS (SELECT source, any_value(need) - coalesce(sum(size) FILTER (got), 0) AS need FROM f1 GROUP BY source),
f2 AS (
  SELECT f1.* REPLACE (n1.need AS need, coalesce(sum(size) OVER w, 0) + size <= n1.need AND size > 0 AND size <= n1.need AS got)
  FROM f1 JOIN n1 ON f1.source IS NOT DISTINCT FROM n1.source WHERE NOT got
  WINDOW w AS (PARTITION BY f1.source, size > 0 AND size <= n1.need ORDER BY pick, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n2 AS (SELECT source, any_value(need) - coalesce(sum(size) FILTER (got), 0) AS need FROM f2 GROUP BY source),
f3 AS (
  SELECT f2.* REPLACE (n2.need AS need, 2 * coalesce(sum(size) OVER w, 0) + size <= 2 * n2.need AND size > 0 AND size <= 2 * n2.need AS got)
  FROM f2 JOIN n2 ON f2.source IS NOT DISTINCT FROM n2.source WHERE NOT got
  WINDOW w AS (PARTITION BY f2.source, size > 0 AND size <= 2 * n2.need ORDER BY pick, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
more AS (
  SELECT doc_id, row FROM f1 WHERE got UNION ALL SELECT doc_id, row FROM f2 WHERE got UNION ALL SELECT doc_id, row FROM f3 WHERE got)
SELECT p.doc_id, p.size::BIGINT AS size, q.source_size, q.target,
       (p.size * (whole + CASE WHEN more.row IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken, p.source,
       (whole + CASE WHEN more.row IS NULL THEN 0 ELSE 1 END)::BIGINT AS times
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
LEFT JOIN more ON more.doc_id IS NOT DISTINCT FROM p.doc_id AND more.row = p.row
"""

QUALITY = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, unnest(l) AS word, generate_subscripts(l, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS l FROM d)),
g AS (SELECT *, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i, word, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w2, w3) > 1 AS a FROM g),
covered AS (
  SELECT r, word, a OR coalesce(lag(a, 1) OVER p, false) OR coalesce(lag(a, 2) OVER p, false) AS c
  FROM again WINDOW p AS (PARTITION BY r ORDER BY i)),
words AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (
  SELECT d.r, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
rates AS (
  SELECT r, lang, source, unnest(['length', 'symbols', 'dup_lines', 'repeats']) AS rate,
         unnest([100 * word_chars // n_words, 10000 * n_symbols // n_words, 10000 * n_dup_lines // n_words,
                 10000 * n_repeat_words // n_words]) AS value
  FROM b WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, rate, value - value % (1::BIGINT << greatest(0, length(bin(value)) - 7)::INTEGER) AS bucket, count(*) AS n
  FROM rates GROUP BY ALL),
grouped AS (
  SELECT lang, source, 0 AS level, rate, bucket, n FROM sketch
  UNION ALL SELECT lang, NULL, 1, rate, bucket, sum(n) FROM sketch GROUP BY lang, rate, bucket
  UNION ALL SELECT NULL, NULL, 2, rate, bucket, sum(n) FROM sketch GROUP BY rate, bucket),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, rate) AS documents FROM grouped),
quartiles AS (
  SELECT level, lang, source, rate, any_value(documents) AS documents, min(bucket) FILTER (upto * 4 >= documents) AS q1,
         min(bucket) FILTER (upto * 4 >= documents * 3) AS q3 FROM ranked GROUP BY level, lang, source, rate),
limits AS (
  SELECT level, lang, source, rate, documents,
         CASE rate WHEN 'length' THEN q1 - 3 * (q3 - q1) - 150 ELSE 0 END AS least,
         q3 + 3 * (q3 - q1) + CASE rate WHEN 'length' THEN 150 WHEN 'symbols' THEN 500 WHEN 'dup_lines' THEN 800 ELSE 3000 END AS most
  FROM quartiles),
picked AS (
  SELECT a.lang, a.source, a.rate,
         CASE WHEN a.documents >= 200 THEN a.least WHEN l.documents >= 200 THEN l.least ELSE g.least END AS least,
         CASE WHEN a.documents >= 200 THEN a.most WHEN l.documents >= 200 THEN l.most ELSE g.most END AS most
  FROM limits a JOIN limits l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM a.lang AND l.rate = a.rate
  JOIN limits g ON g.level = 2 AND g.rate = a.rate WHERE a.level = 0),
bad AS (
  SELECT DISTINCT r FROM rates JOIN picked p ON p.lang IS NOT DISTINCT FROM rates.lang AND p.source IS NOT DISTINCT FROM rates.source
    AND p.rate = rates.rate WHERE value NOT BETWEEN least AND most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM b
"""

PREFERENCE = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
earlier AS (
  SELECT c.conv_id, max_by(text, turn) AS reply FROM conversations c JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id
  WHERE role = 'assistant' AND turn < last GROUP BY c.conv_id),
sides AS (
  SELECT conv_id AS pair_id, turn, role, text, 'chosen' AS side FROM conversations
  UNION ALL
  SELECT c.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN coalesce(reply, '') ELSE text END, 'rejected'
  FROM conversations c LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN earlier e ON e.conv_id IS NOT DISTINCT FROM c.conv_id),
r AS (
  SELECT *, concat('<|im_start|>', coalesce(role, ''), chr(10), replace(coalesce(text, ''), '<|', '< |'), '<|im_end|>', chr(10)) AS rendered,
         row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS no FROM sides),
p AS (
  SELECT *, length(rendered) AS n_chars,
         coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, side ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char
  FROM r),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.no, b.no) AS no,
         a.no IS NULL OR b.no IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text AS differs, a.no IS NOT NULL AS in_a,
         b.no IS NOT NULL AS in_b
  FROM (SELECT * FROM p WHERE side = 'chosen') a FULL JOIN (SELECT * FROM p WHERE side = 'rejected') b ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.no = b.no),
e AS (
  SELECT pair_id, coalesce(min(no) FILTER (differs), max(no) + 1) AS first, count(*) FILTER (in_a) AS n_a, count(*) FILTER (in_b) AS n_b
  FROM m GROUP BY pair_id)
SELECT p.pair_id, CASE WHEN no < first THEN 'prompt' ELSE side END AS part, no, role, rendered, start_char::BIGINT AS start_char, n_chars,
       no >= first AND coalesce(role, '') = 'assistant' AS trainable, first - 1 AS prefix_turns, n_a >= first AND n_b >= first AS usable
FROM p JOIN e ON e.pair_id IS NOT DISTINCT FROM p.pair_id WHERE no >= first OR side = 'chosen'
"""

WARC = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, url, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h, page_id ORDER BY url) AS nth FROM d)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    ('0x' || substr(h, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first AND nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first AND nth = 1 THEN NULL ELSE first END AS refers_to
FROM n
"""

JACCARD = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
k AS (SELECT r, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM g GROUP BY r),
c AS (SELECT k, min(r) AS r FROM k GROUP BY k),
often AS MATERIALIZED (SELECT g.s, g.r FROM g JOIN c USING (r) WHERE s IN (SELECT s FROM g JOIN c USING (r) GROUP BY s HAVING count(*) > 1)),
links AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM often a JOIN often b ON a.s = b.s AND a.r < b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
  UNION ALL SELECT c.r, k.r FROM k JOIN c USING (k) WHERE k.r <> c.r),
ends AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, ends.y FROM reach JOIN ends ON ends.x = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT a AS r, min(doc_id) AS least FROM reach JOIN d ON d.r = reach.b GROUP BY a) m USING (r)
"""


PHRASES = """
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, s, array_to_string(ws[i:i + s - 1], ' ') AS phrase
  FROM (SELECT lang, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(ws) >= s)),
f AS MATERIALIZED (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE s > 1),
cuts AS (SELECT *, unnest(range(1, s)) AS k FROM c),
scored AS (
  SELECT c.lang, c.s, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') AND x.s = k
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:c.s], ' ') AND y.s = c.s - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, ws, a, m, unnest(range(1, s - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE s > m)),
longer AS (SELECT lang, m, phrase, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.m = best.s AND longer.phrase = best.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a,
       l::BIGINT AS l, r::BIGINT AS r, n, score, k::INTEGER AS cut
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out one after the other; the vectors' components are rows (r, i, x)."""
    nearest = """a{n} AS MATERIALIZED (
  SELECT r, min(d * 1000 + k) AS m FROM (
    SELECT x.r, c.k, sum((x.x - c.x) * (x.x - c.x))::HUGEINT AS d FROM x JOIN c{n} c USING (i) GROUP BY x.r, c.k) GROUP BY r)"""
    moved = """c{next} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x)::BIGINT AS x
  FROM c{n} c LEFT JOIN (
    SELECT m % 1000 AS k, i, sum(x.x)::HUGEINT AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY ALL) t ON t.k = c.k AND t.i = c.i)"""
    steps = []
    for n in range(rounds):
        steps += [nearest.format(n=n), moved.format(n=n, next=n + 1)]
    steps.append(nearest.format(n=rounds))
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
all_x AS (
  SELECT r, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM e WHERE len(embedding) = 64),
x AS MATERIALIZED (
  SELECT r, i, floor(256 * e)::BIGINT AS x FROM all_x
  WHERE r NOT IN (SELECT r FROM all_x WHERE e IS NULL OR isnan(e) OR isinf(e))),
v AS (SELECT e.r, vec_id, l FROM e JOIN (SELECT r, list(x ORDER BY i) AS l FROM x GROUP BY r) g ON g.r = e.r),
c0 AS MATERIALIZED (
  SELECT k, x.i, x.x FROM x JOIN (
    SELECT r, row_number() OVER (ORDER BY sha256(concat('2:', coalesce(vec_id::VARCHAR, ''))), l) - 1 AS k FROM v) o USING (r)
  WHERE k < {k}),
{(","+chr(10)).join(steps)},
f AS MATERIALIZED (SELECT r, (m % 1000)::INTEGER AS cluster, (m // 1000)::BIGINT AS distance FROM a{rounds}),
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, h AS centroid_sha256, count(*) OVER (PARTITION BY cluster)::BIGINT AS cluster_size
FROM f JOIN v USING (r) JOIN h ON h.k = f.cluster
"""


ORACLES = {"op2_mixing": MIXING, "op3_quality": QUALITY, "op5_preference": PREFERENCE, "op6_jaccard": JACCARD, "op7_warc": WARC,
           "op11_clusters": _clusters(), "op12_phrases": PHRASES}

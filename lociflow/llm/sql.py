"""DuckDB SQL for the queries that SQL can express."""

#: Uniform numbers come from the first 52 bits of an MD5; the Poisson terms are summed from the left.
MIXING = """
WITH RECURSIVE own AS (
  SELECT source, coalesce(sum(n_chars), 0)::DOUBLE AS m FROM documents GROUP BY source
), weighed AS (
  SELECT source, m, floor(sqrt(m)) AS w FROM own
), total AS (
  SELECT sum(m) AS all_m, sum(w) AS all_w FROM weighed
), rated AS (
  SELECT source, CASE WHEN m > 0 AND all_w > 0 THEN w / all_w * all_m / m ELSE 0.0 END AS rate FROM weighed, total
), parted AS (
  SELECT source, rate, greatest(1, ceil(rate / 8.0))::BIGINT AS parts FROM rated
), terms AS (
  SELECT source, rate / parts AS mean, 0::BIGINT AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parted
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < 48
), cdf AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM terms GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, r.rate, i.i,
         ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i.i::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT row_number() OVER () AS rn, * FROM documents) d
  JOIN parted r ON d.source IS NOT DISTINCT FROM r.source,
  LATERAL (SELECT unnest(range(1, r.parts + 1)) AS i) i
), counted AS (
  SELECT w.doc_id, w.source, w.rate, sum(len(list_filter(c.cdf, lambda x: x <= w.u)))::BIGINT AS n
  FROM drawn w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source
  GROUP BY w.doc_id, w.source, w.rate
), copies AS (
  SELECT doc_id, source, rate AS mix_rate, unnest(range(0, n)) AS mix_copy FROM counted WHERE n > 0
)
SELECT doc_id, source, mix_rate, mix_copy::BIGINT AS mix_copy,
       ('0x' || substr(md5('18:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mix_copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS mix_order
FROM copies
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: CRC-32 of an id's decimal digits, bit by bit.
CRC = """(SELECT CASE WHEN {id} IS NULL THEN NULL ELSE xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
  list_transform(range(1, length({id}::VARCHAR) + 1), lambda i: ascii(substr({id}::VARCHAR, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1))))) END)"""

SNAPSHOT = f"""
WITH old AS (
  SELECT doc_id AS key, text, lang, source, {CRC.format(id="doc_id")} % 10 AS r FROM documents
), new AS (
  SELECT CASE WHEN r IN (3, 4) THEN -1 - key ELSE key END AS key, CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE WHEN r = 2 THEN source ELSE lang END AS lang, CASE WHEN r = 2 THEN lang WHEN r = 4 THEN NULL ELSE source END AS source
  FROM old WHERE r IS NULL OR r <> 0
  UNION ALL SELECT -1 - key, text, lang, source FROM old WHERE r = 5
), paired AS (
  SELECT n.key, o.key AS old_key, concat_ws(',', CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END, CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END,
         CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END) AS changed, n.text, n.lang, n.source
  FROM old o JOIN new n ON o.key = n.key
), o AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key) AS i FROM old WHERE key IS NULL OR key NOT IN (SELECT key FROM paired)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key) AS i FROM new WHERE key IS NULL OR key NOT IN (SELECT key FROM paired)
), found AS (
  SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, text, lang, source FROM paired
  UNION ALL
  SELECT CASE WHEN n.i IS NULL THEN o.key ELSE n.key END, o.key, CASE WHEN n.i IS NULL THEN 'delete' WHEN o.i IS NULL THEN 'insert' ELSE 'rekey' END, '', n.text, n.lang, n.source
  FROM o FULL JOIN n ON o.i = n.i AND o.text IS NOT DISTINCT FROM n.text AND o.lang IS NOT DISTINCT FROM n.lang AND o.source IS NOT DISTINCT FROM n.source
)
SELECT key, old_key, op, changed,
       CASE WHEN op <> 'delete' THEN sha256(concat_ws(chr(10), coalesce(text, '~'), coalesce(lang, '~'), coalesce(source, '~'))) END AS row_sha256,
       CASE WHEN op = 'insert' THEN 0 ELSE 1 END::BIGINT AS old_copies, CASE WHEN op = 'delete' THEN 0 ELSE 1 END::BIGINT AS new_copies
FROM found
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), vocabulary AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), sizes AS (
  SELECT lang, count(v.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN vocabulary v USING (lang) GROUP BY lang
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN vocabulary USING (lang, term) GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN vocabulary v USING (lang) LEFT JOIN counted c USING (lang, source, term)
), own AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM grid JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL) JOIN sizes USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

"""DuckDB SQL that says the same as some of the queries."""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

MIXING = """
WITH docs AS (
  SELECT doc_id, source, len(%s)::BIGINT AS size, sha256(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS key FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) %% 3)::INT + 1] AS weight FROM sizes
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER f, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM ranked WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs
), budgets AS (
  SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goals
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::BIGINT AS taken
FROM placed JOIN budgets USING (source)
""" % WORDS

NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS d, list_transform(list_zip(q.e, c.e), lambda x: abs(x[1] - x[2])) AS apart
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), scored AS (
  SELECT query_id, vec_id, CASE WHEN d BETWEEN 1e-150 AND 1e150 OR list_max(apart) = 0 THEN d
    ELSE list_max(apart) * list_distance(list_transform(apart, lambda x: x / list_max(apart)), list_transform(apart, lambda x: 0.0::DOUBLE)) END AS score FROM pairs
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

NEARDUP = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM docs
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), often AS (
  SELECT x FROM items GROUP BY x HAVING count(*) > 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter
  FROM items a JOIN often USING (x) JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * inter >= 85 * (na + nb - inter)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

SUBSTRINGS = """
WITH docs AS (
  SELECT doc_id, %s AS w FROM documents
), wins AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again
), lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs
), left_over AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN lists USING (doc_id) LEFT JOIN left_over USING (doc_id)
""" % WORDS

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m FROM places, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)
), often AS (
  SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM often WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, h.a AS l, t.a AS r, n, (1000::HUGEINT * c.a * n // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts c JOIN often h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:k], ' ')
    JOIN often t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1:], ' ') JOIN totals ON totals.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase
  FROM (SELECT lang, a, w, m, i, unnest(range(i, m + 1)) AS j FROM (SELECT lang, a, m, string_split(phrase, ' ') AS w, unnest(range(1, m + 1)) AS i FROM often WHERE m > 2)) WHERE j - i + 1 < m
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL
), remaining AS (
  SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM remaining QUALIFY rank <= 2000
"""

CONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id, least(len(w), 10) AS m, w FROM (
    SELECT item_id, list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark) WHERE len(w) > 0
), known AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM items)
), seen AS (
  SELECT row_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT row_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM items) WHERE len(w) >= m)
), hits AS (
  SELECT row_id, m, i, item_id FROM seen JOIN known USING (m, x)
), words AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY row_id
), found AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (row_id) LEFT JOIN found USING (row_id)
"""

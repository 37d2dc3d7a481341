"""DuckDB SQL for the fill-in-middle transformation and ranked search."""

FILL_IN_MIDDLE = r"""
WITH units AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS MATERIALIZED (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units),
parts AS MATERIALIZED (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS p,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

RANKED_SEARCH = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
docs AS MATERIALIZED (SELECT doc_id, r, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
sums AS MATERIALIZED (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs),
asked AS MATERIALIZED (
  SELECT item, any_value(item_id) AS item_id, term, count(*) AS repeats FROM (
    SELECT item, item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark))
  GROUP BY item, term),
held AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, sums GROUP BY term),
scored AS MATERIALIZED (
  SELECT item, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, r,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * all_docs) // all_terms)))))
              AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (r), sums GROUP BY item, r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
         doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

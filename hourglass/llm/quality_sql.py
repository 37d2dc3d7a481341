"""DuckDB SQL for the quality rules: the same counts, grid, exact bounds and choice."""

from hourglass.llm.quality_rules import ALPHA, DELTA, GRID, RULES, WINDOW

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RISK = ALPHA / len(RULES)


def _level(part: str, whole: str) -> str:
    return f"CAST(ceil(CASE WHEN {whole} > 0 THEN least({part}::DOUBLE / {whole}, 1.0) ELSE 0.0 END * {GRID}) AS INT)"


QUALITY = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_WS}, '')) > 0) AS lines
  FROM d),
grams AS (
  SELECT rid, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid),
q AS MATERIALIZED (
  SELECT w.rid, doc_id, lang, len(words) AS n_words, length(translate(t, {_WS}, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
         length(t) - length(translate(t, '!', '')) AS n_shouts
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
lv AS MATERIALIZED (
  SELECT *, [{_level('n_symbols', 'word_chars')}, {_level('n_capitals', 'word_chars')},
             {_level('n_shouts', 'n_words')}, {_level('n_dup_lines', 'n_lines')},
             {_level('n_repeat_words', 'n_words')}] AS lev FROM q),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
st AS MATERIALIZED (
  SELECT coalesce(lang, '*') AS stratum, lev, quality FROM lv JOIN lab USING (doc_id)),
tried AS (
  SELECT stratum, rule, cutoff, sum(quality)::BIGINT AS good,
         count(*) FILTER (quality = 1 AND lev[rule] > cutoff) AS k,
         count(*) FILTER (quality = 0 AND lev[rule] > cutoff) AS bad
  FROM st, (SELECT unnest(range(1, {len(RULES) + 1})) AS rule), (SELECT unnest(range(0, {GRID})) AS cutoff)
  GROUP BY stratum, rule, cutoff),
tested AS (
  SELECT *, (SELECT count(DISTINCT stratum) FROM st) * {len(RULES) * GRID} AS tests,
         list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1)
           + i * ln({_RISK}) + (good - i) * ln(1 - {_RISK})))) AS cdf
  FROM tried WHERE k < good * {_RISK}),
best AS MATERIALIZED (
  SELECT stratum, rule, arg_max(cutoff, (bad - k) * {GRID * 2} + cutoff) AS cutoff
  FROM tested WHERE cdf <= {DELTA} / tests AND bad > k GROUP BY stratum, rule),
rej AS (
  SELECT DISTINCT rid FROM (
    SELECT rid, lev, coalesce(lang, '*') AS stratum FROM lv) x
  JOIN best USING (stratum) WHERE lev[best.rule] > best.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND rid NOT IN (SELECT rid FROM rej) AS kept
FROM lv
"""

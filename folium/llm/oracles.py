"""Oracle SQL (DuckDB) of the training-data operators that SQL can express."""

from __future__ import annotations

from folium.llm.lines import MIN_PAGES, RATIO
from folium.llm.quality_rules import MIN_GROUP, MIN_WORDS, SLACK, SPREAD

_SPACE = r"[\x20\x09-\x0D]"


def quality_rules_sql() -> str:
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items())
    level = lambda name, keys: f"""
{name}_c AS (SELECT {keys}, m, c, sum(n) AS n FROM cells GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, m ORDER BY c) AS cum, sum(n) OVER (PARTITION BY {keys}, m) AS total FROM {name}_c),
{name} AS (SELECT {keys}, m, max(total) AS total,
  min(c) FILTER (WHERE 100 * cum >= 25 * total) AS q25, min(c) FILTER (WHERE 100 * cum >= 50 * total) AS q50,
  min(c) FILTER (WHERE 100 * cum >= 75 * total) AS q75 FROM {name}_r GROUP BY {keys}, m)"""  # noqa: E731
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS l FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
tri2 AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS k FROM tri),
cov AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS q FROM tri2 WHERE k >= 2),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
base AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  1000 * n_symbols // greatest(word_chars, 1) AS sym, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup,
  1000 * n_repeat_words // greatest(n_words, 1) AS rep, 10 * word_chars // greatest(n_words, 1) AS len0,
  CAST(1 AS BIGINT) << greatest(0, length(bin(len0)) - 10) AS unit, len0 // unit * unit AS len FROM base),
cells AS (SELECT lang, source, x.m AS m, x.c AS c, count(*) AS n FROM (
  SELECT lang, source, unnest([{{'m': 'sym', 'c': sym}}, {{'m': 'dup', 'c': dup}}, {{'m': 'rep', 'c': rep}}, {{'m': 'len', 'c': len}}]) AS x
  FROM m WHERE NOT base_failed) GROUP BY ALL),{level("s", "lang, source")},{level("l", "lang")},{level("g", "'all'")},
picked AS (SELECT s.lang, s.source, s.m,
  CASE WHEN s.total >= {MIN_GROUP} THEN s.q25 WHEN l.total >= {MIN_GROUP} THEN l.q25 ELSE g.q25 END AS q25,
  CASE WHEN s.total >= {MIN_GROUP} THEN s.q50 WHEN l.total >= {MIN_GROUP} THEN l.q50 ELSE g.q50 END AS q50,
  CASE WHEN s.total >= {MIN_GROUP} THEN s.q75 WHEN l.total >= {MIN_GROUP} THEN l.q75 ELSE g.q75 END AS q75
  FROM s JOIN l ON s.lang = l.lang AND s.m = l.m JOIN g ON g.m = s.m),
reach AS (SELECT lang, source, m, q50, greatest(CASE m {slack} END, {SPREAD} * (q75 - q25)) AS r FROM picked),
b AS (SELECT lang, source, max(q50 + r) FILTER (WHERE m = 'sym') AS sym_hi, max(q50 + r) FILTER (WHERE m = 'dup') AS dup_hi,
  max(q50 + r) FILTER (WHERE m = 'rep') AS rep_hi, max(q50 + r) FILTER (WHERE m = 'len') AS len_hi, max(q50 - r) FILTER (WHERE m = 'len') AS len_lo
  FROM reach GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(sym <= sym_hi AND dup <= dup_hi AND rep <= rep_hi AND len BETWEEN len_lo AND len_hi, false) AS kept
FROM m LEFT JOIN b USING (lang, source)
"""


def line_dedup_sql() -> str:
    trim = r"regexp_replace(regexp_replace(x, '^[ \t\r\x0b\x0c]+', ''), '[ \t\r\x0b\x0c]+$', '')"
    return rf"""
WITH l AS (SELECT doc_id, source, pos, x, {trim} AS y FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
pages AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
bad AS (SELECT l.source, y FROM l JOIN pages USING (source) WHERE y <> '' GROUP BY l.source, y, n
  HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) > CAST({RATIO} AS DOUBLE) * n)
SELECT doc_id, count(*) AS n_lines, count(bad.y) AS n_dropped,
  coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE bad.y IS NULL), '') AS clean_text
FROM l LEFT JOIN bad ON l.source = bad.source AND l.y = bad.y GROUP BY doc_id
"""


ORACLE_SQL = {"op7_line_dedup": line_dedup_sql(), "op10_quality_rules": quality_rules_sql()}

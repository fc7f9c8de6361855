"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents
), lines AS (
  SELECT r, doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM docs, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos)
), keyed AS (
  SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), judged AS (
  SELECT r, doc_id, pos, line, k IN (SELECT k FROM hot) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), wins AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c >= 2)
  GROUP BY doc_id
), c AS (
  SELECT d.doc_id, t, len(ls) AS n_lines, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps,
         length(t) - length(replace(t, '!', '')) AS bangs
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR word_chars < n_words * 2
            OR word_chars > n_words * 15 OR caps * 2 > word_chars OR bangs * 3 > n_words) AS kept
FROM b
"""


SUFFIX_DEDUP = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(0, n - 49)) AS i)
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS lost FROM w
), b AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM d, LATERAL (SELECT unnest(range(0, n)) AS p)
), g AS (
  SELECT b.doc_id, p, x, coalesce(max(lost::INTEGER) OVER (PARTITION BY b.doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.p
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM g
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM e GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

SHINGLE_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN CASE WHEN len(w) = 0 THEN [] ELSE [w] END
                          ELSE list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) END) AS g FROM words)
), sz AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN sz a ON a.doc_id = x JOIN sz b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(sz.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sz ON sz.doc_id = d.doc_id GROUP BY d.doc_id, sz.n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINE_DEDUP,
        "op3_suffix_dedup": SUFFIX_DEDUP,
        "op6_shingle_join": SHINGLE_JOIN,
        "op7_quality_rules": QUALITY_RULES,
    }

"""DuckDB text of the queries that SQL can express, written apart from the operators."""

SPACE = r"[\x20\x09-\x0D]"

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g
), c AS (
  SELECT rid, count(DISTINCT i + k) AS repeat FROM r, range(3) AS s(k) WHERE n > 1 GROUP BY rid
), l AS (
  SELECT rid, line, length(regexp_replace(line, '{SPACE}+', '', 'g')) AS chars,
    length(line) - length(translate(line, '|»›•', '')) AS bars,
    length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
    length(line) - length(replace(line, '!', '')) AS shouts,
    regexp_matches(lower(line), 'all rights reserved|enable javascript|accept cookies|use of cookies|cookie policy|privacy policy|terms of use|terms of service|lorem ipsum|click here|sign up for our newsletter') AS phrase,
    regexp_matches(line, '[.!?:;\x{{2026}}\x{{3002}}][\x22\x27)\]\x{{BB}}\x{{201D}}\x{{2019}}]*({SPACE}|\z)') AS ends
  FROM (SELECT rid, unnest(ls) AS line FROM w)
), f AS (
  SELECT rid, chars, line,
    chars > 0 AND (bars * 20 > chars OR symbols * 10 > chars OR shouts * 20 > chars OR phrase OR NOT ends) AS fails
  FROM l
), s AS (
  SELECT rid, count(*) FILTER (WHERE fails) AS n_bad_lines, coalesce(sum(chars) FILTER (WHERE NOT fails), 0)::BIGINT AS kept_chars,
    count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0) AS n_dup_lines
  FROM f GROUP BY rid
), a AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(repeat, 0)::BIGINT AS n_repeat_words, n_bad_lines::BIGINT AS n_bad_lines, kept_chars
  FROM w JOIN s USING (rid) LEFT JOIN c USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
)
SELECT *, NOT base_failed AND 100 * kept_chars >= 50 * word_chars AS kept FROM b
"""

_HOST = "translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract({u}, '(?s)^.*?://[^?#]*\?([^#]*)', 1)"


def _address(u):
    kept = (
        f"list_filter(string_split({_QUERY.format(u=u)}, '&'), "
        "lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))"
    )
    return (
        f"CASE WHEN contains({u}, '://') THEN regexp_replace({_HOST.format(u=u)}, ':(80|443)$', '') "
        f"|| regexp_replace({_PATH.format(u=u)}, '/+$', '') "
        f"|| CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"
    )


def _rule(h, p, value):
    tests = [
        ("block", "net/es/", "net", "/es/"),
        ("block", "net/fr/", "net", "/fr/"),
        ("allow", "com/", "com", "/"),
    ]
    tests = [
        ("allow", "www.example.com/en/", "www.example.com", "/en/"),
        ("block", "example.com/en/", "example.com", "/en/"),
        *tests,
    ]
    cases = " ".join(
        f"WHEN ({h} = '{host}' OR {h} LIKE '%.{host}') AND starts_with({p}, '{way}') THEN '{rule if value == 'rule' else verdict}'"
        for verdict, rule, host, way in tests
    )
    return f"CASE {cases} END"


_LINK = r"""
  SELECT {a} AS a, {b} AS b FROM (
    SELECT url, CASE WHEN contains(t, '://') THEN t
      WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || t
      WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?)://', 1) || '://' || {host} || t END AS target
    FROM (
      SELECT url, trim(regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^\s"''>]*)', 1)) AS t
      FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM pages)
      WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b')
      UNION ALL
      SELECT url, trim(regexp_extract(tag, '(?is)url\s*=\s*[''"]?([^"''>]*)', 1)) AS t
      FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS tag FROM pages)
    )
  )
"""

URLS = f"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS u, {_HOST.format(u="coalesce(url, '')")} AS host, {_PATH.format(u="coalesce(url, '')")} AS path FROM pages
), links AS ({_LINK.format(a=_address("url"), b=_address("target"), host=_HOST.format(u="url"))}), e AS (
  SELECT a, b FROM links WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM links WHERE a IS NOT NULL AND b IS NOT NULL
), judged AS (
  SELECT page_id, host, path, {_rule("host", "path", "rule")} AS rule, {_rule("host", "path", "verdict")} AS own, {_address("u")} AS node FROM p
), nodes AS (
  SELECT node FROM judged WHERE node IS NOT NULL UNION SELECT a FROM e
), reach AS (
  SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), seed AS (
  SELECT node, own FROM judged WHERE own IS NOT NULL AND node IS NOT NULL
  UNION SELECT a, {_rule("regexp_extract(a, '^[^/?]*')", "regexp_extract(a, '^[^/?]*([^?]*)', 1)", "verdict")} FROM e
), class AS (
  SELECT reach.a AS node, min(seed.own) AS verdict FROM reach JOIN seed ON seed.node = reach.b WHERE seed.own IS NOT NULL GROUP BY reach.a
)
SELECT page_id, host, path, rule, coalesce(own, class.verdict, 'allow') AS verdict FROM judged LEFT JOIN class USING (node)
"""

LINE_DEDUP = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), j AS (
  SELECT k.rid, k.doc_id, k.i, k.line, coalesce(c.owner <> k.doc_id, false) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""

ORACLE = {"op4_line_quality": QUALITY, "op6_url_equivalence": URLS, "op13_line_dedup": LINE_DEDUP}

"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, BOILERPLATE_WORDS, LEAST_LEFT, SHORT_LINE
from .url_filter import BAD_LIMIT, LEAST_STRENGTH, MOST_STRENGTH, RULES, Z

_WS = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WS}'), lambda x: x <> '')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _ink(text: str) -> str:
    return f"length(regexp_replace({text}, '{_WS}', '', 'g'))"


_CLOSED = r"[.!?:;…\"''”’»)\]][\x20\x09-\x0D]*$"
_BOILER = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

LINE_FIRST = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {_words("text")} AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (
      SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM p GROUP BY r),
l AS (SELECT r, k, line, len({_words("line")}) AS lw FROM (
      SELECT r, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)),
m AS (SELECT r, count(*) - count(DISTINCT line) AS dup,
        coalesce(sum({_ink("line")}) FILTER (NOT (
          {_count("line", "[#*$%&|<>]")} * 10 > {_ink("line")}
          OR {_count("line", "[!?]{2,}")} >= 3
          OR (lw < {SHORT_LINE} AND NOT regexp_matches(line, '{_CLOSED}'))
          OR {_count("line", "[|»›•·]")} >= 3
          OR (({_BOILER}) AND lw <= {BOILERPLATE_WORDS}))), 0)::BIGINT AS clean_chars
      FROM l WHERE lw > 0 GROUP BY r),
b AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, {_ink("d.text")}::BIGINT AS word_chars,
        {_count("d.text", "[#*$%&|<>]")}::BIGINT AS n_symbols,
        coalesce(m.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(m.clean_chars, 0)::BIGINT AS clean_chars
      FROM d JOIN w USING (r) LEFT JOIN m USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND clean_chars >= {LEAST_LEFT} * word_chars AS kept FROM f
"""

_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES)


def _strength(children: str) -> str:
    return f"""(SELECT coalesce(CASE WHEN tau > 0 THEN least(greatest(p * (1 - p) / tau - 1, {LEAST_STRENGTH}),
        {MOST_STRENGTH}) END, {MOST_STRENGTH}) FROM (
      SELECT p, (bb - N * p * p - (k - 1) * p * (1 - p)) / nullif(N - nn / N, 0) AS tau FROM (
        SELECT sum(n) AS N, count(*) AS k, sum(n * n) AS nn, sum(bad * bad / n) AS bb,
               sum(bad) / sum(n) AS p FROM {children} WHERE n > 0)))"""


HOST_REPUTATION = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule, rhost, rpath) AS (VALUES {_RULE_ROWS}),
hit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY r),
known AS (SELECT doc_id AS id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1
                 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad
          FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
        string_split(host, '.')[-1] AS suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
        FROM p LEFT JOIN known ON page_id = id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s AS (SELECT {_strength("suffixes")} AS s1, {_strength("domains")} AS s2, {_strength("hosts")} AS s3,
        (SELECT sum(bad) / nullif(sum(n), 0) FROM suffixes) AS m0),
t1 AS (SELECT suffix, (bad + s1 * m0) / (n + s1) AS m1 FROM suffixes, s),
t2 AS (SELECT domain, (bad + s2 * m1) / (n + s2) AS m2 FROM domains JOIN t1 USING (suffix), s),
t3 AS (SELECT host, n, s3, (bad + s3 * m2) / (n + s3) AS mean FROM hosts JOIN t2 USING (domain), s),
t AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + s3 + 1)) AS bound FROM t3)
SELECT page_id, p.host, path, rule,
       coalesce(verdict, CASE WHEN bound > {BAD_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       round(bound, 9) AS bad_bound
FROM p LEFT JOIN hit USING (r) LEFT JOIN t ON t.host = p.host
"""

EXACT_DEDUP = """
WITH h AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM h WINDOW w AS (PARTITION BY s)
"""

SOURCE_DIVERGENCE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(n), 0)::HUGEINT AS n
      FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
        (1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v))::BIGINT AS p,
        (1 + (1000000000 * (k.n + 5)) // (v.n + 5 * v.v))::BIGINT AS q
      FROM s JOIN v USING (lang) JOIN kept k USING (lang)
      LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item,
           coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM term)
WHERE rank <= 50
"""

SQL: dict[str, str] = {"op4_line_first": LINE_FIRST, "op8_host_reputation": HOST_REPUTATION,
                       "op11_exact_dedup": EXACT_DEDUP, "op13_source_divergence": SOURCE_DIVERGENCE}

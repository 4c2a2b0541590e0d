"""DuckDB SQL with the results of the queries, written from their contracts."""

from .urls import CUTOFF, RULES, Z

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0
), sizes AS (SELECT DISTINCT m FROM windows
), starts AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS p, w FROM docs JOIN sizes ON len(w) >= m
), hits AS (
  SELECT s.doc_id, s.p, s.m, x.item_id FROM (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM starts) s JOIN windows x ON x.m = s.m AND x.g = s.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(k.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words k USING (doc_id) LEFT JOIN named i USING (doc_id)
"""


def _places(kind: str, pattern: str, group: int = 0) -> str:
    """Matches of a pattern with their places, from the pieces between them. DuckDB's split takes the same leftmost matches."""
    return rf"""
  SELECT doc_id, '{kind}' AS kind, s AS start, s + length(m) AS "end", part FROM (
    SELECT doc_id, m, part, sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM (
      SELECT doc_id, generate_subscripts(regexp_extract_all(t, {pattern}), 1) AS i, unnest(regexp_extract_all(t, {pattern})) AS m, unnest(regexp_extract_all(t, {pattern}, {group})) AS part,
             unnest(regexp_split_to_array(t, {pattern})[1:len(regexp_extract_all(t, {pattern}))]) AS g
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, {pattern})
    ) WINDOW w AS (PARTITION BY doc_id ORDER BY i)
  )"""


_ASSIGN = r"""'(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""

SECRET_SCAN = rf"""
WITH base AS (
  SELECT *, 0 AS rank FROM ({_places("assign", _ASSIGN, 1)}) WHERE length(part) >= 6
  UNION ALL SELECT *, 1 FROM ({_places("access", r"'AKIA[A-Z0-9]+'")}) WHERE length(part) >= 20
  UNION ALL SELECT *, 2 FROM ({_places("hex", "'[0-9a-f]+'")}) WHERE length(part) >= 24
), more AS (
  SELECT *, 3 AS rank FROM ({_places("github", r"'\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}'")})
  UNION ALL SELECT *, 4 FROM ({_places("jwt", r"'\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'")})
  UNION ALL SELECT *, 5 FROM ({_places("pem", r"'-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----'")})
  UNION ALL SELECT *, 6 FROM ({_places("slack", r"'\bxox[abprs]-[A-Za-z0-9-]{10,}'")})
), spans AS (
  SELECT * FROM base UNION ALL SELECT * FROM more
), named AS (
  SELECT doc_id, rank, kind, start, concat(kind, ':', CAST(start AS BIGINT), ':', CAST("end" AS BIGINT)) AS s FROM spans
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
         string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans
  FROM named GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules by length, the longest first.
_RULES = sorted((r.pattern, r.verdict) for r in RULES)
_RULES.sort(key=lambda r: -len(r[0]))


def _fits(pattern: str) -> str:
    name, slash, path = pattern.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{path}')"


def _level(name: str, groups: str, prior: str, before: str) -> str:
    """A level of the reputation: its units with their prior, the strength of that prior, and the estimates."""
    clipped = "least(greatest(prior, 1e-6), 1 - 1e-6)"
    spread = f"{clipped} * (1 - {clipped})"
    over, total = f"sum(power(bad - n * {clipped}, 2) - n * {spread})", f"sum(n * (n - 1.0) * {spread})"
    rho = f"CASE WHEN coalesce({total}, 0) = 0 THEN 0.5 ELSE coalesce({over}, 0) / {total} END"
    return f"""{name}_units AS (SELECT {groups}, sum(n) AS n, sum(bad) AS bad, any_value({prior}) AS prior FROM hosts {before} GROUP BY {groups}),
{name}_strength AS (SELECT 1 / least(greatest({rho}, 1e-4), 0.9999) - 1 AS s FROM {name}_units),
{name} AS (SELECT {groups}, (bad + s * prior) / (n + s) AS {name}_mean, n + s AS {name}_weight FROM {name}_units, {name}_strength)"""


URL_FILTER = rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS rest FROM pages)
), outcomes AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY 1),
hosts AS (
  SELECT host, n, bad, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS domain, l[-1] AS suffix
  FROM (SELECT host, string_split(host, '.') AS l, count(good) AS n, count(*) FILTER (good = 0) AS bad FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY host)
), whole AS (SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 0.0 ELSE (sum(bad) + 0.5) / (sum(n) + 1.0) END AS mean FROM hosts),
{_level("suffixes", "suffix", "mean", ", whole")}, {_level("domains", "suffix, domain", "suffixes_mean", "JOIN suffixes USING (suffix)")},
{_level("known", "host", "domains_mean", "JOIN domains USING (suffix, domain)")},
judged AS (SELECT host, power(sin(greatest(asin(sqrt(least(greatest(known_mean, 0.0), 1.0))) - {Z} / (2 * sqrt(known_weight + 1)), 0.0)), 2) >= {CUTOFF} AS blocked FROM known)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(p)} THEN '{p}'" for p, _ in _RULES)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(p)} THEN '{v}'" for p, v in _RULES)} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN judged USING (host)
"""

#: Terms: letters and digits, ASCII letters in lower case.
_TERMS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SEARCH = rf"""
WITH docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
impacts AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))) AS impact FROM postings JOIN sizes USING (doc_id) JOIN weights USING (term), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(times * impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

HARD_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

#: The base columns of quality rules.
QUALITY_BASE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM split WHERE len(w) >= 3),
repeated AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM split LEFT JOIN covered USING (doc_id)
"""

_DIGITS = "regexp_replace(part, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INTEGER) ELSE CAST({_DIGITS}[-i] AS INTEGER) * 2 - 9 * (CAST({_DIGITS}[-i] AS INTEGER) // 5) END)) % 10 = 0"
#: The base columns of personal data.
PII_BASE = rf"""
WITH base AS (
  SELECT *, 0 AS rank FROM ({_places("email", r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'")})
  UNION ALL SELECT *, 1 FROM ({_places("ip", r"'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'")}) WHERE len(list_filter(string_split(part, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
  UNION ALL SELECT *, 2 FROM ({_places("card", r"'[0-9]([\x20-]?[0-9])+'")}) WHERE length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}
  UNION ALL SELECT *, 3 FROM ({_places("phone", r"'\+[0-9][\x20().0-9-]+[0-9]'")}) WHERE length({_DIGITS}) BETWEEN 9 AND 15
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p,
         string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST("end" AS BIGINT)), ',' ORDER BY rank, start) AS spans FROM base GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(e, 0) AS BIGINT) AS n_email, CAST(coalesce(i, 0) AS BIGINT) AS n_ip, CAST(coalesce(c, 0) AS BIGINT) AS n_card, CAST(coalesce(p, 0) AS BIGINT) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""

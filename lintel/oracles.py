"""DuckDB SQL with the results of the queries, over the same tables and templates."""

from __future__ import annotations

from .plans.catalog import BY_ID, MESSAGES, RULES
from .plans.corpus import TEMPLATES


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def say(key: str, *values: str) -> str:
    """A message with SQL expressions in its places."""
    parts = MESSAGES[key].replace("%d", "%s").split("%s")
    out = [_quoted(parts[0])]
    for v, p in zip(values, parts[1:], strict=True):
        out += [f"({v})", _quoted(p)]
    return "concat(" + ", ".join(out) + ")"


_VALUES = ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(TEMPLATES))
N = len(TEMPLATES)
EVENTS = f"""templates(idx, line) AS (VALUES {_VALUES}), objects AS (
  SELECT user_id AS object_key, string_agg(line, chr(10) ORDER BY event_id) AS text
  FROM events JOIN templates ON idx = (event_id * 7 + user_id + event_id * event_id % 11) % {N} GROUP BY user_id
)"""
ORDERS = f"""templates(idx, line) AS (VALUES {_VALUES}), objects AS (
  SELECT o_custkey AS object_key, string_agg(line, chr(10) ORDER BY o_orderkey) AS text
  FROM orders JOIN templates ON idx = (o_orderkey * 5 + o_custkey * 3) % {N} GROUP BY o_custkey
)"""
CALLS = """objects AS (
  SELECT concat('obj', o_custkey) AS object_key, o_custkey AS ord, string_agg(concat('call(''obj', (o_orderkey * 7 + o_custkey) % 400, ''', &v)'), chr(10) ORDER BY o_orderkey) AS text
  FROM orders GROUP BY o_custkey
)"""

_STRING = """''(?:[^'']|'''')*(?:''|\\z)|"(?:[^"]|"")*(?:"|\\z)"""
_WS = r"[ \t\n\x0b\f\r\x{85}\x{a0}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


#: Lines with their views; every string of the corpus is ASCII but for the templates' comments.
LINES = rf"""masked AS (
  SELECT object_key, text, array_to_string(list_transform(regexp_extract_all(text, '(?s){_STRING}|//[^\n]*|/\*.*?\*/|.'), lambda t: CASE WHEN t LIKE '/*%' AND length(t) > 1 THEN regexp_replace(t, '[^\r\n]', ' ', 'g') ELSE t END), '') AS eval
  FROM objects
), numbered AS (
  SELECT object_key, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS raw, unnest(string_split(eval, chr(10))) AS eval FROM masked
), lines AS (
  SELECT object_key, line_no, raw, stripped, lower(stripped) AS lower, clean, lower(clean) AS clean_lower, code, lower(code) AS code_lower FROM (
    SELECT object_key, line_no, raw, {_trim("eval")} AS stripped, {_trim(rf"regexp_replace(eval, '(?s){_STRING}|//.*|/\*.*?(?:\*/|\z)', '', 'g')")} AS clean,
           {_trim(rf"regexp_replace(eval, '(?s)({_STRING})|//.*|/\*.*?(?:\*/|\z)', '\1', 'g')")} AS code
    FROM numbered
  ) WHERE stripped <> ''
)"""


def kw(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"{x} = {_quoted(w)} OR starts_with({x}, {_quoted(w + ' ')})" for w in words) + ")"


def has(x: str, needle: str) -> str:
    return f"contains({x}, {_quoted(needle)})"


C = "clean_lower"


def _depth(delta: str, extra: str = "", source: str = "lines") -> str:
    """d (after the line) and p (before it) of a clamped depth."""
    return f"""stepped AS (SELECT *, {delta} AS step{extra} FROM {source}),
summed AS (SELECT *, sum(step) OVER (PARTITION BY object_key ORDER BY line_no) AS s FROM stepped),
clamped AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY object_key ORDER BY line_no)) AS d FROM summed),
deep AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY object_key ORDER BY line_no), 0) AS p FROM clamped)"""


def _out(rule: str, description: str, source: str, where: str, line: str = "line_no", content: str = "raw") -> str:
    return f"SELECT object_key, '{rule}' AS rule_id, '{BY_ID[rule].severity}' AS severity, CAST({line} AS INTEGER) AS line_number, {description} AS description, {content} AS line_content FROM {source} WHERE {where}"


def _pairs(rule: str, opens: str, mark: str, closes: str) -> tuple[str, str]:
    ctes = _depth(f"CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END", f", {opens} AS o, {mark} AS m, {closes} AS c")
    ctes += """, leveled AS (SELECT *, CASE WHEN o THEN d ELSE p END AS lvl FROM deep),
seen AS (SELECT *, max(CASE WHEN o THEN line_no END) OVER w AS ol, max(CASE WHEN m THEN line_no END) OVER w AS ml FROM leveled WINDOW w AS (PARTITION BY object_key, lvl ORDER BY line_no)),
matched AS (SELECT s.*, r.raw AS oraw FROM seen s LEFT JOIN lines r ON r.object_key = s.object_key AND r.line_no = s.ol)"""
    return ctes, _out(rule, say(rule, "ol"), "matched", "c AND p > 0 AND NOT coalesce(ml > ol, false)", "ol", "oraw")


_CONT = f"""CASE WHEN {C} = '' OR starts_with({C}, '//') OR starts_with({C}, '/*') THEN true
 WHEN {kw(C, 'if', 'do', 'msg', 'for', 'while', 'return', 'new', 'call', 'sub', 'endsub', 'endfor', 'endif', 'else', 'elseif', 'do case', 'case', 'otherwise', 'endcase')} THEN false
 WHEN {kw(C, 'when', 'or', 'and', 'in', 'like', 'between')} THEN true
 ELSE NOT (contains({C}, '=') AND NOT (contains({C}, '==') OR contains({C}, '!=') OR contains({C}, '<=') OR contains({C}, '>=')) AND regexp_matches({C}, '^[_&\\p{{L}}]')) END"""
WHERE = f"""looped AS (SELECT *, coalesce(last_value(CASE WHEN {kw(C, 'for each')} THEN true WHEN {kw(C, 'endfor')} THEN false END IGNORE NULLS) OVER (PARTITION BY object_key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM lines),
bounded AS (SELECT *, {kw(C, 'where')} AND inside AS b, {C} <> '' AND NOT {kw(C, 'where')} AND ({kw(C, 'defined by', 'order')} OR NOT ({_CONT})) AS stop, {kw(C, 'for each', 'endfor')} AS edge FROM looped),
blocked AS (SELECT *, sum(CASE WHEN b OR edge THEN 1 ELSE 0 END) OVER (PARTITION BY object_key ORDER BY line_no) AS blk FROM bounded),
wheres AS (SELECT *, {C} <> '' AND blk > 0 AND first_value(b) OVER w AND max(CASE WHEN stop THEN 1 ELSE 0 END) OVER w = 0 AS active, first_value(line_no) OVER w AS wl FROM blocked WINDOW w AS (PARTITION BY object_key, blk ORDER BY line_no))"""


def _where(rule: str, hit: str, *values: str) -> tuple[str, str]:
    ctes = f"{WHERE}, hits AS (SELECT *, row_number() OVER (PARTITION BY object_key, blk ORDER BY line_no) AS nth FROM wheres WHERE active AND ({hit}))"
    return ctes, _out(rule, say(rule, *values, "wl"), "hits", "nth = 1")


def _names(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ', ')"


_INDENT = "(strlen(raw) - strlen(ltrim(raw)))"
_BAD_WORDS = ", ".join(_quoted(w) for w in ("if", "case", "and", "or", "not", "null", "nullvalue", "like", "in", "true", "false", "do", "otherwise", "empty", "isempty", "isvalid", "udp", "new", "rows", "count"))
_ATTRS = rf"list_filter(list_transform(list_filter(regexp_extract_all(concat(' ', clean), '[^a-zA-Z0-9_][A-Z][a-zA-Z0-9_]*'), lambda w: w[1] NOT IN ('&', '.')), lambda w: w[2:]), lambda w: lower(w) NOT IN ({_BAD_WORDS}))"
_FUNCS = r"list_filter(list_transform(list_filter(regexp_extract_all(concat(' ', clean), '[^a-zA-Z0-9_][a-zA-Z0-9_]+\s*\('), lambda f: f[1] NOT IN ('&', '.')), lambda f: upper(regexp_extract(f, '[a-zA-Z0-9_]+'))), lambda f: f NOT IN ('AND', 'OR', 'NOT', 'IF', 'CASE', 'WHERE', 'IN', 'LIKE'))"
_LOGIC = rf"list_filter(string_split_regex(regexp_replace({C}, '(?s)^(.*?)between.*? and ', '\1'), '\s+'), lambda t: t IN ('and', 'or', 'in'))"
_LITERAL = r"""regexp_extract(regexp_replace(code_lower, '^where', ''), '(?i)(?:!=|<>|<=|>=|=|<|>|\blike)\s*(\d+|''(?:[^'']|'''')*''|"(?:[^"]|"")*")', 1)"""
_NAME = r"regexp_replace(regexp_replace(substr(stripped, 4), '^\s+|\s+$', '', 'g'), ';+$', '')"
_SUBNAME = rf"lower(trim(regexp_replace(regexp_replace({_NAME}, '^[''\"](.*)[''\"]$', '\1'), '\s+', ' ', 'g')))"
_CALLED = r"""lower(trim(regexp_replace(regexp_replace(regexp_extract(stripped, '(?i)(?:^|\s)do\s+(''[^'']+''|"[^"]+"|[^\s]+)', 1), ';+$', ''), '^[''"](.*)[''"]$', '\1')))"""


def _assigned(v: str, operators: str) -> str:
    rest = f"substr(lower, strpos(lower, '{v}') + {len(v)})"
    return rf"(strpos(lower, '{v}') > 0 AND NOT regexp_matches({rest}, '^[a-zA-Z0-9]') AND regexp_matches({rest}, '^\s*{operators}'))"


_LOOSE = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(concat(lower, ' '), '{v}[^a-zA-Z0-9_]') THEN '{v.upper()}' END" for v in ("&i", "&j", "&k")) + "], lambda v: v IS NOT NULL)"
_COUNTERS = "list_filter([" + ", ".join(f"CASE WHEN {_assigned(v, '(?:=|[+]=|-=)')} THEN '{v.upper()}' END" for v in ("&i", "&j", "&k")) + "], lambda v: v IS NOT NULL)"
_LOOP = f"CASE WHEN {has('lower', 'for')} THEN NOT {kw('lower', 'for each')} AND {kw('lower', 'for')} ELSE {kw('lower', 'do while')} END"
_AMP, _EQ = has(C, "&"), has(C, "=")
_TOKENS_DO = r"list_filter(string_split_regex(lower, '\s+'), lambda t: t <> '')"

RULE_SQL: dict[str, tuple[str, str]] = {}
RULE_SQL["GX.1.1"] = ("", _out("GX.1.1", say("GX.1.1", _names("vars")), r"(SELECT *, regexp_extract_all(clean, '&[a-z][a-zA-Z0-9_]*') AS vars FROM lines)", "len(vars) > 0"))
_e12 = "CASE WHEN e AND p > 0 THEN p - 1 ELSE p END"
RULE_SQL["GX.1.2"] = (
    _depth(f"CASE WHEN {C} = '' THEN 0 WHEN {kw(C, 'endfor', 'endif', 'endcase', 'enddo', 'endsub')} THEN -1 WHEN {kw(C, 'for each', 'if', 'case', 'do while', 'sub')} THEN 1 ELSE 0 END", f", {kw(C, 'endfor', 'endif', 'endcase', 'enddo', 'endsub')} AS e"),
    _out("GX.1.2", say("GX.1.2", f"CAST(4 * ({_e12}) AS INTEGER)", f"CAST({_e12} AS INTEGER)", _INDENT), "deep", f"{C} <> '' AND ({_e12}) > 0 AND {_INDENT} < 4 * ({_e12})"),
)
_c13, _ = _pairs("GX.1.3.2", kw(C, "for each"), f"(NOT {kw(C, 'for each')} AND {kw(C, 'where')})", kw(C, "endfor"))
_c13 = _c13.replace(", matched AS", f", defined AS (SELECT *, max(CASE WHEN NOT o AND NOT {kw(C, 'where')} AND {has(C, 'defined by')} THEN line_no END) OVER (PARTITION BY object_key, lvl ORDER BY line_no) AS dl FROM seen), matched AS").replace("FROM seen s LEFT", "FROM defined s LEFT").replace(",\nmatched AS", f",\ndefined AS (SELECT *, max(CASE WHEN NOT o AND NOT {kw(C, 'where')} AND {has(C, 'defined by')} THEN line_no END) OVER (PARTITION BY object_key, lvl ORDER BY line_no) AS dl FROM seen),\nmatched AS")
_words = r"len(list_filter(string_split_regex(clean, '\s+'), lambda t: t <> ''))"
RULE_SQL["GX.1.3"] = (
    _c13,
    " UNION ALL ".join([
        _out("GX.1.3", say("GX.1.3/open"), "matched", f"o AND {_words} < 3"),
        _out("GX.1.3", say("GX.1.3/close"), "matched", f"c AND p > 0 AND NOT contains(raw, '//') AND {_words} < 2"),
        _out("GX.1.3", say("GX.1.3/where", "ol"), "matched", "c AND p > 0 AND coalesce(ml > ol, false) AND NOT coalesce(dl > ol, false)", "ol", "oraw"),
    ]),
)
RULE_SQL["GX.1.3.1"] = (
    WHERE,
    _out("GX.1.3.1", f"CASE WHEN {kw(C, 'where')} THEN {say('GX.1.3.1/where')} ELSE {say('GX.1.3.1/body')} END", "looped", f"{C} <> '' AND inside AND NOT {kw(C, 'for each', 'endfor')} AND {_INDENT} < 4"),
)
RULE_SQL["GX.1.3.2"] = _pairs("GX.1.3.2", kw(C, "if"), kw(C, "else"), kw(C, "endif"))
RULE_SQL["GX.1.3.3"] = _pairs("GX.1.3.3", kw(C, "do case"), kw(C, "otherwise"), kw(C, "endcase"))
RULE_SQL["GX.1.4.1"] = (
    rf"""assigned AS (SELECT *, regexp_extract(clean, '&([a-zA-Z0-9_]+)\s*=', 1) AS v FROM lines WHERE {_AMP} AND {_EQ}),
kept AS (SELECT *, lower(v) AS k, contains(lower(substr(clean, strpos(clean, '=') + 1)), concat('&', lower(v))) AS own FROM assigned WHERE v <> '' AND lower(v) NOT IN ('ok', 'error', 'flag', 'status', 'count', 'exist', 'sdt', 'msg')),
prior AS (SELECT *, lag(line_no) OVER (PARTITION BY object_key, k ORDER BY line_no) AS l FROM kept)""",
    _out("GX.1.4.1", say("GX.1.4.1", "v", "l"), "prior", "NOT own AND line_no - l > 15"),
)
RULE_SQL["GX.1.4.2"] = ("", _out("GX.1.4.2", say("GX.1.4.2", _names("a")), f"(SELECT *, {_ATTRS} AS a FROM lines)", f"{kw(C, 'if', 'case')} AND NOT {kw(C, 'if &', 'if(&', 'case &', 'case(&')} AND len(a) > 0"))
RULE_SQL["GX.1.4.3"] = (
    rf"""parms AS (SELECT *, sum(CASE WHEN regexp_matches({C}, '\bparm\s*\(') THEN 1 ELSE 0 END) OVER (PARTITION BY object_key ORDER BY line_no) AS blk FROM lines),
ended AS (SELECT *, min(CASE WHEN contains({C}, ')') THEN line_no END) OVER (PARTITION BY object_key, blk) AS fin, first_value(line_no) OVER w AS ol, first_value(raw) OVER w AS oraw FROM parms WHERE blk > 0 WINDOW w AS (PARTITION BY object_key, blk ORDER BY line_no)),
texts AS (SELECT object_key, ol AS line_no, oraw AS raw, string_agg({C}, ' ' ORDER BY line_no) AS t FROM ended WHERE line_no <= fin AND {C} <> '' GROUP BY object_key, blk, ol, oraw),
params AS (SELECT object_key, line_no, raw, trim(unnest(string_split(regexp_extract(t, '(?s)parm\s*\((.*?)\)', 1), ','))) AS p FROM texts)""",
    _out("GX.1.4.3", say("GX.1.4.3", "CASE WHEN regexp_matches(p, '&[a-zA-Z0-9_]+') THEN regexp_extract(p, '&[a-zA-Z0-9_]+') ELSE p END"), "params", "p <> '' AND NOT regexp_matches(p, '^(?:in|out|inout):')"),
)
_ops = r"len(regexp_extract_all(clean, '(?i)\b(?:and|or)\b'))"
RULE_SQL["GX.1.5"] = ("", _out("GX.1.5", say("GX.1.5", _ops), "lines", f"{kw(C, 'if', 'case')} AND (contains({C}, ' and ') OR contains({C}, ' or ')) AND {_ops} >= 3"))
_CMT = "(starts_with(stripped, '//') OR starts_with(stripped, '/*'))"
RULE_SQL["GX.1.6.1"] = (
    f"""said AS (SELECT *, {_CMT} AS cmt, {_TOKENS_DO} AS t FROM lines), prior AS (SELECT *, coalesce(lag(cmt) OVER (PARTITION BY object_key ORDER BY line_no), false) AS before FROM said)""",
    _out("GX.1.6.1", say("GX.1.6.1"), "prior", f"NOT cmt AND NOT before AND {_CALLED} <> 'gu: op -> cancelar' AND len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'do' AND NOT coalesce(ends_with(CASE WHEN i > 1 THEN t[i - 1] END, '&'), false) AND coalesce(t[i + 1], '') NOT IN ('while', 'case'))) > 0"),
)
RULE_SQL["GX.1.6.2"] = (
    f"""subs AS (SELECT *, {_CMT} AS cmt, {kw('lower', 'sub')} AND {_SUBNAME} <> 'gu: op -> cancelar' AS q, row_number() OVER (PARTITION BY object_key ORDER BY line_no) AS rn FROM lines),
runs AS (SELECT *, rn - coalesce(max(CASE WHEN NOT q THEN rn END) OVER (PARTITION BY object_key ORDER BY line_no), 0) AS nth FROM subs),
after AS (SELECT *, lag(CASE WHEN q AND nth % 2 = 1 THEN line_no END) OVER w AS ol, lag(raw) OVER w AS oraw FROM runs WINDOW w AS (PARTITION BY object_key ORDER BY line_no))""",
    _out("GX.1.6.2", say("GX.1.6.2", "ol"), "after", "ol IS NOT NULL AND NOT cmt", "ol", "oraw"),
)
RULE_SQL["GX.1.7.1"] = (
    """sections AS (SELECT *, starts_with(lower, 'rules:') AS b, starts_with(lower, 'events') OR starts_with(lower, 'source') OR starts_with(lower, 'sub ') AS e FROM lines),
inside AS (SELECT *, NOT b AND NOT e AND coalesce(last_value(CASE WHEN b THEN true WHEN e THEN false END IGNORE NULLS) OVER (PARTITION BY object_key ORDER BY line_no), true) AS r FROM sections),
headed AS (SELECT object_key, min(line_no) AS line_no, arg_min(raw, line_no) AS raw, list_filter(["""
    + ", ".join(f"CASE WHEN NOT bool_or(r AND contains(lower, '{h}')) THEN '{h.upper()}' END" for h in ("codigo iniciativa", "descripcion", "responsible", "version"))
    + "], lambda h: h IS NOT NULL) AS missing FROM inside GROUP BY object_key)",
    _out("GX.1.7.1", say("GX.1.7.1", "array_to_string(list_sort(missing), ', ')"), "headed", "len(missing) > 0"),
)
_said = r"regexp_replace(substr(stripped, 3), '^\s+|\s+$', '', 'g')"
RULE_SQL["GX.1.7.2"] = (
    "",
    _out("GX.1.7.2", f"CASE WHEN {_said} = '' THEN {say('GX.1.7.2/empty')} ELSE {say('GX.1.7.2/line')} END", "lines", rf"starts_with(stripped, '//') AND ({_said} = '' OR regexp_matches({_said}, '^(?:[- ]+|[_ ]+|[= ]+|[* ]+|[~ ]+|[. ]+|[# ]+)$'))"),
)
RULE_SQL["GX.2.1"] = _where("GX.2.1", has(C, "when"))
RULE_SQL["GX.2.2"] = _where("GX.2.2", f"len({_LOGIC}) > 0", _names(f"list_transform({_LOGIC}, lambda t: upper(t))"))
RULE_SQL["GX.2.3"] = (_depth(rf"CASE WHEN {kw('sq', 'for each')} THEN 1 WHEN {kw('sq', 'endfor', 'end for')} THEN -1 ELSE 0 END", source=rf"(SELECT *, regexp_replace({C}, '\s+', ' ', 'g') AS sq FROM lines)"), _out("GX.2.3", say("GX.2.3", "CAST(d AS INTEGER)"), "deep", f"{kw('sq', 'for each')} AND d > 2"))
RULE_SQL["GX.2.4"] = _where("GX.2.4", f"len({_FUNCS}) > 0", _names(_FUNCS))
RULE_SQL["GX.2.5"] = _where("GX.2.5", f"{_LITERAL} NOT IN ('', '0', '''''', '\"\"', 'true', 'false', 'null', 'nullvalue')", _LITERAL)
RULE_SQL["GX.2.6"] = (
    f"""subs AS (SELECT *, sum(CASE WHEN {kw('lower', 'sub')} THEN 1 ELSE 0 END) OVER (PARTITION BY object_key ORDER BY line_no) AS blk FROM lines),
bodies AS (SELECT *, first_value(line_no) OVER w AS ol, first_value(raw) OVER w AS oraw, first_value({_trim("substr(stripped, 4)")}) OVER w AS name, first_value({_NAME}) OVER w AS bare,
  sum(CASE WHEN {kw('lower', 'endsub')} THEN 1 ELSE 0 END) OVER w AS ends, max(CASE WHEN NOT {kw('lower', 'sub')} AND contains({C}, 'nullvalue(') AND contains({C}, '=') AND contains(split_part({C}, '=', 1), '&') THEN 1 ELSE 0 END) OVER w AS st
  FROM subs WHERE blk > 0 WINDOW w AS (PARTITION BY object_key, blk ORDER BY line_no))""",
    _out("GX.2.6", say("GX.2.6", "name"), "bodies", f"{kw('lower', 'endsub')} AND ends = 1 AND st = 0 AND bare NOT IN ('gu: op -> cancelar', '''gu: op -> cancelar''')", "ol", "oraw"),
)
RULE_SQL["GX.2.7.1"] = (
    _depth(f"CASE WHEN {_LOOP} THEN 1 WHEN {kw('lower', 'endfor', 'enddo')} AND len({_LOOSE}) = 0 THEN -1 ELSE 0 END", f", {_LOOP} AS o, {_LOOSE} AS v") + ", origins AS (SELECT *, last_value(CASE WHEN o AND d = 1 THEN line_no END IGNORE NULLS) OVER (PARTITION BY object_key ORDER BY line_no) AS origin FROM deep)",
    _out("GX.2.7.1", say("GX.2.7.1", "array_to_string(v, ', ')", "origin"), "origins", "d > 0 AND len(v) > 0"),
)
RULE_SQL["GX.2.7.2"] = ("", _out("GX.2.7.2", say("GX.2.7.2", f"array_to_string({_COUNTERS}, ', ')"), "lines", f"{_AMP} AND {_EQ} AND len({_COUNTERS}) > 0"))
_COND = "list_filter([" + ", ".join(f"CASE WHEN {_assigned(v, '(?::=|[+]=|=(?:[^=]|$))')} THEN '{v}' END" for v in ("&cond", "&ok", "&flag", "&status", "&condition")) + "], lambda v: v IS NOT NULL)"
RULE_SQL["GX.2.7.3"] = (
    f"""mine AS (SELECT object_key, line_no, raw, {_COND} AS vars, row_number() OVER (PARTITION BY object_key ORDER BY line_no) AS rn FROM lines WHERE {_AMP} AND {_EQ} AND len({_COND}) > 0),
folded(object_key, line_no, raw, rn, seen, hit) AS (
  SELECT object_key, line_no, raw, rn, vars, CAST(NULL AS VARCHAR) FROM mine WHERE rn = 1
  UNION ALL
  SELECT m.object_key, m.line_no, m.raw, m.rn,
    list_distinct(list_concat(f.seen, CASE WHEN len(list_filter(m.vars, lambda v: list_contains(f.seen, v))) = 0 THEN m.vars ELSE m.vars[1:list_position(m.vars, list_filter(m.vars, lambda v: list_contains(f.seen, v))[1]) - 1] END)),
    list_filter(m.vars, lambda v: list_contains(f.seen, v))[1]
  FROM folded f JOIN mine m ON m.object_key = f.object_key AND m.rn = f.rn + 1
)""",
    _out("GX.2.7.3", say("GX.2.7.3", "hit"), "folded", "hit IS NOT NULL"),
)
_ASSIGN = f"({_EQ} AND NOT (contains(lower, '==') OR contains(lower, '!=') OR contains(lower, '<=') OR contains(lower, '>=')) AND contains(lower, '='))"
RULE_SQL["GX.2.7.4"] = (
    f"""mentions AS (
  SELECT object_key, line_no, raw, substr(unnest(regexp_extract_all(split_part(lower, '=', 1), '&[a-zA-Z0-9_]+')), 2) AS v, 1 AS w FROM lines WHERE {_AMP} AND {_ASSIGN}
  UNION ALL SELECT object_key, line_no, raw, substr(unnest(regexp_extract_all(CASE WHEN {_ASSIGN} THEN substr(lower, strpos(lower, '=') + 1) ELSE lower END, '&[a-zA-Z0-9_]+')), 2), 0 FROM lines WHERE {_AMP}
), dead AS (SELECT object_key, v, min(line_no) AS line_no, arg_min(raw, line_no) AS raw FROM mentions GROUP BY object_key, v HAVING min(w) = 1)""",
    _out("GX.2.7.4", say("GX.2.7.4", "v"), "dead", "v NOT IN ('pgmname', 'time', 'today', 'mode', 'gx_fail', 'gx_empty')"),
)


def rule_sql(rule: str, corpus: str = EVENTS) -> str:
    ctes, select = RULE_SQL[rule]
    return f"WITH RECURSIVE {corpus}, {LINES}{', ' + ctes if ctes else ''} {select}"


def all_findings(ids: tuple[str, ...], corpus: str = EVENTS) -> str:
    """The findings of several rules: each rule's tables are its own."""
    return " UNION ALL ".join(f"SELECT * FROM ({rule_sql(i, corpus)})" for i in ids)


CATEGORY = ", ".join(f"('{r.id}', '{r.category}', '{r.version}', {str(not r.abstract).lower()}, {str(r.default).lower()}, {i})" for i, r in enumerate(RULES))

#: The semantic model: stmts has a row for each line with tokens, tokens one for each token.
_TOKEN = rf"""(?s)&\w*|{_STRING}|[0-9][0-9.]*|[a-zA-Z_]\w*|[<>=!][=>]?|[^\s]"""
_KEYS = ", ".join(_quoted(k) for k in ("for", "each", "endfor", "if", "elseif", "else", "endif", "do", "case", "otherwise", "endcase", "sub", "endsub", "where", "defined", "by", "order", "parm", "in", "out", "inout", "not", "and", "or", "like", "true", "false", "nullvalue", "new", "is"))
_STMT = """CASE WHEN a = 'for' AND b = 'each' THEN 'ForEach' WHEN a = 'endfor' THEN 'EndFor' WHEN a = 'if' THEN 'If' WHEN a = 'elseif' OR (a = 'else' AND b = 'if') THEN 'ElseIf' WHEN a = 'else' THEN 'Else' WHEN a = 'endif' THEN 'EndIf'
 WHEN a = 'do' AND b = 'case' THEN 'DoCase' WHEN a = 'case' THEN 'Case' WHEN a = 'otherwise' THEN 'Otherwise' WHEN a = 'endcase' THEN 'EndCase' WHEN a = 'sub' THEN 'Sub' WHEN a = 'endsub' THEN 'EndSub' WHEN a = 'where' THEN 'Where'
 WHEN a = 'defined' AND b = 'by' THEN 'DefinedBy' WHEN a = 'order' THEN 'Order' WHEN a = 'parm' THEN 'Parm' WHEN starts_with(a, '&') AND b = '=' THEN 'Assignment' WHEN a = 'do' OR (regexp_matches(a, '^[a-z_]') AND NOT a IN (""" + _KEYS + """) AND b = '(') THEN 'Call' ELSE 'Other' END"""
MODEL = rf"""sources AS (SELECT object_key, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM objects),
lexed AS (SELECT *, regexp_extract_all(regexp_replace(raw, '(?s)({_STRING})|//.*|/\*.*?(?:\*/|\z)', '\1', 'g'), '{_TOKEN}') AS toks FROM sources),
stmts AS (SELECT object_key, line_no, raw, toks, {_STMT} AS stmt FROM (SELECT *, lower(toks[1]) AS a, coalesce(lower(toks[2]), '') AS b FROM lexed WHERE len(toks) > 0)),
tokens AS (SELECT object_key, line_no, row_number() OVER (PARTITION BY object_key ORDER BY line_no, i) - 1 AS tok_order, text,
  CASE WHEN starts_with(text, '&') THEN 'variable' WHEN text[1] IN ('''', '"') THEN 'string' WHEN regexp_matches(text, '^[0-9]') THEN 'number' WHEN lower(text) IN ({_KEYS}) THEN 'keyword' WHEN regexp_matches(text, '^[a-zA-Z_]') THEN 'ident' WHEN text[1] IN ('<', '>', '=', '!', '+', '-', '*', '/') THEN 'operator' ELSE 'punct' END AS kind
  FROM (SELECT object_key, line_no, unnest(toks) AS text, unnest(range(1, len(toks) + 1)) AS i FROM stmts))"""
_OPENS, _CLOSES = "stmt IN ('ForEach', 'If', 'DoCase', 'Sub')", "stmt IN ('EndFor', 'EndIf', 'EndCase', 'EndSub')"
NESTED = _depth(f"CASE WHEN {_OPENS} THEN 1 WHEN {_CLOSES} THEN -1 ELSE 0 END", source="stmts") + f""",
leveled AS (SELECT *, CASE WHEN {_OPENS} THEN d ELSE p END AS lvl FROM deep),
matched AS (SELECT *, {_CLOSES} AND (p = 0 OR last_value(CASE stmt WHEN 'ForEach' THEN 'EndFor' WHEN 'If' THEN 'EndIf' WHEN 'DoCase' THEN 'EndCase' WHEN 'Sub' THEN 'EndSub' END IGNORE NULLS) OVER (PARTITION BY object_key, lvl ORDER BY line_no) <> stmt) AS bad FROM leveled)"""
ACCESSES = """accesses AS (SELECT object_key, lower(text) AS name, line_no, tok_order, CASE WHEN stmt = 'Assignment' AND row_number() OVER (PARTITION BY object_key, line_no ORDER BY tok_order) = 1 THEN 'Write' ELSE 'Read' END AS access, stmt IN ('If', 'ElseIf', 'Case', 'Where') AS in_condition
  FROM tokens JOIN stmts USING (object_key, line_no) WHERE kind = 'variable')"""

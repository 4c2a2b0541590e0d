"""DuckDB SQL for flows: a machine that walks over tokens, and one that runs statements in order.

The engine finds both by windows and fixpoints; here they are recursions step by step,
so that neither can share a mistake.
"""

from __future__ import annotations

from . import oracles as o
from .operators import calls, taint
from .plans.corpus import CHAINS


def _listed(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(o._quoted(n) for n in names) + ")"


def _hint(texts: str, hints: tuple[str, ...]) -> str:
    return f"len(list_filter({texts}, lambda n: " + " OR ".join(f"contains(n, '{h}')" for h in hints) + ")) > 0"


CHAIN = f"""chains(idx, line) AS (VALUES {", ".join(f"({i}, {o._quoted(t)})" for i, t in enumerate(CHAINS))}), objects AS (
  SELECT CAST(object_key AS VARCHAR) AS object_key, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
    SELECT DISTINCT o_custkey AS object_key, -1 AS pos, 'parm(in:&Entrada, inout:&Both, out:&Out);' AS line FROM orders
    UNION ALL SELECT o_custkey, o_orderkey, line FROM orders JOIN chains ON idx = (o_orderkey * 11 + o_custkey * 5) % {len(CHAINS)}) GROUP BY object_key
)"""
FLOW = """objects AS (
  SELECT concat('obj', key) AS object_key, key AS ord, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
    SELECT DISTINCT o_custkey AS key, -1 AS pos, 'parm(in:&Entrada, out:&Salida);' AS line FROM orders
    UNION ALL SELECT a.o_custkey, a.o_orderkey, CASE WHEN a.o_orderkey % 4 < 2 THEN concat('call(''obj', coalesce(b.o_custkey, a.o_custkey + 1), ''', &Entrada, &Salida)')
      WHEN a.o_orderkey % 4 = 2 THEN '&Salida = Trim(&Entrada)' ELSE concat('&sql = ''select '' + &Entrada', chr(10), '&Result = &sql.Execute()') END
    FROM orders a LEFT JOIN orders b ON b.o_orderkey + 1 = a.o_orderkey) GROUP BY key
)"""

#: A machine over each line's tokens: the depth, that of the call it is in, and the place of that call.
WALK = f"""{o.MODEL}, placed AS (SELECT *, row_number() OVER l AS i, kind = 'ident' AND lead(kind) OVER l = 'punct' AND lead(text) OVER l = '(' AS head,
    CASE WHEN lag(text, 1) OVER l = '.' AND lag(kind, 2) OVER l IN ('variable', 'ident') THEN lower(lag(text, 2) OVER l) END AS before
  FROM tokens WINDOW l AS (PARTITION BY object_key, line_no ORDER BY tok_order)),
walk(object_key, line_no, i, depth, outside, own) AS (
  SELECT DISTINCT object_key, line_no, CAST(0 AS BIGINT), 0, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT) FROM placed
  UNION ALL
  SELECT p.object_key, p.line_no, p.i, w.depth + CASE WHEN p.kind = 'punct' AND p.text = '(' THEN 1 WHEN p.kind = 'punct' AND p.text = ')' THEN -1 ELSE 0 END,
    CASE WHEN w.outside IS NULL AND coalesce(p.head, false) THEN w.depth WHEN p.kind = 'punct' AND p.text = ')' AND w.depth - 1 = w.outside THEN NULL ELSE w.outside END,
    CASE WHEN w.outside IS NULL THEN CASE WHEN coalesce(p.head, false) THEN p.i END ELSE w.own END
  FROM walk w JOIN placed p ON p.object_key = w.object_key AND p.line_no = w.line_no AND p.i = w.i + 1),
owned AS (SELECT p.*, w.own, p.i > w.own + 1 AS inside, CASE WHEN p.kind = 'string' THEN lower(replace(CASE WHEN length(p.text) > 1 AND p.text[-1] = p.text[1] THEN p.text[2:-2] ELSE p.text[2:] END, p.text[1] || p.text[1], p.text[1])) END AS value
  FROM placed p JOIN walk w USING (object_key, line_no, i) WHERE w.own IS NOT NULL),
calls AS (SELECT object_key, line_no, own AS pos, max(before) FILTER (i = own) AS receiver, max(lower(text)) FILTER (i = own) AS method,
    coalesce(list(lower(text) ORDER BY i) FILTER (inside AND kind = 'variable'), []) AS variables, coalesce(list(value ORDER BY i) FILTER (inside AND kind = 'string'), []) AS strings, coalesce(list(lower(text) ORDER BY i) FILTER (inside AND head), []) AS inner_calls
  FROM owned GROUP BY object_key, line_no, own)"""

_NAMES = "list_append(variables, coalesce(receiver, ''))"
_CLASS = f"""CASE WHEN method IN {_listed(calls.SQL_METHODS)} AND ({_hint(_NAMES, calls.SQL_NAMES)} OR {_hint("strings", calls.SQL_WORDS)}) THEN 'sql_injection' WHEN method IN {_listed(calls.COMMAND_METHODS)} AND {_hint(_NAMES, calls.COMMAND_NAMES)} THEN 'command_injection'
  WHEN method = 'write' AND {_hint(_NAMES, calls.OUTPUT_NAMES)} THEN 'unencoded_output' WHEN method IN {_listed(calls.PATH_METHODS)} AND {_hint(_NAMES, calls.PATH_NAMES)} THEN 'path_traversal' END"""


def _step(kind: str, line: str, detail: str) -> str:
    return f"{{'kind': '{kind}', 'line': CAST({line} AS INTEGER), 'detail': {detail}}}"


PROGRAM = f"""{WALK}, {o.NESTED}, whole AS (SELECT object_key FROM matched GROUP BY object_key HAVING arg_max(d, line_no) = 0 AND count(*) FILTER (bad) = 0),
parms AS (SELECT object_key, name, direction, declared, row_number() OVER (PARTITION BY object_key ORDER BY tok_order) - 1 AS idx FROM (
  SELECT object_key, tok_order, kind, lower(text) AS name, min(line_no) OVER (PARTITION BY object_key, lower(text)) AS declared, CASE WHEN lag(text) OVER w = ':' THEN lower(lag(text, 2) OVER w) ELSE '' END AS direction
  FROM tokens JOIN stmts USING (object_key, line_no) WHERE stmt = 'Parm' WINDOW w AS (PARTITION BY object_key, line_no ORDER BY tok_order)) WHERE kind = 'variable'),
said AS (SELECT object_key, line_no, list(method ORDER BY pos) AS methods, list_concat(list(method ORDER BY pos), flatten(list(inner_calls ORDER BY pos))) AS named FROM calls GROUP BY object_key, line_no),
vars AS (SELECT object_key, line_no, list(lower(text) ORDER BY tok_order) AS v FROM tokens WHERE kind = 'variable' GROUP BY object_key, line_no),
program AS (SELECT s.object_key, s.line_no, v[1] AS target, list_filter(v[2:], lambda x: x <> v[1]) AS reads, list_filter(methods, lambda m: m IN {_listed(taint.SOURCES)})[1] AS source,
    list_filter(named, lambda m: m NOT IN {_listed(taint.NEUTRAL)})[1] AS strange, row_number() OVER (PARTITION BY s.object_key ORDER BY s.line_no) AS a, count(*) OVER (PARTITION BY s.object_key) AS n
  FROM stmts s JOIN vars USING (object_key, line_no) LEFT JOIN said USING (object_key, line_no) WHERE stmt = 'Assignment')"""

_PARENT = "list_sort(list_transform(list_filter(r.st, lambda x: list_contains(p.reads, x.name)), lambda x: {'n': len(x.path), 'name': x.name, 'path': x.path}))[1]"
_UNKNOWN = _step("unsupported_call", "line_no", "concat(strange, '() sin semántica de sanitizador modelada')")
_MOVED = _step("propagate", "line_no", "concat(target, ' = ... ', parent.name, ' ...')")
#: begun has object_key, seed and st, the list of what is reached at the start (name, path); run follows it over four passes.
RUN = f"""run(object_key, seed, k, st, line_no, met) AS (
  SELECT object_key, seed, CAST(0 AS BIGINT), st, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM begun
  UNION ALL
  SELECT object_key, seed, k + 1, CASE WHEN list_contains(list_transform(st, lambda x: x.name), target) THEN st
      WHEN source IS NOT NULL THEN list_append(st, {{'name': target, 'path': [{_step("source", "line_no", "concat(source, '()')")}]}})
      WHEN parent IS NULL THEN st ELSE list_append(st, {{'name': target, 'path': CASE WHEN len(path) < {taint.TRACE} THEN list_append(path, {_MOVED}) ELSE path END}}) END,
    line_no, CASE WHEN source IS NULL AND parent IS NOT NULL THEN strange END
  FROM (SELECT *, CASE WHEN strange IS NOT NULL THEN list_append(parent.path, {_UNKNOWN}) ELSE parent.path END AS path FROM (
    SELECT r.object_key, r.seed, r.k, r.st, p.line_no, p.target, p.source, p.strange, {_PARENT} AS parent FROM run r JOIN program p ON p.object_key = r.object_key AND p.a = r.k % p.n + 1 WHERE r.k < {taint.PASSES} * p.n))),
ended AS (SELECT object_key, seed, unnest(arg_max(st, k)) AS x FROM run GROUP BY object_key, seed),
reached AS (SELECT object_key, seed, x.name AS name, x.path AS path FROM ended),
unknown AS (SELECT DISTINCT object_key, seed, line_no, met AS method FROM run WHERE met IS NOT NULL),
into_sinks AS (SELECT object_key, line_no, pos, method, receiver, {_CLASS} AS class, unnest(CASE WHEN receiver IS NULL THEN variables ELSE list_append(variables, receiver) END) AS name, unnest(range(1, len(variables) + CASE WHEN receiver IS NULL THEN 1 ELSE 2 END)) AS i FROM calls),
sunk AS (SELECT *, CASE class WHEN 'sql_injection' THEN 89 WHEN 'command_injection' THEN 78 WHEN 'unencoded_output' THEN 79 ELSE 22 END AS cwe FROM into_sinks JOIN reached USING (object_key, name) WHERE class IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY object_key, seed, line_no, class ORDER BY pos, i) = 1),
found AS (SELECT *, row_number() OVER (PARTITION BY object_key, seed ORDER BY line_no, pos) - 1 AS k, CASE WHEN len(path) < {taint.TRACE} THEN list_append(path, {_step("sink", "line_no", "concat(receiver || '.', method)")}) ELSE path END AS trace,
  {o.say("GX.SEC.2", "replace(class, '_', ' ')", "cwe", "name", "method")} AS description FROM sunk QUALIFY k < {taint.FINDINGS})"""
CONFIDENCE = "CASE WHEN len(list_filter(path, lambda s: s.kind = 'unsupported_call')) > 0 THEN 'low' WHEN len(trace) <= 2 THEN 'high' ELSE 'medium' END"
#: A trace as text.
TOLD = "array_to_string(list_transform(trace, lambda s: concat(s.kind, ':', s.line, ':', s.detail)), '|')"

_CONTAINER = "^(" + "|".join(taint.CONTAINERS) + ")"
#: What is reached at the start of complete objects.
LOCAL = f"""entries AS (SELECT object_key, name, arg_min({{'line': line_no, 'detail': detail}}, late * 1000000000 + line_no) AS e FROM (
    SELECT object_key, name, declared AS line_no, 0 AS late, concat('parm entrada ', name) AS detail FROM parms WHERE direction IN ('in', 'inout')
    UNION ALL SELECT object_key, lower(text), line_no, 1, 'request/contenedor externo' FROM tokens WHERE kind = 'variable' AND regexp_matches(lower(text), '{_CONTAINER}')) JOIN whole USING (object_key) GROUP BY object_key, name),
begun AS (SELECT object_key, '' AS seed, coalesce(list({{'name': name, 'path': [{_step("source", "e.line", "e.detail")}]}}) FILTER (name IS NOT NULL), []) AS st FROM whole LEFT JOIN entries USING (object_key) GROUP BY object_key)"""


def local(corpus: str) -> str:
    return f"WITH RECURSIVE {corpus}, {PROGRAM}, {LOCAL}, {RUN}"


#: Each input parameter, and each variable that a call returns a value to, on its own; '' stands for no seed.
SEEDED = f"""linked AS (SELECT c.object_key, c.line_no, c.pos, lower(trim(s.value)) AS callee, c.variables AS args FROM calls c JOIN (SELECT object_key, line_no, arg_min(value, i) AS value FROM (
    SELECT object_key, line_no, i, CASE WHEN length(text) > 1 AND text[-1] = text[1] THEN text[2:-2] ELSE text[2:] END AS value FROM placed WHERE kind = 'string') GROUP BY object_key, line_no) s USING (object_key, line_no)
  WHERE c.method IN ('call', 'udp') AND lower(trim(s.value)) IN (SELECT object_key FROM objects)),
groups AS (SELECT object_key, '' AS seed FROM objects UNION SELECT object_key, name FROM parms UNION SELECT l.object_key, l.args[p.idx + 1] FROM linked l JOIN parms p ON p.object_key = l.callee WHERE p.direction IN ('out', 'inout') AND l.args[p.idx + 1] IS NOT NULL),
begun AS (SELECT object_key, seed, CASE WHEN seed = '' THEN [] ELSE [{{'name': seed, 'path': [{_step("source", "1", "seed")}]}}] END AS st FROM groups)"""
SUMMARIES = f"""takes AS (SELECT object_key, name AS seed, idx FROM parms JOIN whole USING (object_key) WHERE direction IN ('in', 'inout') AND idx < {taint.FLOW_PARAMS}),
param_sinks AS (SELECT t.object_key, t.idx, f.line_no, f.class, f.cwe FROM takes t JOIN found f USING (object_key, seed)),
param_outs AS (SELECT t.object_key, t.idx AS from_param, p.idx AS to_param FROM takes t JOIN reached r USING (object_key, seed) JOIN parms p ON p.object_key = r.object_key AND p.name = r.name AND p.direction IN ('out', 'inout'))"""
ACROSS = """passed AS (SELECT object_key, line_no, callee, args, unnest(args) AS arg, unnest(range(0, len(args))) AS i FROM linked),
met AS (SELECT p.*, r.seed FROM passed p JOIN reached r ON r.object_key = p.object_key AND r.name = p.arg),
ways AS (SELECT DISTINCT m.object_key, m.seed, m.callee AS to_object, p.name AS to_seed FROM met m JOIN parms p ON p.object_key = m.callee AND p.idx = m.i
  UNION SELECT m.object_key, m.seed, m.object_key, m.args[u.to_param + 1] FROM met m JOIN param_outs u ON u.object_key = m.callee AND u.from_param = m.i WHERE m.args[u.to_param + 1] IS NOT NULL),
outer_seeds AS (SELECT object_key, '' AS seed FROM objects UNION SELECT object_key, name FROM parms WHERE direction IN ('in', 'inout') AND object_key NOT IN (SELECT callee FROM linked)),
active(object_key, seed) AS (SELECT * FROM outer_seeds UNION SELECT w.to_object, w.to_seed FROM active a JOIN ways w ON w.object_key = a.object_key AND w.seed = a.seed)"""


def seeded(corpus: str) -> str:
    return f"WITH RECURSIVE {corpus}, {PROGRAM}, {SEEDED}, {RUN}, {SUMMARIES}"


def across(corpus: str) -> str:
    return f"{seeded(corpus)}, {ACROSS}"


"""One query for each operator, over a corpus dealt out from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as o
from .functions import lexical as x
from .operators import deal, decisions, paging, project, rules, semantics
from .operators.lines import FLAGS, parse_lines, split_lines
from .operators.rules import LINE_RULES, line_findings, unused_variables
from .plans import corpus
from .plans.catalog import CONCRETE, DEFAULT, catalog, routes
from .registry import ORACLE_SQL, QUERIES, Query, query
from .sources import readers

SHOWN = ("object_key", "rule_id", "severity", "line_number", "description", "line_content")


def _rule(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _lines(spark, sf_dir)
        found = unused_variables(lines) if rule == "GX.2.7.4" else line_findings(lines, [rule])
        return found.select(*SHOWN)

    return run


for _id in (*LINE_RULES, "GX.2.7.4"):
    query("rule_" + _id[3:].replace(".", "_"), o.rule_sql(_id))(_rule(_id))


def default_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_findings(_lines(spark, sf_dir), list(DEFAULT))


@query("findings_default", o.all_findings(DEFAULT))
def findings_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_findings(spark, sf_dir).select(*SHOWN)


_LINES = f"WITH {o.EVENTS}, {o.LINES}"


@query("lines_view", f"{_LINES} SELECT object_key, CAST(line_no AS INTEGER) AS line_no, raw, stripped, lower, clean, clean_lower, code, code_lower FROM lines")
def lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("object_key", "line_no", "raw", "stripped", "lower", "clean", "clean_lower", "code", "code_lower")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(deal.by_text(corpus.event_objects(spark, sf_dir)))


@query("lex_mask", f"WITH {o.EVENTS}, {o.LINES} SELECT object_key, eval AS masked FROM masked")
def lex_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.event_objects(spark, sf_dir).select("object_key", x.mask_blocks(F.col("text")).alias("masked"))


_CLEAN = rf"regexp_replace(regexp_replace(t, '(?s){o._STRING}|//.*|/\*.*?(?:\*/|\z)', '', 'g'), '^\s+|\s+$', '', 'g')"


@query("lex_clean", f"SELECT page_id, {_CLEAN} AS clean FROM (SELECT page_id, url AS t FROM pages)")
def lex_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", x.clean(F.col("url")).alias("clean"))


@query("lex_code", f"{_LINES} SELECT object_key, CAST(line_no AS INTEGER) AS line_no, code FROM lines WHERE code <> stripped")
def lex_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("code <> stripped").select("object_key", "line_no", "code")


_FLAGS = ", ".join(f"contains(clean_lower, '{v}') AS {k}" for k, v in FLAGS.items())


@query("trigger_flags", f"{_LINES} SELECT object_key, CAST(line_no AS INTEGER) AS line_no, {_FLAGS} FROM lines")
def trigger_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("object_key", "line_no", *FLAGS)


@query("dispatch_candidates", f"""{_LINES}, f AS (SELECT *, {_FLAGS} FROM lines)
SELECT rule_id, count(*) FILTER (hit) AS candidates FROM (
  SELECT unnest(['GX.1.1', 'GX.1.4.1', 'GX.1.4.2', 'GX.1.5', 'GX.2.7.2', 'GX.2.7.3', 'GX.2.7.4']) AS rule_id,
         unnest([has_ampersand, has_equal OR has_ampersand, has_if OR has_case, has_if OR has_case, has_equal OR has_ampersand, has_equal OR has_ampersand, has_ampersand]) AS hit FROM f) GROUP BY rule_id""")
def dispatch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each rule that is routed by tokens is given."""
    hits = [F.struct(F.lit(r).alias("rule_id"), F.expr(" OR ".join(f)).alias("hit")) for r, f in routes(CONCRETE).items()]
    rows = _lines(spark, sf_dir).select(F.explode(F.array(*hits)).alias("h"))
    return rows.groupBy(F.col("h.rule_id").alias("rule_id")).agg(F.count_if("h.hit").alias("candidates"))


@query("generated_cut", """SELECT doc_id, CAST(CASE WHEN pos > 0 THEN pos - 1 ELSE len(l) END AS BIGINT) AS kept FROM (
  SELECT doc_id, l, coalesce(list_position(list_transform(l, lambda y: contains(lower(y), 'generated subroutines (public)')), true), 0) AS pos
  FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), 'Generated Subroutines (Public)', chr(10), 'x') ELSE text END, chr(10)) AS l FROM documents))""")
def generated_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines remain of texts of which every third ends with a generated part."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nGenerated Subroutines (Public)\nx"))).otherwise(F.col("text"))
    return split_lines(d.select(F.col("doc_id").alias("object_key"), text.alias("text"))).groupBy(F.col("object_key").alias("doc_id")).agg(F.count("*").alias("kept"))


@query("leading_width", f"{_LINES} SELECT object_key, CAST(line_no AS INTEGER) AS line_no, CAST({o._INDENT} AS INTEGER) AS width FROM lines")
def leading_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("object_key", "line_no", x.leading_width(F.col("raw")).alias("width"))


@query("where_blocks", f"WITH {o.EVENTS}, {o.LINES}, {o.WHERE} SELECT object_key, CAST(line_no AS INTEGER) AS line_no, CAST(wl AS INTEGER) AS where_line FROM wheres WHERE active")
def where_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that stand in a where's condition, with the line of the where."""
    rows = _lines(spark, sf_dir)
    for level in rules.where_blocks():
        rows = rows.withColumns(level)
    return rows.where("w_active").select("object_key", "line_no", F.col("w_line").alias("where_line"))


@query("nesting_depth", f"WITH {o.EVENTS}, {o.LINES}, {o._depth(f'CASE WHEN {o.kw(o.C, 'for each')} THEN 1 WHEN {o.kw(o.C, 'endfor')} THEN -1 ELSE 0 END')} SELECT object_key, CAST(max(d) AS BIGINT) AS deepest FROM deep GROUP BY object_key")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    low = F.col("clean_lower")
    for level in rules.depth("n", F.when(x.keyword(low, "for each"), 1).when(x.keyword(low, "endfor"), -1).otherwise(0)):
        rows = rows.withColumns(level)
    return rows.groupBy("object_key").agg(F.max("n").cast("long").alias("deepest"))


# Findings, metrics and decisions.

_DEFAULT = o.all_findings(DEFAULT)
_COUNTS = "count(*) AS total_findings, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS info"


@query("findings_all", o.all_findings((*LINE_RULES, "GX.2.7.4")))
def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return line_findings(lines, list(LINE_RULES)).unionByName(unused_variables(lines)).select(*SHOWN)


@query("findings_per_rule", f"SELECT rule_id, count(*) AS findings FROM ({_DEFAULT}) GROUP BY rule_id")
def findings_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("findings"))


@query("metrics_severity", f"SELECT {_COUNTS} FROM ({_DEFAULT})")
def metrics_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.metrics(default_findings(spark, sf_dir))


_BY_OBJECT = f"SELECT object_key, {_COUNTS} FROM ({_DEFAULT}) GROUP BY object_key"


@query("gate_absolute", f"SELECT object_key, errors, warnings, errors <= 12 AND warnings <= 20 AS passes FROM ({_BY_OBJECT})")
def gate_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.metrics(default_findings(spark, sf_dir), "object_key")
    return rows.select("object_key", "errors", "warnings", decisions.Absolute(12, 20).passes().alias("passes"))


@query("gate_percentage", f"SELECT object_key, errors, total_findings, total_findings = 0 OR CAST(errors AS FLOAT) * CAST(100 AS FLOAT) / CAST(total_findings AS FLOAT) <= CAST(60 AS FLOAT) AS passes FROM ({_BY_OBJECT})")
def gate_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.metrics(default_findings(spark, sf_dir), "object_key")
    return rows.select("object_key", "errors", "total_findings", decisions.Percentage(60.0).passes().alias("passes"))


@query("completion_verdict", f"""SELECT object_key, completion, CASE WHEN completion <> 'complete' THEN 'error' WHEN object_key % 11 = 0 THEN 'reject' WHEN errors <= 12 THEN 'pass' ELSE 'reject' END AS verdict FROM (
  SELECT object_key, errors, CASE WHEN object_key % 7 = 0 THEN 'cancelled' WHEN total_findings > 40 THEN 'partial' WHEN object_key % 5 = 0 THEN 'failed' ELSE 'complete' END AS completion FROM ({_BY_OBJECT}))""")
def completion_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion and verdict over all their cases; cancellation, failures and security errors are dealt out by key."""
    rows = decisions.metrics(default_findings(spark, sf_dir), "object_key")
    key = F.col("object_key")
    rows = rows.withColumn("completion", decisions.completion(key % 7 == 0, F.col("total_findings") > 40, F.when(key % 5 == 0, 1).otherwise(0)))
    return rows.select("object_key", "completion", decisions.verdict(F.col("completion"), F.when(key % 11 == 0, 1).otherwise(0), F.col("errors") <= 12).alias("verdict"))


@query("pack_coverage", f"SELECT r.id, r.version, (SELECT count(DISTINCT user_id) FROM events) AS objects_analyzed, count(f.rule_id) AS findings FROM (VALUES {o.CATEGORY}) r(id, category, version, concrete, dflt, ord) LEFT JOIN ({_DEFAULT}) f ON f.rule_id = r.id WHERE r.concrete GROUP BY r.id, r.version")
def pack_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    return decisions.pack_coverage(default_findings(spark, sf_dir), catalog(spark).where("not is_abstract"), objects)


@query("rules_times_triggered", f"SELECT r.id AS rule_id, count(f.rule_id) AS times_triggered FROM (VALUES {o.CATEGORY}) r(id, category, version, concrete, dflt, ord) LEFT JOIN ({_DEFAULT}) f ON f.rule_id = r.id GROUP BY r.id")
def rules_times_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.times_triggered(catalog(spark), default_findings(spark, sf_dir))


@query("catalog_rules", f"SELECT id AS rule_id, category, version, NOT concrete AS is_abstract, dflt AS is_default, ord FROM (VALUES {o.CATEGORY}) r(id, category, version, concrete, dflt, ord)")
def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark).select("rule_id", "category", "version", "is_abstract", "is_default", "ord")


# Pages, search and retention, over issues made of events.

_ISSUES = "SELECT event_id AS id, user_id % 20 AS run_id, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, concat('GX.', event_id % 7) AS rule_id, event_type AS description FROM events"
_RANK = "CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, "ERROR").when(F.col("event_id") % 3 == 1, "WARNING").otherwise("INFO")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("run_id"), kind.alias("severity"), F.concat(F.lit("GX."), (F.col("event_id") % 7).cast("string")).alias("rule_id"), F.col("event_type").alias("description"))


@query("page_keyset", f"SELECT id, severity FROM ({_ISSUES}) WHERE {_RANK} > 1 OR ({_RANK} = 1 AND id > 100) ORDER BY {_RANK}, id LIMIT 51")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 after cursor 1:100, and the row that tells of a next page."""
    return paging.keyset_page(issues(spark, sf_dir), "1:100", 50).select("id", "severity")


@query("page_runs", "SELECT DISTINCT user_id AS id FROM events WHERE user_id < 90 ORDER BY id DESC LIMIT 11")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.run_page(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct(), 90, 10)


@query("page_offset", f"SELECT id, severity, rule_id FROM ({_ISSUES}) ORDER BY id LIMIT 100 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 41 to 140 in the order of findings; here an issue is a finding at its own line."""
    rows = issues(spark, sf_dir).select("*", F.lit(0).alias("object_key"), F.lit(0).alias("phase"), F.col("id").alias("emit_line"), F.lit(0).alias("rule_ord"), F.lit(0).alias("sub_idx"))
    return paging.offset_page(rows, 40, 100).select("id", "severity", "rule_id")


@query("search_findings", f"SELECT id, rule_id, description FROM ({_ISSUES}) WHERE severity = 'WARNING' AND contains(lower(concat_ws(' ', rule_id, description)), 'click')")
def search_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.search(issues(spark, sf_dir), severity="WARNING", term=" CLICK ", columns=("rule_id", "description")).select("id", "rule_id", "description")


@query("distinct_rules", f"SELECT DISTINCT rule_id FROM ({_DEFAULT})")
def distinct_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_findings(spark, sf_dir).select("rule_id").distinct()


@query("findings_cap", f"SELECT object_key, count(*) AS findings FROM (SELECT object_key, row_number() OVER (PARTITION BY object_key ORDER BY line_number) AS r FROM ({_DEFAULT})) WHERE r <= 10 GROUP BY object_key")
def findings_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each object keeps under a cap of ten."""
    return paging.capped_per_object(default_findings(spark, sf_dir), 10).groupBy("object_key").agg(F.count("*").alias("findings"))


@query("retention_keep_n", f"SELECT id, run_id FROM ({_ISSUES}) WHERE run_id IN (SELECT DISTINCT user_id % 20 FROM events ORDER BY 1 DESC LIMIT 5)")
def retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issues(spark, sf_dir)
    _, kept = paging.retained(rows.select(F.col("run_id").alias("id")).distinct(), rows, 5)
    return kept.select("id", "run_id")


@query("source_window", f"{_LINES} SELECT CAST(line_no AS INTEGER) AS line_no, raw FROM lines WHERE object_key = 1 AND line_no BETWEEN 5 AND 24")
def source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.source_window(_lines(spark, sf_dir), 1, 5, 20).select("line_no", "raw")


@query("member_line_map", "SELECT o_orderkey, CAST(CASE WHEN n >= 61 THEN 200 + n - 61 WHEN n >= 21 THEN 50 + n - 21 ELSE n + 2 END AS INTEGER) AS member_line FROM (SELECT o_orderkey, CAST(o_orderkey % 100 + 1 AS INTEGER) AS n FROM orders)")
def member_line_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text of three segments in the lines of their members."""
    n = (F.col("o_orderkey") % 100 + 1).cast("int")
    segments = F.array(*(F.struct(F.lit(a).alias("text_start_line"), F.lit(b).alias("member_start_line")) for a, b in ((1, 3), (21, 50), (61, 200))))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", x.member_line(segments, n).cast("int").alias("member_line"))


_ORDER = "l[1] AS min, l[greatest(CAST(ceil(len(l) * 0.5) AS INTEGER), 1)] AS median, l[greatest(CAST(ceil(len(l) * 0.95) AS INTEGER), 1)] AS p95, l[len(l)] AS max"


@query("run_percentiles", f"SELECT user_id, {_ORDER} FROM (SELECT user_id, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY user_id)")
def run_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order statistics of each user's values."""
    return decisions.percentiles_by(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "user_id")


@query("event_percentiles", "SELECT l[1] AS min, l[greatest(CAST(ceil(len(l) * 0.5) AS INTEGER), 1)] AS median, l[greatest(CAST(ceil(len(l) * 0.95) AS INTEGER), 1)] AS p95, l[len(l)] AS max FROM (SELECT list_sort(list(value)) AS l FROM events)")
def event_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all events."""
    return decisions.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


# The semantic model.


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.model(corpus.event_objects(spark, sf_dir))


@query("tokens", f"WITH {o.EVENTS}, {o.MODEL} SELECT object_key, CAST(line_no AS INTEGER) AS line_no, CAST(tok_order AS BIGINT) AS tok_order, kind, text FROM tokens")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.tokens(_model(spark, sf_dir))


@query("statements", f"WITH {o.EVENTS}, {o.MODEL}, {o.NESTED} SELECT object_key, CAST(line_no AS INTEGER) AS line_no, stmt AS kind, CAST(p AS INTEGER) AS depth FROM matched")
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.statements(_model(spark, sf_dir)).select("object_key", "line_no", "kind", "depth")


@query("statement_parents", f"""WITH {o.EVENTS}, {o.MODEL}, {o.NESTED}, numbered AS (SELECT *, {o._OPENS} AS opens, row_number() OVER (PARTITION BY object_key ORDER BY line_no) - 1 AS idx FROM matched)
SELECT a.object_key, CAST(a.idx AS INTEGER) AS stmt_idx, CAST(a.line_no AS INTEGER) AS line_no, a.stmt AS kind, CAST(a.p AS INTEGER) AS depth, CAST(max(b.idx) AS INTEGER) AS parent
FROM numbered a LEFT JOIN numbered b ON a.p > 0 AND b.object_key = a.object_key AND b.opens AND b.d = a.p AND b.line_no < a.line_no GROUP BY ALL""")
def statement_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.statements(_model(spark, sf_dir))


@query("coverage", f"WITH {o.EVENTS}, {o.MODEL}, {o.NESTED} SELECT object_key, CAST(arg_max(d, line_no) AS BIGINT) AS unclosed_blocks, count(*) FILTER (bad) AS malformed_lines, arg_max(d, line_no) = 0 AND count(*) FILTER (bad) = 0 AS complete FROM matched GROUP BY object_key")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.coverage(_model(spark, sf_dir))


@query("accesses", f"WITH {o.EVENTS}, {o.MODEL}, {o.ACCESSES} SELECT object_key, name, CAST(line_no AS INTEGER) AS line_no, CAST(tok_order AS BIGINT) AS tok_order, access, in_condition FROM accesses")
def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.accesses(_model(spark, sf_dir))


@query("parameters", f"""WITH {o.EVENTS}, {o.MODEL}, parms AS (
  SELECT object_key, line_no, tok_order, kind, lower(text) AS text, lag(lower(text), 2) OVER (PARTITION BY object_key, line_no ORDER BY tok_order) AS before FROM tokens JOIN stmts USING (object_key, line_no) WHERE stmt = 'Parm')
SELECT object_key, CAST(row_number() OVER (PARTITION BY object_key ORDER BY tok_order) - 1 AS INTEGER) AS param_idx, text AS name, CASE before WHEN 'in' THEN 'In' WHEN 'out' THEN 'Out' WHEN 'inout' THEN 'InOut' ELSE 'Unspecified' END AS direction FROM parms WHERE kind = 'variable'""")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.parameters(_model(spark, sf_dir))


def _small_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.model(corpus.order_objects(spark, sf_dir))


@query("rule_2_7_5", f"""WITH {o.ORDERS}, {o.MODEL}, {o.NESTED}, {o.ACCESSES}, whole AS (SELECT object_key FROM matched GROUP BY object_key HAVING arg_max(d, line_no) = 0 AND count(*) FILTER (bad) = 0),
outs AS (SELECT DISTINCT t.object_key, lower(t.text) AS name FROM tokens t JOIN stmts s USING (object_key, line_no) WHERE s.stmt = 'Parm' AND lower(t.text) = '&total'),
stores AS (SELECT a.*, a.access = 'Write' AND EXISTS (SELECT 1 FROM accesses r WHERE r.object_key = a.object_key AND r.line_no = a.line_no AND r.name = a.name AND r.access = 'Read' AND r.tok_order > a.tok_order) AS again FROM accesses a),
nexts AS (SELECT *, lead(access) OVER w AS nx, lead(again) OVER w AS na FROM stores WINDOW w AS (PARTITION BY object_key, name ORDER BY tok_order))
SELECT n.object_key, 'GX.2.7.5' AS rule_id, CAST(n.line_no AS INTEGER) AS line_number, {o.say("GX.2.7.5", "n.name")} AS description FROM nexts n JOIN whole USING (object_key) WHERE access = 'Write' AND nx = 'Write' AND NOT na AND NOT in_condition AND NOT EXISTS (SELECT 1 FROM outs o WHERE o.object_key = n.object_key AND o.name = n.name)""")
def rule_2_7_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.dead_stores(_small_model(spark, sf_dir)).select("object_key", "rule_id", "line_number", "description")


_REDACTED = "regexp_replace(raw, '''S3cr3t!''', '''***''')"
_PASSWORD = o.say("GX.SEC.1", "'&password'")


@query("rule_sec_1", f"WITH {o.EVENTS}, {o.MODEL} SELECT object_key, CAST(line_no AS INTEGER) AS line_number, {_REDACTED} AS line_content, {_PASSWORD} AS description FROM stmts WHERE stmt = 'Assignment' AND starts_with(lower(raw), '&password =')")
def rule_sec_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.credentials(_model(spark, sf_dir)).select("object_key", "line_number", "line_content", "description")


# The call graph.


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    objects = corpus.call_objects(spark, sf_dir)
    return project.call_edges(objects), objects


_EDGES = f"WITH RECURSIVE {o.CALLS}, edges AS (SELECT object_key AS caller, concat('obj', regexp_extract(line, 'obj([0-9]+)', 1)) AS callee, no AS line_no FROM (SELECT object_key, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM objects)), deps AS (SELECT DISTINCT caller, callee FROM edges WHERE callee IN (SELECT object_key FROM objects))"


@query("call_edges", f"{_EDGES} SELECT caller, callee, CAST(line_no AS INTEGER) AS line_no FROM edges")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[0]


@query("call_in_degree", f"{_EDGES} SELECT callee, count(*) AS callers FROM deps GROUP BY callee")
def call_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.in_degree(project.dependencies(*_edges(spark, sf_dir)))


@query("frontier_objects", f"{_EDGES} SELECT object_key FROM objects WHERE object_key NOT IN (SELECT callee FROM deps)")
def frontier_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, objects = _edges(spark, sf_dir)
    return project.frontier(project.dependencies(edges, objects), objects)


@query("dependents", f"{_EDGES}, reach(object_key) AS (SELECT 'obj7' UNION SELECT d.caller FROM deps d JOIN reach r ON d.callee = r.object_key) SELECT object_key FROM reach")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.dependents(project.dependencies(*_edges(spark, sf_dir)), ["obj7"])


@query("decode_bytes", "SELECT doc_id, text AS decoded FROM documents")
def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through their bytes."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", readers.decoded(F.encode("text", "UTF-8")).alias("decoded"))


from . import queries_sources, queries_taint  # noqa: E402, F401 - they register their queries

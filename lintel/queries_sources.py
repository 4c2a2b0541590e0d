"""Queries for sources, planning, the store and what is counted of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as o
from .functions import lexical as x
from .operators import deal, decisions, paging, rank_index, user_rules
from .operators.lines import FLAGS
from .plans import corpus
from .plans.audit import audit
from .plans.catalog import DEFAULT, catalog, routes
from .registry import query
from .sources import discovery, packages, planning, readers, reports, store

_EXTENSION = "['txt', 'XML', 'prg', 'md', 'zip', 'py'][page_id % 6 + 1]"
_LISTING = f"""listing AS (SELECT concat('/src/d', page_id % 7, '/', CASE WHEN page_id % 13 = 0 THEN '.old/' ELSE '' END, 'f', page_id, '.', {_EXTENSION}) AS path FROM pages)"""
_SOURCE = "regexp_matches(lower(path), '\\.(txt|prg|gxd|src|xml|xpz|zip|rar)$')"
_HIDDEN = "regexp_matches(path, '/\\.[^/]')"


@query("discovery_files", f"WITH {_LISTING} SELECT path FROM listing WHERE {_SOURCE} AND NOT {_HIDDEN}")
def discovery_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover(corpus.listing(spark, sf_dir), "/src")[0].select("path")


@query("discovery_globs", f"WITH {_LISTING} SELECT path FROM listing WHERE {_SOURCE} AND regexp_matches(path, '^/src/d[1-4]/.*f.*[0-9]\\.(XML|zip)$') AND NOT regexp_matches(path, '/d2/.*') AND NOT regexp_matches(path, '7[^/]\\.[^/.]*$')")
def discovery_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusions, exclusions and an ignore file, with hidden folders."""
    policy = discovery.Policy(include=("d[1-4]/*f*[0-9].{XML,zip}",), exclude=("d2/**",), ignore_lines=("# old ones", "", "*7?.*"), include_hidden=True)
    return discovery.discover(corpus.listing(spark, sf_dir), "/src", policy)[0].select("path")


def _plan(spark: SparkSession, sf_dir: str) -> planning.Plan:
    inputs = spark.createDataFrame(list(corpus.INPUTS), "ordinal long, path string, kind string")
    return planning.plan_inputs(inputs, corpus.listing(spark, sf_dir))


_INPUTS = "inputs(ordinal, path, kind) AS (VALUES " + ", ".join(map(str, corpus.INPUTS)) + ")"
_PLANNED = f"""WITH {_LISTING}, {_INPUTS},
below AS (SELECT i.ordinal, l.path, {_SOURCE.replace("path", "l.path")} AS ok FROM listing l JOIN inputs i ON i.kind = 'directory' AND starts_with(l.path, concat(i.path, '/')) WHERE NOT {_HIDDEN.replace("path", "l.path")}),
found AS (SELECT ordinal, path FROM below WHERE ok UNION ALL SELECT ordinal, path FROM inputs WHERE kind = 'file' AND {_SOURCE}),
failed AS (SELECT ordinal, path, CASE kind WHEN 'file' THEN 'unsupported extension' WHEN 'missing' THEN 'path does not exist' ELSE 'no source files' END AS error FROM inputs
  WHERE kind = 'missing' OR (kind = 'file' AND NOT {_SOURCE}) OR (kind = 'directory' AND ordinal NOT IN (SELECT ordinal FROM below WHERE ok)))"""


@query("plan_files", f"{_PLANNED} SELECT min(ordinal) AS ordinal, path FROM found GROUP BY path")
def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).files


@query("plan_failures", f"{_PLANNED} SELECT ordinal, path, error FROM failed")
def plan_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).failures


@query("plan_coverage", f"""{_PLANNED} SELECT (SELECT count(*) FROM inputs) AS inputs_declared, count(DISTINCT path) AS inputs_scanned, count(DISTINCT path) AS files_discovered,
  (SELECT count(*) FROM below WHERE NOT ok) AS files_excluded, count(*) - count(DISTINCT path) AS files_deduplicated, (SELECT count(*) FROM failed WHERE error = 'no source files') AS source_free_inputs FROM found""")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).coverage


@query("path_validation", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty path' WHEN page_id % 3 = 0 THEN 'path does not exist' WHEN page_id % 2 = 0 THEN 'not a file' END AS as_file,
  CASE WHEN page_id % 5 = 0 THEN 'empty path' WHEN page_id % 3 = 0 THEN 'path does not exist' WHEN page_id % 2 <> 0 THEN 'not a directory' END AS as_directory FROM pages""")
def path_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are blank, missing, or folders by their keys."""
    k = F.col("page_id")
    path, there, is_dir = F.when(k % 5 == 0, "  ").otherwise("/p"), k % 3 != 0, k % 2 == 0
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", planning.path_error(path, there, is_dir, "file").alias("as_file"), planning.path_error(path, there, is_dir, "directory").alias("as_directory"))


@query("approved_scope", f"WITH {_LISTING} SELECT DISTINCT path FROM listing WHERE starts_with(path, '/src/d1/') OR path IN (SELECT path FROM listing WHERE path LIKE '/src/d2/f2%')")
def approved_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below one approved folder, and approved files."""
    files = corpus.listing(spark, sf_dir)
    scope = files.where(F.col("path").startswith("/src/d2/f2")).union(spark.createDataFrame([("/src/d1",)], "path string"))
    return planning.approved(files, scope)


# Readers.

_XML = """exports AS (SELECT concat('/x/c', c_custkey, '.xml') AS path, c_custkey % 4 AS kind, c_custkey AS k FROM customer),
objects AS (SELECT path, concat('P', k) AS id, 'Procedure' AS object_type, 'F' AS package, concat('&a = ', k, chr(10), '&b = 2', chr(10), chr(10), 'parm(in:&a);') AS text, 2 AS code_start_line FROM exports WHERE kind = 0
  UNION ALL SELECT path, concat('L', k), 'Thing', 'pk', concat('e', k), 2 FROM exports WHERE kind = 1)"""
_OBJECT = ("path", "id", "object_type", "member", "package", "text", "code_start_line")


@query("xml_objects", f"WITH {_XML} SELECT path, id, object_type, replace(path, '/x/', '') AS member, package, text, CAST(code_start_line AS INTEGER) AS code_start_line FROM objects")
def xml_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_objects(corpus.xml_files(spark, sf_dir))[0].select(*_OBJECT)


@query("xml_segments", f"""WITH {_XML} SELECT path, 'Events' AS kind, CAST(1 AS INTEGER) AS text_start_line, CAST(2 AS INTEGER) AS member_start_line FROM objects
  UNION ALL SELECT path, 'Rules', 4, 3 FROM objects WHERE object_type = 'Procedure'""")
def xml_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sections of each object begin in its text and in its member."""
    rows = readers.read_objects(corpus.xml_files(spark, sf_dir))[0]
    return rows.select("path", F.inline("segments"))


@query("xml_failures", "SELECT concat('/x/c', c_custkey, '.xml') AS path, 'malformed XML' AS error FROM customer WHERE c_custkey % 4 = 2")
def xml_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = readers.read_objects(corpus.xml_files(spark, sf_dir))[1]
    return failures.select("path", F.substring_index("error", ":", 1).alias("error"))


@query("package_objects", f"WITH {_XML} SELECT replace(path, '.xml', '.xpz') AS path, id, object_type, unnest(['folder/a.xml', 'b.xml']) AS member, package, text, CAST(code_start_line AS INTEGER) AS code_start_line FROM objects")
def package_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_objects(corpus.packages(spark, sf_dir))[0].select(*_OBJECT)


@query("package_members", "SELECT concat('/x/c', c_custkey, '.xpz') AS path, CAST(unnest([0, 1, 2]) AS INTEGER) AS ord, unnest(['folder/a.xml', 'b.xml', 'blank.xml']) AS member FROM customer")
def package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.list_members(corpus.packages(spark, sf_dir)).select("path", "ord", "member")


@query("text_objects", r"SELECT concat('/t/', doc_id, '.txt') AS path, CAST(doc_id AS VARCHAR) AS id, 'Source' AS object_type, text FROM documents WHERE regexp_matches(text, '\S')")
def text_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_objects(corpus.text_files(spark, sf_dir))[0].select("path", "id", "object_type", "text")


@query("object_lookup", "SELECT concat('/x/c', c_custkey, '.xml') AS path, concat('P', c_custkey) AS id FROM customer WHERE c_custkey = 8")
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one object of a member by its id."""
    rows = readers.read_objects(corpus.xml_files(spark, sf_dir))[0]
    return planning.looked_up(rows, "c8.xml", "P8").select("path", "id")


# The store.

_PART = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_partkey % 9 + 1, '.', p_partkey % 7, ' ', p_name) END AS name, ['ERROR grave', 'Informativo', 'Advertencia', NULL][p_partkey % 4 + 1] AS kind FROM part"


@query("catalogue_import", f"""SELECT concat(p_partkey % 9 + 1, '.', p_partkey % 7) AS number, substr(name, 5) AS name, CAST(p_partkey AS VARCHAR) AS description,
  CASE p_partkey % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' ELSE 'WARNING' END AS severity FROM ({_PART}) WHERE p_partkey % 3 <> 0""")
def catalogue_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with a row for each part; every third has no number."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat((k % 9 + 1).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(" "), F.col("p_name")))
    kind = F.element_at(F.array(F.lit("ERROR grave"), F.lit("Informativo"), F.lit("Advertencia"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("").alias("blank"), name.alias("name"), k.cast("string").alias("description"), kind.alias("kind"))
    return store.catalogue_rows(rows)


@query("rule_toggles", f"""SELECT r.id AS rule_id, coalesce(c.enabled, r.dflt) AS enabled, c.at AS updated_at FROM (VALUES {o.CATEGORY}) r(id, category, version, concrete, dflt, ord)
  LEFT JOIN (SELECT event_id % 40 AS ord, arg_max(event_id % 2 = 0, event_id) AS enabled, max(event_id) AS at FROM events WHERE event_id % 3 = 0 GROUP BY 1) c ON c.ord = r.ord""")
def rule_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules switched on and off by events in their order; some name no rule."""
    rules = catalog(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 = 0")
    changes = events.select((F.col("event_id") % 40).alias("ord"), (F.col("event_id") % 2 == 0).alias("enabled"), F.col("event_id").alias("at"))
    changes = changes.join(F.broadcast(rules.select("ord", "rule_id")), "ord").select("rule_id", "enabled", "at")
    return store.toggled(rules.select("rule_id", F.col("is_default").alias("enabled")), changes)


@query("catalog_counts", f"SELECT count(*) AS rules, count(*) FILTER (dflt) AS enabled, count(*) = 0 AS is_empty FROM (VALUES {o.CATEGORY}) r(id, category, version, concrete, dflt, ord)")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(catalog(spark).select("rule_id", F.col("is_default").alias("enabled")))


@query("rules_enabled", f"""SELECT concat('GX.', e.n) AS rule_id, coalesce(r.dflt, false) AS enabled FROM (SELECT DISTINCT concat(event_id % 3, '.', event_id % 8) AS n FROM events) e
  LEFT JOIN (VALUES {o.CATEGORY}) r(id, category, version, concrete, dflt, ord) ON r.id = concat('GX.', e.n)""")
def rules_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked ids, some of which are no rules."""
    k = F.col("event_id")
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("GX."), (k % 3).cast("string"), F.lit("."), (k % 8).cast("string")).alias("rule_id")).distinct()
    return store.enabled_of(catalog(spark).select("rule_id", F.col("is_default").alias("enabled")), asked)


_SETTING = "['true', CAST(o_orderkey AS VARCHAR), concat(o_orderkey % 100, '.5'), 'on or off'][o_orderkey % 4 + 1]"


@query("settings_typed", f"""SELECT key, value, ['bool', 'int', 'float', 'string'][k % 4 + 1] AS value_type, CASE WHEN k % 4 = 1 THEN CAST(value AS BIGINT) END AS as_int,
  CASE WHEN k % 4 IN (1, 2) THEN CAST(value AS DOUBLE) END AS as_float FROM (SELECT concat('s', o_orderkey) AS key, o_orderkey AS k, {_SETTING} AS value FROM orders)""")
def settings_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    values = F.array(F.lit("true"), k.cast("string"), F.concat((k % 100).cast("string"), F.lit(".5")), F.lit("on or off"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("s"), k.cast("string")).alias("key"), F.element_at(values, (k % 4 + 1).cast("int")).alias("value"))
    return store.typed(rows)


@query("distinct_containers", "SELECT DISTINCT concat('/c/', user_id % 50) AS container FROM events WHERE user_id % 20 = 3 AND event_id % 9 <> 0")
def distinct_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).alias("run_id"), F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("/c/"), (F.col("user_id") % 50).cast("string"))).alias("container"))
    return store.containers_of(rows, 3)


@query("config_keys", "SELECT user_id, sha256(array_to_string(list_sort(list_distinct(list(event_type))), ',')) AS key FROM events GROUP BY user_id")
def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each user's set of event types."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(store.config_key(F.collect_set("event_type")).alias("key"))


@query("source_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", store.digest(F.coalesce("text", F.lit(""))).alias("digest"))


# Caps, retention and counters of a run.

_CAP = 500
_DEFAULT = o.all_findings(DEFAULT)


@query("findings_run_cap", f"""WITH RECURSIVE per AS (SELECT object_key, row_number() OVER (ORDER BY object_key) - 1 AS i, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT user_id AS object_key FROM events) LEFT JOIN (SELECT object_key, count(*) AS n FROM ({_DEFAULT}) GROUP BY object_key) USING (object_key)),
sized AS (SELECT *, count(*) OVER (PARTITION BY i // 8) AS size FROM per),
walk(i, object_key, total, quota, kept) AS (
  SELECT i, object_key, least(n, greatest({_CAP} // size, 1), {_CAP}), greatest({_CAP} // size, 1), least(n, greatest({_CAP} // size, 1), {_CAP}) FROM sized WHERE i = 0
  UNION ALL
  SELECT s.i, s.object_key, w.total + least(s.n, q.quota, {_CAP} - w.total), q.quota, least(s.n, q.quota, {_CAP} - w.total)
  FROM walk w JOIN sized s ON s.i = w.i + 1, LATERAL (SELECT CASE WHEN s.i % 8 = 0 THEN greatest(({_CAP} - w.total) // s.size, 1) ELSE w.quota END AS quota) q WHERE w.total < {_CAP})
SELECT object_key, CAST(kept AS BIGINT) AS findings FROM walk WHERE kept > 0""")
def findings_run_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each object keeps under a cap of 500 for the run, dealt out to chunks of eight objects."""
    from .queries import default_findings

    files = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("object_key")).distinct()
    files = rank_index.RankIndex(files, [F.col("object_key")]).ranked().withColumnRenamed("rank", "file_idx")
    kept, _ = paging.capped_by_chunks(default_findings(spark, sf_dir), files, _CAP)
    return kept.groupBy("object_key").agg(F.count("*").alias("findings"))


@query("session_retention", """SELECT id, findings FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS r, sum(findings) OVER (ORDER BY id DESC) AS t FROM (SELECT user_id AS id, count(*) AS findings FROM events GROUP BY user_id)) WHERE r <= 8 AND (r = 1 OR t <= 400)""")
def session_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("findings"))
    return paging.sessions_kept(sessions, 8, 400)


@query("issues_of_run", "SELECT id, severity FROM (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity FROM events WHERE user_id % 20 = 7)")
def issues_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of a run, by rank and id."""
    from .queries import issues

    return paging.issues_of(issues(spark, sf_dir), 7).select("id", "severity")


@query("operation_counters", f"""WITH {o.EVENTS}, {o.LINES}, counted AS (SELECT object_key, count(*) AS n FROM lines GROUP BY object_key)
SELECT (SELECT count(*) FROM objects) AS objects, (SELECT sum(strlen(text)) FROM objects) AS source_bytes, (SELECT count(*) FROM lines) AS lines_evaluated,
  (SELECT count(*) FROM ({_DEFAULT})) AS findings, (SELECT max(n) FROM counted) AS most_lines""")
def operation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.lines import parse_lines
    from .queries import default_findings

    objects = corpus.event_objects(spark, sf_dir)
    return decisions.operations(objects, parse_lines(objects), default_findings(spark, sf_dir))


@query("wrapped_text", r"SELECT doc_id, true AS whole, true AS fits FROM documents")
def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped at 112 columns: no word is lost, and no line is longer."""
    text = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"), x.wrapped(text, reports.WIDTH).alias("lines"))
    whole = F.replace(F.array_join("lines", ""), F.lit(" "), F.lit("")) == F.array_join(x.tokens_by_space(F.col("text")), "")
    return rows.select("doc_id", whole.alias("whole"), F.forall("lines", lambda line: F.length(line) <= reports.WIDTH).alias("fits"))


@query("report_blocks", f"SELECT object_key, count(*) AS blocks FROM ({_DEFAULT}) GROUP BY object_key")
def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks the paged report has of each object; no page has more lines than it holds."""
    from .queries import default_findings

    rows = reports.paged(default_findings(spark, sf_dir))
    pages = rows.groupBy("object_key", "page").agg(F.sum(F.size("lines") + 1).alias("used"), F.count("*").alias("blocks"))
    return pages.where((F.col("used") <= reports.LINES_PER_PAGE) | (F.col("blocks") == 1)).groupBy("object_key").agg(F.sum("blocks").alias("blocks"))


# Packages as a data source, exports in any case, and rules of the user.


@query("xml_any_case", f"WITH {_XML} SELECT path, id, object_type, package, text FROM objects")
def xml_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports whose tags are written in small or in capital letters by turns: the same objects."""
    text, turn = F.decode("content", "UTF-8"), F.crc32("path") % 3
    tags = ("ExportFile", "GXObject", "Info", "Name", "Folder", "Events", "Rules")
    small = big = text
    for t in tags:
        small, big = (F.regexp_replace(x, f"<(/?){t}>", f"<$1{w}>") for x, w in ((small, t.lower()), (big, t.upper())))
    files = corpus.xml_files(spark, sf_dir).select("path", F.encode(F.when(turn == 0, text).when(turn == 1, small).otherwise(big), "UTF-8").alias("content"))
    return readers.read_objects(files)[0].select("path", "id", "object_type", "package", "text")


@query("package_source", f"WITH {_XML} SELECT concat('p', k // 100, '.xpz') AS package_file, CAST(dense_rank() OVER (PARTITION BY k // 100 ORDER BY k) - 1 AS INTEGER) AS place, concat('c', k, '.xml') AS member, id, text FROM exports LEFT JOIN objects USING (path) QUALIFY id IS NOT NULL")
def package_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of a hundred exports each, read in ranges of members by several tasks."""
    folder = corpus.package_files(spark, sf_dir)
    objects, _ = packages.read_package_objects(spark, folder, splitBytes=4096)
    return objects.select(F.substring_index("path", "/", -1).alias("package_file"), "place", "member", "id", "text")


_LONGEST = f"""WITH {o.EVENTS}, {o.LINES}, marked AS (SELECT object_key, line_no, raw, starts_with(lower, 'for each') AS opens, starts_with(lower, 'endfor') AS closes FROM lines),
blocks AS (SELECT *, sum(CASE WHEN opens OR closes THEN 1 ELSE 0 END) OVER (PARTITION BY object_key ORDER BY line_no) AS b FROM marked),
sized AS (SELECT object_key, b, min(line_no) AS first, arg_min(raw, line_no) AS raw, count(*) - 1 AS n, bool_or(opens) AS real FROM blocks GROUP BY object_key, b)
SELECT object_key, CAST(first AS INTEGER) AS line_number, raw AS line_content, concat('Bloque de ', n, ' líneas.') AS description FROM sized WHERE real
QUALIFY row_number() OVER (PARTITION BY object_key ORDER BY n DESC, first) = 1"""


@query("user_rules", _LONGEST)
def user_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered stateful rule: of each object the longest run of lines after a loop's opening, told at the object's end."""
    from .operators.lines import parse_lines

    registry = user_rules.Registry()

    @registry.stateful_rule("USER.LOOP", "INFO", "Longest loop body")
    class Longest(user_rules.Stateful):
        def __init__(self):
            self.best: tuple[int, int, str] | None = None
            self.run: tuple[int, int, str] | None = None

        def line(self, number: int, raw: str, clean: str):
            low = raw.strip().lower()
            if low.startswith(("for each", "endfor")):
                self._close()
                self.run = (0, number, raw) if low.startswith("for each") else None
            elif self.run:
                self.run = (self.run[0] + 1, *self.run[1:])

        def _close(self):
            if self.run and (self.best is None or self.run[0] > self.best[0]):
                self.best = self.run

        def finish(self):
            self._close()
            if self.best:
                yield self.best[1], f"Bloque de {self.best[0]} líneas.", self.best[2]

    found = registry.findings(parse_lines(deal.by_text(corpus.event_objects(spark, sf_dir))))
    return found.select("object_key", "line_number", "line_content", "description")


@query("page_deep", "SELECT CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS rank, event_id, value FROM events QUALIFY rank >= 5000 AND rank < 5100")
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks 5,000 to 5,099 of events by value, from the ranges that they lie in."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    return rank_index.RankIndex(rows, [F.col("value"), F.col("event_id")]).page(5000, 100)


_ASKED = " + ".join("CAST(" + " OR ".join(flags) + " AS INTEGER)" for flags in routes(DEFAULT).values())
_FLAGGED = ", ".join(f"contains(clean_lower, '{needle}') AS {name}" for name, needle in FLAGS.items())


@query("audit_counters", f"""WITH {o.EVENTS}, {o.LINES}, flagged AS (SELECT *, {_FLAGGED} FROM lines)
SELECT (SELECT count(*) FROM objects) AS objects_extracted, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM objects) AS source_bytes, (SELECT count(*) FROM lines) AS lines_evaluated,
  (SELECT CAST(sum({len(DEFAULT) - len(routes(DEFAULT))} + {_ASKED}) AS BIGINT) FROM flagged) AS rule_evaluations, (SELECT count(*) FROM ({_DEFAULT})) AS findings_emitted, CAST({len(DEFAULT)} AS BIGINT) AS rule_factory_invocations""")
def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit of the default profile counts in passing."""
    result = audit(corpus.event_objects(spark, sf_dir))
    result.release()
    names = ("objects_extracted", "source_bytes", "lines_evaluated", "rule_evaluations", "findings_emitted", "rule_factory_invocations")
    return spark.createDataFrame([tuple(result.counters[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("wrapped_lines", rf"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\s]{{1,40}}') AS w FROM documents),
lines AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN list_reduce(w, lambda acc, x: concat(acc, CASE WHEN length(string_split(acc, chr(10))[-1]) + 1 + length(x) > 40 THEN chr(10) ELSE ' ' END, x)) ELSE '' END AS t FROM words)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS INTEGER) AS n_lines, sha256(t) AS lines_sha256 FROM lines""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped at 40 columns, line by line; longer words are cut."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", x.wrapped(F.coalesce("text", F.lit("")), 40).alias("lines"))
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


@query("decode_western", r"SELECT doc_id, concat(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g'), '€ éœ') AS decoded FROM documents")
def decode_western(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose bytes are no UTF-8: the Windows code page decides, with characters where it differs from Latin-1."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "")
    content = F.concat(F.encode(text, "ISO-8859-1"), F.unhex(F.lit("8020E99C")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", readers.decoded(content).alias("decoded"))


@query("profile_stored", f"""SELECT id AS rule_id FROM (VALUES {o.CATEGORY}) r(id, category, version, concrete, dflt, ord) LEFT JOIN (SELECT p_partkey % 34 AS ord, arg_max(p_partkey % 3 <> 0, p_partkey) AS now FROM part GROUP BY p_partkey % 34) USING (ord) WHERE concrete AND coalesce(now, dflt)""")
def profile_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a run whose store has had each rule switched on and off by the rows of a table."""
    rules = catalog(spark).select("rule_id", F.col("is_default").alias("enabled"), "ord")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 34).cast("int").alias("ord"), (F.col("p_partkey") % 3 != 0).alias("enabled"), F.col("p_partkey").alias("at"))
    changes = part.join(F.broadcast(rules.select("rule_id", "ord")), "ord").select("rule_id", "enabled", "at")
    ids = store.chosen_profile(spark, rules=store.toggled(rules.select("rule_id", "enabled"), changes))
    return spark.createDataFrame([(i,) for i in ids], "rule_id string")


@query("xml_layouts", "SELECT concat('/x/c', c_custkey, '.xml') AS path, 'unsupported layout' AS error FROM customer WHERE c_custkey % 3 = 0")
def xml_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by turns without an object or code, with an object that has no code, and with code: only the first are of no known layout."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "<a><b>text</b><events>no section</events></a>").when(k % 3 == 1, "<E><GXObject><X/></GXObject></E>").otherwise("<a><rules><![CDATA[parm();]]></rules></a>")
    rows = deal.by_count(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    files = rows.select(F.concat(F.lit("/x/c"), k.cast("string"), F.lit(".xml")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return readers.read_objects(files)[1].select("path", F.substring_index("error", ":", 1).alias("error"))

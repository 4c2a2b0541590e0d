"""History of runs, rules and settings as Parquet tables.

Runs are published by a log: a run's issues are written to a folder of their own, and
then one small file with the run's row and that folder's token appears in the log, at
once or not at all.  What the log doesn't name never happened, so a lost writer leaves
nothing half done (``vacuum`` deletes what it wrote), and a reader that keeps a
snapshot, the number of the last log entry it has seen, sees the same runs and issues
whatever is written meanwhile.

The schema has versions that only add columns; what an older version has not is null.
Version 1 had no log: its runs lie in a table whose rows were added after their issues,
and they belong to every snapshot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import setting_type
from ..operators.paging import keyset_page, retained, run_page
from ..plans.catalog import RULES, catalog, profile

#: Columns by the version that added them.
RUN_COLUMNS = {1: "id long, started timestamp, policy string, completion string, verdict string, total_findings long, errors long, warnings long, info long", 2: "snapshot string", 3: "counters string, reasons string"}
ISSUE_COLUMNS = {1: "run_id long, id long, rule_id string, severity string, line_number int, line_content string, description string", 2: "object_key string", 3: "phase int, emit_line int, rule_ord int, sub_idx int"}
VERSION = 3


def _schema(columns: dict[int, str], version: int = VERSION) -> str:
    return ", ".join(c for v, c in columns.items() if v <= version)


RUN, ISSUE = _schema(RUN_COLUMNS), _schema(ISSUE_COLUMNS)
ENTRY = f"number long, version int, token string, {RUN}"


class History:
    """Runs and their issues below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self._path(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if self._files(path).exists(path) else self.spark.createDataFrame([], schema)

    def _numbers(self) -> list[int]:
        path = self._path("log")
        files = self._files(path)
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self) -> int:
        """The number of the last log entry (0: none)."""
        return max(self._numbers(), default=0)

    def log(self, at: int | None = None) -> DataFrame:
        """Log entries up to a snapshot (by default the last)."""
        if not self._numbers():
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).json(f"{self.folder}/log")
        return rows.where(F.col("number") <= (self.snapshot() if at is None else at))

    def runs(self, at: int | None = None) -> DataFrame:
        columns = [c.split()[0] for c in RUN.split(", ")]
        return self._table("audit_runs", RUN).union(self.log(at).select(*columns))

    def issues(self, at: int | None = None) -> DataFrame:
        """Issues of published runs, and of runs of version 1 that have a row."""
        columns = [c.split()[0] for c in ISSUE.split(", ")]
        old = self._table("audit_issues", ISSUE).join(self._table("audit_runs", RUN).select(F.col("id").alias("run_id")), "run_id", "left_semi").select(*columns)
        new = self._table("issues", f"{ISSUE}, token string").join(self.log(at).select(F.col("id").alias("run_id"), "token"), ["run_id", "token"], "left_semi")
        return old.union(new.select(*columns))

    def _claimed(self) -> int:
        """A run id after the last one that no other writer has: the file system lets one writer make a mark."""
        run = (self.runs().agg(F.max("id")).first()[0] or 0) + 1
        while True:
            mark = self._path(f"audit_ids/{run}")
            files = self._files(mark)
            if not files.exists(mark) and files.createNewFile(mark):
                return run
            run += 1

    def written(self, result, run: int) -> str:
        """Write a run's issues; they count once published under the token that is returned."""
        token = uuid.uuid4().hex
        rows = result.findings.select("rule_id", "severity", "line_number", "line_content", "description", F.col("object_key").cast("string").alias("object_key"), "phase", "emit_line", "rule_ord", "sub_idx")
        numbered = rows.withColumns({"id": F.monotonically_increasing_id(), "run_id": F.lit(run).cast("long"), "token": F.lit(token)})
        numbered.select(*(c.split()[0] for c in ISSUE.split(", ")), "token").write.mode("append").partitionBy("run_id", "token").parquet(f"{self.folder}/issues")
        return token

    def published(self, run: int, token: str, row: dict) -> int:
        """Add a log entry under the next free number, and return that; of two writers with one number the second takes the one after."""
        started = self.spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).first()[0]
        number = self.snapshot() + 1
        while True:
            entry = {"number": number, "version": VERSION, "token": token, "id": run, "started": started, **row}
            if self._placed(f"log/{number:012d}.json", json.dumps(entry)):
                return number
            number += 1

    def _placed(self, name: str, text: str) -> bool:
        """Make a file with all its content at once; False if there is one of that name."""
        jvm, part, target = self.spark._jvm, self._path(f"log/.{uuid.uuid4().hex}"), self._path(name)
        files = self._files(part)
        out = files.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, options)
        except Exception:
            files.delete(part, False)
            if files.exists(target):
                return False
            raise
        return True

    def persist(self, result) -> int:
        """Add a run; its id is one more than the last that was claimed."""
        run = self._claimed()
        token = self.written(result, run)
        head = {"policy": result.policy.label(), "completion": result.completion, "verdict": result.verdict, **{k: result.metrics[k] for k in ("total_findings", "errors", "warnings", "info")}}
        reasons = [r for p in getattr(result, "projects", ()) for r in p.reasons]
        self.published(run, token, head | {"snapshot": json.dumps(head), "counters": json.dumps(getattr(result, "counters", {})), "reasons": json.dumps(reasons)})
        return run

    def vacuum(self) -> int:
        """Delete issues that no log entry names, of writers that died; to be run while none writes. How many folders went."""
        known = {(r["id"], r["token"]) for r in self.log().select("id", "token").toLocalIterator()}
        path, gone = self._path("issues"), 0
        files = self._files(path)
        for run in files.listStatus(path) if files.exists(path) else ():
            if not run.getPath().getName().startswith("run_id="):
                continue
            number = int(run.getPath().getName().partition("=")[2])
            for f in files.listStatus(run.getPath()):
                if (number, f.getPath().getName().partition("=")[2]) not in known:
                    files.delete(f.getPath(), True)
                    gone += 1
        return gone

    def page(self, run: int, cursor: str | None = None, limit: int = 100) -> DataFrame:
        return keyset_page(self.issues().where(F.col("run_id") == run), cursor, limit)

    def run_page(self, before: int | None = None, limit: int = 100) -> DataFrame:
        return run_page(self.runs(), before, limit)

    def keep_newest(self, n: int, target: str) -> None:
        """Write the newest runs and their issues to another folder, as tables that belong to every snapshot."""
        runs, issues = retained(self.runs(), self.issues(), n)
        issues.write.mode("overwrite").partitionBy("run_id").parquet(f"{target}/audit_issues")
        runs.write.mode("overwrite").parquet(f"{target}/audit_runs")


def digest(content) -> object:
    """The SHA-256 of a source, in hexadecimal."""
    return F.sha2(content, 256)


def seeded(rules: DataFrame, spark: SparkSession) -> DataFrame:
    """Rules (rule_id, enabled) with the catalogue's rules that were missing, at their defaults."""
    missing = catalog(spark).join(rules, "rule_id", "left_anti").select("rule_id", F.col("is_default").alias("enabled"))
    return rules.select("rule_id", "enabled").union(missing)


def missing_ids(rules: DataFrame, spark: SparkSession) -> DataFrame:
    return catalog(spark).select("rule_id").join(rules, "rule_id", "left_anti")


def with_enabled(rules: DataFrame, rule_id: str, enabled: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("rule_id") == rule_id, F.lit(enabled)).otherwise(F.col("enabled")))


#: Line rules that the default profile has on or off; any other is on when a catalogue names it.
SPOKEN_OF = (
    "GX.1.1", "GX.1.2", "GX.1.3", "GX.1.3.1", "GX.1.3.2", "GX.1.3.3", "GX.1.4.1", "GX.1.4.2", "GX.1.4.3", "GX.1.5", "GX.1.6.1", "GX.1.6.2", "GX.1.7.1", "GX.1.7.2",
    "GX.2.1", "GX.2.2", "GX.2.3", "GX.2.4", "GX.2.5", "GX.2.6", "GX.2.7.1", "GX.2.7.2", "GX.2.7.3",
)
#: Settings and their defaults.
SETTINGS = {"max_error_pct": "10.0", "max_errors": "0", "max_warnings": "999999"}


def setting(settings: DataFrame, key: str) -> str | None:
    row = settings.where(F.col("key") == key).select("value").first()
    return row["value"] if row else SETTINGS.get(key)


def with_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    one = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return settings.where(F.col("key") != key).select("key", "value").unionByName(one)


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """number, name, description, severity of the rows (blank, name, description, kind) of a catalogue that have a number."""
    number = F.regexp_extract("name", r"^\s*(\d+(?:\.\d+)*)\s", 1)
    kind = F.coalesce(F.lower("kind"), F.lit(""))
    severity = F.when(kind.contains("error"), "ERROR").when(kind.contains("info"), "INFO").otherwise("WARNING")
    return rows.where(number != "").select(number.alias("number"), F.trim(F.regexp_replace("name", r"^\s*\d+(?:\.\d+)*\s+", "")).alias("name"), "description", severity.alias("severity"))


def catalogue_csv(spark: SparkSession, path: str) -> tuple[DataFrame, float | None]:
    """Rules of a catalogue file without header, and its percentage row."""
    rows = spark.read.csv(path, header=False, schema="blank string, name string, description string, kind string", multiLine=True, escape='"')
    line = F.concat_ws(" ", "blank", "name", "description", "kind")
    pct = rows.select(line.alias("line")).where(F.lower("line").contains("porcentaje de error")).select(F.regexp_extract("line", r"([0-9]+(?:\.[0-9]+)?)\s*$", 1).try_cast("double")).first()
    return catalogue_rows(rows), pct[0] if pct else None


def imported(rules: DataFrame, found: DataFrame) -> DataFrame:
    """rule_id, enabled of rules (rule_id, enabled) with those of a catalogue's rows (number, ...) that are line rules.

    A rule that is there keeps its state; a new one has the default profile's, and is
    enabled where that profile doesn't speak of it.  Numbers of groups and unknown ones add nothing.
    """
    states = [(r.id, r.default or r.id not in SPOKEN_OF) for r in RULES if not r.abstract and r.scope == "line"]
    numbers = found.select(F.concat(F.lit("GX."), "number").alias("rule_id")).distinct()
    new = rules.sparkSession.createDataFrame(states, "rule_id string, enabled boolean").join(numbers, "rule_id", "left_semi")
    return rules.select("rule_id", "enabled").union(new.join(rules, "rule_id", "left_anti").select("rule_id", "enabled"))


def chosen_profile(spark: SparkSession, enable: list[str] | None = None, disable: list[str] | None = None, csv: str | None = None, rules: DataFrame | None = None) -> list[str]:
    """Concrete rule ids of a run: a whitelist, else a catalogue file's enabled rules, else those of stored rules, else the default profile; less what is disabled."""
    if enable is None and (csv is not None or rules is not None):
        if csv is not None:
            rules = imported(spark.createDataFrame([], "rule_id string, enabled boolean"), catalogue_csv(spark, csv)[0])
        enable = sorted({r["rule_id"] for r in rules.where("enabled").select("rule_id").collect()})  # a row for each rule
    return profile(enable, disable)


def toggled(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rule_id, enabled, updated_at after changes (rule_id, enabled, at): the last change of a rule counts; ids that are no rules change nothing."""
    last = changes.groupBy("rule_id").agg(F.max_by("enabled", "at").alias("now"), F.max("at").alias("at"))
    out = rules.join(last, "rule_id", "left")
    return out.select("rule_id", F.coalesce("now", "enabled").alias("enabled"), F.col("at").alias("updated_at"))


def enabled_of(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked ids (rule_id) with whether they are enabled; one that is missing is not."""
    return asked.join(rules.select("rule_id", "enabled"), "rule_id", "left").select("rule_id", F.coalesce("enabled", F.lit(False)).alias("enabled"))


def counts(rules: DataFrame) -> DataFrame:
    """One row: how many rules there are, how many are enabled, and whether there is none."""
    return rules.agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled"), (F.count("*") == 0).alias("is_empty"))


def typed(settings: DataFrame) -> DataFrame:
    """key, value, value_type, as_int, as_float: settings with what their text can be read as."""
    return settings.select("key", "value", setting_type(F.col("value")).alias("value_type"), F.col("value").try_cast("bigint").alias("as_int"), F.col("value").try_cast("double").alias("as_float"))


def containers_of(issues: DataFrame, run: int) -> DataFrame:
    """The distinct containers (container) of a run's issues."""
    return issues.where((F.col("run_id") == run) & F.col("container").isNotNull()).select("container").distinct()


def config_key(ids: Column) -> Column:
    """A key of a set of rule ids that their order doesn't change."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), ","), 256)


class ContentCache:
    """Results by content: what is computed for a text under a key is read back for any object with that text.

    The folder is a Parquet table of (content, key, value) that grows; only contents
    that it lacks under the key are computed.  compute: DataFrame (content, text) to
    DataFrame (content, value), value of one type for all keys.
    """

    def __init__(self, spark: SparkSession, folder: str, value: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), f"content string, key string, value {value}"

    def _known(self, key: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder).where(F.col("key") == key)

    def of(self, objects: DataFrame, key: str, compute) -> DataFrame:
        """objects (text, ...) with the value of each."""
        rows = objects.withColumn("content", digest(F.coalesce(F.col("text"), F.lit(""))))
        missing = rows.select("content").distinct().join(self._known(key), "content", "left_anti")
        texts = rows.select("content", F.coalesce("text", F.lit("")).alias("text")).join(missing, "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
        compute(texts).select("content", F.lit(key).alias("key"), "value").write.mode("append").parquet(self.folder)
        known = self._known(key).groupBy("content").agg(F.first("value").alias("value"))
        return rows.join(known, "content").drop("content")

"""The audit: objects and chosen rules to findings, and findings to a result."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deal, decisions, semantics
from ..operators.counters import Counters
from ..operators.lines import parse_lines
from ..operators.paging import capped, ordered
from ..operators.project import Coverage, Limits, analyze
from ..operators.rules import LINE_RULES, line_findings, unused_variables
from ..operators.taint import local_taint
from .catalog import CONCRETE, DEFAULT

COLUMNS = ("object_key", "rule_id", "severity", "line_number", "description", "line_content", "phase", "emit_line", "rule_ord", "sub_idx")


def findings(objects: DataFrame, ids: list[str] | tuple[str, ...] = DEFAULT, retain_evidence: bool = False, limits: Limits | None = None, covers: list[Coverage] | None = None, counters: Counters | None = None) -> DataFrame:
    """Findings of the chosen rules over objects (object_key, text; for GX.SEC.3 ord too).

    Only the relations that the rules need are built: lines for line rules, the
    semantic model for object rules, summaries for the project rule, whose coverage
    within the limits (none by default) is added to covers.  counters mark the plan of
    the line rules, or else that of the first other rule, and the findings.
    """
    chosen = [i for i in CONCRETE if i in set(ids)]
    parts: list[DataFrame] = []
    on_lines = [i for i in chosen if i in LINE_RULES]
    dealt = deal.by_text(objects) if on_lines or "GX.2.7.4" in chosen else objects
    lines = parse_lines(dealt)
    marked = counters.objects(dealt) if counters else dealt
    if on_lines:
        given = parse_lines(marked)
        parts.append(line_findings(counters.lines(given, on_lines) if counters else given, on_lines))
        marked = objects
    if "GX.2.7.4" in chosen:
        given = lines if on_lines else parse_lines(marked)
        parts.append(unused_variables(given if on_lines or not counters else counters.lines(given, ["GX.2.7.4"])))
        marked = objects
    if {"GX.2.7.5", "GX.SEC.1"} & set(chosen):
        model = semantics.model(marked)
        marked = objects
        if "GX.2.7.5" in chosen:
            parts.append(semantics.dead_stores(model))
        if "GX.SEC.1" in chosen:
            parts.append(semantics.credentials(model, retain_evidence))
    if "GX.SEC.2" in chosen:
        parts.append(local_taint(objects))
    if "GX.SEC.3" in chosen:
        found, cover = analyze(objects, limits)
        if covers is not None:
            covers.append(cover)
        parts.append(found)
    if not parts:
        raise ValueError("no concrete rule is enabled")
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return counters.findings(out) if counters else out


@dataclass
class Result:
    """What an audit gives: findings in order, one row of metrics, and the decision."""

    findings: DataFrame
    metrics: dict
    policy: decisions.Absolute | decisions.Percentage
    completion: str
    verdict: str
    scanned: int
    failures: list[tuple[str, str]] = field(default_factory=list)
    security: dict | None = None
    held: DataFrame | None = None
    projects: list[Coverage] = field(default_factory=list)
    counters: dict = field(default_factory=dict)

    def release(self) -> None:
        """Give back the memory that the findings are held in; they are computed anew if they are read later."""
        if self.held is not None:
            self.held.unpersist()

    @property
    def exit_code(self) -> int:
        return decisions.EXIT_CODES[self.verdict]


def with_deadline(spark: SparkSession, seconds: float, job):
    """job() and whether it was cut off: its Spark jobs are interrupted when the time is over, and the value is then None."""
    context, tag = spark.sparkContext, f"lintel-{uuid.uuid4().hex}"
    cut, done = threading.Event(), threading.Event()

    def stop() -> None:
        if done.wait(seconds):
            return
        cut.set()
        while not done.wait(0.5):  # jobs that begin after the time is over are interrupted too
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    threading.Thread(target=stop, daemon=True).start()
    try:
        return job(), False
    except Exception:
        if cut.is_set():
            return None, True
        raise
    finally:
        done.set()
        context.removeJobTag(tag)


def audit(objects: DataFrame, ids: list[str] | tuple[str, ...] = DEFAULT, policy=None, max_findings: int | None = None, failures: list[tuple[str, str]] | None = None, cancelled: bool = False, retain_evidence: bool = False, scanned: int | None = None, limits: Limits | None = None) -> Result:
    """Run the rules and decide. The cap keeps the first findings in order and makes the run partial, and so do limits that cut a project."""
    policy, failures, covers = policy or decisions.Absolute(), failures or [], []
    counters = Counters([i for i in CONCRETE if i in set(ids)])
    found = held = findings(objects, ids, retain_evidence, limits, covers, counters).persist()
    limited = any(c.truncated for c in covers)
    if max_findings is not None:
        over = found.count() > max_findings
        found, limited = capped(found, max_findings) if over else found, limited or over
    from .catalog import catalog

    spark = objects.sparkSession
    security = decisions.security_summary(found, catalog(spark).select("rule_id", "category")).first()
    row = decisions.metrics(found)
    done = decisions.completion(F.lit(cancelled), F.lit(limited), F.lit(len(failures)))
    row = row.withColumn("completion", done)
    row = row.withColumn("verdict", decisions.verdict(F.col("completion"), F.lit(security["errors"] if security else 0), policy.passes())).first()
    numbers = {k: row[k] for k in ("total_findings", "errors", "warnings", "info")}
    scanned = objects.count() if scanned is None else scanned
    return Result(ordered(found), numbers, policy, row["completion"], row["verdict"], scanned, failures, security.asDict() if security else None, held, covers, counters.of(covers, scanned))

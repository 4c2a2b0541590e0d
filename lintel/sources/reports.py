"""Sinks: text, JSON, lines of JSON, and a paged text report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import wrapped
from ..plans.audit import Result

VERDICTS = {"pass": "PASS", "reject": "REJECT", "error": "ERROR (fallos de scan)"}
LINES_PER_PAGE, WIDTH = 56, 112


def finding_line() -> object:
    return F.format_string("%-7s %-10s línea %-4d %s", F.col("severity"), F.col("rule_id"), F.col("line_number"), F.col("description"))


def text_summary(result: Result, with_findings: bool = True) -> str:
    """The summary that a scan prints. Findings pass the driver one partition at a time; ``write_text`` writes any number of them."""
    m = result.metrics
    out = [f"[gx] política: {result.policy.label()}", f"[gx] archivos escaneados: {result.scanned} | hallazgos: {m['total_findings']} ({m['errors']} ERROR / {m['warnings']} WARNING / {m['info']} INFO)"]
    if with_findings:
        out += [r[0] for r in result.findings.select(finding_line()).toLocalIterator()]
    if result.security:
        s = result.security
        out.append(f"[gx] seguridad: {s['findings']} hallazgo(s), {s['errors']} error(es) — veredicto {VERDICTS[s['verdict']]} (CWE/patrones)")
    out.append(f"[gx] quality gate: {VERDICTS[result.verdict]} ({result.policy.name})")
    return "\n".join(out) + "\n"


def write_text(result: Result, path: str) -> None:
    """The findings' lines in their order, written by the executors in as many parts as there are, and what the whole run says as a last part."""
    result.findings.select(finding_line().alias("value")).write.mode("overwrite").text(path)
    spark = result.findings.sparkSession
    head, *rest = text_summary(result, with_findings=False).rstrip("\n").split("\n")
    spark.createDataFrame([(x,) for x in (head, *rest)], "value string").coalesce(1).write.mode("append").text(path)


def summary(result: Result) -> dict:
    return {"scanned_files": result.scanned, "metrics": result.metrics, "policy": result.policy.label(), "verdict": result.verdict, "completion": result.completion, "security": result.security, "failures": [{"path": p, "error": e} for p, e in result.failures]}


FIELDS = ("rule_id", "severity", "line_number", "line_content", "description", "object_key")


def to_json(result: Result) -> str:
    return json.dumps(summary(result) | {"findings": [r.asDict() for r in result.findings.select(*FIELDS).toLocalIterator()]}, ensure_ascii=False, indent=2)


def write_json_lines(result: Result, path: str) -> None:
    """A line for each finding, written by the executors, and a last part with the summary."""
    result.findings.select(F.to_json(F.struct(*FIELDS)).alias("value")).write.mode("overwrite").text(path)
    last = result.findings.sparkSession.createDataFrame([(json.dumps({"type": "summary"} | summary(result), ensure_ascii=False),)], "value string")
    last.coalesce(1).write.mode("append").text(path)


def paged(findings: DataFrame) -> DataFrame:
    """object_key, block, page, lines: blocks of wrapped lines, never split over pages of 56 lines, each object from a new page."""
    blocks = findings.select("object_key", F.struct("phase", "emit_line", "rule_ord", "sub_idx").alias("o"), wrapped(finding_line(), WIDTH).alias("lines"))
    every = blocks.groupBy("object_key").agg(F.array_sort(F.collect_list(F.struct("o", "lines"))).alias("b"))
    start = F.struct(F.lit(1).alias("page"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("pages"))

    def place(a, x):
        n = F.size(x["lines"]) + 1
        new = (a["used"] > 0) & (a["used"] + n > LINES_PER_PAGE)
        page = a["page"] + F.when(new, 1).otherwise(0)
        return F.struct(page.alias("page"), F.when(new, n).otherwise(a["used"] + n).alias("used"), F.concat(a["pages"], F.array(page)).alias("pages"))

    pages = F.aggregate("b", start, place, lambda a: a["pages"])
    rows = every.select("object_key", "b", pages.alias("p")).select("object_key", F.posexplode(F.arrays_zip("b", "p")).alias("block", "z"))
    return rows.select("object_key", "block", F.col("z.p").alias("page"), F.col("z.b.lines").alias("lines"))

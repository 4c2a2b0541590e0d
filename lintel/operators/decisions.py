"""Metrics, policies, completion and verdict as aggregates and expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rounds import held


@dataclass(frozen=True)
class Absolute:
    max_errors: int = 0
    max_warnings: int = 999_999

    name = "absolute"

    def passes(self) -> Column:
        return (F.col("errors") <= self.max_errors) & (F.col("warnings") <= self.max_warnings)

    def label(self) -> str:
        return f"absolute (max_errors={self.max_errors}, max_warnings={self.max_warnings})"


@dataclass(frozen=True)
class Percentage:
    """Errors as a share of all findings, in 32-bit arithmetic."""

    max_error_pct: float = 10.0

    name = "percentage"

    def passes(self) -> Column:
        share = (F.col("errors").cast("float") * F.lit(100).cast("float") / F.col("total_findings").cast("float")).cast("float")
        return F.when(F.col("total_findings") == 0, F.lit(True)).otherwise(share <= F.lit(self.max_error_pct).cast("float"))

    def label(self) -> str:
        return f"percentage (max_error_pct={self.max_error_pct:g})"


def metrics(findings: DataFrame, *by: str) -> DataFrame:
    """total_findings, errors, warnings, info; one row, or one for each group."""
    counts = [F.count("*").alias("total_findings"), *(F.count_if(F.col("severity") == s).alias(n) for s, n in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "info")))]
    return findings.groupBy(*by).agg(*counts) if by else findings.agg(*counts)


def beside(*rows: DataFrame) -> DataFrame:
    """One row of the columns of several tables of one row each."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*(F.max(c).alias(c) for c in out.columns))


def operations(objects: DataFrame, lines: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counters of a run: objects, source_bytes, lines_evaluated, findings, most_lines (of one object)."""
    of_objects = objects.agg(F.count("*").alias("objects"), F.sum(F.octet_length("text").cast("long")).alias("source_bytes"))
    per_object = lines.groupBy("object_key").agg(F.count("*").alias("n"))
    of_lines = per_object.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines_evaluated"), F.max("n").alias("most_lines"))
    of_findings = findings.agg(F.count("*").alias("findings"))
    return beside(of_objects, of_lines, of_findings).select("objects", "source_bytes", "lines_evaluated", "findings", "most_lines")


def security_summary(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """findings, errors, verdict of the security rules; no row without any. categories: rule_id, category."""
    rows = findings.join(F.broadcast(categories), "rule_id").where("category = 'security'")
    out = rows.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "ERROR").alias("errors")).where("findings > 0")
    return out.withColumn("verdict", F.when(F.col("errors") > 0, "reject").otherwise("pass"))


def completion(cancelled: Column, limited: Column, failures: Column) -> Column:
    """cancelled, then partial, then complete without failures, else failed."""
    return F.when(cancelled, "cancelled").when(limited, "partial").when(failures == 0, "complete").otherwise("failed")


def verdict(completion: Column, security_errors: Column, passes: Column) -> Column:
    """error unless complete; reject with security errors; else what the policy says."""
    return F.when(completion != "complete", "error").when(security_errors > 0, "reject").when(passes, "pass").otherwise("reject")


EXIT_CODES = {"pass": 0, "reject": 1, "invalid": 2, "error": 3}


def pack_coverage(findings: DataFrame, packs: DataFrame, objects: int) -> DataFrame:
    """id, version, objects_analyzed, findings of each chosen pack, those without findings too."""
    counts = findings.groupBy("rule_id").agg(F.count("*").alias("n"))
    return packs.join(counts, "rule_id", "left").select(F.col("rule_id").alias("id"), "version", F.lit(objects).cast("long").alias("objects_analyzed"), F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def percentiles(times: DataFrame, column: str) -> DataFrame:
    """min, median, p95, max: the median and p95 are the order statistics at the rounded-up index.

    Values are counted, and the counts dealt out by ranges of values.  Running sums
    within a range begin at the total of the ranges before it (a row for each range
    is what meets), so no task has more than a range of the values.
    """
    counted = times.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    # Held: another run could cut the ranges elsewhere.
    dealt = held(counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["c"]) for r in dealt.groupBy("part").agg(F.sum("c").alias("c")).collect())
    n, before = 0, []
    for part, c in sums:
        before.append((part, n))
        n += c
    starts = times.sparkSession.createDataFrame(before, "part int, start long")
    last = F.col("start") + F.sum("c").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.join(F.broadcast(starts), "part").select("x", "c", last.alias("last"))
    whole = F.lit(n).cast("long")
    at = lambda q: F.min(F.when(F.col("last") >= F.greatest(F.ceil(whole * q), F.lit(1)), F.col("x")))
    return ranked.agg(F.min("x").alias("min"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("x").alias("max"), F.count("*").alias("n")).where("n > 0").drop("n")


def percentiles_by(times: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, min, median, p95, max of each group, as ``percentiles``: a group's values are dealt out by ranges too, so a large one is many tasks' work."""
    counted = times.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("x")).agg(F.count("*").alias("c"))
    dealt = held(counted.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "part").agg(F.sum("c").alias("held"))
    group = Window.partitionBy(*keys)
    upto = F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    starts = sums.withColumns({"start": upto - F.col("held"), "whole": F.sum("held").over(group)}).drop("held")
    last = F.col("start") + F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    starts = starts.select(*(F.col(k).alias(f"lintel_{k}") for k in (*keys, "part")), "start", "whole")
    same = [F.col(k).eqNullSafe(F.col(f"lintel_{k}")) for k in (*keys, "part")]
    ranked = dealt.join(starts, same).withColumn("last", last)
    at = lambda q: F.min(F.when(F.col("last") >= F.greatest(F.ceil(F.col("whole") * q), F.lit(1)), F.col("x")))
    return ranked.groupBy(*keys).agg(F.min("x").alias("min"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("x").alias("max"))

"""Order, caps, pages, search and retention over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import severity_rank

#: The order of findings of one run.
ORDER = ("object_key", "phase", "emit_line", "rule_ord", "sub_idx")
DEFAULT_LIMIT, MAX_LIMIT = 100, 500


def order_key() -> list[Column]:
    """Findings of lines by line, then rule; findings at an object's end by rule; those of packs after them."""
    return [F.col("object_key"), F.least("phase", F.lit(2)), F.when(F.col("phase") == 0, F.col("emit_line")).otherwise(0), F.col("rule_ord"), F.col("emit_line"), F.col("sub_idx")]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order_key())


def capped(findings: DataFrame, most: int) -> DataFrame:
    """The first findings of a run; TakeOrdered keeps only so many of each partition."""
    return findings.orderBy(*order_key()).limit(most)


def capped_per_object(findings: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("object_key").orderBy(*order_key()[1:]))
    return findings.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


#: Files in one chunk of a run's cap.
CHUNK = 8


def chunk_quotas(counts: DataFrame, most: int, chunk: int = CHUNK) -> tuple[DataFrame, bool]:
    """file_idx, kept: how many findings each file keeps under a run-wide cap, and whether the cap cut anything.

    counts: file_idx (0, 1, ... in input order), n.  Files come in chunks; each file of
    a chunk may keep an equal share of what is left, at least one, and the run ends
    where the cap is reached.  What is left after a chunk depends on all before it, so
    chunks pass one after the other, and no more of them than the cap lasts for.
    """
    spark = counts.sparkSession
    rows = counts.groupBy(F.floor(F.col("file_idx") / chunk).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("file_idx", "n"))).alias("files"))
    kept, total, cut = [], 0, False
    for r in rows.orderBy("chunk").toLocalIterator():
        if total >= most:
            cut = True
            break
        quota = max((most - total) // len(r["files"]), 1)
        for f in r["files"]:
            n = min(f["n"], quota, most - total)
            cut = cut or n < f["n"]
            if n:
                kept.append((f["file_idx"], n))
            total += n
    return spark.createDataFrame(kept, "file_idx long, kept long"), cut


def capped_by_chunks(findings: DataFrame, files: DataFrame, most: int, chunk: int = CHUNK) -> tuple[DataFrame, bool]:
    """Findings (object_key and the columns of ORDER) that a run keeps under its cap, and whether that cut any. files: object_key, file_idx."""
    counts = files.join(findings.groupBy("object_key").agg(F.count("*").alias("n")), "object_key", "left").select("file_idx", F.coalesce("n", F.lit(0)).alias("n"))
    quotas, cut = chunk_quotas(counts, most, chunk)
    rank = F.row_number().over(Window.partitionBy("object_key").orderBy(*order_key()[1:]))
    ranked = findings.withColumn("rank", rank).join(files.join(quotas, "file_idx").select("object_key", "kept"), "object_key")
    return ranked.where(F.col("rank") <= F.col("kept")).drop("rank", "kept"), cut


def search(findings: DataFrame, severity: str | None = None, rule_id: str | None = None, term: str | None = None, columns: tuple[str, ...] = ("rule_id", "description", "object_key")) -> DataFrame:
    """Findings of a severity and a rule whose columns have a term, in either case."""
    out = findings
    if severity:
        out = out.where(F.col("severity") == severity)
    if rule_id:
        out = out.where(F.col("rule_id") == rule_id)
    if term and term.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))), F.lit(term.strip().lower())))
    return out


def offset_page(findings: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return ordered(findings).offset(max(0, offset)).limit(min(MAX_LIMIT, max(1, limit)))


def keyset_page(issues: DataFrame, cursor: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Issues (id, severity) after a cursor rank:id, by rank and id; one more than the limit tells of a next page."""
    rows = issues.withColumn("rank", severity_rank(F.col("severity")))
    at = parse_cursor(cursor)
    if at:
        rows = rows.where((F.col("rank") > at[0]) | ((F.col("rank") == at[0]) & (F.col("id") > at[1])))
    return rows.orderBy("rank", "id").limit(min(MAX_LIMIT, max(1, limit)) + 1)


def issues_of(issues: DataFrame, run: int) -> DataFrame:
    """A run's issues by rank and id."""
    return issues.where(F.col("run_id") == run).withColumn("rank", severity_rank(F.col("severity"))).orderBy("rank", "id").drop("rank")


def parse_cursor(cursor: str | None) -> tuple[int, int] | None:
    parts = (cursor or "").split(":")
    return (int(parts[0]), int(parts[1])) if len(parts) == 2 and all(p.isdigit() for p in parts) else None


def run_page(runs: DataFrame, before: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    rows = runs if before is None else runs.where(F.col("id") < before)
    return rows.orderBy(F.desc("id")).limit(limit + 1)


def source_window(lines: DataFrame, object_key, start: int, count: int = 400) -> DataFrame:
    """At most 400 lines of an object from a line on."""
    first = max(1, start)
    return lines.where((F.col("object_key") == object_key) & F.col("line_no").between(first, first + min(400, max(1, count)) - 1))


def retained(runs: DataFrame, issues: DataFrame, newest: int) -> tuple[DataFrame, DataFrame]:
    """The newest runs, and the issues of these."""
    keep = runs.orderBy(F.desc("id")).limit(newest)
    return keep, issues.join(keep.select(F.col("id").alias("run_id")), "run_id", "left_semi")


def sessions_kept(sessions: DataFrame, most: int = 8, findings: int = 50_000) -> DataFrame:
    """The newest sessions (id, findings) within a count and a total of findings; the newest always stays."""
    newest = Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = sessions.orderBy(F.desc("id")).limit(most)
    rows = rows.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("id"))), "total": F.sum("findings").over(newest)})
    return rows.where((F.col("rank") == 1) | (F.col("total") <= findings)).drop("rank", "total")


def times_triggered(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """How often each rule was found, zero too."""
    counts = findings.groupBy("rule_id").agg(F.count("*").alias("n"))
    return rules.select("rule_id").join(counts, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).cast("long").alias("times_triggered"))

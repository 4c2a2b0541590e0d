"""Declared inputs to planned files: what each path is, which files it gives, and what went wrong.

Folders meet their files by an equality of paths (every file names the folders
above it), so a listing of any size is an equi-join and never a comparison of all
files with all inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import beside
from .discovery import Policy, allows, is_source

UNSUPPORTED, MISSING, EMPTY = "unsupported extension", "path does not exist", "no source files"


def above(path: Column) -> Column:
    """The folders that a path stands in, the outermost first."""
    parts = F.split(path, "/")
    inner = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.transform(inner, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def path_error(path: Column, there: Column, is_dir: Column, kind: str) -> Column:
    """What is wrong with a declared path of a kind (file or directory); null if nothing is."""
    fits = is_dir if kind == "directory" else ~is_dir
    blank = F.trim(F.coalesce(path, F.lit(""))) == ""
    return F.when(blank, "empty path").when(~there, MISSING).when(~fits, f"not a {kind}")


def described(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ordinal, path, kind (file, directory or missing) of declared paths, a short list of the caller's."""
    rows = []
    for i, p in enumerate(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p.strip() or ".")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        there = bool(p.strip()) and files.exists(at)
        kind = "missing" if not there else "directory" if files.getFileStatus(at).isDirectory() else "file"
        rows.append((i, p.strip().rstrip("/") or p, kind))
    return spark.createDataFrame(rows, "ordinal long, path string, kind string")


@dataclass
class Plan:
    """files: ordinal, path; failures: ordinal, path, error; coverage: one row of counters."""

    files: DataFrame
    failures: DataFrame
    coverage: DataFrame


def plan_inputs(inputs: DataFrame, listing: DataFrame, policy: Policy | None = None) -> Plan:
    """inputs: ordinal, path, kind; listing: path of every file below them. A path that several inputs give is the first one's."""
    policy = policy or Policy()
    alone = inputs.where("kind = 'file'").withColumn("ok", is_source(F.col("path")))
    folders = inputs.where("kind = 'directory'").select("ordinal", F.col("path").alias("root"))
    below = listing.select("path", F.explode(above(F.col("path"))).alias("root")).join(folders, "root")
    below = below.withColumn("relative", F.substr("path", F.length("root") + 2))
    if not policy.include_hidden:
        below = below.where(~F.col("relative").rlike(r"(?:^|/)\.[^/]"))
    below = below.withColumn("ok", is_source(F.col("path")) & allows(F.col("relative"), policy))
    found = alone.where("ok").select("ordinal", "path").union(below.where("ok").select("ordinal", "path"))
    files = found.groupBy("path").agg(F.min("ordinal").alias("ordinal")).select("ordinal", "path")
    counts = below.groupBy("ordinal").agg(F.count_if("ok").alias("wanted"), F.count_if(~F.col("ok")).alias("others"))
    folders = folders.join(counts, "ordinal", "left").select("ordinal", "root", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("others", F.lit(0)).alias("others"))
    failures = (
        alone.where("not ok").select("ordinal", "path", F.lit(UNSUPPORTED).alias("error"))
        .union(inputs.where("kind = 'missing'").select("ordinal", "path", F.lit(MISSING).alias("error")))
        .union(folders.where("wanted = 0").select("ordinal", F.col("root").alias("path"), F.lit(EMPTY).alias("error")))
    )
    one = F.count("*")
    of_folders = folders.agg(F.coalesce(F.sum("others"), F.lit(0)).alias("files_excluded"), F.count_if(F.col("wanted") == 0).alias("source_free_inputs"))
    coverage = beside(inputs.agg(one.alias("inputs_declared")), files.agg(one.alias("files_discovered")), found.agg(one.alias("given")), of_folders)
    coverage = coverage.select("inputs_declared", F.col("files_discovered").alias("inputs_scanned"), "files_discovered", "files_excluded", (F.col("given") - F.col("files_discovered")).alias("files_deduplicated"), "source_free_inputs")
    return Plan(files, failures, coverage)


def approved(containers: DataFrame, scope: DataFrame) -> DataFrame:
    """The containers (path, ...) that are an approved path (path) or stand below one."""
    marked = containers.withColumn("lintel_above", F.explode(F.concat(above(F.col("path")), F.array("path"))))
    scope = scope.select(F.col("path").alias("lintel_above")).distinct()
    return marked.join(scope, "lintel_above", "left_semi").drop("lintel_above").distinct()


def looked_up(objects: DataFrame, member: str, name: str) -> DataFrame:
    """The object of a member with an id; without an id the member's only object, never one of several."""
    inside = objects.where(F.col("member") == member)
    exact = inside.where(F.col("id") == name)
    if name:
        return exact.limit(1)
    two = inside.limit(2)
    return two.join(F.broadcast(two.agg(F.count("*").alias("lintel_n"))), F.col("lintel_n") == 1).drop("lintel_n")

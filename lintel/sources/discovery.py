"""Finding source files: globs, hidden files, extensions, repeated inputs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import EXTENSIONS


@dataclass(frozen=True)
class Policy:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignore_lines: tuple[str, ...] = field(default=())
    include_hidden: bool = False

    def excluded(self) -> tuple[str, ...]:
        """Exclusions and the lines of an ignore file that are neither blank nor comments."""
        return (*self.exclude, *(x.strip() for x in self.ignore_lines if x.strip() and not x.strip().startswith("#")))


def glob_pattern(glob: str) -> str:
    """A glob over a relative path as a regular expression; * and ? cross folders. An unclosed class or group is an error."""
    out, i, groups = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            whole = glob.startswith("**/", i)
            out += "(?:.*/)?" if whole else ".*"
            i += 3 if whole else 2 if glob.startswith("**", i) else 1
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in {glob!r}")
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            groups += 1
            out += "(?:"
        elif c == "}" and groups:
            groups -= 1
            out += ")"
        elif c == "," and groups:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if groups:
        raise ValueError(f"unclosed group in {glob!r}")
    return f"^{out}$"


def allows(relative: Column, policy: Policy) -> Column:
    """Whether a path is included (all are without inclusions) and not excluded."""
    any_of = lambda globs: relative.rlike("|".join(map(glob_pattern, globs)))
    ok = any_of(policy.include) if policy.include else F.lit(True)
    out = policy.excluded()
    return ok & ~any_of(out) if out else ok


def is_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


def discover(listing: DataFrame, root: str, policy: Policy | None = None) -> tuple[DataFrame, int]:
    """The source files of a listing (path, ...) below a root, and how many of the other files were left out."""
    policy = policy or Policy()
    relative = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/+", "")
    shown = F.lit(True) if policy.include_hidden else ~relative.rlike(r"(?:^|/)\.[^/]")
    rows = listing.withColumn("relative", relative).where(shown)
    wanted = is_source(F.col("path")) & allows(F.col("relative"), policy)
    return rows.where(wanted), rows.where(~wanted).count()


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """path, length of all files below a root; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, content of all files below a root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """The same of source files alone: others are left out of the scan by their names, and their contents are never read."""
    either = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{either}}}").load(root)


def planned(inputs: DataFrame) -> DataFrame:
    """Inputs (ordinal, canonical_path), each path once: the first stays."""
    rank = F.row_number().over(Window.partitionBy("canonical_path").orderBy("ordinal"))
    return inputs.withColumn("rank", rank).where("rank = 1").drop("rank")


def scan_coverage(inputs: DataFrame) -> DataFrame:
    """One row of counters over planned inputs (status, excluded)."""
    kinds = ("ok", "error", "duplicate", "missing", "empty_directory")
    return inputs.agg(F.count("*").alias("inputs"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))

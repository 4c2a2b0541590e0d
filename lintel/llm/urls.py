"""URL filter: rules first, then empirical-Bayes host reputation, in DataFrame functions only.

Outcomes of labelled pages are counted by host.  A host's share of bad pages has
a beta prior around the estimate of its registered domain (its last two labels),
that one around the estimate of its suffix (the last label), and that one around
the mean of all pages; the strength of each prior comes from how much more the
counts of one level differ than binomial counts would (method of moments of the
beta-binomial).  A host is blocked if the lower bound of its posterior share of
bad pages is at least ``CUTOFF``.  The bound is taken on the arcsine of the square
root of the share, whose deviation 1 / (2 sqrt(weight + 1)) does not depend on the
share: ``Z`` deviations below the posterior mean, and a share at every size.

Counts by host are partial aggregates, so a host with a third of all pages is one
row; it meets its pages in a join that adaptive execution can split.

Defined results: a null url or one without :// has an empty host and path, fits no
rule and is judged as the host ''; without outcomes every host is allowed; a null
outcome is none; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, CUTOFF = 2.0, 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    #: host, then path from its first slash on
    pattern: str

    def fits(self) -> Column:
        name, slash, path = self.pattern.partition("/")
        below = (F.col("host") == name) | F.col("host").endswith(f".{name}")
        return below & F.col("path").startswith(slash + path)


#: The rules of the query.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rule(rules: tuple[Rule, ...], value) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        out = F.when(r.fits(), F.lit(value(r))).otherwise(out)
    return out


def _strength(units: DataFrame, prior: str) -> float:
    """Prior observations of a level: units have n, bad and the prior mean of each."""
    m = F.least(F.greatest(F.col(prior), F.lit(1e-6)), F.lit(1 - 1e-6))
    n, spread = F.col("n").cast("double"), m * (1 - m)
    # Sums of squares as they are: one page against a prior near zero must not outweigh all others.
    over = F.sum(F.pow(F.col("bad") - n * m, 2) - n * spread)
    total = F.sum(n * (n - 1) * spread)
    row = units.agg(over.alias("o"), total.alias("t")).first()
    rho = (row["o"] or 0.0) / row["t"] if row["t"] else 0.5
    rho = min(max(rho, 1e-4), 0.9999)
    return 1 / rho - 1


def reputation(pages: DataFrame, outcomes: DataFrame, keep: Scratch) -> DataFrame:
    """host, n, and mean and weight of the posterior beta of its share of bad pages, for every host of pages (page_id, host)."""
    bad = outcomes.where("page_id is not null and good in (0, 1)").groupBy("page_id").agg(F.min("good").alias("good"))
    hits = pages.join(bad, "page_id", "left")
    hosts = hits.groupBy("host").agg(F.count("good").alias("n"), F.count_if(F.col("good") == 0).alias("bad"))
    labels = F.split("host", r"\.")
    hosts = keep.keep(hosts.select("host", "n", "bad", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix")), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    mean = (total[1] + 0.5) / (total[0] + 1.0) if total[0] else 0.0
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(mean))
    s = _strength(level, "prior")
    suffixes = keep.keep(level.select("suffix", ((F.col("bad") + s * F.col("prior")) / (F.col("n") + s)).alias("prior")), "suffixes")
    level = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    s = _strength(level, "prior")
    domains = keep.keep(level.select("domain", ((F.col("bad") + s * F.col("prior")) / (F.col("n") + s)).alias("prior")), "domains")
    level = hosts.join(domains, "domain")
    s = _strength(level, "prior")
    return keep.keep(level.select("host", "n", ((F.col("bad") + s * F.col("prior")) / (F.col("n") + s)).alias("mean"), (F.col("n") + s).alias("weight")), "reputation")


def lower_bound(mean: Column, weight: Column, z: float) -> Column:
    """The share that lies z deviations below the mean of a beta of that weight, on the arcsine scale."""
    angle = F.asin(F.sqrt(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)))) - z / (2 * F.sqrt(weight + 1))
    return F.pow(F.sin(F.greatest(angle, F.lit(0.0))), F.lit(2.0))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", z: float = Z, cutoff: float = CUTOFF) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. outcomes: page_id, good (1 or 0)."""
    keep = Scratch(pages.sparkSession, "urls")
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = reputation(rows.select("page_id", "host"), outcomes, keep)
    blocked = known.select("host", (lower_bound(F.col("mean"), F.col("weight"), z) >= cutoff).alias("bad"))
    out = rows.join(blocked, "host", "left")
    by_host = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", _rule(rules, lambda r: r.pattern).alias("rule"), F.coalesce(_rule(rules, lambda r: r.verdict), by_host).alias("verdict"))

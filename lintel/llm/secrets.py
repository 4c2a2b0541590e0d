"""Secret scan over an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is a text.  A text's SHA-256 is its blob; the ledger
holds the findings of each (blob, rules version) pair that has been scanned.  A
scan takes the blobs that the ledger lacks under the current rules, reads each
once however many paths and versions have it, adds them to the ledger, and joins
the findings back to all paths.  A blob shared by a third of all paths meets as
partial aggregates and in a join that adaptive execution can split.

Rules: the base kinds assign, access and hex, matched as in ``BASE``, and further
kinds.  Further findings are added to the base ones, also where both mark one
stretch of text: what a secret is assigned to and what it is are two findings.

Defined results: a null text is empty; a null path is a path; repeated rows each
get a row; further columns are ignored; a rules version that is scanned for the
first time scans every blob anew and leaves older findings in the ledger.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import counted, find, listed

ASSIGN = r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MORE = {
    "github": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "pem": r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
}
KINDS = ("assign", "access", "hex", *MORE)
#: Most hashes of unseen blobs sent to every executor; more are joined by a shuffle.
BROADCAST_BLOBS = 1_000_000
SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def rules_version() -> str:
    return hashlib.sha256(repr((ASSIGN, ACCESS, HEX, sorted(MORE.items()))).encode()).hexdigest()[:16]


def _kind(name: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(SPAN)


def findings(text: Column) -> Column:
    """Spans of a text, sorted by start, then kind as listed."""
    low = F.lower(text)
    named = F.contains(low, F.lit("password")) | F.contains(low, F.lit("passwd")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    base = F.concat(
        _kind("assign", F.filter(find(text, ASSIGN, 1, named), lambda s: F.length(s["part"]) >= 6)),
        _kind("access", find(text, ACCESS, 0, F.contains(text, F.lit("AKIA")))),
        _kind("hex", find(text, HEX)),
    )
    hints = {"github": F.contains(text, F.lit("gh")), "jwt": F.contains(text, F.lit("eyJ")), "pem": F.contains(text, F.lit("-----BEGIN")), "slack": F.contains(text, F.lit("xox"))}
    more = F.concat(*(_kind(k, find(text, p, 0, hints[k])) for k, p in MORE.items()))
    rank = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    keyed = F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(SPAN)


def scan(history: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text", version: str | None = None) -> DataFrame:
    """One row per row of history: path, blob, spans. ``ledger`` is a Parquet folder that grows; blobs it has under this rules version are not read again."""
    spark: SparkSession = history.sparkSession
    version = version or rules_version()
    rows = history.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    known = _ledger(spark, ledger)
    unseen = rows
    if known is not None:
        # Hashes first: texts of blobs that the ledger has stay where they are.
        new = rows.select("blob").distinct().join(known.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
        new = Scratch(spark, "unseen").keep(new, "blobs")
        unseen = rows.join(F.broadcast(new) if new.count() <= BROADCAST_BLOBS else new, "blob", "left_semi")
    blobs = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    blobs.select("blob", findings(F.col("text")).alias("spans")).withColumn("rules", F.lit(version)).write.mode("append").parquet(ledger)
    # Most blobs have no finding: only those that have one are joined back to paths, each once, also where two scans at a time added it.
    hit = _ledger(spark, ledger).where((F.col("rules") == version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    return rows.select("path", "blob").join(hit, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob string, spans {SPAN}, rules string").parquet(ledger)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan() with doc_id as the path."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    counts = [counted("spans", k) for k in ("assign", "access", "hex")]
    return scanned.select(F.col("path").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """A first scan of documents, with a ledger of its own."""
    return digest(scan(docs, Scratch(docs.sparkSession, "ledger").base, "doc_id"))

"""The corpus pipeline: STAGES applied to documents, each written as Parquet and reread.

Toxic documents go; of each group of near duplicates the one with the smallest id
stays; documents with a benchmark passage go; personal data is replaced; what is
left is packed into training sequences.  Each function takes (spark, docs, sf_dir).

Defined results: without labels of both classes nothing is toxic; without benchmark
items nothing is contaminated; rows without an id or a text, and different texts that
share an id, are documents like others (of one class of near duplicates the smallest
id stays, null last); further columns stay until packing; no documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import decontaminate, ngram_join, packing, pii, queries, toxicity
from lintel.llm.scratch import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    return ngram_join.representatives(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars is that of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("ngram_join", near_duplicates),
    ("decontamination", contaminated),
    ("pii", personal_data),
    ("packing", packed),
]

#: Toxicity, personal data and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = keep.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            keep.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs

"""Tables between the rounds of an iteration, in the folder that all executors share.

What a round makes is written as Parquet and read back, so lineage does not grow from
round to round, and what an executor held is not lost with it.  The folder is
``spark.checkpoint.dir`` of the running session; only a session with a local master may
have none and then gets a temporary one of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    set_ = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        set_ = f"file://{tempfile.mkdtemp(prefix='lintel-')}"
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_.rstrip("/")


class Rounds:
    """Numbered tables below one folder of an iteration."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, label: str = "held") -> DataFrame:
    """A table written once and read back: what is made by chance of partitioning stays as it is."""
    return Rounds(df.sparkSession, label).keep(df)

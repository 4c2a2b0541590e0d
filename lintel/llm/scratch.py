"""Lineage cuts in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the running session.  Only a session with
a local master (tests on one machine) may have none: it gets a temporary folder of
its own.  On a cluster a missing setting is an error, never a machine's own folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lintel-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Named Parquet tables below one unique folder of the shared root."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/lintel-{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.base}/{name}")

    def drop_but(self, *names: str) -> None:
        """Delete all tables of this scratch but those that a result still reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in files.listStatus(path):
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

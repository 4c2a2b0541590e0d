"""A directory as a stream of files: each micro-batch audits whole objects.

An object never spans files, so batches need no state of each other and a stream
gives what one batch over all files gives.  A content that an earlier batch had is
not audited again: the hashes of each batch's contents are written below the sink
(64 bytes a file), by batch, and later batches leave them out.  A batch that is run
again leaves out those of earlier batches only, and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.audit import COLUMNS, findings
from ..plans.catalog import DEFAULT
from ..sources.discovery import is_source
from ..sources.readers import read_objects

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder).where(is_source(F.col("path")))


def seen(spark: SparkSession, out: str, number: int) -> DataFrame:
    """The hashes of contents that batches before this one had."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/hashes")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "hash string")
    return spark.read.schema("hash string, batch int").parquet(f"{out}/hashes").where(F.col("batch") < number).select("hash")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, ids: tuple[str, ...] = DEFAULT, once: bool = True) -> StreamingQuery:
    """Audit new files into ``out/findings`` and ``out/failures``, partitioned by batch: a batch that is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        hashed = rows.withColumn("hash", F.sha2("content", 256)).dropDuplicates(["hash"])
        fresh = hashed.join(seen(spark, out, number), "hash", "left_anti").persist()
        objects, failures = read_objects(fresh)
        for name, df in (("findings", findings(objects, ids).select(*COLUMNS)), ("failures", failures), ("hashes", fresh.select("hash"))):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
        fresh.unpersist()

    writer = files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

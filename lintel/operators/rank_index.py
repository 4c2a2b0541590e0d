"""A rank index: deep pages of a fixed order without sorting all rows again.

Rows are dealt out by ranges of the order, sorted within each range and written with
their place there, a folder for each range; beside them stands a row for each range with
the number of rows before it.  A page reads the ranges that its ranks lie in, and no
other folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rounds import Rounds

_PLACE = (1 << 33) - 1


class RankIndex:
    """Pages of rows in an order that tells all rows apart."""

    def __init__(self, rows: DataFrame, order: list[Column], ranges: int | None = None):
        self.spark, self.columns = rows.sparkSession, rows.columns
        parts = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        place = F.monotonically_increasing_id()
        dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("lintel_at", place)
        dealt = dealt.withColumns({"lintel_place": F.col("lintel_at").bitwiseAND(F.lit(_PLACE)), "lintel_range": F.shiftright("lintel_at", 33).cast("int")}).drop("lintel_at")
        folder = Rounds(self.spark, "ranks").folder
        dealt.write.partitionBy("lintel_range").parquet(f"{folder}/rows")
        self.rows = self.spark.read.schema(dealt.schema).parquet(f"{folder}/rows")
        counts = self.rows.groupBy("lintel_range").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("lintel_range").rowsBetween(Window.unboundedPreceding, -1))
        # One row for each range.
        counts.withColumn("before", F.coalesce(before, F.lit(0))).write.parquet(f"{folder}/ranges")
        self.ranges = self.spark.read.parquet(f"{folder}/ranges")

    def page(self, offset: int, limit: int) -> DataFrame:
        """rank (from 0) and the rows [offset, offset + limit) in order."""
        offset, limit = max(0, offset), max(0, limit)
        held = self.ranges.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()  # ranges of one page
        if not held:
            return self.rows.limit(0).select(F.lit(0).cast("long").alias("rank"), *self.columns)
        before = F.lit(None).cast("long")
        for r in held:
            before = F.when(F.col("lintel_range") == r["lintel_range"], F.lit(r["before"])).otherwise(before)
        rank = (F.col("lintel_place") + before).alias("rank")
        found = self.rows.where(F.col("lintel_range").isin([r["lintel_range"] for r in held])).select(rank, *self.columns)
        return found.where((F.col("rank") >= offset) & (F.col("rank") < offset + limit)).orderBy("rank")

    def ranked(self) -> DataFrame:
        """rank (from 0) and all rows; a row for each range is sent to every task."""
        before = F.broadcast(self.ranges.select("lintel_range", "before"))
        return self.rows.join(before, "lintel_range").select((F.col("lintel_place") + F.col("before")).alias("rank"), *self.columns)

    def count(self) -> int:
        return self.ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

"""Project analysis that computes changed objects and their callers only.

Summaries lie below a folder by versions.  A run tells by contents which objects are
new, changed or gone, adds all that call these, directly or not (their returned values
may differ), and summarizes no others: the rest is read back.  A summary depends on its
object's text and on which parameters of the objects it calls are outputs, on nothing
behind these; ``by_outputs`` adds callers only where that set is another one.  What flows between
objects is then solved anew over all summaries, which are joins over small tables.
A version counts once its last table, that of contents, is whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rounds import Rounds
from . import graph, project, semantics
from .project import Coverage, Limits, Summaries


@dataclass
class Work:
    """What a run had to do."""

    objects: int
    changed: int
    summarized: int


class IncrementalProject:
    """Analyses of one project, each with the summaries of the one before."""

    def __init__(self, spark: SparkSession, folder: str, config: str = ""):
        """config: a key of whatever else results depend on; another one begins from nothing."""
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{config or 'all'}"

    def _last(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
        done = [int(p.getName()) for p in names if p.getName().isdigit() and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/contents/_SUCCESS"))]
        return max(done, default=0)

    def _read(self, version: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{version}/{name}")

    def analyze(self, objects: DataFrame, limits: Limits | None = None, by_outputs: bool = False) -> tuple[DataFrame, Coverage, Work]:
        """GX.SEC.3 as ``project.analyze``, and what was done for it."""
        limits, cover = limits or Limits(), Coverage()
        held, rows, work = self._stored(objects, limits, cover, by_outputs)
        return project.solve(held, rows, limits, cover, with_components=False), cover, work

    def places(self, objects: DataFrame, by_outputs: bool = False) -> DataFrame:
        """object_key, line_number, sink_class, cwe of the findings of ``analyze``, which are not told otherwise; a new version of the summaries as well."""
        held, rows, _ = self._stored(objects, Limits(), Coverage(), by_outputs)
        return project.places(held, rows)

    def update(self, objects: DataFrame, limits: Limits | None = None, by_outputs: bool = False) -> Work:
        """A new version of the summaries, without the findings."""
        return self._stored(objects, limits or Limits(), Coverage(), by_outputs)[2]

    def _stored(self, objects: DataFrame, limits: Limits, cover: Coverage, by_outputs: bool) -> tuple[Summaries, DataFrame, Work]:
        rounds = Rounds(self.spark, "changes")
        rows = rounds.keep(project.inputs(objects, limits, cover))
        contents = rows.select("object_key", F.sha2("text", 256).alias("content"))
        last = self._last()
        if not last:
            found = project.summarize(rows.select("object_key", "text"))
            n = rows.count()
            work = Work(n, n, n)
        else:
            found, work = self._merged(last, rows, contents, rounds, by_outputs)
        version = last + 1
        for name, table in found.tables().items():
            table.write.mode("overwrite").parquet(f"{self.folder}/{version}/{name}")
        contents.write.mode("overwrite").parquet(f"{self.folder}/{version}/contents")
        return Summaries(**{name: self._read(version, name) for name in found.tables()}), rows, work

    def _merged(self, last: int, rows: DataFrame, contents: DataFrame, rounds: Rounds, by_outputs: bool) -> tuple[Summaries, Work]:
        before = self._read(last, "contents").withColumnRenamed("content", "was")
        changed = contents.join(before, "object_key", "full").where("content is null or was is null or content <> was").select(F.col("object_key").alias("node"))
        changed = rounds.keep(changed)
        # Edges to objects that were not there count too: they may be now.
        calls = self._read(last, "calls").select(F.col("callee").alias("a"), F.col("object_key").alias("b")).distinct()
        if by_outputs:
            others = self._other_outputs(last, rows, changed.withColumnRenamed("node", "object_key"))
            redo = changed.select(F.col("node").alias("object_key")).union(calls.join(others.withColumnRenamed("object_key", "a"), "a", "left_semi").select(F.col("b").alias("object_key"))).distinct()
        else:
            redo = graph.reachable(calls, changed, rounds).select(F.col("node").alias("object_key"))
        redo = rounds.keep(redo)
        again = rounds.keep(rows.select("object_key", "text").join(redo, "object_key", "left_semi"))
        rest = {name: self._read(last, name).join(redo, "object_key", "left_anti") for name in Summaries.__dataclass_fields__}
        work = Work(rows.count(), changed.count(), again.count())
        if not work.summarized:
            return Summaries(**rest), work
        new = project.summarize(again, rest["parameters"]).tables()
        return Summaries(**{name: table.select(*new[name].columns).union(new[name]) for name, table in rest.items()}), work

    def _other_outputs(self, last: int, rows: DataFrame, changed: DataFrame) -> DataFrame:
        """object_key of the changed objects (object_key) whose output parameters are not at the places where they were."""
        texts = rows.select("object_key", "text").join(changed, "object_key", "left_semi")
        outs = lambda p: p.where("direction in ('Out', 'InOut')").select("object_key", "param_idx")
        now = outs(semantics.parameters(semantics.model(texts))).withColumn("n", F.lit(1))
        was = outs(self._read(last, "parameters").join(changed, "object_key", "left_semi")).withColumn("n", F.lit(-1))
        return now.union(was).groupBy("object_key", "param_idx").agg(F.sum("n").alias("n")).where("n <> 0").select("object_key").distinct()

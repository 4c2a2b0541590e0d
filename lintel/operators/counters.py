"""Counters of a run, observed on the plans that run anyway.

``Counters`` marks the relations of an audit; what they count comes with the job that
makes the findings, so nothing is read again for it.  Only where no finding comes of a
relation can the optimizer take its mark out of the plan; it is then counted by itself.
"""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.catalog import BY_ID, routes


#: Seconds to wait for the counts of a job that has ended.
PATIENCE = 5.0


def _observed(mark: Observation, df: DataFrame, what: tuple) -> dict:
    """What a mark counted; counts of a mark that was taken out of the plan never come."""
    until = time.time() + PATIENCE
    while time.time() < until:
        if mark._jo is not None and mark._jo.future().isCompleted():
            try:
                return mark.get
            except Py4JJavaError as e:  # a mark below a relation found to be empty
                if e.java_exception.getClass().getName() != "java.lang.AssertionError":
                    raise
                break
        time.sleep(0.05)
    return df.agg(*what).first().asDict()


class Counters:
    """Marks on objects, lines and findings; ``of()`` gives the counts once the marked plan has run."""

    def __init__(self, ids: list[str] | tuple[str, ...]):
        self.ids, self.began = list(ids), time.time()
        self.marks: dict[str, tuple[Observation, DataFrame, tuple]] = {}

    def _observe(self, name: str, df: DataFrame, *what) -> DataFrame:
        if name in self.marks:  # a plan has each mark once
            return df
        mark = Observation()
        self.marks[name] = mark, df, what
        return df.observe(mark, *what)

    def objects(self, df: DataFrame) -> DataFrame:
        size = F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("source_bytes")
        return self._observe("objects", df, F.count(F.lit(1)).alias("objects_extracted"), size)

    def lines(self, df: DataFrame, ids: list[str]) -> DataFrame:
        """Lines, and the pairs of a line and a rule that it is given to: all rules but those that ask for flags which the line lacks."""
        asks = routes(ids)
        pairs = F.lit(len([i for i in ids if i not in asks]))
        for flags in asks.values():
            pairs = pairs + F.expr(" OR ".join(flags)).cast("int")
        return self._observe("lines", df, F.count(F.lit(1)).alias("lines_evaluated"), F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("rule_evaluations"))

    def findings(self, df: DataFrame) -> DataFrame:
        """Findings, and when the first was made by the clock of its executor."""
        timed = df.withColumn("lintel_ms", F.expr("CAST(reflect('java.lang.System', 'currentTimeMillis') AS BIGINT)"))
        return self._observe("findings", timed, F.count(F.lit(1)).alias("findings_emitted"), F.min("lintel_ms").alias("first_ms")).drop("lintel_ms")

    def of(self, projects=(), scanned: int = 0) -> dict[str, int | None]:
        """All counters; scanned: how many objects there are, for plans on which they could not be marked."""
        out: dict[str, int | None] = {k: 0 for k in ("objects_extracted", "source_bytes", "lines_evaluated", "rule_evaluations", "findings_emitted")}
        for mark in self.marks.values():
            out |= _observed(*mark)
        out["objects_extracted"] = out["objects_extracted"] or scanned
        first = out.pop("first_ms", None)
        out["first_finding_millis"] = None if first is None else max(0, int(first - self.began * 1000))
        asked = [i for i in self.ids if BY_ID[i].scope in ("object", "project")]
        out |= {"rule_factory_invocations": len(self.ids), "rule_set_instantiations": 1, "fact_model_requests": out["objects_extracted"] if asked else 0}
        return out | {f"project_{k}": sum(getattr(p, a) for p in projects) for k, a in (("objects", "objects"), ("edges", "edges"), ("iterations", "rounds"))}

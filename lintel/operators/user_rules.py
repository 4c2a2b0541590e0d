"""Rules of the user, beside those of the catalogue.

A rule is registered with a descriptor and one of three ways to say it:

* ``line_rule``: a condition and a description as columns over the lines relation;
* ``relation_rule``: a function from lines to findings, for windows and joins;
* ``stateful_rule``: a class whose ``line`` is called for the lines of one object in
  order and whose ``finish`` is called after the last.  It runs as a polymorphic table
  function over ``TABLE(lines) PARTITION BY object_key ORDER BY line_no``, so Spark
  deals out and sorts the lines, and an object's lines stream through the class.

Registered rules are chosen, ordered and counted like those of the catalogue: their
findings have the same columns, with rule_ord after the catalogue's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..plans.catalog import BY_ID, RULES

SEVERITIES = ("ERROR", "WARNING", "INFO")
#: A finding of a stateful rule: the line it is told at, what it says, and that line's text.
FOUND = "object_key string, line_number int, description string, line_content string, emit_line int, at_end boolean"


@dataclass(frozen=True)
class UserRule:
    """What is known of a rule, and how its findings come from lines (object_key, line_no, raw, ...)."""

    id: str
    severity: str
    name: str
    find: Callable[[DataFrame], DataFrame]
    category: str = "user"


class Stateful:
    """Base of stateful rules.  line() and finish() give (line_number, description, line_content)."""

    def line(self, number: int, raw: str, clean: str) -> Iterator[tuple[int, str, str]]:
        raise NotImplementedError

    def finish(self) -> Iterator[tuple[int, str, str]]:
        return iter(())


class Registry:
    """Rules by id, in the order of their registration."""

    def __init__(self):
        self.rules: dict[str, UserRule] = {}

    def add(self, rule: UserRule) -> UserRule:
        if rule.id in BY_ID or rule.id in self.rules:
            raise ValueError(f"rule {rule.id} exists")
        if rule.severity not in SEVERITIES:
            raise ValueError(f"rule {rule.id}: severity {rule.severity} is none of {', '.join(SEVERITIES)}")
        self.rules[rule.id] = rule
        return rule

    def line_rule(self, id: str, severity: str, name: str, when: Column, description: Column) -> UserRule:
        def find(lines: DataFrame) -> DataFrame:
            return lines.where(when).select("object_key", F.col("line_no").cast("int").alias("line_number"), description.alias("description"), F.col("raw").alias("line_content"), F.col("line_no").cast("int").alias("emit_line"), F.lit(False).alias("at_end"))

        return self.add(UserRule(id, severity, name, find))

    def relation_rule(self, id: str, severity: str, name: str):
        """Registers a function from lines to findings (object_key, line_number, description, line_content)."""

        def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            self.add(UserRule(id, severity, name, lambda lines: f(lines).withColumns({"emit_line": F.col("line_number"), "at_end": F.lit(False)})))
            return f

        return register

    def stateful_rule(self, id: str, severity: str, name: str):
        """Registers a class derived from ``Stateful``; each object has an instance of its own."""

        def register(rule: type[Stateful]) -> type[Stateful]:
            self.add(UserRule(id, severity, name, lambda lines: _streamed(lines, rule, f"lintel_{id.lower().replace('.', '_')}")))
            return rule

        return register

    def findings(self, lines: DataFrame, ids: list[str] | None = None) -> DataFrame:
        """The findings of the chosen rules (all by default), in the catalogue's columns."""
        chosen = list(self.rules) if ids is None else ids
        unknown = [i for i in chosen if i not in self.rules]
        if unknown:
            raise ValueError(f"unknown rules: {', '.join(unknown)}")
        parts = [self._stamped(lines, self.rules[i]) for i in chosen]
        if not parts:
            raise ValueError("no rule is chosen")
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def _stamped(self, lines: DataFrame, rule: UserRule) -> DataFrame:
        found, place = rule.find(lines), len(RULES) + list(self.rules).index(rule.id)
        key = lines.schema["object_key"].dataType
        return found.select(
            F.col("object_key").cast(key).alias("object_key"), F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), "line_number", "description", "line_content",
            F.when(F.col("at_end"), 1).otherwise(0).alias("phase"), "emit_line", F.lit(place).alias("rule_ord"), F.lit(0).alias("sub_idx"),
        )


def _streamed(lines: DataFrame, rule: type[Stateful], name: str) -> DataFrame:
    class Runner:
        def __init__(self):
            self.rule, self.key, self.last = rule(), None, 0

        def eval(self, row):
            self.key, self.last = row["object_key"], row["line_no"]
            for line, description, content in self.rule.line(row["line_no"], row["raw"], row["clean"]) or ():
                yield self.key, line, description, content, row["line_no"], False

        def terminate(self):
            if self.key is not None:
                for line, description, content in self.rule.finish() or ():
                    yield self.key, line, description, content, self.last, True

    spark: SparkSession = lines.sparkSession
    spark.udtf.register(name, udtf(Runner, returnType=FOUND))
    rows = lines.select(F.col("object_key").cast("string").alias("object_key"), F.col("line_no").cast("int").alias("line_no"), "raw", "clean")
    return spark.sql(f"SELECT * FROM {name}(TABLE({{rows}}) PARTITION BY object_key ORDER BY line_no)", rows=rows)

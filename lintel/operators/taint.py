"""Flows of outside values inside objects, as joins.

An object is read in passes, four at most, from its first line to its last; an
assignment hands on what reaches it.  The time at which a value reaches a variable is
pass * 2^32 + line, and an edge (line, read, target) takes a time to the next time at
which that line is read.  Earliest times are a fixpoint of joins over changed states
only; they say which variables are reached, in which order, and which reads had been
reached when a variable was: of these the one with the shortest trace, then the
smallest name, is its parent.  Traces are built from parents in as many rounds as the
longest chain has steps.

States are (object_key, seed, name): all values that a seed stands for are followed
together, all seeds of all objects in the same joins.  Memory depends on no object's
size but for a line's calls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import let
from ..plans.catalog import BY_ID, MESSAGES, ORDER
from ..sources.rounds import Rounds
from . import semantics
from .calls import calls_in_lines, has_call, sink_class, weakness

PASSES, TRACE, FINDINGS, FLOW_PARAMS = 4, 8, 32, 32
#: Where outside values come from, and what hands them on unchanged.
SOURCES = ("getcookie", "getparameter", "getvariable", "getremoteaddress", "gethostname", "getenvironmentvariable")
CONTAINERS = ("&httprequest", "&websession", "&httpcontext")
NEUTRAL = ("trim", "tostring", "tolower", "toupper", "lower", "upper", "concat", "format", "str", "string", "strcat", "substring", "replace", "length", "len", "iif")

#: A pass in times, the time of what is reached from the start, and the first that is too late.
PASS = 1 << 32
START, LATE = PASS, (PASSES + 1) * PASS
STEP = "struct<kind: string, line: int, detail: string>"
STATE = ("object_key", "seed", "name")


def step(kind: str, line: Column, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), detail.alias("detail"))


@dataclass
class Model:
    """The relations of objects that flows are found in."""

    #: object_key, line_no, statement, variables (lower case), and tokens of lines with calls or parameters
    lines: DataFrame
    #: object_key, line_no, pos, receiver, method, variables, strings, inner
    calls: DataFrame
    #: object_key, param_idx, name, direction, line_no (of the declaration)
    parameters: DataFrame
    #: object_key of objects whose blocks are closed as they were opened
    complete: DataFrame
    #: object_key, line_no, target, reads, source (the outside function that it calls), unknown (the first call that nothing is known of)
    assignments: DataFrame
    rounds: Rounds


def build(objects: DataFrame) -> Model:
    """Everything is derived from one pass over the objects' lines, which is kept without their texts."""
    rounds = Rounds(objects.sparkSession, "flows")
    found = semantics.model(objects)
    asked = has_call(F.col("tokens")) | (F.col("statement") == "Parm")
    variables = F.transform(F.filter("tokens", lambda t: t["kind"] == "variable"), lambda t: F.lower(t["text"]))
    lines = rounds.keep(found.select("object_key", "line_no", "statement", variables.alias("variables"), F.when(asked, F.col("tokens")).alias("tokens")))
    calls = rounds.keep(calls_in_lines(lines.where("tokens is not null")))
    declared = lines.where("statement = 'Parm'").select("object_key", "line_no", F.explode("variables").alias("name")).groupBy("object_key", "name").agg(F.min("line_no").alias("line_no"))
    parameters = rounds.keep(semantics.parameters(lines).join(declared, ["object_key", "name"]).select("object_key", "param_idx", "name", "direction", "line_no"))
    complete = rounds.keep(semantics.complete(lines))
    return Model(lines, calls, parameters, complete, rounds.keep(_assignments(lines, calls)), rounds)


def _assignments(lines: DataFrame, calls: DataFrame) -> DataFrame:
    target = F.get("variables", F.lit(0))
    reads = F.array_distinct(F.filter(F.slice("variables", 2, F.greatest(F.size("variables"), F.lit(1))), lambda n: n != target))
    rows = lines.where("statement = 'Assignment'").select("object_key", "line_no", target.alias("target"), reads.alias("reads"))
    # Calls of other lines go before they are put in order.
    met = rows.join(calls.select("object_key", "line_no", F.struct("pos", "method", "inner").alias("call")), ["object_key", "line_no"], "left")
    ordered = met.groupBy("object_key", "line_no", "target", "reads").agg(F.array_sort(F.collect_list("call")).alias("c"))
    outer, inner = F.col("c.method"), F.flatten("c.inner")
    source = F.get(F.filter(outer, lambda m: m.isin(*SOURCES)), F.lit(0))
    unknown = F.get(F.filter(F.concat(outer, inner), lambda m: ~m.isin(*NEUTRAL)), F.lit(0))
    return ordered.select("object_key", "line_no", "target", "reads", source.alias("source"), unknown.alias("unknown"))


def next_time(time: Column, line: Column) -> Column:
    """When a line is read next after a time."""
    at = time % PASS
    return time - at + line + F.when(line > at, 0).otherwise(PASS)


def reach(model: Model, seeds: DataFrame, groups: DataFrame) -> DataFrame:
    """object_key, seed, name, time: all variables that are reached, at their earliest times.

    seeds: object_key, seed, name; groups: object_key, seed (functions that return outside
    values are sources in each group, even one without seeds).
    """
    hands_on = model.assignments.where("source is null").select("object_key", "line_no", "target", F.explode("reads").alias("name"))
    called = model.assignments.where("source is not null").join(groups, "object_key").select("object_key", "seed", F.col("target").alias("name"), (F.lit(START) + F.col("line_no")).alias("time"))
    starts = seeds.select(*STATE, F.lit(START).alias("time")).union(called.select(*STATE, "time"))
    reached = new = model.rounds.keep(starts.groupBy(*STATE).agg(F.min("time").alias("time")))
    while not new.isEmpty():
        came = new.join(hands_on, ["object_key", "name"]).select("object_key", "seed", F.col("target").alias("name"), next_time(F.col("time"), F.col("line_no")).alias("time"))
        came = came.where(F.col("time") < LATE).groupBy(*STATE).agg(F.min("time").alias("time"))
        known = reached.withColumnRenamed("time", "known")
        new = model.rounds.keep(came.join(known, list(STATE), "left").where("known is null or time < known").drop("known"))
        if not new.isEmpty():
            reached = model.rounds.keep(reached.join(new, list(STATE), "left_anti").select(*STATE, "time").union(new.select(*STATE, "time")))
    return reached


def traces(model: Model, reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """object_key, seed, name, time, trace: how each variable was reached; seeds: object_key, seed, name, trace of what is reached from the start."""
    there = model.rounds.keep(reached.withColumn("line_no", (F.col("time") % PASS).cast("int")).join(model.assignments.withColumnRenamed("target", "name"), ["object_key", "line_no", "name"], "left"))
    called = there.where("source is not null").select(*STATE, "time", F.array(step("source", F.col("line_no"), F.concat("source", F.lit("()")))).alias("trace"))
    began = there.where(F.col("line_no") == 0).join(seeds, list(STATE)).select(*STATE, "time", "trace")
    done = new = model.rounds.keep(began.union(called))
    waits = there.where("source is null and line_no > 0").select(*STATE, "time", "line_no", "unknown", F.explode("reads").alias("read"))
    before = reached.select("object_key", "seed", F.col("name").alias("read"), F.col("time").alias("earlier"))
    waits = model.rounds.keep(waits.join(before, ["object_key", "seed", "read"]).where("earlier < time").drop("earlier"))
    while not waits.isEmpty():
        parents = done.select("object_key", "seed", F.col("name").alias("read"), F.col("trace").alias("path"))
        known = waits.join(parents, ["object_key", "seed", "read"], "left").groupBy(*STATE, "time", "line_no", "unknown")
        known = known.agg(F.count("*").alias("all"), F.count("path").alias("n"), F.min_by(F.struct("path", "read"), F.struct(F.size("path"), "read")).alias("parent")).where("n = all")
        path = F.col("parent.path")
        strange = step("unsupported_call", F.col("line_no"), F.concat("unknown", F.lit("() sin semántica de sanitizador modelada")))
        path = F.when(F.col("unknown").isNotNull(), F.concat(path, F.array(strange))).otherwise(path)
        moved = step("propagate", F.col("line_no"), F.format_string("%s = ... %s ...", "name", "parent.read"))
        new = model.rounds.keep(known.select(*STATE, "time", F.when(F.size(path) < TRACE, F.concat(path, F.array(moved))).otherwise(path).alias("trace")))
        waits = model.rounds.keep(waits.join(new.select(*STATE), list(STATE), "left_anti").select(*STATE, "time", "line_no", "unknown", "read"))
        done = done.union(new)
    return done


def unknown_calls(model: Model, reached: DataFrame) -> DataFrame:
    """object_key, seed, line_no, method: calls that reached values pass and nothing is known of, each once."""
    passes = model.assignments.where("source is null and unknown is not null").select("object_key", "line_no", "unknown", F.explode("reads").alias("name"))
    met = reached.join(passes, ["object_key", "name"]).where(next_time(F.col("time"), F.col("line_no")) < LATE)
    return met.select("object_key", "seed", "line_no", F.col("unknown").alias("method")).distinct()


def sinks(model: Model, reached: DataFrame) -> DataFrame:
    """object_key, seed, line_no, pos, sink, source, i, method, receiver, k: the calls that reached values go into.

    Of a call the first reached argument counts, else its receiver; of a line and class the
    first call; of an object and seed the first ``FINDINGS``, numbered by k from 0.
    """
    risky = model.calls.withColumn("sink", sink_class()).where("sink is not null")
    into = risky.select("object_key", "line_no", "pos", "sink", "method", "receiver", F.posexplode(F.concat("variables", F.array("receiver"))).alias("i", "name")).where("name is not null")
    hit = into.join(reached.select(*STATE), ["object_key", "name"])
    first = F.row_number().over(Window.partitionBy("object_key", "seed", "line_no", "sink").orderBy("pos", "i"))
    place = F.row_number().over(Window.partitionBy("object_key", "seed").orderBy("line_no", "pos"))
    hit = hit.withColumn("first", first).where("first = 1").withColumn("k", place - 1).where(F.col("k") < FINDINGS)
    return hit.select("object_key", "seed", "line_no", "pos", "sink", F.col("name").alias("source"), "i", "method", "receiver", "k")


def told(found: DataFrame) -> DataFrame:
    """sinks with a trace: the trace to its end, cwe, confidence and description."""
    ends = step("sink", F.col("line_no"), F.concat(F.coalesce(F.concat("receiver", F.lit(".")), F.lit("")), F.col("method")))
    strange = F.exists("trace", lambda s: s["kind"] == "unsupported_call")
    whole = F.when(F.size("trace") < TRACE, F.concat("trace", F.array(ends))).otherwise(F.col("trace"))
    rows = found.withColumns({"strange": strange, "trace": whole, "cwe": weakness(F.col("sink"))})
    confidence = F.when(F.col("strange"), "low").when(F.size("trace") <= 2, "high").otherwise("medium")
    said = F.format_string(MESSAGES["GX.SEC.2"], F.replace("sink", F.lit("_"), F.lit(" ")), F.col("cwe"), F.col("source"), F.col("method"))
    return rows.withColumns({"confidence": confidence, "description": said}).drop("strange")


def entries(model: Model) -> DataFrame:
    """object_key, name, trace: outside values at the start of complete objects, their input parameters and request containers."""
    params = model.parameters.where("direction in ('In', 'InOut')").select("object_key", "name", "line_no", F.lit(0).alias("late"), F.concat(F.lit("parm entrada "), "name").alias("detail"))
    used = model.lines.select("object_key", "line_no", F.explode(F.filter("variables", lambda v: v.rlike("^(" + "|".join(CONTAINERS) + ")"))).alias("name"))
    used = used.select("object_key", "name", "line_no", F.lit(1).alias("late"), F.lit("request/contenedor externo").alias("detail"))
    first = params.union(used).groupBy("object_key", "name").agg(F.min(F.struct("late", "line_no", "detail")).alias("s"))
    rows = first.join(model.complete, "object_key", "left_semi")
    return rows.select("object_key", "name", F.array(step("source", F.col("s.line_no"), F.col("s.detail"))).alias("trace"))


@dataclass
class Flows:
    """The flows of outside values inside objects."""

    model: Model
    seeds: DataFrame
    reached: DataFrame

    def unknown(self) -> DataFrame:
        return unknown_calls(self.model, self.reached).drop("seed")

    def findings(self) -> DataFrame:
        """object_key, line_no, k, sink, cwe, confidence, description, trace, unsupported."""
        m = self.model
        paths = m.rounds.keep(traces(m, self.reached, self.seeds))
        found = sinks(m, self.reached).join(paths.select(*STATE[:2], F.col("name").alias("source"), "trace"), ["object_key", "seed", "source"])
        counted = self.unknown().groupBy("object_key").agg(F.count("*").cast("int").alias("unsupported"))
        return told(found).join(counted, "object_key", "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(0)))


def flows(objects: DataFrame) -> Flows:
    model = build(objects)
    seeds = model.rounds.keep(entries(model).withColumn("seed", F.lit("")))
    return Flows(model, seeds, reach(model, seeds, model.complete.withColumn("seed", F.lit(""))))


def local_taint(objects: DataFrame) -> DataFrame:
    """GX.SEC.2: outside values that reach a sink within an object, each with its trace."""
    rule = BY_ID["GX.SEC.2"]
    found = flows(objects).findings()
    found = with_content(found, objects)
    line, k = F.col("line_no").cast("int"), F.col("k").cast("int")
    return found.select(
        "object_key", F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), line.alias("line_number"), "description", "line_content", F.lit(4).alias("phase"), line.alias("emit_line"),
        F.lit(ORDER[rule.id]).alias("rule_ord"), k.alias("sub_idx"), "cwe", "confidence", F.col("sink").alias("sink_class"), "trace", "unsupported",
    )


def with_content(found: DataFrame, objects: DataFrame) -> DataFrame:
    """found (object_key, line_no, ...) with line_content, the line as it stands in its object's text; a text is moved once."""
    asked = found.groupBy("object_key").agg(F.collect_set("line_no").alias("asked"))
    cut = let(F.split("text", "\n", -1), lambda parts: F.transform("asked", lambda n: F.struct(n.alias("line_no"), F.regexp_replace(F.get(parts, n - 1), r"\r+\z", "").alias("line_content"))))
    lines = objects.select("object_key", "text").join(asked, "object_key").select("object_key", F.inline(cut))
    return found.join(lines, ["object_key", "line_no"])

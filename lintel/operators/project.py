"""Flows of outside values across objects, and the call graph, as joins.

What a value does inside an object doesn't depend on who calls it: each input
parameter, and each variable that a call can return a value to, is a seed, and one
job follows all seeds of all objects (``taint.reach``).  An object reacts to a set of
seeds as to each of them alone, so between objects there is a graph: seed s of object A
leads to parameter i of B if it reaches the i-th variable of a call of B in A, and to
A's j-th variable of that call if parameter i of B reaches B's output parameter j.
Seeds are met round by round, all objects at once: what one finds, others see in the
next round.  Parameters of objects that no other calls come from outside.

A finding is told as the first round has it, then the first object in the given order,
its own sinks before its calls.  Objects, lines and classes don't depend on that choice.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import let, literal_value, trim
from ..plans.catalog import BY_ID, ORDER
from ..sources.rounds import Rounds
from . import graph, semantics, taint
from .calls import weakness
from .taint import FLOW_PARAMS, TRACE, step

#: No depth: outside of calls.
NONE = -(2**31)


@dataclass
class Limits:
    """Bounds of a project; none by default. What is cut off is told, and makes the coverage partial.

    bytes: of the texts of the first ``objects`` objects, which must be given with it.
    """

    objects: int | None = None
    bytes: int | None = None
    edges: int | None = None
    findings: int | None = None


@dataclass
class Coverage:
    objects: int = 0
    edges: int = 0
    sccs: int = 0
    rounds: int = 0
    truncated: bool = False
    reasons: list[str] = field(default_factory=list)

    def cut(self, reason: str) -> None:
        self.truncated = True
        self.reasons.append(reason)


#: The closed literal of a line whose first tokens are a calling word, a parenthesis and that literal.
DIRECT = r"""(?is)^[\s\p{Z}]*+(?:call|udp)[\s\p{Z}]*+\([\s\p{Z}]*+'((?:[^']|'')*+)'"""


def called_name(tokens: str | Column = "tokens") -> Column:
    """The object that a line calls: its first literal."""
    named = F.get(F.filter(tokens, lambda t: t["kind"] == "string"), F.lit(0))["text"]
    return F.lower(trim(literal_value(named)))


def calls_object(tokens: Column) -> Column:
    """Whether a line calls an object by a call that lies in no other: one fold over its tokens, which holds the depth and that of the call it is in."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.struct(a["kind"].alias("kind"), F.lower(a["text"]).alias("text"), F.coalesce((b["kind"] == "punct") & (b["text"] == "("), F.lit(False)).alias("opens")))

    def fold(s: Column, t: Column) -> Column:
        mark = t["kind"] == "punct"
        depth = s["depth"] + F.when(mark & (t["text"] == "("), 1).when(mark & (t["text"] == ")"), -1).otherwise(0)
        begins = (s["outer"] == NONE) & (t["kind"] == "ident") & t["opens"]
        ends = mark & (t["text"] == ")") & (depth == s["outer"])
        outer = F.when(begins, s["depth"]).when(ends, NONE).otherwise(s["outer"])
        return F.struct(depth.alias("depth"), outer.alias("outer"), (s["found"] | (begins & t["text"].isin("call", "udp"))).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("depth"), F.lit(NONE).alias("outer"), F.lit(False).alias("found")), fold, lambda s: s["found"])


def call_edges(objects: DataFrame) -> DataFrame:
    """caller, callee, line_no: lines that call an object. Lines without a calling word are left out, and those that begin with the call are told by their first tokens; only others are read as tokens."""
    lines = objects.select(F.lower("object_key").alias("caller"), F.posexplode(F.split("text", "\n", -1)).alias("at", "l")).where(F.col("l").rlike("(?i)call|udp"))
    direct = F.lower(trim(F.replace(F.regexp_extract("l", DIRECT, 1), F.lit("''"), F.lit("'"))))
    rows = lines.select("caller", (F.col("at") + 1).alias("line_no"), "l", direct.alias("direct"))
    other = let(semantics.line_tokens(F.col("l")), lambda ts: F.when(calls_object(ts), called_name(ts)))
    # A condition on what is computed would compute it once more; on a generator's rows it does not.
    callee = F.when(F.col("direct") != "", F.array("direct")).otherwise(F.filter(F.array(other), lambda c: c != ""))
    return rows.select("caller", F.explode(callee).alias("callee"), "line_no")


def dependencies(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """caller, callee: distinct edges to objects that are there. Edges are computed once; where they lead to few objects, they are not moved to these."""
    rounds = Rounds(edges.sparkSession, "dependencies")
    pairs = rounds.keep(edges.select("caller", "callee").distinct())
    called = rounds.keep(pairs.select("callee").distinct())
    there = rounds.keep(objects.select(F.lower("object_key").alias("callee")).join(called, "callee", "left_semi").distinct())
    return pairs.join(there, "callee", "left_semi").select("caller", "callee")


def in_degree(deps: DataFrame) -> DataFrame:
    return deps.groupBy("callee").agg(F.count("*").alias("callers"))


def frontier(deps: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that no other calls: their input parameters come from outside."""
    return objects.select(F.lower("object_key").alias("object_key")).distinct().join(deps.select(F.col("callee").alias("object_key")), "object_key", "left_anti")


def dependents(deps: DataFrame, changed: list[str]) -> DataFrame:
    """object_key: the changed objects and all that call them, directly or not."""
    starts = deps.sparkSession.createDataFrame([(c.lower(),) for c in sorted(set(changed))], "node string")
    found = graph.reachable(deps.select(F.col("callee").alias("a"), F.col("caller").alias("b")), starts)
    return found.select(F.col("node").alias("object_key"))


def components(deps: DataFrame, objects: DataFrame) -> DataFrame:
    """object_key, component: objects that call each other, directly or not, share one."""
    found = graph.strong_components(objects.select(F.lower("object_key").alias("node")), deps.select(F.col("caller").alias("a"), F.col("callee").alias("b")))
    return found.select(F.col("node").alias("object_key"), "component")


def inputs(objects: DataFrame, limits: Limits, cover: Coverage) -> DataFrame:
    """object_key (lower case), ord, text of the objects within the limits: of one name the last in order."""
    rows = objects.select(F.lower(F.col("object_key").cast("string")).alias("object_key"), F.col("ord").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    if limits.bytes is not None and limits.objects is None:
        raise ValueError("a limit of bytes needs one of objects")
    if limits.objects is not None:
        count = rows.count()
        if count > limits.objects:
            cover.cut(f"proyecto truncado: {count} objetos > máximo {limits.objects}")
        rows = rows.orderBy("ord").limit(limits.objects)
    if limits.bytes is not None:
        total = F.sum(F.octet_length("text")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("total", total)
        most = rows.agg(F.max("total")).first()[0] or 0
        if most > limits.bytes:
            cover.cut(f"proyecto truncado: {most} bytes > máximo {limits.bytes}")
        rows = rows.where(F.col("total") <= limits.bytes).drop("total")
    return rows.groupBy("object_key").agg(F.max_by(F.struct("ord", "text"), "ord").alias("o")).select("object_key", "o.ord", "o.text")


def object_calls(model: taint.Model) -> DataFrame:
    """object_key, line_no, pos, callee, args: calls of other objects."""
    named = model.lines.where("tokens is not null").select("object_key", "line_no", called_name().alias("callee")).where("callee <> ''")
    rows = model.calls.where(F.col("method").isin("call", "udp")).join(named, ["object_key", "line_no"])
    return rows.select("object_key", "line_no", "pos", "callee", F.col("variables").alias("args"))


@dataclass
class Summaries:
    """What is known of objects by themselves; each table has an object_key, so those of other objects can be put beside them."""

    #: object_key, line_no, pos, callee, args: calls of objects, there or not
    calls: DataFrame
    #: object_key, param_idx, name, direction, line_no
    parameters: DataFrame
    #: object_key, seed, name, trace: what each seed reaches, and how
    paths: DataFrame
    #: object_key, seed, line_no, pos, sink, source, i, method, receiver, k: the sinks that each seed reaches
    sinks: DataFrame
    #: object_key, param_idx, seed, line_no, sink, k: sinks that an input parameter reaches
    param_sinks: DataFrame
    #: object_key, from_param, to_param: output parameters that an input parameter reaches
    param_outs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


#: The step that holds the place of a seed's own trace.
PLACE = ("seed", 0, "")


@dataclass
class Reached:
    """What the seeds of objects reach inside them."""

    model: taint.Model
    calls: DataFrame
    seeds: DataFrame
    reached: DataFrame
    #: object_key, param_idx, seed: input parameters of complete objects
    takes: DataFrame
    param_outs: DataFrame


def followed(objects: DataFrame, known: DataFrame | None = None) -> Reached:
    """Each seed of objects (object_key, text) followed inside its object, without traces and sinks."""
    model = taint.build(objects)
    keep = model.rounds.keep
    calls = keep(object_calls(model))
    gives = model.parameters.where("direction in ('Out', 'InOut')")
    others = gives if known is None else gives.select("object_key", "param_idx").union(known.where("direction in ('Out', 'InOut')").select("object_key", "param_idx"))
    returned = calls.join(others.select(F.col("object_key").alias("callee"), "param_idx"), "callee")
    returned = returned.select("object_key", F.get("args", F.col("param_idx")).alias("seed")).where("seed is not null")
    none = objects.select("object_key", F.lit("").alias("seed"))
    groups = keep(none.union(model.parameters.select("object_key", F.col("name").alias("seed"))).union(returned).distinct())
    seeds = groups.where("seed <> ''").select("object_key", "seed", F.col("seed").alias("name"))
    reached = taint.reach(model, seeds, groups)
    takes = model.parameters.where(F.col("direction").isin("In", "InOut") & (F.col("param_idx") < FLOW_PARAMS)).join(model.complete, "object_key", "left_semi")
    takes = keep(takes.select("object_key", "param_idx", F.col("name").alias("seed")))
    outs = takes.join(reached.select("object_key", "seed", "name"), ["object_key", "seed"]).join(gives.select("object_key", F.col("param_idx").alias("to_param"), "name"), ["object_key", "name"])
    return Reached(model, calls, seeds, reached, takes, keep(outs.select("object_key", F.col("param_idx").alias("from_param"), "to_param")))


def summarize(objects: DataFrame, known: DataFrame | None = None) -> Summaries:
    """Summaries of objects (object_key, text), each seed followed inside its object.

    known: parameters of further objects that these may call.
    """
    f = followed(objects, known)
    keep = f.model.rounds.keep
    sinks = keep(taint.sinks(f.model, f.reached))
    place = F.array(step(PLACE[0], F.lit(PLACE[1]), F.lit(PLACE[2])))
    paths = taint.traces(f.model, f.reached, f.seeds.withColumn("trace", place)).select("object_key", "seed", "name", "trace")
    into = keep(sinks.join(f.takes, ["object_key", "seed"]).select("object_key", "param_idx", "seed", "line_no", "sink", "k"))
    return Summaries(f.calls, f.model.parameters, keep(paths), sinks, into, f.param_outs)


def seed_edges(p: Summaries) -> DataFrame:
    """object_key, seed, to_object, to_seed, line_no, pos, i, j, arg: where a seed leads between objects; j is null for the way into the callee."""
    passed = p.calls.select("object_key", "line_no", "pos", "callee", "args", F.posexplode("args").alias("i", "arg"))
    met = passed.join(p.paths.select("object_key", "seed", F.col("name").alias("arg")), ["object_key", "arg"])
    params = p.parameters.select(F.col("object_key").alias("callee"), F.col("param_idx").alias("i"), F.col("name").alias("into"), F.lit(None).cast("int").alias("j"))
    outs = p.param_outs.select(F.col("object_key").alias("callee"), F.col("from_param").alias("i"), F.lit(None).cast("string").alias("into"), F.col("to_param").alias("j"))
    ways = met.join(params.union(outs), ["callee", "i"]).withColumn("to_seed", F.when(F.col("j").isNull(), F.col("into")).otherwise(F.get("args", F.col("j")))).where("to_seed is not null")
    return ways.select("object_key", "seed", F.when(F.col("j").isNull(), F.col("callee")).otherwise(F.col("object_key")).alias("to_object"), "to_seed", "line_no", "pos", "i", "j", "arg", "callee")


def _longer(path: Column, *steps: Column) -> Column:
    """A trace with further steps, as far as it may grow."""
    for s in steps:
        path = F.when(F.size(path) < TRACE, F.concat(path, F.array(s))).otherwise(path)
    return path


def _whole(base: Column, trace: Column) -> Column:
    """The trace of a variable behind that of its seed, whose place its first step holds (none: the way begins in the object itself)."""
    rest = F.when(F.get(trace, F.lit(0))["kind"] == PLACE[0], F.concat(base, F.slice(trace, 2, TRACE))).otherwise(trace)
    return F.slice(rest, 1, TRACE)


def active_seeds(p: Summaries, starts: DataFrame, rounds: Rounds) -> tuple[DataFrame, int]:
    """object_key, seed, level, base: seeds that outside values come to, in which round and by which trace; and the number of rounds.

    starts: object_key, seed, base of the first round.
    """
    keep = rounds.keep
    edges = keep(seed_edges(p))
    steps = p.paths.select("object_key", "seed", F.col("name").alias("arg"), "trace")
    seen = new = keep(starts.select("object_key", "seed", F.lit(1).alias("level"), "base"))
    level = 1
    while not new.isEmpty():
        level += 1
        ways = new.drop("level").join(edges, ["object_key", "seed"]).join(seen.select(F.col("object_key").alias("to_object"), F.col("seed").alias("to_seed")), ["to_object", "to_seed"], "left_anti")
        ways = ways.join(steps, ["object_key", "seed", "arg"])
        entered = F.array(step("source", F.lit(1), F.format_string("parm entrada %s (llamador)", "to_seed")))
        call = step("call", F.col("line_no"), F.format_string("call('%s')", "callee"))
        back = step("propagate", F.col("line_no"), F.format_string("%s ← out de '%s'", "to_seed", "callee"))
        base = F.when(F.col("j").isNull(), entered).otherwise(_longer(_whole(F.col("base"), F.col("trace")), call, back))
        # A returned value has a way that tells more than that the parameter was passed, so it goes first.
        first = F.struct(F.col("j").isNull(), "line_no", "pos", "i", "j", "object_key", "seed")
        new = keep(ways.groupBy("to_object", "to_seed").agg(F.min_by(base, first).alias("base")).select(F.col("to_object").alias("object_key"), F.col("to_seed").alias("seed"), F.lit(level).alias("level"), "base"))
        seen = seen.union(new)
    return seen, level - 1


def analyze(objects: DataFrame, limits: Limits | None = None, with_components: bool = True) -> tuple[DataFrame, Coverage]:
    """GX.SEC.3: findings of objects (object_key, ord, text), and what was covered; with_components: count the strongly connected ones too."""
    limits, cover = limits or Limits(), Coverage()
    rows = Rounds(objects.sparkSession, "project").keep(inputs(objects, limits, cover))
    return solve(summarize(rows.select("object_key", "text")), rows, limits, cover, with_components), cover


def solve(p: Summaries, rows: DataFrame, limits: Limits, cover: Coverage, with_components: bool = True) -> DataFrame:
    """The findings of objects (object_key, ord, text) with these summaries; cover gets what was covered."""
    rounds = Rounds(rows.sparkSession, "solve")
    cover.objects = rows.count()
    p = replace(p, calls=rounds.keep(p.calls.join(rows.select(F.col("object_key").alias("callee")), "callee", "left_semi")))
    deps = p.calls.select(F.col("object_key").alias("caller"), "callee").distinct()
    if limits.edges is not None:
        count = deps.count()
        if count > limits.edges:
            cover.cut(f"proyecto truncado: aristas > máximo {limits.edges}")
            deps = rows.select(F.col("object_key").alias("caller"), "ord").join(deps, "caller").orderBy("ord", "callee").limit(limits.edges).select("caller", "callee")
    deps = rounds.keep(deps)
    cover.edges = deps.count()
    if with_components:
        cover.sccs = components(deps, rows).select("component").distinct().count()
    outer = _outer(p, deps, rows)
    outer = outer.select("object_key", "seed", F.array(step("source", F.lit(1), F.format_string("parm entrada %s (frontera del proyecto)", "seed"))).alias("base"))
    every = rows.select("object_key", F.lit("").alias("seed"), F.array().cast(f"array<{taint.STEP}>").alias("base"))
    active, cover.rounds = active_seeds(p, outer.union(every), rounds)
    active = rounds.keep(active.join(rows.select("object_key", "ord"), "object_key"))
    found = rounds.keep(_first(_inside(p, active).unionByName(_through(p, active))))
    if limits.findings is not None and found.count() > limits.findings:
        cover.cut(f"hallazgos > máximo {limits.findings}")
        found = found.orderBy("object_key", "line_no", "cwe").limit(limits.findings)
    return _issues(found, rows)


def _outer(p: Summaries, deps: DataFrame, rows: DataFrame) -> DataFrame:
    """object_key, seed: input parameters of objects that no other calls."""
    return p.parameters.where("direction in ('In', 'InOut')").select("object_key", F.col("name").alias("seed")).distinct().join(frontier(deps, rows), "object_key", "left_semi")


def places(p: Summaries, rows: DataFrame) -> DataFrame:
    """object_key, line_number, sink_class, cwe: where ``solve`` finds what, without limits and without the ways there.

    A sink that an argument reaches in a called object is one of that object's own, by the
    seed of the parameter that the call leads to; so seeds and their own sinks are all.
    """
    rounds = Rounds(rows.sparkSession, "places")
    p = replace(p, calls=p.calls.join(rows.select(F.col("object_key").alias("callee")), "callee", "left_semi"))
    # Seeds are names of variables or empty, so no two are told by one text.
    node = lambda key, seed: F.concat(seed, F.lit(" "), key)
    ways = seed_edges(p).select(node("object_key", "seed").alias("a"), node("to_object", "to_seed").alias("b")).where("a <> b").distinct()
    starts = _outer(p, p.calls.select("callee"), rows).union(rows.select("object_key", F.lit("").alias("seed")))
    active = graph.reachable(ways, starts.select(node("object_key", "seed").alias("node")), rounds)
    found = p.sinks.select("object_key", "line_no", "sink", node("object_key", "seed").alias("node")).join(active, "node", "left_semi").select("object_key", "line_no", "sink").distinct()
    return found.select("object_key", F.col("line_no").cast("int").alias("line_number"), F.col("sink").alias("sink_class"), weakness(F.col("sink")).alias("cwe"))


def _inside(p: Summaries, active: DataFrame) -> DataFrame:
    """Sinks in the objects themselves that active seeds reach."""
    found = p.sinks.join(active, ["object_key", "seed"])
    found = found.join(p.paths.select("object_key", "seed", F.col("name").alias("source"), "trace"), ["object_key", "seed", "source"])
    found = taint.told(found.withColumn("trace", _whole(F.col("base"), F.col("trace"))))
    nothing = F.lit(0)
    key = F.struct("level", "ord", nothing.alias("kind"), "line_no", "pos", "i", nothing.alias("k"), "source", "seed")
    return found.select("object_key", "line_no", "sink", "cwe", "confidence", "description", "trace", key.alias("key"))


def _through(p: Summaries, active: DataFrame) -> DataFrame:
    """Sinks in called objects that arguments reach by the callee's summary, told from the caller."""
    passed = p.calls.select("object_key", F.col("line_no").alias("at"), "pos", "callee", F.posexplode("args").alias("i", "arg"))
    found = passed.join(p.paths.select("object_key", "seed", F.col("name").alias("arg"), "trace"), ["object_key", "arg"]).join(active, ["object_key", "seed"])
    into = p.param_sinks.select(F.col("object_key").alias("callee"), F.col("param_idx").alias("i"), "line_no", "sink", "k")
    found = found.join(into, ["callee", "i"]).withColumn("cwe", weakness(F.col("sink")))
    call = step("call", F.col("at"), F.format_string("call('%s')", "callee"))
    trace = _longer(_whole(F.col("base"), F.col("trace")), call, step("sink", F.col("line_no"), F.concat("sink", F.lit("()"))))
    said = F.format_string("Posible %s (CWE-%d): '%s' llega al parámetro %d de '%s' desde '%s'.", F.replace("sink", F.lit("_"), F.lit(" ")), "cwe", "arg", "i", "callee", "object_key")
    key = F.struct("level", "ord", F.lit(1).alias("kind"), F.col("at").alias("line_no"), "pos", "i", F.col("k").cast("int").alias("k"), F.col("arg").alias("source"), "seed")
    return found.select(F.col("callee").alias("object_key"), "line_no", "sink", "cwe", F.lit("medium").alias("confidence"), said.alias("description"), trace.alias("trace"), key.alias("key"))


def _first(found: DataFrame) -> DataFrame:
    """Of each object, line and class what was found first."""
    return found.groupBy("object_key", "line_no", "sink").agg(F.min_by(F.struct("cwe", "confidence", "description", "trace"), "key").alias("f")).select("object_key", "line_no", "sink", "f.*")


def _issues(found: DataFrame, objects: DataFrame) -> DataFrame:
    rule = BY_ID["GX.SEC.3"]
    rows = taint.with_content(found, objects).withColumn("sub_idx", F.row_number().over(Window.partitionBy("object_key").orderBy("line_no", "cwe")) - 1)
    line = F.col("line_no").cast("int")
    return rows.select(
        "object_key", F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), line.alias("line_number"), "description", "line_content", F.lit(5).alias("phase"), line.alias("emit_line"),
        F.lit(ORDER[rule.id]).alias("rule_ord"), F.col("sub_idx").cast("int").alias("sub_idx"), "cwe", "confidence", F.col("sink").alias("sink_class"), "trace", F.lit(0).alias("unsupported"),
    )

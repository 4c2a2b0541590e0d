"""Calls within lines, by the depth of parentheses.

A call is an identifier before an opening parenthesis, and reaches to the first token
at which the depth is again what it was before the call, or to the line's end.  Of
tokens of one depth that is the next one, so a window by depth finds it.  A call that
lies inside an earlier one is no call of its own: the outer one has its name among its
inner calls, and its variables and literals among its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import literal_value

#: What tells a sink.
SQL_NAMES = ("sql", "query", "consulta", "sentencia", "select")
SQL_WORDS = ("select ", "insert ", "update ", "delete ", "where ")
SQL_METHODS = ("execute", "executedirect", "executequery", "executescalar", "load")
COMMAND_NAMES = ("cmd", "command", "comando", "shell", "os", "exec")
COMMAND_METHODS = ("execute", "shell", "run", "system", "cmd", "exec")
OUTPUT_NAMES = ("httpresponse", "webresponse", "response", "html")
PATH_NAMES = ("file", "archivo", "path", "ruta", "directory", "carpeta", "folder")
PATH_METHODS = ("open", "create", "delete", "rename", "readline", "writeline", "read", "write", "copy", "move")
#: Classes of sinks and their numbers in the list of weaknesses.
CLASSES = {"sql_injection": 89, "command_injection": 78, "unencoded_output": 79, "path_traversal": 22}


def has_call(tokens: Column) -> Column:
    """Whether a line's tokens (kind, text) have an identifier before an opening parenthesis."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.coalesce((a["kind"] == "ident") & (b["kind"] == "punct") & (b["text"] == "("), F.lit(False)))
    return F.exists(pairs, lambda x: x)


def _texts(pairs: Column) -> Column:
    """Texts of collected (pos, text), in order."""
    return F.transform(F.array_sort(F.collect_list(pairs)), lambda x: x["text"])


def calls_in_lines(lines: DataFrame) -> DataFrame:
    """object_key, line_no, pos, receiver, method, variables, strings, inner: the calls of lines (object_key, line_no, tokens).

    A line with one opening parenthesis has one call, which is read from its tokens as they are.
    """
    opens = F.size(F.filter("tokens", lambda t: t["text"] == "("))
    return _single(lines.where(opens == 1)).union(_nested(lines.where(opens > 1)))


def _single(lines: DataFrame) -> DataFrame:
    """The call of each line with one opening parenthesis, if an identifier stands before that."""

    rows = lines.select("object_key", "line_no", "tokens", F.transform("tokens", lambda t: t["text"]).alias("texts"))
    rows = rows.withColumn("open", F.array_position("texts", "(").cast("int"))
    name, of = F.get("tokens", F.col("open") - 2), F.get("tokens", F.col("open") - 4)
    end = F.array_position(F.slice("texts", F.col("open") + 1, F.size("texts")), ")").cast("int")
    inside = F.slice("tokens", F.col("open") + 1, F.when(end > 0, end - 1).otherwise(F.size("texts")))
    rows = rows.select("object_key", "line_no", "tokens", "texts", "open", name.alias("name"), of.alias("of"), F.filter(inside, lambda t: t["kind"].isin("variable", "string")).alias("inside"))
    receiver = F.when((F.get("texts", F.col("open") - 3) == ".") & F.col("of.kind").isin("variable", "ident"), F.lower("of.text"))
    return rows.where("name.kind = 'ident'").select(
        "object_key", "line_no", (F.col("open") - 2).alias("pos"), receiver.alias("receiver"), F.lower("name.text").alias("method"),
        F.transform(F.filter("inside", lambda t: t["kind"] == "variable"), lambda t: F.lower(t["text"])).alias("variables"),
        F.transform(F.filter("inside", lambda t: t["kind"] == "string"), lambda t: F.lower(literal_value(t["text"]))).alias("strings"), F.array().cast("array<string>").alias("inner"),
    )


def _nested(lines: DataFrame) -> DataFrame:
    """The calls of lines in which calls may lie in others."""
    flat = lines.where(has_call(F.col("tokens"))).select("object_key", "line_no", F.posexplode("tokens").alias("pos", "t")).select("object_key", "line_no", "pos", "t.kind", "t.text")
    line = Window.partitionBy("object_key", "line_no").orderBy("pos")
    upto, earlier = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = ((F.col("kind") == "punct") & (F.col("text") == p) for p in ("(", ")"))
    flat = flat.withColumns(
        {
            "depth": F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto),
            "named": (F.col("kind") == "ident") & F.coalesce(F.lead(opens).over(line), F.lit(False)),
            "of": F.when((F.lag("text", 1).over(line) == ".") & F.lag("kind", 2).over(line).isin("variable", "ident"), F.lower(F.lag("text", 2).over(line))),
        }
    )
    level = Window.partitionBy("object_key", "line_no", "depth").orderBy("pos")
    flat = flat.withColumn("end", F.when(F.col("named"), F.coalesce(F.lead("pos").over(level), F.lit(2**31 - 1))))
    flat = flat.withColumn("outer", F.col("named") & (F.coalesce(F.max("end").over(earlier), F.lit(-1)) < F.col("pos")))
    flat = flat.withColumn("own", F.last(F.when(F.col("outer"), F.struct("pos", "end")), ignorenulls=True).over(upto))
    first = F.col("pos") == F.col("own.pos")
    inside = (F.col("pos") > F.col("own.pos") + 1) & (F.col("pos") < F.col("own.end"))
    said = F.struct("pos", F.lower("text").alias("text"))
    value = F.struct("pos", F.lower(literal_value(F.col("text"))).alias("text"))
    return (
        flat.where(first | inside)
        .groupBy("object_key", "line_no", F.col("own.pos").alias("pos"))
        .agg(
            F.max(F.when(first, F.col("of"))).alias("receiver"), F.max(F.when(first, F.lower("text"))).alias("method"),
            _texts(F.when(inside & (F.col("kind") == "variable"), said)).alias("variables"), _texts(F.when(inside & (F.col("kind") == "string"), value)).alias("strings"),
            _texts(F.when(inside & F.col("named"), said)).alias("inner"),
        )
    )


def sink_class() -> Column:
    """The class of sink that a call is (or null), by method, names around it and literals."""
    names = F.array_compact(F.concat(F.array("receiver"), F.col("variables")))

    def hinted(hints: tuple[str, ...]) -> Column:
        return F.exists(names, lambda n: n.rlike("|".join(hints)))

    worded = F.exists("strings", lambda s: s.rlike("|".join(SQL_WORDS)))
    return (
        F.when(F.col("method").isin(*SQL_METHODS) & (hinted(SQL_NAMES) | worded), "sql_injection")
        .when(F.col("method").isin(*COMMAND_METHODS) & hinted(COMMAND_NAMES), "command_injection")
        .when((F.col("method") == "write") & hinted(OUTPUT_NAMES), "unencoded_output")
        .when(F.col("method").isin(*PATH_METHODS) & hinted(PATH_NAMES), "path_traversal")
    )


def weakness(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, number in CLASSES.items():
        out = F.when(kind == name, number).otherwise(out)
    return out

"""The semantic model of objects as relations: tokens, statements, accesses, parameters, coverage.

It reads the unmasked text and knows no generated part.  One row per line with a
token holds the line's tokens as an array; the flat relations are projections of
it, and what needs the order of lines is windows by object, so the model is dealt
out by object once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import KEPT_LITERAL_OR_COMMENT, TOKEN, has, let, literal_value, redacted, trim
from .language import BLOCKS, CONDITIONS, KEYWORDS
from .rules import by, depth, finding, text, within


def kind(token: Column) -> Column:
    """By the first character; its range is told by comparing the token, which takes no part of it."""

    def begins(*marks: str) -> Column:
        return reduce(lambda a, m: a | token.startswith(m), marks[1:], token.startswith(marks[0]))

    latin = ((token >= "a") & (token < "{")) | ((token >= "A") & (token < "[")) | token.startswith("_")
    letter = latin | ((token >= "\x80") & F.substring(token, 1, 1).rlike(r"\p{L}"))
    return (
        F.when(begins("(", ")", ",", "."), "punct")
        .when(begins("&"), "variable")
        .when(begins("'", '"'), "string")
        .when((token >= "0") & (token < ":"), "number")
        .when(letter, F.when(F.lower(token).isin(*KEYWORDS), "keyword").otherwise("ident"))
        .when(begins("<", ">", "=", "!", "+", "-", "*", "/"), "operator")
        .otherwise("punct")
    )


def statement(tokens: Column) -> Column:
    """The kind of statement by a line's first two tokens."""

    def word(i: int, w: str) -> Column:
        t = F.get(tokens, F.lit(i))
        return F.coalesce((t["kind"] == "keyword") & (F.lower(t["text"]) == w), F.lit(False))

    def is_(i: int, k: str, t: str) -> Column:
        x = F.get(tokens, F.lit(i))
        return F.coalesce((x["kind"] == k) & (x["text"] == t), F.lit(False))

    first = F.get(tokens, F.lit(0))["kind"]
    return (
        F.when(word(0, "for") & word(1, "each"), "ForEach")
        .when(word(0, "endfor"), "EndFor")
        .when(word(0, "if"), "If")
        .when(word(0, "elseif") | (word(0, "else") & word(1, "if")), "ElseIf")
        .when(word(0, "else"), "Else")
        .when(word(0, "endif"), "EndIf")
        .when(word(0, "do") & word(1, "case"), "DoCase")
        .when(word(0, "case"), "Case")
        .when(word(0, "otherwise"), "Otherwise")
        .when(word(0, "endcase"), "EndCase")
        .when(word(0, "sub"), "Sub")
        .when(word(0, "endsub"), "EndSub")
        .when(word(0, "where"), "Where")
        .when(word(0, "defined") & word(1, "by"), "DefinedBy")
        .when(word(0, "order"), "Order")
        .when(word(0, "parm"), "Parm")
        .when((first == "variable") & is_(1, "operator", "="), "Assignment")
        .when(word(0, "do") | ((first == "ident") & is_(1, "punct", "(")), "Call")
        .otherwise("Other")
    )


def without_comments(raw: Column) -> Column:
    """A line without its comments; most lines have none and need no pattern."""
    return F.when(has(raw, "//") | has(raw, "/*"), F.regexp_replace(raw, KEPT_LITERAL_OR_COMMENT, "$1")).otherwise(raw)


def line_tokens(raw: Column) -> Column:
    """The tokens (kind, text) of a line, without its comments."""
    found = F.regexp_extract_all(without_comments(raw), F.lit(TOKEN), 0)
    return F.transform(found, lambda t: F.struct(kind(t).alias("kind"), t.alias("text")))


def model(objects: DataFrame) -> DataFrame:
    """object_key, line_no, raw, tokens (kind, text), statement: the lines that have tokens."""
    rows = objects.select("object_key", F.posexplode(F.split("text", "\n", -1)).alias("at", "l"))
    # Whatever is no white space is a token: asking for the tokens' number would make them twice.
    plain = (F.col("l") >= "!") & (F.col("l") < "\x7f") & ~has(F.col("l"), "//") & ~has(F.col("l"), "/*")
    rows = rows.where(plain | without_comments(F.col("l")).rlike(r"[^\s\p{Z}]"))
    raw = F.when(F.col("l").endswith("\r"), F.regexp_replace("l", r"\r+\z", "")).otherwise(F.col("l"))
    rows = rows.select("object_key", (F.col("at") + 1).alias("line_no"), raw.alias("raw")).withColumn("tokens", line_tokens(F.col("raw")))
    return rows.withColumn("statement", statement(F.col("tokens")))


def tokens(lines: DataFrame) -> DataFrame:
    """object_key, line_no, tok_order, kind, text; tok_order counts through the object."""
    before = F.coalesce(F.sum(F.size("tokens")).over(by().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = lines.withColumn("before", before).select("object_key", "line_no", "before", F.posexplode("tokens").alias("at", "t"))
    return flat.select("object_key", "line_no", (F.col("before") + F.col("at")).cast("long").alias("tok_order"), "t.kind", "t.text")


def statements(lines: DataFrame) -> DataFrame:
    """object_key, stmt_idx, line_no, kind, depth (blocks open before it), parent (the statement that opened the innermost, or null)."""
    opens, closes = F.col("statement").isin(*BLOCKS), F.col("statement").isin(*BLOCKS.values())
    rows = lines.select("object_key", "line_no", F.col("statement").alias("kind"), (F.row_number().over(by()) - 1).alias("stmt_idx"), F.when(opens, 1).when(closes, -1).otherwise(0).alias("step"))
    for level in depth("d", F.col("step")):
        rows = rows.withColumns(level)
    none = F.lit(None).cast("int")
    # Each statement asks at its depth for the last block opened there; each opening statement answers at the depth it makes.
    asks = rows.select("object_key", F.col("d_before").alias("at"), "line_no", "stmt_idx", "kind", none.alias("opener"))
    answers = rows.where("step = 1").select("object_key", F.col("d").alias("at"), "line_no", none.alias("stmt_idx"), "kind", F.col("stmt_idx").alias("opener"))
    earlier = Window.partitionBy("object_key", "at").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    found = asks.union(answers).withColumn("parent", F.last("opener", ignorenulls=True).over(earlier)).where("stmt_idx is not null")
    return found.select("object_key", "stmt_idx", "line_no", "kind", F.col("at").cast("int").alias("depth"), F.when(F.col("at") > 0, F.col("parent")).alias("parent"))


def coverage(lines: DataFrame) -> DataFrame:
    """object_key, unclosed_blocks, malformed_lines, complete: closes without an open or of another kind are malformed."""
    opens, closes = F.col("statement").isin(*BLOCKS), F.col("statement").isin(*BLOCKS.values())
    wanted = F.lit(None).cast("string")
    for o, c in BLOCKS.items():
        wanted = F.when(F.col("statement") == o, c).otherwise(wanted)
    rows = lines.select("object_key", "line_no", "statement").withColumn("wanted", wanted)
    for level in depth("d", F.when(opens, 1).when(closes, -1).otherwise(0)):
        rows = rows.withColumns(level)
    rows = rows.withColumn("level", F.when(opens, F.col("d")).otherwise(F.col("d_before"))).withColumn("expects", F.last(F.when(opens, F.col("wanted")), ignorenulls=True).over(within("level")))
    bad = closes & ((F.col("d_before") == 0) | (F.col("expects") != F.col("statement")))
    out = rows.groupBy("object_key").agg(F.max_by("d", "line_no").alias("u"), F.count_if(bad).alias("m"))
    return out.select("object_key", F.col("u").cast("long").alias("unclosed_blocks"), F.col("m").alias("malformed_lines"), ((F.col("u") == 0) & (F.col("m") == 0)).alias("complete"))


def complete(lines: DataFrame) -> DataFrame:
    """object_key of the objects that ``coverage`` calls complete: only lines that open or close a block tell, an object without any is complete."""
    blocks = lines.where(F.col("statement").isin(*BLOCKS, *BLOCKS.values()))
    return lines.select("object_key").distinct().join(coverage(blocks).where("not complete"), "object_key", "left_anti")


def accesses(lines: DataFrame) -> DataFrame:
    """object_key, name, line_no, tok_order, access, in_condition: an assignment's first variable is written, all others are read."""
    rows = tokens(lines).where("kind = 'variable'").join(lines.select("object_key", "line_no", "statement"), ["object_key", "line_no"])
    first = F.row_number().over(Window.partitionBy("object_key", "line_no").orderBy("tok_order")) == 1
    return rows.select("object_key", F.lower("text").alias("name"), "line_no", "tok_order", F.when((F.col("statement") == "Assignment") & first, "Write").otherwise("Read").alias("access"), F.col("statement").isin(*CONDITIONS).alias("in_condition"))


def parameters(lines: DataFrame) -> DataFrame:
    """object_key, param_idx, name, direction of the parm lines; the direction stands before the variable, or after it."""
    entry = "array<struct<name: string, direction: string>>"
    start = F.struct(F.lit(None).cast("string").alias("pending"), F.array().cast(entry).alias("out"))

    def step(a: Column, t: Column) -> Column:
        low = F.lower(t["text"])
        named = F.when(low == "in", "In").when(low == "out", "Out").when(low == "inout", "InOut")
        out, pending = a["out"], a["pending"]
        last = F.element_at(out, -1)
        after = F.when((F.size(out) > 0) & pending.isNotNull(), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["name"].alias("name"), pending.alias("direction"))))).otherwise(out).cast(entry)
        colon = (t["kind"] == "punct") & (t["text"] == ":")
        word = (t["kind"] == "ident") | ((t["kind"] == "punct") & ~colon)
        return (
            F.when(t["kind"] == "keyword", F.struct(F.coalesce(named, pending).alias("pending"), out.alias("out")))
            .when(t["kind"] == "variable", F.struct(F.lit(None).cast("string").alias("pending"), F.concat(out, F.array(F.struct(low.alias("name"), F.coalesce(pending, F.lit("Unspecified")).alias("direction")))).cast(entry).alias("out")))
            .when(word & (F.size(out) > 0), F.struct(F.lit(None).cast("string").alias("pending"), after.alias("out")))
            .otherwise(F.struct(pending.alias("pending"), out.alias("out")))
        )

    rows = lines.where("statement = 'Parm'").select("object_key", "line_no", F.posexplode(F.aggregate("tokens", start, step, lambda a: a["out"])).alias("at", "p"))
    rank = F.row_number().over(Window.partitionBy("object_key").orderBy("line_no", "at")) - 1
    return rows.select("object_key", rank.cast("int").alias("param_idx"), "p.name", "p.direction")


def dead_stores(lines: DataFrame) -> DataFrame:
    """GX.2.7.5: writes that the next access of the variable overwrites without reading it."""
    found = accesses(lines)
    reads = found.where("access = 'Read'").groupBy("object_key", "line_no", "name").agg(F.max("tok_order").alias("last_read"))
    rows = found.join(reads, ["object_key", "line_no", "name"], "left").withColumn("again", (F.col("access") == "Write") & F.coalesce(F.col("last_read") > F.col("tok_order"), F.lit(False)))
    by = Window.partitionBy("object_key", "name").orderBy("tok_order")
    rows = rows.withColumns({"next": F.lead("access").over(by), "next_again": F.lead("again").over(by)})
    out = parameters(lines).where("direction in ('Out', 'InOut')").select("object_key", "name").distinct()
    whole = coverage(lines).where("complete").select("object_key")
    dead = rows.where("access = 'Write' and next = 'Write' and not next_again and not in_condition").join(out, ["object_key", "name"], "left_anti").join(whole, "object_key", "left_semi")
    dead = dead.join(lines.select("object_key", "line_no", "raw"), ["object_key", "line_no"])
    rank = F.row_number().over(Window.partitionBy("object_key").orderBy("tok_order")) - 1
    return dead.withColumn("i", rank).select("object_key", finding("GX.2.7.5", text("GX.2.7.5", F.col("name")), phase=2, sub=F.col("i")).alias("f")).select("object_key", "f.*")


#: Names of sensitive variables, their endings, and values that are no secrets.
SENSITIVE = ("password", "passwd", "pwd", "clave", "secret", "token", "apikey", "api_key", "accesskey", "client_secret")
SENSITIVE_ENDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "accesskey", "clave")
PLACEHOLDERS = ("***", "xxx", "xxxx", "changeme", "example", "placeholder", "todo", "secret", "password")


def credentials(lines: DataFrame, retain: bool = False) -> DataFrame:
    """GX.SEC.1: a sensitive variable that is assigned a literal; the literal is redacted unless retained."""

    def hits(ts: Column) -> Column:
        def judge(t: Column, i: Column) -> Column:
            rest = F.slice(ts, i + 2, F.size(ts))
            equal = F.array_position(F.transform(rest, lambda x: (x["kind"] == "operator") & (x["text"] == "=")), F.lit(True)).cast("int")
            literal = F.get(F.filter(F.slice(rest, equal + 1, F.size(ts)), lambda x: x["kind"] == "string"), F.lit(0))["text"]
            name = F.lower(F.regexp_replace(t["text"], "^&+", ""))
            ends = F.lit(False)
            for e in SENSITIVE_ENDS:
                ends = ends | name.endswith(e)
            value = F.lower(trim(literal_value(literal)))
            good = (t["kind"] == "variable") & (name.isin(*SENSITIVE) | ends) & (equal > 0) & literal.isNotNull() & (value != "") & ~value.isin(*PLACEHOLDERS)
            return F.when(good, F.struct(t["text"].alias("name"), literal.alias("literal")))

        return F.filter(F.transform(ts, judge), lambda x: x.isNotNull())

    rows = lines.where("statement = 'Assignment'").select("object_key", "line_no", "raw", F.posexplode(let(F.col("tokens"), hits)).alias("i", "h"))
    content = F.col("raw") if retain else redacted(F.col("raw"), F.col("h.literal"))
    return rows.select("object_key", finding("GX.SEC.1", text("GX.SEC.1", F.col("h.name")), content=content, phase=3, sub=F.col("i")).alias("f")).select("object_key", "f.*")


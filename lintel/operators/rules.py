"""Line rules as columns over the lines relation.

A rule is a few levels of columns and an array of findings.  The levels of all
chosen rules are merged, so the whole catalogue reads its lines once, is dealt
out by object once, and shares its windows; then the findings are exploded.
Windows by (object, level) need no further exchange.

``depth`` is a clamped running sum: opens add one, closes take one, and a close
at depth zero takes none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import called_subroutine, continues_where, has, keyword, leading_width, let, squeeze, tokens_by_space, trim, unquoted, without_between
from ..plans.catalog import BY_ID, MESSAGES, ORDER

FINDING = "struct<rule_id: string, severity: string, line_number: int, description: string, line_content: string, phase: int, emit_line: int, rule_ord: int, sub_idx: int>"


def by():
    return Window.partitionBy("object_key").orderBy("line_no")


def so_far():
    return by().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return by().rowsBetween(Window.unboundedPreceding, -1)


def whole():
    return Window.partitionBy("object_key")


def within(*columns: str):
    """Rows so far of the object's lines that share these columns."""
    return Window.partitionBy("object_key", *columns).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


@dataclass
class Rule:
    id: str
    findings: Column
    levels: list[dict[str, Column]] = field(default_factory=list)


def text(key: str, *values: Column) -> Column:
    return F.format_string(MESSAGES[key], *values) if values else F.lit(MESSAGES[key].replace("%%", "%"))


def finding(rule: str, description: Column, line: Column | None = None, content: Column | None = None, phase: int = 0, sub: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(BY_ID[rule].severity).alias("severity"), (F.col("line_no") if line is None else line).cast("int").alias("line_number"), description.alias("description"),
        (F.col("raw") if content is None else content).alias("line_content"), F.lit(phase).alias("phase"), F.col("line_no").alias("emit_line"), F.lit(ORDER[rule]).alias("rule_ord"), (F.lit(0) if sub is None else sub).cast("int").alias("sub_idx"),
    ).cast(FINDING)


def only(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(F.array().cast(f"array<{FINDING}>"))


def depth(name: str, delta: Column) -> list[dict[str, Column]]:
    """Levels that make ``name`` (after the line) and ``name``_before (before it) from a step of +1, -1 or 0."""
    s, d = f"{name}_sum", f"{name}_step"
    return [
        {d: delta},
        {s: F.sum(d).over(so_far())},
        {name: F.col(s) - F.least(F.lit(0), F.min(s).over(so_far()))},
        {f"{name}_before": F.coalesce(F.lag(name).over(by()), F.lit(0))},
    ]


def views() -> tuple[Column, Column, Column]:
    """A line without strings and comments in lower case, as it is, and whether any of it is left."""
    return F.col("clean_lower"), F.col("clean"), F.col("clean_lower") != ""


def names(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(found)), ", ")


def rule_1_1() -> Rule:
    # A word boundary must follow: the name may not run on into a letter of another script.
    found = F.transform(F.regexp_extract_all("clean", F.lit(r"&([a-z][a-zA-Z0-9_]*+)(?![\p{L}\p{M}\p{N}_])"), 1), lambda v: F.concat(F.lit("&"), v))
    return Rule("GX.1.1", only(F.col("has_ampersand") & (F.size(found) > 0), finding("GX.1.1", text("GX.1.1", names(found)))))


def rule_1_2() -> Rule:
    lower, _, there = views()
    start, end = keyword(lower, "for each", "if", "case", "do while", "sub"), keyword(lower, "endfor", "endif", "endcase", "enddo", "endsub")
    expected = F.when(end & (F.col("r12_before") > 0), F.col("r12_before") - 1).otherwise(F.col("r12_before"))
    width = leading_width(F.col("raw"))
    bad = there & (expected > 0) & (width < expected * 4)
    return Rule("GX.1.2", only(bad, finding("GX.1.2", text("GX.1.2", (expected * 4).cast("int"), expected.cast("int"), width))), depth("r12", F.when(~there, 0).when(end, -1).when(start, 1).otherwise(0)))


def matched(name: str, opens: Column, closes: Column) -> list[dict[str, Column]]:
    """Depth, the stack level of each line (an opening line's is its own), and name_open: the line, raw and words of the block that is open there."""
    here = F.struct(F.col("line_no").alias("line"), F.col("raw").alias("raw"))
    return [
        *depth(name, F.when(opens, 1).when(closes, -1).otherwise(0)),
        {f"{name}_level": F.when(opens, F.col(name)).otherwise(F.col(f"{name}_before"))},
        {f"{name}_open": F.last(F.when(opens, here), ignorenulls=True).over(within(f"{name}_level"))},
    ]


def marked(name: str, mark: Column) -> Column:
    """The last line of the level with a mark."""
    return F.last(F.when(mark, F.col("line_no")), ignorenulls=True).over(within(f"{name}_level"))


def rule_1_3() -> Rule:
    lower, clean, _ = views()
    opens, closes = keyword(lower, "for each"), keyword(lower, "endfor")
    where = ~opens & keyword(lower, "where")
    defined = ~opens & ~keyword(lower, "where") & has(lower, "defined by")
    levels = matched("r13", opens, closes)
    levels[-1] |= {"r13_where": marked("r13", where), "r13_defined": marked("r13", defined)}
    inside = closes & (F.col("r13_before") > 0)
    begun = F.col("r13_open.line")
    missing = inside & (F.coalesce("r13_where", F.lit(0)) > begun) & ~(F.coalesce("r13_defined", F.lit(0)) > begun)
    words = F.size(tokens_by_space(clean))
    return Rule(
        "GX.1.3",
        F.concat(
            only(opens & (words < 3), finding("GX.1.3", text("GX.1.3/open"))),
            only(inside & ~has(F.col("raw"), "//") & (words < 2), finding("GX.1.3", text("GX.1.3/close"))),
            only(missing, finding("GX.1.3", text("GX.1.3/where", begun), begun, F.col("r13_open.raw"), sub=F.lit(1))),
        ),
        levels,
    )


def rule_1_3_1() -> Rule:
    lower, _, there = views()
    opens, closes = keyword(lower, "for each"), keyword(lower, "endfor")
    levels = [{"r131_in": F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(before())}]
    bad = there & ~opens & ~closes & F.coalesce("r131_in", F.lit(False)) & (leading_width(F.col("raw")) < 4)
    return Rule("GX.1.3.1", only(bad, finding("GX.1.3.1", F.when(keyword(lower, "where"), text("GX.1.3.1/where")).otherwise(text("GX.1.3.1/body")))), levels)


def _closed_without(rule: str, name: str, opens: Column, mark: Column, closes: Column) -> Rule:
    levels = matched(name, opens, closes)
    levels[-1] |= {f"{name}_mark": marked(name, mark)}
    begun = F.col(f"{name}_open.line")
    bad = closes & (F.col(f"{name}_before") > 0) & ~(F.coalesce(f"{name}_mark", F.lit(0)) > begun)
    return Rule(rule, only(bad, finding(rule, text(rule, begun), begun, F.col(f"{name}_open.raw"))), levels)


def rule_1_3_2() -> Rule:
    lower, _, _ = views()
    return _closed_without("GX.1.3.2", "r132", keyword(lower, "if"), keyword(lower, "else"), keyword(lower, "endif"))


def rule_1_3_3() -> Rule:
    lower, _, _ = views()
    return _closed_without("GX.1.3.3", "r133", keyword(lower, "do case"), keyword(lower, "otherwise"), keyword(lower, "endcase"))


#: Variables that may be assigned again.
REUSABLE = ("ok", "error", "flag", "status", "count", "exist", "sdt", "msg")


def rule_1_4_1() -> Rule:
    name = F.regexp_extract("clean", r"&([a-zA-Z0-9_]+)\s*=", 1)
    key = F.when(F.col("has_ampersand") & F.col("has_equal") & (name != "") & ~F.lower(name).isin(*REUSABLE), F.lower(name))
    right = F.lower(F.substr("clean", F.instr("clean", "=") + 1))
    levels = [{"r141_key": key, "r141_name": name}, {"r141_last": F.lag("line_no").over(Window.partitionBy("object_key", "r141_key").orderBy("line_no"))}]
    own = F.contains(right, F.concat(F.lit("&"), F.col("r141_key")))
    bad = F.col("r141_key").isNotNull() & ~own & (F.col("line_no") - F.col("r141_last") > 15)
    return Rule("GX.1.4.1", only(bad, finding("GX.1.4.1", text("GX.1.4.1", F.col("r141_name"), F.col("r141_last")))), levels)


#: Words that are no attributes.
NO_ATTRIBUTES = ("if", "case", "and", "or", "not", "null", "nullvalue", "like", "in", "true", "false", "do", "otherwise", "empty", "isempty", "isvalid", "udp", "new", "rows", "count")


def rule_1_4_2() -> Rule:
    lower, _, _ = views()
    decision = (F.col("has_if") | F.col("has_case")) & keyword(lower, "if", "case") & ~keyword(lower, "if &", "if(&", "case &", "case(&")
    found = F.filter(F.regexp_extract_all("clean", F.lit(r"(?<![&.])(?<![\p{L}\p{M}\p{N}_])([A-Z][a-zA-Z0-9_]*+)(?![\p{L}\p{M}\p{N}_])"), 1), lambda w: ~F.lower(w).isin(*NO_ATTRIBUTES))
    return Rule("GX.1.4.2", only(decision & (F.size(found) > 0), finding("GX.1.4.2", text("GX.1.4.2", names(found)))))


def rule_1_4_3() -> Rule:
    lower, _, there = views()
    begins = there & lower.rlike(r"\bparm\s*\(")
    here = within("r143_block")
    levels = [
        {"r143_block": F.sum(F.when(begins, 1).otherwise(0)).over(so_far())},
        {"r143_ends": F.min(F.when(there & has(lower, ")"), F.col("line_no"))).over(here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "r143_open": F.first(F.struct("line_no", "raw")).over(here)},
        {"r143_text": F.collect_list(F.when(there & (F.col("r143_block") > 0) & (F.col("line_no") <= F.col("r143_ends")), lower)).over(here)},
    ]
    inner = trim(F.regexp_extract(F.array_join("r143_text", " "), r"(?s)parm\s*\((.*?)\)", 1))
    plain = F.filter(F.transform(F.split(inner, ",", -1), trim), lambda p: (p != "") & ~p.rlike(r"^(?:in|out|inout):"))

    def named(p: Column, i: Column) -> Column:
        variable = F.regexp_extract(p, "&[a-zA-Z0-9_]+", 0)
        shown = F.when(variable != "", variable).otherwise(p)
        return finding("GX.1.4.3", text("GX.1.4.3", shown), F.col("r143_open.line_no"), F.col("r143_open.raw"), sub=i)

    ends = (F.col("r143_block") > 0) & (F.col("line_no") == F.col("r143_ends"))
    return Rule("GX.1.4.3", F.when(ends, F.transform(plain, named)).otherwise(F.array().cast(f"array<{FINDING}>")), levels)


def rule_1_5() -> Rule:
    lower, _, _ = views()
    count = F.regexp_count("clean", F.lit(r"(?i)\b(?:and|or)\b"))
    decision = (F.col("has_if") | F.col("has_case")) & keyword(lower, "if", "case") & (has(lower, " and ") | has(lower, " or "))
    return Rule("GX.1.5", only(decision & (count >= 3), finding("GX.1.5", text("GX.1.5", count))))


#: Fixed value: the generated subroutine that is left alone.
GENERATED_SUB = "gu: op -> cancelar"


def rule_1_6_1() -> Rule:
    comment = F.col("stripped").startswith("//") | F.col("stripped").startswith("/*")

    def calls(t: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (F.get(t, i) == "do") & ~F.coalesce(F.get(t, i - 1).endswith("&"), F.lit(False)) & ~F.coalesce(F.get(t, i + 1), F.lit("")).isin("while", "case"))

    call = ~comment & has(F.col("lower"), "do") & let(tokens_by_space(F.col("lower")), calls)
    bad = call & (called_subroutine(F.col("stripped")) != GENERATED_SUB) & ~F.col("r161_before")
    return Rule("GX.1.6.1", only(bad, finding("GX.1.6.1", text("GX.1.6.1"))), [{"r161_before": F.lag(comment, 1, False).over(by())}])


def rule_1_6_2() -> Rule:
    comment = F.col("stripped").startswith("//") | F.col("stripped").startswith("/*")
    sub = keyword(F.col("lower"), "sub") & (F.lower(unquoted(F.substr("stripped", F.lit(4)))) != GENERATED_SUB)
    levels = [
        {"r162_sub": sub, "r162_row": F.row_number().over(by())},
        # Of subs in a row every second one is only the line that the one before waits for.
        {"r162_run": F.col("r162_row") - F.coalesce(F.last(F.when(~F.col("r162_sub"), F.col("r162_row")), ignorenulls=True).over(so_far()), F.lit(0))},
        {"r162_declares": F.col("r162_sub") & (F.col("r162_run") % 2 == 1)},
        {"r162_open": F.lag(F.when(F.col("r162_declares"), F.struct("line_no", "raw"))).over(by())},
    ]
    bad = F.col("r162_open").isNotNull() & ~comment
    return Rule("GX.1.6.2", only(bad, finding("GX.1.6.2", text("GX.1.6.2", F.col("r162_open.line_no")), F.col("r162_open.line_no"), F.col("r162_open.raw"))), levels)


#: What the history of changes must have.
HEADERS = ("codigo iniciativa", "descripcion", "responsible", "version")


def rule_1_7_1() -> Rule:
    low = F.col("lower")
    begins, ends = low.startswith("rules:"), low.startswith("events") | low.startswith("source") | low.startswith("sub ")
    levels = [
        {"r171_in": F.coalesce(F.last(F.when(begins, True).when(ends, False), ignorenulls=True).over(so_far()), F.lit(True)) & ~begins & ~ends, "r171_first": F.row_number().over(by()) == 1},
        {f"r171_{i}": F.max(F.col("r171_in") & has(low, h)).over(whole()) for i, h in enumerate(HEADERS)},
    ]
    missing = F.filter(F.array(*(F.when(~F.col(f"r171_{i}"), h.upper()) for i, h in enumerate(HEADERS))), lambda h: h.isNotNull())
    return Rule("GX.1.7.1", only(F.col("r171_first") & (F.size(missing) > 0), finding("GX.1.7.1", text("GX.1.7.1", F.array_join(F.array_sort(missing), ", ")), phase=1)), levels)


def rule_1_7_2() -> Rule:
    comment = F.col("stripped").startswith("//")
    said = trim(F.substr("stripped", F.lit(3)))
    ruled = said.rlike(r"^([-_=*~.#])(?:\1| )*+\z")
    return Rule("GX.1.7.2", F.concat(only(comment & (said == ""), finding("GX.1.7.2", text("GX.1.7.2/empty"))), only(comment & ruled, finding("GX.1.7.2", text("GX.1.7.2/line")))))


def where_blocks() -> list[dict[str, Column]]:
    """w_active: the line is in the condition of a where in a loop; w_block and w_line: which one, and its line."""
    lower, _, there = views()
    each, ends = keyword(lower, "for each"), keyword(lower, "endfor")
    begins = there & keyword(lower, "where") & F.coalesce("w_loop", F.lit(False))
    stops = there & ~keyword(lower, "where") & (keyword(lower, "defined by", "order") | ~continues_where(lower))
    here = within("w_block")
    return [
        {"w_loop": F.last(F.when(each, True).when(ends, False), ignorenulls=True).over(before())},
        {"w_begins": begins, "w_block": F.sum(F.when(begins | each | ends, 1).otherwise(0)).over(so_far())},
        {"w_is": F.first("w_begins").over(here), "w_line": F.first("line_no").over(here), "w_dead": F.max(F.when(stops, 1).otherwise(0)).over(here)},
        {"w_active": there & F.col("w_is") & (F.col("w_block") > 0) & (F.col("w_dead") == 0)},
    ]


def _in_where(rule: str, name: str, hit: Column, *values: Column) -> Rule:
    """The first hit of each where block."""
    levels = [*where_blocks(), {f"{name}_hit": F.col("w_active") & hit}, {f"{name}_n": F.sum(F.when(F.col(f"{name}_hit"), 1).otherwise(0)).over(within("w_block"))}]
    return Rule(rule, only(F.col(f"{name}_hit") & (F.col(f"{name}_n") == 1), finding(rule, text(rule, *values, F.col("w_line")))), levels)


def rule_2_1() -> Rule:
    lower, _, _ = views()
    return _in_where("GX.2.1", "r21", has(lower, "when"))


def rule_2_2() -> Rule:
    lower, _, _ = views()
    found = F.filter(tokens_by_space(without_between(lower)), lambda t: t.isin("and", "or", "in"))
    return _in_where("GX.2.2", "r22", F.size(found) > 0, names(F.transform(found, F.upper)))


def rule_2_3() -> Rule:
    lower, _, _ = views()
    line = squeeze(lower)
    opens, closes = keyword(line, "for each"), keyword(line, "endfor", "end for")
    return Rule("GX.2.3", only(opens & (F.col("r23") > 2), finding("GX.2.3", text("GX.2.3", F.col("r23").cast("int")))), depth("r23", F.when(opens, 1).when(closes, -1).otherwise(0)))


#: Words before a parenthesis that are no functions.
NO_FUNCTIONS = ("and", "or", "not", "if", "case", "where", "in", "like")


def rule_2_4() -> Rule:
    found = F.filter(F.regexp_extract_all("clean", F.lit(r"(?<![.&])(?<![\p{L}\p{M}\p{N}_])([a-zA-Z0-9_]++)\s*\("), 1), lambda f: ~F.lower(f).isin(*NO_FUNCTIONS))
    return _in_where("GX.2.4", "r24", F.size(found) > 0, names(F.transform(found, F.upper)))


#: Literals that may stand in a condition.
TRIVIAL = ("0", "''", '""', "true", "false", "null", "nullvalue")
HARD_CODED = r"""(?i)(?:!=|<>|<=|>=|=|<|>|\blike)\s*(\d+|'(?:[^']|'')*+'|"(?:[^"]|"")*+")"""


def rule_2_5() -> Rule:
    target = F.regexp_replace("code_lower", "^where", "")
    literal = F.regexp_extract(target, HARD_CODED, 1)
    return _in_where("GX.2.5", "r25", (literal != "") & ~literal.isin(*TRIVIAL), literal)


def rule_2_6() -> Rule:
    lower, _, _ = views()
    low = F.col("lower")
    sub, end = keyword(low, "sub"), keyword(low, "endsub")
    name = trim(F.substr("stripped", F.lit(4)))
    sets = has(lower, "nullvalue(") & has(F.substring_index("clean_lower", "=", 1), "&") & has(lower, "=")
    here = within("r26_block")
    levels = [
        {"r26_block": F.sum(F.when(sub, 1).otherwise(0)).over(so_far())},
        {"r26_open": F.first(F.struct("line_no", "raw", name.alias("name"))).over(here), "r26_ends": F.sum(F.when(end, 1).otherwise(0)).over(here), "r26_set": F.max(sets & ~sub).over(here)},
    ]
    opened = F.col("r26_open")
    bad = end & (F.col("r26_block") > 0) & (F.col("r26_ends") == 1) & ~F.col("r26_set") & (unquoted(opened["name"]) != GENERATED_SUB)
    return Rule("GX.2.6", only(bad, finding("GX.2.6", text("GX.2.6", opened["name"]), opened["line_no"], opened["raw"])), levels)


LOOSE = ("&i", "&j", "&k")


def rule_2_7_1() -> Rule:
    low = F.col("lower")
    loops = F.when(has(low, "for"), ~keyword(low, "for each") & keyword(low, "for")).otherwise(keyword(low, "do while"))
    found = F.filter(F.array(*(F.when(low.rlike(rf"{v}(?![a-zA-Z0-9_])"), v.upper()) for v in LOOSE)), lambda v: v.isNotNull())
    closes = keyword(low, "endfor", "enddo") & (F.size(found) == 0)
    levels = [*depth("r271", F.when(loops, 1).when(closes, -1).otherwise(0)), {"r271_from": F.last(F.when(loops & (F.col("r271") == 1), F.col("line_no")), ignorenulls=True).over(so_far())}]
    return Rule("GX.2.7.1", only((F.col("r271") > 0) & (F.size(found) > 0), finding("GX.2.7.1", text("GX.2.7.1", F.array_join(found, ", "), F.col("r271_from")))), levels)


def _first_assigned(variable: str, operators: str) -> Column:
    """Whether the first mention of a variable is followed by one of the operators; _ ends a name here."""
    at = F.instr("lower", variable)
    rest = F.substr("lower", at + len(variable))
    return (at > 0) & ~rest.rlike("^[a-zA-Z0-9]") & rest.rlike(rf"(?U)^\s*{operators}")


def rule_2_7_2() -> Rule:
    found = F.filter(F.array(*(F.when(_first_assigned(v, r"(?:=|\+=|-=)"), v.upper()) for v in LOOSE)), lambda v: v.isNotNull())
    return Rule("GX.2.7.2", only(F.col("has_ampersand") & F.col("has_equal") & (F.size(found) > 0), finding("GX.2.7.2", text("GX.2.7.2", F.array_join(found, ", ")))))


#: Variables of conditions, in the order in which a line is searched for them.
CONDITIONS = ("&cond", "&ok", "&flag", "&status", "&condition")


def rule_2_7_3() -> Rule:
    """Of a line's variables the first that was seen is the finding; those before it are seen from now on, those after it are not looked at.

    So when a variable is first seen depends on those before it in the list only: a running
    flag for each, one after the other.  No row holds what its object's other rows have.
    """
    given = F.col("has_ampersand") & F.col("has_equal")
    sets, seen = ([f"r273_{k}{end}" for k in range(len(CONDITIONS))] for end in ("", "_seen"))
    met = [given & _first_assigned(v, r"(?::=|\+=|=(?!=))") for v in CONDITIONS]
    levels: list[dict[str, Column]] = [dict(zip(sets, met, strict=True))]
    adds = met[0]
    for k, name in enumerate(seen):
        if k:
            levels.append({})
            adds = F.col(sets[k]) & ~reduce(or_, (F.col(a) & F.col(b) for a, b in zip(sets[:k], seen[:k], strict=True)))
        levels[k][name] = F.coalesce(F.max(adds).over(before()), F.lit(False))
    hit = F.coalesce(*(F.when(F.col(a) & F.col(b), v) for a, b, v in zip(sets, seen, CONDITIONS, strict=True)))
    return Rule("GX.2.7.3", only(hit.isNotNull(), finding("GX.2.7.3", text("GX.2.7.3", hit))), levels)


LINE_RULES = {
    "GX.1.1": rule_1_1, "GX.1.2": rule_1_2, "GX.1.3": rule_1_3, "GX.1.3.1": rule_1_3_1, "GX.1.3.2": rule_1_3_2, "GX.1.3.3": rule_1_3_3, "GX.1.4.1": rule_1_4_1, "GX.1.4.2": rule_1_4_2,
    "GX.1.4.3": rule_1_4_3, "GX.1.5": rule_1_5, "GX.1.6.1": rule_1_6_1, "GX.1.6.2": rule_1_6_2, "GX.1.7.1": rule_1_7_1, "GX.1.7.2": rule_1_7_2, "GX.2.1": rule_2_1, "GX.2.2": rule_2_2,
    "GX.2.3": rule_2_3, "GX.2.4": rule_2_4, "GX.2.5": rule_2_5, "GX.2.6": rule_2_6, "GX.2.7.1": rule_2_7_1, "GX.2.7.2": rule_2_7_2, "GX.2.7.3": rule_2_7_3,
}


@lru_cache(maxsize=256)
def built(rule: str, application: str) -> Rule:
    """A rule's columns, made once in each Spark application."""
    return LINE_RULES[rule]()


def line_findings(lines: DataFrame, ids: list[str]) -> DataFrame:
    """object_key and the findings of the chosen line rules, from one pass over the lines."""
    rules = [built(i, lines.sparkSession.sparkContext.applicationId) for i in ids]
    rows = lines
    for k in range(max((len(r.levels) for r in rules), default=0)):
        level: dict[str, Column] = {}
        for r in rules:
            if k < len(r.levels):
                level.update(r.levels[k])
        rows = rows.withColumns(level)
    return rows.select("object_key", F.explode(F.concat(*(r.findings for r in rules))).alias("f")).select("object_key", "f.*")


#: Variables that the system sets.
SYSTEM = ("pgmname", "time", "today", "mode", "gx_fail", "gx_empty")


def unused_variables(lines: DataFrame) -> DataFrame:
    """GX.2.7.4: variables that an object writes and never reads, at their first mention."""
    low = F.col("lower")
    compared = has(low, "==") | has(low, "!=") | has(low, "<=") | has(low, ">=")
    assigns = F.col("has_equal") & ~compared & has(low, "=")
    left = F.when(assigns, F.substring_index(low, "=", 1)).otherwise("")
    right = F.when(assigns, F.substr(low, F.instr(low, "=") + 1)).otherwise(low)
    named = lambda x: F.regexp_extract_all(x, F.lit("&([a-zA-Z0-9_]+)"), 1)
    mentions = F.concat(F.transform(named(left), lambda v: F.struct(v.alias("var"), F.lit(True).alias("written"))), F.transform(named(right), lambda v: F.struct(v.alias("var"), F.lit(False).alias("written"))))
    rows = lines.where("has_ampersand").select("object_key", "line_no", "raw", F.explode(mentions).alias("m")).select("object_key", "line_no", "raw", "m.*")
    dead = rows.groupBy("object_key", "var").agg(F.max("written").alias("w"), F.max(~F.col("written")).alias("r"), F.min(F.struct("line_no", "raw")).alias("at")).where(F.col("w") & ~F.col("r") & ~F.col("var").isin(*SYSTEM))
    rank = F.row_number().over(Window.partitionBy("object_key").orderBy("var")) - 1
    found = dead.select("object_key", F.col("at.line_no").alias("line_no"), F.col("at.raw").alias("raw"), "var", rank.alias("i"))
    return found.select("object_key", finding("GX.2.7.4", text("GX.2.7.4", F.col("var")), phase=1, sub=F.col("i")).alias("f")).select("object_key", "f.*")

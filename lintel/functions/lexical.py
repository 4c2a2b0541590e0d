"""Lexical column functions over program text.

All are built-in expressions, so they stay in the JVM.  Patterns repeat groups
possessively: long strings and comments need neither stack nor retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexemes of a whole text: strings (which may span lines), line comments, closed block comments, and what is none of these.
LEXEME = r"""(?s)'(?:[^']|'')*+(?:'|\z)|"(?:[^"]|"")*+(?:"|\z)|//[^\n]*+|/\*.*?\*/|[^'"/]++|."""
#: Strings and comments of one line.
LITERAL_OR_COMMENT = r"""(?s)'(?:[^']|'')*+(?:'|\z)|"(?:[^"]|"")*+(?:"|\z)|//.*\z|/\*.*?(?:\*/|\z)"""
KEPT_LITERAL_OR_COMMENT = r"""(?s)('(?:[^']|'')*+(?:'|\z)|"(?:[^"]|"")*+(?:"|\z))|//.*\z|/\*.*?(?:\*/|\z)"""
#: Tokens of one line without comments.
TOKEN = r"""(?s)&[\p{L}\p{N}_]*+|'(?:[^']|'')*+(?:'|\z)|"(?:[^"]|"")*+(?:"|\z)|[0-9][0-9.]*+|[\p{L}_][\p{L}\p{N}_]*+|[<>=!][=>]?|[^\s\p{Z}]"""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once per row."""
    return F.transform(F.array(value), use).getItem(0)


#: The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(x: Column) -> Column:
    """Without white space at the ends, as Unicode has it."""
    return F.btrim(x, F.lit(SPACES))


def trim_start(x: Column) -> Column:
    return F.ltrim(x, F.lit(SPACES))


def leading_width(raw: Column) -> Column:
    """Bytes of white space before the first other character."""
    return F.octet_length(raw) - F.octet_length(trim_start(raw))


def mask_blocks(text: Column) -> Column:
    """Closed block comments outside strings become spaces; length and line breaks stay."""
    blank = F.transform(F.regexp_extract_all(text, F.lit(LEXEME), 0), lambda t: F.when(t.startswith("/*") & (F.length(t) > 1), F.regexp_replace(t, r"[^\r\n]", " ")).otherwise(t))
    return F.when(F.contains(text, F.lit("/*")), F.array_join(blank, "")).otherwise(text)


def _quoted(line: Column) -> Column:
    """Whether a line can have strings or comments; most lines have none and need no pattern."""
    return has(line, "'") | has(line, '"') | has(line, "//") | has(line, "/*")


def clean(line: Column) -> Column:
    """A line without strings and comments."""
    return trim(F.when(_quoted(line), F.regexp_replace(line, LITERAL_OR_COMMENT, "")).otherwise(line))


def code(line: Column) -> Column:
    """A line without comments."""
    return trim(F.when(_quoted(line), F.regexp_replace(line, KEPT_LITERAL_OR_COMMENT, "$1")).otherwise(line))


def keyword(x: Column, *words: str) -> Column:
    """Whether x is one of the words or begins with one and a space."""
    out = F.lit(False)
    for w in words:
        out = out | (x == w) | x.startswith(w + " ")
    return out


def has(x: Column, needle: str) -> Column:
    return F.contains(x, F.lit(needle))


def tokens_by_space(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+", -1), lambda t: t != "")


def squeeze(x: Column) -> Column:
    return F.array_join(tokens_by_space(x), " ")


#: Words that end a condition, words that go on with one, and comparisons that are no assignment.
BODY_KEYWORDS = ("if", "do", "msg", "for", "while", "return", "new", "call", "sub", "endsub", "endfor", "endif", "else", "elseif", "do case", "case", "otherwise", "endcase")
CONDITION_KEYWORDS = ("when", "or", "and", "in", "like", "between")
COMPARISONS = ("==", "!=", "<=", ">=")


def continues_where(lower: Column) -> Column:
    """Whether a line goes on with the condition of the line before."""
    compared = F.lit(False)
    for op in COMPARISONS:
        compared = compared | has(lower, op)
    assigns = has(lower, "=") & ~compared & lower.rlike(r"^[_&\p{IsAlphabetic}]")
    return (
        F.when((lower == "") | lower.startswith("//") | lower.startswith("/*"), F.lit(True))
        .when(keyword(lower, *BODY_KEYWORDS), F.lit(False))
        .when(keyword(lower, *CONDITION_KEYWORDS), F.lit(True))
        .otherwise(~assigns)
    )


def without_between(lower: Column) -> Column:
    """Without the first stretch from between to its and."""
    return F.regexp_replace(lower, r"(?s)^(.*?)between.*? and ", "$1")


def unquoted(name: Column) -> Column:
    """A subroutine's name without semicolons, quotes and repeated spaces."""
    bare = trim(F.regexp_replace(trim(name), r";+\z", ""))
    return squeeze(F.regexp_replace(bare, r"(?s)^(['\"])(.*)\1\z", "$2"))


def called_subroutine(stripped: Column) -> Column:
    return F.lower(unquoted(F.regexp_extract(stripped, r"""(?i)(?:^|\s)do\s+('[^']+'|"[^"]+"|[^\s]+)""", 1)))


def literal_value(token: Column) -> Column:
    """The value of a string token."""
    single = token.startswith("'")
    inner = F.regexp_replace(token, r"""(?s)^['"]|['"]\z""", "")
    return F.when(single, F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(F.replace(inner, F.lit('""'), F.lit('"')))


def redacted(line: Column, literal: Column) -> Column:
    """Every occurrence of a literal in a line as three stars in its quotes."""
    quote = F.substring(literal, 1, 1)
    return F.replace(line, literal, F.concat(quote, F.lit("***"), quote))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "ERROR", 0).when(severity == "WARNING", 1).otherwise(2)


def setting_type(value: Column) -> Column:
    """bool, int, float or string, by what the text can be read as."""
    return F.when(F.lower(value).isin("true", "false"), "bool").when(value.try_cast("bigint").isNotNull(), "int").when(value.try_cast("double").isNotNull(), "float").otherwise("string")


def member_line(segments: Column, line: Column) -> Column:
    """The line in the member of a line in the object's text, by the last segment that begins at or before it."""
    return let(F.element_at(F.filter(segments, lambda s: s["text_start_line"] <= line), -1), lambda s: s["member_start_line"] + line - s["text_start_line"])


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, filled word by word; a longer word is cut into pieces of that width."""
    words = F.flatten(F.transform(tokens_by_space(text), lambda w: F.when(F.length(w) <= width, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s).{{1,{width}}}"), 0))))
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("line"))

    def add(a: Column, word: Column) -> Column:
        joined = F.concat(a["line"], F.lit(" "), word)
        full = a["line"].isNotNull() & (F.length(joined) > width)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["line"]))).otherwise(a["done"]).alias("done"), F.when(full | a["line"].isNull(), word).otherwise(joined).alias("line"))

    return F.aggregate(words, start, add, lambda a: F.when(a["line"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["line"]))))

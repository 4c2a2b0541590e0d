"""Matches of a pattern with their places, in column functions only.

Splitting a text at a pattern gives the gaps between its leftmost
non-overlapping matches, and extracting the pattern gives the matches; their
lengths add up to places in code points.  Patterns here repeat groups only
possessively, so long runs need neither stack nor retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import let

FOUND = "array<struct<start: bigint, end: bigint, text: string, part: string, before: string, after: string>>"
#: Code points of context kept on each side of a match.
CONTEXT = 32
#: Matches of a text that are placed together.
BLOCK = 128


def nothing() -> Column:
    return F.array().cast(FOUND)


def find(text: Column, pattern: str, part: int = 0, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches in order; ``part`` is the group kept beside the whole match, ``when`` a cheap test that no text with a match fails."""

    def place(x: Column) -> Column:
        gaps, parts = x["gaps"], x["parts"]
        rows = F.transform(x["found"], lambda m, i: F.struct(m.alias("m"), F.get(parts, i).alias("p"), F.get(gaps, i).alias("g"), F.get(gaps, i + 1).alias("h")))
        return F.when(F.size(x["found"]) <= BLOCK, _placed(rows, F.lit(0).cast("long"))).otherwise(let(rows, _blockwise))

    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.regexp_extract_all(text, F.lit(pattern), part).alias("parts"))
    test = F.lit(True) if when is None else when
    return F.when(test & text.rlike(pattern), let(pieces, place)).otherwise(nothing())


def _placed(rows: Column, at: Column) -> Column:
    """Places of some matches (gap before, match, gap after) from a place on. An array is copied for each match, so these are BLOCK at most."""
    start = F.struct(at.alias("at"), nothing().alias("out"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["g"])
        end = begin + F.length(row["m"])
        hit = F.struct(begin.alias("start"), end.alias("end"), row["m"].alias("text"), row["p"].alias("part"), F.right(row["g"], F.lit(CONTEXT)).alias("before"), F.left(row["h"], F.lit(CONTEXT)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).cast(FOUND).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def _blockwise(rows: Column) -> Column:
    """Places of many matches: blocks' lengths are added up first, then each block is placed from where it begins."""
    longs = "array<bigint>"

    def cut(b: Column) -> Column:
        return F.slice(rows, (b * BLOCK + 1).cast("int"), F.lit(BLOCK))

    def length(b: Column) -> Column:
        return F.aggregate(cut(b), F.lit(0).cast("long"), lambda a, r: a + F.length(r["g"]) + F.length(r["m"]))

    def starts(lengths: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(longs).alias("out"))
        return F.aggregate(lengths, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).cast(longs).alias("out")), lambda a: a["out"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
    return let(starts(F.transform(blocks, length)), lambda at: F.flatten(F.transform(at, lambda s, b: _placed(cut(b), s))))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def total(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(F.substr(F.translate(d, "0123456789", "0246813579"), i, F.lit(1)).cast("int")))

    return (F.length(number) > 0) & (let(F.reverse(number), total) % 10 == 0)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    """n_kind: how many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

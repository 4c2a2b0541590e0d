"""Objects to lines: the relation that every rule reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import clean, code, has, mask_blocks, trim

#: Fixed value: what follows is generated code.
GENERATED = "generated subroutines (public)"
FLAGS = {"has_ampersand": "&", "has_equal": "=", "has_where": "where", "has_for_each": "for each", "has_sub": "sub", "has_if": "if", "has_case": "case", "has_do": "do"}


def split_lines(objects: DataFrame) -> DataFrame:
    """object_key, line_no, raw, eval: every line up to the generated part. Nothing is shuffled: lines stay where their object is."""
    lines = F.arrays_zip(F.split("text", "\n", -1).alias("raw"), F.split(mask_blocks(F.col("text")), "\n", -1).alias("eval"))
    rows = objects.select("object_key", F.posexplode(_before_generated(lines)).alias("at", "l"))
    bare = lambda c: F.rtrim(c, F.lit("\r"))
    return rows.select("object_key", (F.col("at") + 1).alias("line_no"), bare(F.col("l.raw")).alias("raw"), bare(F.col("l.eval")).alias("eval"))


def _before_generated(lines):
    from ..functions.lexical import let

    def cut(ls):
        at = F.array_position(F.transform(ls, lambda x: has(F.lower(x["eval"]), GENERATED)), F.lit(True))
        return F.when(at > 0, F.slice(ls, F.lit(1), at.cast("int") - 1)).otherwise(ls)

    return let(lines, cut)


def parse_lines(objects: DataFrame) -> DataFrame:
    """object_key, line_no, raw, stripped, lower, clean, clean_lower, code, code_lower and the trigger flags; blank lines are numbered but left out."""
    rows = split_lines(objects).withColumn("stripped", trim(F.col("eval"))).where("stripped <> ''")
    rows = rows.select("object_key", "line_no", "raw", "stripped", F.lower("stripped").alias("lower"), clean(F.col("eval")).alias("clean"), code(F.col("eval")).alias("code"))
    rows = rows.select("*", F.lower("clean").alias("clean_lower"), F.lower("code").alias("code_lower"))
    return rows.withColumns({name: has(F.col("clean_lower"), needle) for name, needle in FLAGS.items()})

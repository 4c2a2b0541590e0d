"""Quality rules as a learned decision list, in DataFrame functions only.

Counts of every whole text give five shares (symbols, repeated words, repeated
lines, capitals, mean word length).  The smallest and largest value and quantiles
of the good and of the bad labelled rows are a share's marks; it is cut midway
between neighbouring marks, so no row lies on a cut that was taken from it.
Labelled rows are counted by cell: at most ``(2 * len(QUANTILES) + 4) ** 5`` cells,
whatever the number of rows.  On those counts sequential covering grows
conjunctions of thresholds for the class of bad documents (FOIL gain on one half
of the rows) and prunes them on the other half.  The ordered list, of at most
``MAX_RULES`` rules with ``MAX_CONDITIONS`` conditions each, becomes one conditional
expression; after ``MAX_TRIES`` refuted rules the search ends.

Words are runs without white space (\\x20, \\x09-\\x0D).  Defined results: a null
or blank text has no words and fails the base rule; labels that are null or of
unknown ids are ignored; without labels of both classes the list is empty and the
base rule alone decides; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

QUANTILES = (0.02, 0.25, 0.5, 0.75, 0.98)
FEATURES = ("symbols", "repeats", "lines", "capitals", "length")
MAX_RULES, MAX_CONDITIONS, MAX_TRIES = 16, 3, 24
MIN_PRECISION = 0.8
WHITE = "\t\n\x0b\f\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use).getItem(0)


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twin = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
            at = F.sort_array(F.filter(twin, lambda i: i.isNotNull()))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(by_hash, count))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows, covered))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the counts of each row, from one pass over the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def counts(parts: Column, t: Column) -> Column:
        def of_words(words: Column) -> Column:
            return F.struct(F.size(words).cast("long").alias("n_words"), (F.length(t) - F.size(parts) + 1).cast("long").alias("word_chars"), _repeated(words).alias("n_repeat_words"))

        return let(F.array_remove(parts, ""), of_words)

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    return rows.select(
        "doc_id",
        let(F.split(F.translate("t", WHITE, " " * len(WHITE)), " ", -1), lambda p: counts(p, F.col("t"))).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_capitals")


def _shares(counts: DataFrame) -> DataFrame:
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words", "n_lines"))
    return counts.select("*", (F.col("n_symbols") / chars).alias("symbols"), (F.col("n_repeat_words") / words).alias("repeats"), (F.col("n_dup_lines") / lines).alias("lines"), (F.col("n_capitals") / chars).alias("capitals"), (F.col("word_chars") / words).alias("length"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def learn(cells: list[dict], cuts: dict[str, list[float]]) -> list[Rule]:
    """Ordered conjunctions for bad rows. A cell: the bin of each feature (how many cuts are not above its values), and bad and good rows of the growing (gb, gg) and pruning half (pb, pg)."""

    def holds(cell: dict, c: Condition) -> bool:
        return (cell[c.feature] > cuts[c.feature].index(c.threshold)) == c.above

    def total(rows: list[dict], bad: str, good: str) -> tuple[int, int]:
        return sum(r[bad] for r in rows), sum(r[good] for r in rows)

    def precision(bad: int, good: int) -> float:
        return (bad + 1) / (bad + good + 2)

    candidates = [Condition(f, above, t) for f, ts in cuts.items() for t in ts for above in (True, False)]
    rules: list[Rule] = []
    left = list(cells)
    failed: set[Condition] = set()  # first conditions of rules that the other half refuted
    while len(rules) < MAX_RULES and len(failed) < MAX_TRIES:
        rule: list[Condition] = []
        covered = left
        while len(rule) < MAX_CONDITIONS:
            p, n = total(covered, "gb", "gg")
            if not p or not n:
                break
            best, gain = None, 1e-9
            for c in candidates:
                if not rule and c in failed:
                    continue
                inside = [r for r in covered if holds(r, c)]
                p1, n1 = total(inside, "gb", "gg")
                if p1 and (g := p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))) > gain:
                    best, gain, kept = c, g, inside
            if best is None:
                break
            rule.append(best)
            covered = kept
        if not rule:
            break
        first = rule[0]
        # Prune final conditions while the other half says the rule gets no worse.
        while len(rule) > 1:
            full = [r for r in left if all(holds(r, c) for c in rule)]
            short = [r for r in left if all(holds(r, c) for c in rule[:-1])]
            if precision(*total(short, "pb", "pg")) < precision(*total(full, "pb", "pg")):
                break
            rule.pop()
        inside = [r for r in left if all(holds(r, c) for c in rule)]
        if precision(*total(inside, "pb", "pg")) < MIN_PRECISION:
            failed.add(first)
            continue
        rules.append(tuple(rule))
        left = [r for r in left if not all(holds(r, c) for c in rule)]
    return rules


def between(marks: list[float]) -> list[float]:
    """Cuts midway between neighbouring marks, above the lower and at most at the higher one."""
    low = sorted(set(marks))
    return sorted({m if a < (m := (a + b) / 2) else b for a, b in zip(low, low[1:], strict=False)})


def fit(shares: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """The decision list from all labelled rows, through bounded statistics."""
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id is not null and good in (0, 1)")
    rows = shares.select("doc_id", *FEATURES).join(good, "doc_id")
    marks = []
    for f in FEATURES:
        for g in (0, 1):
            own = F.when(F.col("good") == g, F.col(f))
            marks.append(F.concat(F.percentile_approx(own, list(QUANTILES), 10_000), F.array(F.min(own), F.max(own))).alias(f"{f}{g}"))
    found = rows.agg(F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("fine"), *marks).first()
    if not found["bad"] or not found["fine"]:
        return []
    cuts = {f: between([*found[f"{f}0"], *found[f"{f}1"]]) for f in FEATURES}
    binned = rows.select("good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("grow"), *(sum((F.when(F.col(f) >= t, 1).otherwise(0) for t in cuts[f]), F.lit(0)).alias(f) for f in FEATURES))
    half = {"gb": "good = 0 and grow", "gg": "good = 1 and grow", "pb": "good = 0 and not grow", "pg": "good = 1 and not grow"}
    cells = binned.groupBy(*FEATURES).agg(*(F.count_if(F.expr(e)).alias(k) for k, e in half.items())).collect()
    return learn([r.asDict() for r in cells], cuts)


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds says bad; else good."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    keep = Scratch(docs.sparkSession, "quality")
    shares = _shares(keep.keep(measured(docs, id_col, text_col), "counts"))
    rules = fit(shares, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = shares.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Personal data by weak supervision, in DataFrame functions only.

Candidates are all matches of the base patterns (email, ip, card, phone), whether
or not they pass their checks, and of looser patterns.  Labelers vote on each
candidate: shape (a base pattern with its check), a gazetteer of trigger words
before it, what stands directly around it, placeholder digits, and words of other
numbers before it (versions, orders, prices).  A vote is 1, -1 or 0 (none).  The
table of vote patterns by kind, at most ``3 ** 5`` rows a kind, is what leaves
the executors.  Expectation-maximisation estimates from it how reliable each
labeler is without any labels; a logistic span classifier is then trained on the
patterns, weighted by their posteriors, and decides on candidates that are not
base spans.  Base spans always stay, and an added span overlaps none of them.

Candidates of each text are found in one pass and kept as a table; the decision
is a conditional expression over the votes.

Defined results: a null or empty text has no spans; without candidates nothing is
trained and nothing added; equal candidates vote alike; repeated rows each get a
row; further columns are ignored (redact() keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .scratch import Scratch
from .spans import counted, digits, find, listed, luhn

BASE = ("email", "ip", "card", "phone")
LOOSE = ("email_words", "phone_local", "social", "iban")
KINDS = (*BASE, *LOOSE)
LABELERS = ("shape", "gazetteer", "edges", "digits", "other")
#: An added span needs this posterior.
ACCEPT = 0.9

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The base patterns, written so that no run is tried twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_words": r"(?i)\b[a-z0-9._%+-]{2,64} ?[\[(] ?at ?[\])] ?[a-z0-9-]{2,63}(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]{2,63})+",
    "phone_local": r"(?<![0-9+.)-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
}
TRIGGERS = r"(?i)\b(?:address|call|card|cell|contact|e-?mail|fax|iban|mail|mobile|phone|ssn|tel|telephone|visa|whatsapp|write|correo|courriel|telefon|téléphone|tarjeta|karte)\b[^A-Za-z0-9]{0,4}(?:[A-Za-z]{1,6}[^A-Za-z0-9]{1,3})?$"
OTHERS = r"(?i)(?:\b(?:version|ver|release|isbn|issn|order|invoice|item|sku|page|chapter|section|fig|figure|price|build|rfc|id)\b|[$€£%#=/])[^A-Za-z0-9]{0,3}$"
CANDIDATE = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, shape: int, gazetteer: int, edges: int, digits: int, other: int>>"
#: A column of redact() that no table of documents has.
FOUND = "lintel_pii_candidates"
SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def _passes(kind: str, text: Column) -> Column:
    """The check of a base kind; loose kinds have their own."""
    d = digits(text)
    if kind == "ip":
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "social":
        return ~text.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return F.length(F.regexp_replace(text, " ", "")).between(15, 34)
    return F.lit(True)


def _candidates(kind: str, text: Column, when: Column) -> Column:
    def vote(s: Column) -> Column:
        d = digits(s["text"])
        ok = _passes(kind, s["text"])
        base = ok if kind in BASE else F.lit(False)
        fine = F.when(ok, 1).otherwise(-1) if kind in BASE else F.when(ok, 0).otherwise(-1)
        around = F.concat(F.right(s["before"], F.lit(1)), F.left(s["after"], F.lit(1)))
        same = (F.length(d) >= 6) & d.rlike(r"^(\d)\1+$|^0?123456")
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), fine.alias("shape"),
            F.when(s["before"].rlike(TRIGGERS), 1).otherwise(0).alias("gazetteer"),
            F.when(around.rlike(r"[\p{L}\p{N}_@+]"), -1).otherwise(1).alias("edges"),
            F.when(same, -1).otherwise(0).alias("digits"),
            F.when(s["before"].rlike(OTHERS), -1).otherwise(0).alias("other"),
        )

    return F.transform(find(text, PATTERNS[kind], 0, when), vote).cast(CANDIDATE)


def candidates(text: Column) -> Column:
    """All candidates of a text, base kinds first, each with its votes."""
    digit = text.rlike("[0-9]")
    hints = {
        "email": F.contains(text, F.lit("@")),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": digit,
        "phone": F.contains(text, F.lit("+")),
        "email_words": text.rlike(r"(?i)[\[(] ?at ?[\])]"),
        "phone_local": digit,
        "social": digit & F.contains(text, F.lit("-")),
        "iban": digit,
    }
    return F.concat(*(_candidates(k, text, hints[k]) for k in KINDS))


def estimate(patterns: dict[tuple[str, tuple[int, ...]], tuple[int, int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that each (kind, votes) is personal data. Values: how many candidates, how many of them base spans.

    Two things are known: base spans are true, and candidates that fail the check of
    their kind (shape -1) are false.  The estimates of expectation-maximisation for
    the rest, and these, are the labels of a logistic classifier over votes and kind,
    and its outputs are returned.
    """
    total = sum(n for n, _ in patterns.values())
    if not total:
        return {}
    size = len(LABELERS)
    # share of true candidates, and chance of each vote given true (1) or false (0)
    prior = 0.5
    says = {y: [{v: (0.6 if (v > 0) == (y == 1) and v else 0.2) for v in (-1, 0, 1)} for _ in range(size)] for y in (0, 1)}
    posterior: dict = {}
    for _ in range(rounds):
        for key, (n, base) in patterns.items():
            if base == n or key[1][0] < 0:
                posterior[key] = float(base == n)
                continue
            a, b = math.log(prior), math.log(1 - prior)
            for i, v in enumerate(key[1]):
                a += math.log(says[1][i][v])
                b += math.log(says[0][i][v])
            posterior[key] = 1 / (1 + math.exp(min(700, b - a)))
        weight = sum(n * posterior[k] for k, (n, _) in patterns.items())
        prior = min(0.99, max(0.01, (weight + 1) / (total + 2)))
        for y in (0, 1):
            mass = weight if y else total - weight
            for i in range(size):
                for v in (-1, 0, 1):
                    got = sum(n * (posterior[k] if y else 1 - posterior[k]) for k, (n, _) in patterns.items() if k[1][i] == v)
                    # a labeler is held to be no worse than chance: a pseudo-count on its own side
                    says[y][i][v] = (got + (2 if v and (v > 0) == (y == 1) else 1)) / (mass + 4)
    kinds = sorted({k for k, _ in patterns})
    weights = [0.0] * (2 * size + len(kinds) + 1)

    def features(key) -> list[int]:
        on = [i for i, v in enumerate(key[1]) if v > 0] + [size + i for i, v in enumerate(key[1]) if v < 0]
        return [*on, 2 * size + kinds.index(key[0]), len(weights) - 1]

    def output(key) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(weights[j] for j in features(key))))))

    for _ in range(400):
        slope = [1e-3 * w for w in weights]
        for key, (n, _) in patterns.items():
            e = (output(key) - posterior[key]) * n / total
            for j in features(key):
                slope[j] += e
        weights = [w - 2.0 * g for w, g in zip(weights, slope, strict=True)]
    return {key: output(key) for key in patterns}


def _decided(table: DataFrame, accept: float, found: str = "found") -> Column:
    """Base spans, and accepted others that overlap none of them, by kind as listed, then start."""
    votes = table.select(F.explode(found).alias("c")).groupBy("c.kind", *(f"c.{v}" for v in LABELERS)).agg(F.count("*").alias("n"), F.count_if("c.base").alias("b")).collect()
    chance = estimate({(r["kind"], tuple(r[v] for v in LABELERS)): (r["n"], r["b"]) for r in votes})
    good = sorted(":".join([k, *map(str, v)]) for (k, v), p in chance.items() if p >= accept and v[0] >= 0)
    base = F.filter(found, lambda c: c["base"])
    if good:
        name = lambda c: F.concat_ws(":", c["kind"], *(c[v].cast("string") for v in LABELERS))
        free = lambda b: F.filter(found, lambda c: ~c["base"] & name(c).isin(good) & ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))
        both = let(base, lambda b: F.concat(b, free(b)))
    else:
        both = base
    return F.transform(both, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).cast(SPAN)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end), base spans first by kind."""
    keep = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = keep.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), candidates(text).alias("found")), "found")
    return found.select("doc_id", _decided(found, accept).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from personal_data()."""
    counts = [counted("spans", k) for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets; other columns as they are."""
    keep = Scratch(docs.sparkSession, "redact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = keep.keep(docs.select("*", candidates(text).alias(FOUND)), "found")
    at = F.sort_array(F.transform(_decided(found, accept, FOUND), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    t = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        clear = s["start"] >= a["at"]  # of spans that overlap, the first is named
        piece = F.concat(a["out"], F.substr(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(clear, piece).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(at, start, step, lambda a: F.concat(a["out"], F.substr(t, (a["at"] + 1).cast("int"), F.length(t))))
    return found.withColumn(text_col, F.when(F.size(at) > 0, clean).otherwise(t)).select(*docs.columns)

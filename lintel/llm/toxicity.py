"""Toxicity by compression distance.

Two zstandard dictionaries of one size are trained from labelled text, each in two
parts.  The first is trained on ordinary text and the same in both, so that what is
common costs the same.  The second is trained on the class's own text, on those of
its words that are characteristic of it, as they follow each other; carriers stand at
the end.  A window (a word, lower-cased, with a mark at its end) is compressed
between the carriers with either dictionary.  The carriers always compress, so the
lengths differ by what the window alone costs, without the frame's overhead or
zstandard's fallback for very short input.  The share of its ordinary cost that a
window saves under the toxic dictionary is its gain.  A window whose gain is at least
a threshold is a hit of the level of its gain.  The threshold, what a hit of each
level weighs, and the logistic curve from weights to scores are calibrated on the
labelled sample.

Toxic words count by distinct pairs of neighbours, so copies of a text add nothing.
Words of ordinary training text that would be hits take the toxic words they match
out of what the dictionary is trained on.

The fit takes at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows (the smallest
hashes of the ids) with at most ``TOXIC_BYTES`` and ``ORDINARY_BYTES`` of text, whole
texts in that order; it runs on the driver.  Scoring reads every word of every text;
a task remembers at most ``CACHE`` windows.

Defined results: a null or wordless text has no hits and the score of none; null
ids and labels are not trained on; without labels of both classes every score is
0; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernel import small_batches

#: Most labelled rows, and bytes of their texts, that the fit takes of toxic and of ordinary text.
TOXIC_ROWS, TOXIC_BYTES = 2000, 4_000_000
ORDINARY_ROWS, ORDINARY_BYTES = 4000, 8_000_000
GENERAL, SPECIAL = 6144, 4096
#: A toxic word stands between at least so many different neighbours, and is so much likelier in toxic text.
CONTEXTS, ODDS = 6, 3.5
SAVED = 4
#: A text of more than this part of its class's bytes is learned from by a stretch of that length, at a place that its id's hash gives.
STRETCH = 20
THRESHOLD = 0.3
CACHE = 200_000
#: Characteristic words in one sample of the trainer.
RUN = 6
HEAD, TAIL = bytes(range(128, 144)), bytes(range(200, 216))
#: What ends a word: too short to be a reference of its own, so a word that only begins like an entry pays for it.
MARK = b"\x02\x03\x04"
WORD = re.compile(r"\w+")
#: Shares of a window's cost that part its gains into levels.
LEVELS = tuple(0.5 + 0.05 * k for k in range(10))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    """Dictionaries, the gain of a hit, the weight of a hit of each level, and slope and intercept of the score."""

    toxic: bytes
    ordinary: bytes
    gain: float
    weights: list[float]
    slope: float
    intercept: float

    def score(self, gains: list[float]) -> float:
        """Of the gains of a text's distinct windows."""
        return _logistic(self.slope * _evidence(gains, self.gain, self.weights) + self.intercept)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _level(gain: float) -> int:
    return sum(gain >= x for x in LEVELS)


def _evidence(gains: list[float], least: float, weights: list[float]) -> float:
    """Weights of the hits; a further hit of a level counts half of the one before."""
    n: Counter = Counter(_level(g) for g in gains if g >= least)
    return sum(weights[k] * (2 - 0.5 ** (c - 1)) for k, c in n.items())


class Gains:
    """Compression gains of windows under a model."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstd.ZstdCompressionParameters(window_log=14, hash_log=12, chain_log=12, search_log=5, min_match=4, strategy=zstd.STRATEGY_GREEDY, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.with_ = []
        for raw in (toxic, ordinary):
            held = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.with_.append(zstd.ZstdCompressor(dict_data=held, compression_params=params))
        self.base = [len(c.compress(HEAD + TAIL)) for c in self.with_]
        self.known: dict[str, float] = {}

    def learn(self, windows: set[str]) -> None:
        new = [w for w in windows if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(windows)
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            data = [HEAD + b" " + w.encode("utf-8", "replace") + MARK + TAIL for w in part]
            toxic, ordinary = (c.multi_compress_to_buffer(data) for c in self.with_)
            for i, w in enumerate(part):
                cost, saved = len(ordinary[i]) - self.base[1], len(ordinary[i]) - len(toxic[i])
                self.known[w] = saved / cost if saved >= SAVED and cost > 0 else 0.0

    def of(self, window: str) -> float:
        return self.known[window]


def _dictionary(general: bytes, special: bytes) -> bytes:
    return general + b"~" * (SPECIAL - len(special)) + special + b"~~~~" + TAIL + HEAD


def _entry(w: str) -> bytes:
    return b" " + w.encode("utf-8", "replace") + MARK


def _special(of: list[list[str]], ranked: list[str], banned: set[str]) -> bytes:
    """What zstandard's trainer makes of a class's characteristic words as they follow each other in its texts."""
    kept = [w for w in ranked if w not in banned]
    among = set(kept)
    said = [[_entry(w) for w in ws if w in among] for ws in of]
    samples = [b"".join(row[i : i + RUN]) for row in said for i in range(0, len(row), RUN)]
    if not samples:
        return b""
    try:
        return zstd.train_dictionary(SPECIAL + 1024, samples, k=50, d=8).as_bytes()[-SPECIAL:]
    except zstd.ZstdError:  # too little to train on: each word once, the most characteristic where references are shortest
        return b"".join(reversed([_entry(w) for w in kept]))[-SPECIAL:]


def _contexts(of: list[list[str]], asked: set[str]) -> dict[str, int]:
    """Between how many different pairs of neighbours each asked word stands."""
    around: dict[str, set[tuple[str, str]]] = {w: set() for w in asked}
    for ws in of:
        for i, w in enumerate(ws):
            if w in around:
                around[w].add((ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else ""))
    return {w: len(x) for w, x in around.items()}


def _ranked(mine: Counter, theirs: Counter, of: list[list[str]], contexts: int, odds: float) -> list[str]:
    """Words by how characteristic they are of one class: how much likelier, times the number of contexts."""
    m, t = max(1, mine.total()), max(1, theirs.total())
    likelier = {w: x for w, n in mine.items() if n >= contexts and (x := math.log((n + 0.5) / m) - math.log((theirs[w] + 0.5) / t)) >= odds}
    found = _contexts(of, set(likelier))
    return [w for _, w in sorted((-found[w] * x, w) for w, x in likelier.items() if found[w] >= contexts)]


def _kin(c: str, w: str) -> bool:
    """Whether one word's dictionary entry can stand for most of the other."""
    return c in w or (len(w) >= 4 and w in c)


def _general(of: list[list[str]]) -> bytes:
    """What zstandard's trainer makes of ordinary text, from pieces of all of it."""
    pieces = [p for ws in of for t in (" ".join(ws).encode("utf-8", "replace"),) for p in (t[i : i + 1000] for i in range(0, len(t), 1000))]
    try:
        return zstd.train_dictionary(GENERAL + 4096, pieces).as_bytes()[-GENERAL:]
    except zstd.ZstdError:  # too little text to train on
        return b" ".join(pieces)[-GENERAL:].rjust(GENERAL, b" ")


def fit(toxic: list[str], ordinary: list[str], rate: float) -> Model | None:
    """rate: the share of toxic rows among labelled rows."""
    if not toxic or not ordinary:
        return None
    once: dict[str, str] = {}  # each word is held once
    bad, good = ([[once.setdefault(w, w) for w in words(t)] for t in side] for side in (toxic, ordinary))
    general = _general(good)
    few = max(1, min(CONTEXTS, len(bad) // 10))
    said_bad, said_good = (Counter(w for ws in side for w in ws) for side in (bad, good))
    candidates = _ranked(said_bad, said_good, bad, few, ODDS)
    ordinary_special = _special(good, _ranked(said_good, said_bad, good, few, ODDS / 2), set())
    worth = Counter(w for ws in bad for w in set(ws))
    seen_good = Counter(w for ws in good for w in set(ws))
    banned: set[str] = set()
    for _ in range(4):
        dictionaries = _dictionary(general, _special(bad, candidates, banned)), _dictionary(general, ordinary_special)
        gains = Gains(*dictionaries)
        gains.learn(set(seen_good))
        false = {w: n for w, n in seen_good.items() if gains.of(w) >= 0.7}
        # Words in ordinary text that look toxic take what they match out, unless it is far more often right than wrong.
        drop = {c for c in candidates if c not in banned and (n := sum(n for w, n in false.items() if _kin(c, w))) and worth[c] * len(good) < 20 * len(bad) * n}
        if not drop:
            break
        banned |= drop

    def found(ws: list[str]) -> list[float]:
        windows = set(ws)
        gains.learn(windows)
        return [g for w in windows if (g := gains.of(w)) >= LEVELS[0]]

    of_bad, of_good = ([found(ws) for ws in side] for side in (bad, good))
    best = None
    for least in (0.55, 0.6, 0.65, 0.7, 0.75):
        tp, fp = (sum(any(g >= least for g in gs) for gs in side) / len(side) for side in (of_bad, of_good))
        tp, fp = tp * rate, fp * (1 - rate)
        quality = (2 * tp / (tp + fp + rate)) if tp else 0.0
        if best is None or quality >= best[0]:
            best = (quality, least)
    least, weights = best[1], []
    for k in range(len(LEVELS) + 1):
        b, g = (sum(any(x >= least and _level(x) == k for x in gs) for gs in side) for side in (of_bad, of_good))
        weight = math.log((b + 0.5) / (len(bad) + 1)) - math.log((g + 0.5) / (len(good) + 1)) if b + g else 0.0
        weights.append(max(0.0, weight, *weights))  # no level tells less than one below
    slope, intercept = _calibrate([_evidence(gs, least, weights) for gs in of_bad], [_evidence(gs, least, weights) for gs in of_good], rate)
    return Model(*dictionaries, least, weights, slope, intercept)


def _calibrate(bad: list[float], good: list[float], rate: float) -> tuple[float, float]:
    """A logistic curve over evidence, each class with its share of labelled rows, by Newton's method with a small ridge."""
    parts = [(x, 1, rate / len(bad) * n) for x, n in Counter(bad).items()] + [(x, 0, (1 - rate) / len(good) * n) for x, n in Counter(good).items()]
    a, b, ridge = 1.0, math.log(rate / (1 - rate)), 1e-4
    for _ in range(50):
        ga, gb, haa, hab, hbb = ridge * (a - 1), 0.0, ridge, 0.0, ridge
        for x, y, w in parts:
            p = _logistic(a * x + b)
            ga, gb, v = ga + w * (p - y) * x, gb + w * (p - y), w * p * (1 - p)
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = max(0.05, a - step * da), b - step * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return a, b


_held: dict[bytes, Gains] = {}


def _score(model, text_col: str | None = None, most: float = 1.0):
    """doc_id and score of rows with doc_id and text; or, with a text column of the struct own, the rows that score less than most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        if m is not None:
            key = m.toxic + m.ordinary
            if key not in _held:
                _held.clear()
                _held[key] = Gains(m.toxic, m.ordinary)
            gains = _held[key]
        for batch in batches:
            scores = []
            for text in batch.column("text") if text_col is None else _text_of(batch.column("own"), text_col):
                if m is None:
                    scores.append(0.0)
                    continue
                windows = set(words(text.as_py()))
                gains.learn(windows)
                scores.append(m.score([gains.of(w) for w in windows]))
            if text_col is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])
            else:
                own = batch.column("own")
                yield pa.RecordBatch.from_arrays([own, pa.array(scores, pa.float64())], ["own", "score"]).filter(pa.array([s < most for s in scores], pa.bool_()))

    return run


def _text_of(own: pa.StructArray, column: str) -> pa.Array:
    return own.field(column).cast(pa.string())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: tuple[int, int] = (ORDINARY_ROWS, TOXIC_ROWS), size: tuple[int, int] = (ORDINARY_BYTES, TOXIC_BYTES)) -> Model | None:
    """A model from a bounded sample of labelled rows: rows and bytes of the ordinary and of the toxic class."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    picked = [marked.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows[y]) for y in (0, 1)]
    ids = picked[0].union(picked[1])  # at most sum(rows) rows are broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id").where("text is not null")
    # Texts in the order of their hashes, as long as they fit; equal ones once. No text takes so much room that others have none.
    most = F.when(F.col("label") == 1, size[1] // STRETCH).otherwise(size[0] // STRETCH)
    first = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - most, F.lit(1))) + 1
    texts = texts.withColumn("text", F.when(F.length("text") <= most, F.col("text")).otherwise(F.substr("text", first.cast("int"), most)))
    ordered = texts.groupBy("label", "id", "text").agg(F.octet_length("text").cast("long").alias("bytes")).withColumn("hash", F.xxhash64("id"))
    upto = F.sum("bytes").over(Window.partitionBy("label").orderBy("hash", "id", "text"))
    fits = F.when(F.col("label") == 1, F.lit(size[1])).otherwise(F.lit(size[0]))
    sides: dict[int, set[str]] = {0: set(), 1: set()}
    for r in ordered.withColumn("upto", upto).where(F.col("upto") <= fits).select("label", "text").toLocalIterator():
        sides[r["label"]].add(r["text"])
    return fit(sorted(sides[1]), sorted(sides[0]), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(held), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, all columns as they are."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("own"))
    schema = StructType([rows.schema["own"], StructField("score", DoubleType())])
    return rows.mapInArrow(_score(held, text_col, threshold), schema).select("own.*")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's query: labels of rows with crc32(id) mod 4 other than 2 are learned from; all rows are scored."""
    out = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2
    model = train(docs, labels.where(~out), id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

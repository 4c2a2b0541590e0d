"""Token ids in files compressed by grammars (Re-Pair), readable at any place.

``write_ids`` orders documents by id, encodes their texts and cuts the stream of ids
into shards of whole documents.  Within a shard frequent pairs of neighbouring symbols
are replaced by nonterminals, again and again: a round counts all pairs, takes the
most frequent ones, replaces each where no more frequent pair overlaps it, and the
next round finds pairs of what is left.  No pair reaches across the end of a
document, so each document is a run of whole symbols.

The format is Parquet, one row per shard:

* ``part``, ``block``: the shards' order; ``n_ids``: ids in the shard;
* ``doc_ids``, ``doc_tokens``, ``doc_symbols``: its documents with their numbers of ids and symbols;
* ``base``: symbols below it are ids, symbol ``base + k`` is rule k;
* ``rules``: two little-endian unsigned 32-bit symbols a rule, those of earlier rules or ids only;
* ``lengths``: how many ids each rule expands to (unsigned 32 bits);
* ``symbols``: the sequence, little-endian, in ``width`` bytes each (2 or 4).

Expansion lengths say how many ids a symbol stands for, so a range of ids is found and
decoded without expanding what lies before it (``Shard.ids``).  A second table has the
number of ids before each shard.

Defined results: a null or empty text is the end id alone; null ids come first; rows
that share an id are kept in the order of their texts' hashes; an empty table gives no
shards and no rows; further columns are ignored.  A task holds one shard of about
``SHARD_IDS`` ids, or one longer document.  Rows that share an id may lie in several shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import U64, _odd, small_batches
from .packing import _encoder
from .scratch import Scratch

END = 1
SHARD_IDS = 1 << 20
#: Most symbols that two bytes tell apart: rules are made while there are numbers left.
SYMBOLS = 1 << 16
ROUNDS = 12
#: Fewest occurrences for which a rule takes less room than what it replaces (12 bytes against 2 each).
LEAST = 8
#: A round that shortens the sequence by less than this part is the last.
GAIN = 0.005
#: The table that pairs are counted in has 2^18 slots.
_SLOTS = 18
_ODD = _odd(31, 2 * ROUNDS).astype(np.uint32).reshape(-1, 2)
#: Shards whose totals are added up in one group.
GROUP = 1024


@dataclass
class Shard:
    """A grammar and the sequence of symbols that it expands."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        kind = "<u2" if row["width"] == 2 else "<u4"
        return cls(row["base"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["symbols"], kind))

    @cached_property
    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions one after the other, and where each begins."""
        total = np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))
        at, flat = total[:-1], np.empty(total[-1], dtype="<u4")
        needs = np.maximum.accumulate(self.rules.max(axis=1).astype(np.int64)) - self.base if len(self.rules) else at
        k = 0
        while k < len(self.rules):  # rules of one round need those of earlier rounds only
            e = int(np.searchsorted(needs, k))
            flat[total[k] : total[e]] = self._gather(self.rules[k:e].ravel(), at, flat)
            k = e
        return at, flat

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol expands to."""
        out = np.ones(len(symbols), dtype=np.int64)
        made = symbols >= self.base
        out[made] = self.lengths[symbols[made].astype(np.int64) - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self._gather(symbols, *self._rules)

    def _gather(self, symbols: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
        size = self.sizes(symbols)
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
        made = symbols >= self.base
        first = ends - size
        out[first[~made]] = symbols[~made]
        size, first = size[made], first[made]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(first, size) + inner] = flat[np.repeat(at[symbols[made].astype(np.int64) - self.base], size) + inner]
        return out

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids [start, start + count) of the shard: only the symbols that cover them are expanded."""
        ends = np.cumsum(self.sizes(self.symbols))
        a, b = np.searchsorted(ends, (start, start + count - 1), side="right")
        if count <= 0 or a >= len(ends):
            return np.empty(0, dtype="<u4")
        found = self.expand(self.symbols[a : b + 1])
        skip = start - (int(ends[a - 1]) if a else 0)
        return found[skip : skip + count]


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> tuple[Shard, np.ndarray]:
    """A sequence's grammar, and which of its symbols end a document; ends: the same of the ids."""
    base = int(ids.max(initial=0)) + 1
    room = (SYMBOLS if base < SYMBOLS else 1 << 32) - base
    s, ends = ids.astype(np.uint32), ends.copy()
    rules, lengths, made = np.empty((0, 2), dtype=np.uint32), np.empty(0, dtype=np.int64), 0
    for odd in _ODD[:rounds]:
        if len(s) < 2 or made >= room:
            break
        slot, count, at = _frequent(s, ends, least, max((room - made) // 2, min(room - made, 256)), odd)
        at = _apart(slot, count, at)
        used = np.bincount(slot[at], minlength=1 << _SLOTS)
        at = at[used[slot[at]] >= least]
        if not len(at):
            break
        kinds = np.flatnonzero(used >= least)
        number = np.zeros(1 << _SLOTS, dtype=np.uint32)
        number[kinds] = np.arange(len(kinds)) + base + made
        one = np.zeros(1 << _SLOTS, dtype=np.int64)
        one[slot[at]] = at
        one = one[kinds]
        pairs = np.stack((s[one], s[one + 1]), axis=1)
        known = np.concatenate((np.ones(1, dtype=np.int64), lengths))
        lengths = np.append(lengths, known[np.where(pairs < base, 0, pairs.astype(np.int64) - base + 1)].sum(axis=1))
        rules = np.concatenate((rules, pairs))
        s[at] = number[slot[at]]
        ends[at] = ends[at + 1]
        stay = np.ones(len(s), dtype=bool)
        stay[at + 1] = False
        s, ends = s[stay], ends[stay]
        made += len(kinds)
        if len(at) < GAIN * len(stay):
            break
    kind = "<u2" if base + made <= SYMBOLS else "<u4"
    return Shard(base, rules.astype("<u4"), lengths.astype("<u4"), s.astype(kind)), ends


def _frequent(s: np.ndarray, ends: np.ndarray, least: int, most: int, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot of the pair at each place, how often each slot is met, and the places of the ``most`` most frequent pairs at most.

    Pairs are counted in a table of slots.  A slot that is met often stands for one of the
    pairs that fall into it; the next round has other slots, so the others are met later.
    """
    slot = ((s[:-1] * odd[0] + s[1:] * odd[1]) >> np.uint32(32 - _SLOTS)).astype(np.int64)
    count = np.bincount(slot, minlength=1 << _SLOTS)
    if np.count_nonzero(count >= least) > most:
        least = int(np.partition(count, len(count) - most)[len(count) - most]) + 1
    at = np.flatnonzero((count >= least)[slot] & ~ends[:-1])
    own, pair = slot[at], s[at].astype(U64) << U64(32) | s[at + 1]
    held = np.zeros(1 << _SLOTS, dtype=U64)
    held[own] = pair
    return slot, count, at[held[own] == pair]


def _apart(slot: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places that don't overlap: every other one of a run of one pair, and where pairs overlap the more frequent one."""
    own, place = slot[at], np.arange(len(at))
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (np.diff(at) == 1) & (own[1:] == own[:-1])
    begun = np.maximum.accumulate(np.where(again, 0, place)) if len(at) else place
    at = at[(place - begun) % 2 == 0]
    own = slot[at]
    rank = count[own] * (1 << _SLOTS) + own
    near = np.diff(at) == 1
    keep = np.ones(len(at), dtype=bool)
    keep[1:] &= ~near | (rank[1:] > rank[:-1])
    keep[:-1] &= ~near | (rank[:-1] > rank[1:])
    return at[keep]


SHARDS = "part long, block long, n_ids long, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, base long, rules binary, lengths binary, width int, symbols binary"
_LISTS = {"doc_ids": pa.list_(pa.int64()), "doc_tokens": pa.list_(pa.int64()), "doc_symbols": pa.list_(pa.int64())}
_KINDS = {"part": pa.int64(), "block": pa.int64(), "n_ids": pa.int64(), **_LISTS, "base": pa.int64(), "rules": pa.binary(), "lengths": pa.binary(), "width": pa.int32(), "symbols": pa.binary()}


def _encoded(model, end: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(model.value), TaskContext.get().partitionId()
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        block = total = 0
        last = np.array([end], dtype="<u4")

        def shard() -> pa.RecordBatch:
            nonlocal block, total
            sizes = np.array([len(x) for x in held], dtype=np.int64)
            ends = np.zeros(total, dtype=bool)
            ends[np.cumsum(sizes) - 1] = True
            found, closed = compress(np.concatenate(held), ends)
            runs = np.diff(np.flatnonzero(closed), prepend=-1)
            width = found.symbols.itemsize
            row = [part, block, total, docs[:], sizes, runs, found.base, found.rules.tobytes(), found.lengths.tobytes(), width, found.symbols.tobytes()]
            block += 1
            total = 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS.values(), strict=True)], list(_KINDS))

        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                if held and total + len(ids) + 1 > shard_ids:
                    yield shard()
                docs.append(doc)
                held.append(np.append(ids, last))
                total += len(ids) + 1
        if held:
            yield shard()

    return run


@dataclass
class IdFiles:
    """Where shards lie, and how many ids stand before each."""

    shards: DataFrame
    before: DataFrame


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, shard_ids: int = SHARD_IDS, keep: Scratch | None = None) -> IdFiles:
    """Write the shards of all documents in ascending order of their ids."""
    spark = docs.sparkSession
    keep = keep or Scratch(spark, "ids")
    small_batches(spark)
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("at"))
    # The row's place comes last, so that equal rows in any number are dealt to several tasks.
    order = ("doc_id", "tie", "at")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = keep.keep(rows.mapInArrow(_encoded(model, end, shard_ids), SHARDS), "shards")
    return IdFiles(shards, keep.keep(_before(shards), "before"))


def _before(shards: DataFrame) -> DataFrame:
    """part, block, before: the number of ids before each shard.

    Parts are added up in groups of ``GROUP``, and within a group by windows, so one
    task sees a row for each group or the shards of one group only.
    """
    group = F.floor(F.col("part") / GROUP)
    rows = shards.select("part", "block", "n_ids").withColumn("g", group)
    upto = (Window.unboundedPreceding, -1)
    groups = rows.groupBy("g").agg(F.sum("n_ids").alias("n"))
    groups = groups.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(*upto)), F.lit(0)).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("g").orderBy("part", "block").rowsBetween(*upto))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0)))
    return rows.join(F.broadcast(groups), "g").select("part", "block", (F.col("base") + F.col("within")).alias("before"))


def _documents(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Each document of a shard: its id, how many ids of the shard stand before it, and its ids."""
    shard = Shard.of(row)
    a = start = 0
    for doc, tokens, symbols in zip(row["doc_ids"], row["doc_tokens"], row["doc_symbols"], strict=True):
        yield doc, start, shard.expand(shard.symbols[a : a + symbols])
        a += symbols
        start += tokens


def _decoded(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = [(doc, row["before"] + start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None) for doc, start, ids in _documents(row)]
                for k in range(0, len(out), 500):
                    columns = list(zip(*out[k : k + 500], strict=True))
                    made = [pa.array(x, pa.int64()) for x in columns[:4]] + ([pa.array(columns[4], pa.list_(pa.int64()))] if with_ids else [])
                    yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    return run


def read_ids(files: IdFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of all documents, decoded from the files."""
    rows = files.shards.join(files.before, ["part", "block"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return rows.mapInArrow(_decoded(with_ids), schema)


def read_range(files: IdFiles, start: int, count: int) -> list[int]:
    """Ids [start, start + count) of the whole stream: only the shards that they lie in are read, and only their symbols expanded."""
    rows = files.shards.join(files.before, ["part", "block"]).where((F.col("before") < start + count) & (F.col("before") + F.col("n_ids") > start))
    out: list[int] = []
    for r in rows.orderBy("before").select("before", "base", "rules", "lengths", "width", "symbols").toLocalIterator():
        first = max(start - r["before"], 0)
        out += Shard.of(r).ids(first, start + count - r["before"] - first).tolist()
    return out

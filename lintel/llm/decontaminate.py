"""Benchmark decontamination by a prefix-filtered containment join.

A window is ``size`` consecutive words of an item (an item of fewer words, but
not none, is one window).  A document word inside any occurrence of a window is
hit.  Words are runs of letters, digits and non-ASCII characters after
lower-casing A-Z.

A window's tokens are its shingles of ``shingle`` words (fewer in a shorter
window).  Full containment makes the necessary prefix of a window one token, and
the rarest is taken: a first pass counts the benchmark's shingles over all
documents, the second looks each document shingle up among the rarest tokens.
A token at place p of a document, at offset o of a window of length m, can only
be an occurrence at p - o, so p - o >= 0 (position) and p - o + m <= words of the
document (length) come first; then all m words are compared, hash by hash and
at last byte by byte.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words.  Blocks are worked
off one after the other: the hits of one are written before the next is sent, so what
is on executors at once has a bound; hits of several blocks are united by document
row.  Defined results: null or blank texts have no words and no hits; an item
without words has no window; an item without id hits words but is not listed;
items of one id count once; repeated rows each get a row; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import ALNUM, U64, chunks, small_batches
from .scratch import Scratch

WINDOW = 10
SHINGLE = 4
BLOCK_WORDS = 400_000
TABLE = 1 << 22


class Block:
    """Windows of some items, found by hash, and their shingles."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int, shingle: int):
        found: dict[bytes, set[str]] = {}
        #: by window length: the words of each window
        self.ids: list[list[str]] = []
        self.bytes: list[bytes] = []
        hashes: list[np.ndarray] = []
        for c in chunks(pa.array([t for _, t in items], pa.large_string()), ALNUM):
            for r in range(len(c)):
                a, b = int(c.off[r]), int(c.off[r + 1])
                m = min(size, b - a)
                for i in range(a, b - m + 1 if m else a):
                    key = b" ".join(bytes(c.data[s:e]) for s, e in zip(c.start[i : i + m], c.end[i : i + m], strict=True))
                    if key not in found:
                        found[key] = set()
                        self.bytes.append(key)
                        hashes.append(c.word[i : i + m].copy())
                    if items[c.first + r][0] is not None:
                        found[key].add(items[c.first + r][0])
        self.hashes, self.ids = hashes, [sorted(found[k]) for k in self.bytes]
        self.shingle = shingle
        self.grams = sorted({min(shingle, len(h)) for h in hashes})
        #: by shingle length k: sorted distinct shingles of all windows
        self.tokens = {k: np.unique(np.concatenate([_shingles(h, k) for h in hashes if min(shingle, len(h)) == k])) for k in self.grams}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Take the rarest shingle of each window: the token, its offset and the window."""
        self.table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        rows = defaultdict(list)
        for w, h in enumerate(self.hashes):
            k = min(self.shingle, len(h))
            s = _shingles(h, k)
            rare = counts[k][np.searchsorted(self.tokens[k], s)]
            o = int(np.lexsort((s, rare))[0])
            rows[k].append((int(s[o]), o, w))
        for k, found in rows.items():
            found.sort()
            token = np.array([x[0] for x in found], dtype=U64)
            self.table[k] = (token, np.array([x[1] for x in found]), np.array([x[2] for x in found]), _bits(token))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    from .kernel import PLACE, mix

    out = np.zeros(len(h) - k + 1, dtype=U64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * PLACE[i]
    return mix(out + U64(k))


def _bits(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(TABLE, dtype=bool)
    bits[(tokens & U64(TABLE - 1)).astype(np.int64)] = True
    return bits


def _within(c, k: int) -> np.ndarray:
    """Whether the k words from each on lie in one row."""
    ok = np.ones(max(0, len(c.word) - k + 1), dtype=bool)
    for b in c.off[1:-1]:
        ok[max(0, b - k + 1) : b] = False
    return ok


def _places(c, k: int, tokens: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words where a shingle of k words is one of the sorted tokens, and that shingle."""
    s = c.windows(k)
    at = np.flatnonzero(bits[(s & U64(TABLE - 1)).astype(np.int64)])
    at = at[_within(c, k)[at]]
    at = at[np.isin(s[at], tokens)]
    return at, s[at]


def _count(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        bits = {k: _bits(t) for k, t in b.tokens.items()}
        counts = {k: np.zeros(len(t), dtype=np.int64) for k, t in b.tokens.items()}
        for batch in batches:
            for c in chunks(batch.column("text"), ALNUM):
                for k, tokens in b.tokens.items():
                    _, s = _places(c, k, tokens, bits[k])
                    counts[k] += np.bincount(np.searchsorted(tokens, s), minlength=len(tokens))
        for k, n in counts.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k)), pa.array(full), pa.array(n[full])], ["k", "i", "n"])

    return run


def _occurrences(c, block: Block) -> Iterator[tuple[int, int, int]]:
    """(row, first word, window) of each occurrence in a chunk."""
    for k, (tokens, offsets, windows, bits) in block.table.items():
        at, s = _places(c, k, tokens, bits)
        if not len(at):
            continue
        lo, hi = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
        row = np.searchsorted(c.off, at, side="right") - 1
        for p, a, b, r in zip(at.tolist(), lo.tolist(), hi.tolist(), row.tolist(), strict=True):
            begin, end = int(c.off[r]), int(c.off[r + 1])
            for j in range(a, b):
                w = int(windows[j])
                h = block.hashes[w]
                q = p - int(offsets[j])
                if q < begin or q + len(h) > end or not np.array_equal(c.word[q : q + len(h)], h):
                    continue
                if b" ".join(bytes(c.data[x:y]) for x, y in zip(c.start[q : q + len(h)], c.end[q : q + len(h)], strict=True)) == block.bytes[w]:
                    yield r, q - begin, w


def _hits(block, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            n = batch.num_rows
            words, hits, items = np.zeros(n, dtype=np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
            for c in chunks(batch.column("text"), ALNUM):
                words[c.first : c.first + len(c)] = np.diff(c.off)
                for r, q, w in _occurrences(c, b):
                    hits[c.first + r].append((q, q + len(b.hashes[w])))
                    items[c.first + r].update(b.ids[w])
            spans = [_union(x) for x in hits]
            out = [batch.column("doc_id"), pa.array(words), pa.array([[{"a": a, "b": e} for a, e in x] for x in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "spans", "items"]
            if not last:
                out.append(batch.column("row"))
                names.append("row")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of bounded size, read partition by partition."""
    rows, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        rows.append((item, text))
        size += len(text or "") // 2 + 1
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (array of hit word ranges a, b), items (sorted ids)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, spans array<struct<a: long, b: long>>, items array<string>"
    blocks = (b for b in (Block(items, window, shingle) for items in _blocks(benchmark, item_col, item_text_col, block_words)) if b.hashes)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return rows.mapInArrow(_hits(spark.sparkContext.broadcast(_Empty()), True), schema)
    if following is None:
        return rows.mapInArrow(_hits(_chosen(rows, block), True), schema)
    # One block at a time: what one has found is written before the next is sent.
    keep = Scratch(spark, "decon")
    numbered = keep.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    every = None
    for i, b in enumerate(chain((block, following), blocks)):
        held = _chosen(numbered, b)
        found = keep.keep(numbered.mapInArrow(_hits(held, False), schema + ", row long").where(F.size("spans") > 0 if i else F.lit(True)), f"hits-{i}")
        held.destroy()
        every = found if every is None else every.union(found)
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.mapInArrow(_merge, schema)


def _chosen(rows: DataFrame, block: Block):
    """A broadcast of a block with the rarest shingle of each window, by counts over all rows."""
    context = rows.sparkSession.sparkContext
    held = context.broadcast(block)
    counts = {k: np.zeros(len(t), dtype=np.int64) for k, t in block.tokens.items()}
    seen = rows.select("text").mapInArrow(_count(held), "k long, i long, n long").groupBy("k", "i").agg(F.sum("n"))
    for k, i, n in seen.collect():  # no more rows than the block has shingles
        counts[k][i] = n
    held.destroy()
    block.choose(counts)
    return context.broadcast(block)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"a": a, "b": b} for a, b in _union([(x["a"], x["b"]) for x in row])] for row in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), batch.column("items")], ["doc_id", "n_words", "spans", "items"])


class _Empty:
    """A benchmark without windows."""

    table: dict = {}
    hashes: list = []
    ids: list = []


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from benchmark_hits()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    out = hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def items_hash(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def without_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, all columns as they are."""
    spark: SparkSession = docs.sparkSession
    keep = Scratch(spark, "clean")
    numbered = docs.select("*", F.monotonically_increasing_id().alias("lintel_row"))
    numbered = keep.keep(numbered, "rows")
    hits = benchmark_hits(numbered.select("lintel_row", F.col(text_col).alias("text")), benchmark, "lintel_row", "text")
    hit = keep.keep(hits.where(F.size("spans") > 0).select(F.col("doc_id").alias("lintel_row")).distinct(), "hit")
    n = hit.count()
    return numbered.join(F.broadcast(hit) if n <= 1_000_000 else hit, "lintel_row", "left_anti").select(*docs.columns)

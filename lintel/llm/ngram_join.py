"""N-gram Jaccard self-join with several global token orders.

Every text becomes its set of distinct 5-word shingles (fewer words: the whole
sequence).  Two texts link when their sets have a Jaccard similarity of at
least 0.8.  The plan:

1. One pass gives each row a 64-bit key of its word sequence, its set size, and
   counts of shingles in ``BUCKETS`` hash buckets.  Equal keys are one text from
   here on, so a hot group of copies is one node.
2. A second pass orders each set by (bucket count, hash), rare first, and sends
   out the necessary prefix, n - ceil(0.8 n) + 1 shingles.  Texts that meet in no
   prefix shingle can't link.  Shingles of buckets that count over ``HOT`` are
   dealt out by key too, so no task gets all texts of a frequent one.
3. In every group of texts with a prefix shingle the most central text is the
   pivot; (pivot, member) pairs are judged first and their components taken.  This is
   linear in the group.  Only pairs whose ends are then in different components are
   joined.
4. Pairs are held against the length bound and a parity-sketch bound (|A ^ B| is at
   least the Hamming distance of two 1024-bit parity sketches).  The ends of what is
   left get their prefixes under ``ORDERS`` further global orders (coarser rarity, then
   a hash of the order's own).  A pair must share a prefix shingle under every order:
   the filters are intersected on shingles alone, before two texts are brought together.
5. The intersections of the pairs that are left are verified exactly.

Defined results: a null or blank text has an empty set and links with nothing;
a null id never becomes a component id (a class of null ids alone has a null
one); repeated rows each get a row; other columns are ignored.  Two different
texts share a 64-bit key with probability n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .kernel import SPACED, U64, chunks, mix, small_batches
from .scratch import Scratch

WORDS = 5
SIMILARITY = 80
BUCKETS = 1 << 17
#: Further global orders beside that of rarity.
ORDERS = 2
#: Shingles of buckets with larger counts are spread by key over SPREAD groups.
HOT, SPREAD = 20_000, 64
#: Longs of a parity sketch; sets over WIDE_FROM shingles, which fill it, have a second one of WIDE longs.
SKETCH, WIDE, WIDE_FROM = 16, 256, 1000
#: Most keys sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
SEEN = 200_000


def prefix_length(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


SKETCHED = ", ".join(f"s{i} long" for i in range(SKETCH))


def _sketch(s: np.ndarray, longs: int) -> np.ndarray:
    """Bit i is the parity of the number of shingles that a hash sends to i."""
    bits = np.bincount((mix(s) >> U64(32)).astype(np.int64) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _profile(words: int):
    """A row for each text (bucket 0), then at a task's end one for each bucket of shingle counts."""
    names = ["doc_id", "key", "n", "bucket", "wide", *(f"s{i}" for i in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            rows = batch.num_rows
            wide: list[np.ndarray | None] = [None] * rows
            keys, sizes, bits = np.zeros(rows, dtype=U64), np.zeros(rows, dtype=np.int64), np.zeros((rows, SKETCH), dtype=np.int64)
            for c in chunks(batch.column("text"), SPACED):
                windows = c.windows(words)
                for r in range(len(c)):
                    s = c.shingles(r, words, windows)
                    if len(s):
                        sizes[c.first + r], keys[c.first + r], bits[c.first + r] = len(s), c.sequence(r), _sketch(s, SKETCH)
                        if len(s) > WIDE_FROM:
                            wide[c.first + r] = _sketch(s, WIDE)
                        np.add.at(counts, (s & U64(BUCKETS - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed(keys), pa.array(sizes), pa.array(np.zeros(rows, np.int64)), pa.array(wide, pa.list_(pa.int64())), *(pa.array(bits[:, i]) for i in range(SKETCH))], names)
        full = np.flatnonzero(counts)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(counts[full]), pa.array(full + 1), pa.nulls(len(full), pa.list_(pa.int64())), *[none] * SKETCH], names)

    return run


def _prefixes(words: int, similarity: int, counts):
    """token, key, n and part of each prefix shingle; part is 0 but for hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot = counts.value
        seen: set[int] = set()
        for batch in batches:
            tokens, keys, sizes = [], [], []
            for c in chunks(batch.column("text"), SPACED):
                windows = c.windows(words)
                for r in range(len(c)):
                    s = c.shingles(r, words, windows)
                    if not len(s):
                        continue
                    key = c.sequence(r)
                    if key in seen:  # a copy in the same task adds nothing
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    p = prefix_length(len(s), similarity)
                    if p < len(s):
                        order = (rank[(s & U64(BUCKETS - 1)).astype(np.int64)] << U64(40)) | (s >> U64(24))
                        s = s[np.argpartition(order, p - 1)[:p]]
                        n = len(order)
                    else:
                        n = len(s)
                    tokens.append(s)
                    keys.append(np.full(len(s), key, dtype=U64))
                    sizes.append(np.full(len(s), n, dtype=np.int32))
                    if sum(map(len, tokens[-64:])) > 200_000 or len(tokens) >= 1000:
                        yield _postings(tokens, keys, sizes, hot)
                        tokens, keys, sizes = [], [], []
            if tokens:
                yield _postings(tokens, keys, sizes, hot)

    return run


def _postings(tokens, keys, sizes, hot) -> pa.RecordBatch:
    token, key = np.concatenate(tokens), np.concatenate(keys)
    part = np.where(hot[(token & U64(BUCKETS - 1)).astype(np.int64)], 1 + (mix(key) % U64(SPREAD)).astype(np.int8), 0).astype(np.int8)
    return pa.RecordBatch.from_arrays([_signed(token), _signed(key), pa.array(np.concatenate(sizes)), pa.array(part)], ["token", "key", "n", "part"])


def _texts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Key and text of each row, copies within a task once."""
        seen: set[int] = set()
        for batch in batches:
            keys = np.zeros(batch.num_rows, dtype=U64)
            for c in chunks(batch.column("text"), SPACED):
                for r in range(len(c)):
                    if c.off[r] < c.off[r + 1] and (key := c.sequence(r)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        keys[c.first + r] = key
            full = np.flatnonzero(keys)
            yield pa.RecordBatch.from_arrays([_signed(keys[full]), batch.column("text").take(pa.array(full))], ["key", "text"])

    return run


def _under(s: np.ndarray, order: int, p: int, rarity: np.ndarray) -> np.ndarray:
    """The first p shingles of a set under a further order: coarse rarity, then a hash of that order."""
    if p >= len(s):
        return s
    own = mix(s ^ U64(0x9E3779B97F4A7C15 * (order + 1) % 2**64))
    place = (rarity[(s & U64(BUCKETS - 1)).astype(np.int64)] << U64(56)) | (own >> U64(8))
    return s[np.argpartition(place, p - 1)[:p]]


def _sets(column, words: int) -> Iterator[np.ndarray]:
    for c in chunks(column, SPACED):
        windows = c.windows(words)
        for r in range(len(c)):
            yield c.shingles(r, words, windows)


def _orders(words: int, similarity: int, rarity):
    """key, text, o0, o1, ...: texts with their prefix shingles under each further order."""
    names = ["key", "text", *(f"o{k}" for k in range(ORDERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
            for s in _sets(batch.column("text"), words):
                p = prefix_length(len(s), similarity)
                for k in range(ORDERS):
                    found[k].append(_under(s, k, p, rarity.value))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text"), *map(_lists, found)], names)

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Lists of half of each hash: two shingles that share it let a pair pass the filter, and never keep one from passing."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate([*arrays, np.empty(0, dtype=U64)]) >> U64(32)).astype(np.uint32).view(np.int32)))


def linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """The exact test on two sets."""
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < similarity * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _verify(words: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(a, b, similarity) for a, b in zip(_sets(batch.column("ta"), words), _sets(batch.column("tb"), words), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    keep = Scratch(spark, "ngram")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = keep.keep(rows.mapInArrow(_profile(words), f"doc_id long, key long, n long, bucket long, wide array<long>, {SKETCHED}"), "profile")
    members = profile.where("bucket = 0").select("doc_id", "key", "n")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, total in profile.where("bucket > 0").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        counts[bucket - 1] = total
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(U64)
    rank = spark.sparkContext.broadcast((rank, counts > HOT))
    rarity = spark.sparkContext.broadcast(np.ceil(np.log2(counts + 1)).astype(U64))

    postings = rows.select("text").mapInArrow(_prefixes(words, similarity, rank), "token long, key long, n int, part byte")
    # A group holds a token's texts, at most HOT rows of documents, or one of the parts of a hot token, which are all kept.
    group = Window.partitionBy("token", "part")
    met = postings.withColumns({"lo": F.min("key").over(group), "hi": F.max("key").over(group)}).where("lo < hi or part > 0").select("token", "key", "n").distinct()
    shared = keep.keep(met, "shared")
    sketches = profile.where("bucket = 0 and n > 0").select("key", "wide", *(f"s{i}" for i in range(SKETCH)))
    links = _links(keep, rows, shared, sketches, rarity, words, similarity)
    roots = None if links is None else components(links, keep, "all")
    if roots is None:
        roots = members.where("false").select(F.col("key").alias("node"), F.col("key").alias("root"))
    # A copy group or component of any size meets as partial minima, then in joins that can be split.
    firsts = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    classed = keep.keep(firsts.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first"), "classed")
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = keep.keep(classed.join(least, "root").select("key", "component_id"), "ids")
    keep.drop_but("profile", "ids")
    full = members.where("n > 0").join(ids, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _apart(x: str, y: str) -> Column:
    """The Hamming distance of two sketches."""
    return sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(SKETCH)), F.lit(0))


def _near(x: str, y: str, similarity: int) -> Column:
    """What sizes and sketches allow: |A ^ B| <= (100 - s) / (100 + s) * (|A| + |B|) for a similarity of s in 100."""
    sizes = F.lit(100) * F.least(f"{x}.n", f"{y}.n") >= F.lit(similarity) * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (F.lit(100 + similarity) * _apart(x, y) <= F.lit(100 - similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def _wide_near(x: str, y: str, similarity: int) -> Column:
    """The same bound by the second sketches, where both sets have one."""
    apart = F.aggregate(F.zip_with(f"{x}.wide", f"{y}.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, b: n + b)
    return F.when(F.col(f"{x}.wide").isNull() | F.col(f"{y}.wide").isNull(), F.lit(True)).otherwise(F.lit(100 + similarity) * apart <= F.lit(100 - similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def _links(keep: Scratch, rows: DataFrame, shared: DataFrame, sketches: DataFrame, rarity, words: int, similarity: int) -> DataFrame | None:
    """Verified pairs of keys, enough of them to connect every two texts that any links connect."""
    weights = shared.groupBy("token").agg(F.count("*").alias("w")).where("w > 1")
    weighed = shared.join(weights, "token").groupBy("key").agg(F.sum("w").alias("central"), F.first("n").alias("n"))
    nodes = keep.keep(weighed.join(sketches, "key").dropDuplicates(["key"]), "nodes")
    if nodes.isEmpty():
        return None
    kinds = ", ".join(f"o{k} array<int>" for k in range(ORDERS))

    def ends(texts: DataFrame, of: str, what: list[str]) -> DataFrame:
        return texts.select(F.col("key").alias(of), *(F.col(c).alias(f"{of}_{c}") for c in what))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs that sizes and sketches allow, those that meet under every further order and are similar."""
        ids = keep.keep(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), f"{name}-ids")
        texts = rows.select("text").mapInArrow(_texts(words), "key long, text string")
        texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "key").groupBy("key").agg(F.min("text").alias("text"))
        texts = keep.keep(texts.mapInArrow(_orders(words, similarity, rarity), f"key long, text string, {kinds}"), f"{name}-texts")
        orders = [f"o{k}" for k in range(ORDERS)]
        every = F.lit(True)
        for o in orders:
            every = every & F.arrays_overlap(f"a_{o}", f"b_{o}")
        met_again = keep.keep(pairs.join(ends(texts, "b", orders), "b").join(ends(texts, "a", orders), "a").where(every).select("a", "b"), f"{name}-met")
        whole = met_again.join(ends(texts, "b", ["text"]), "b").join(ends(texts, "a", ["text"]), "a")
        out = keep.keep(whole.select("a", "b", F.col("a_text").alias("ta"), F.col("b_text").alias("tb")).mapInArrow(_verify(words, similarity), "a long, b long"), name)
        keep.drop(f"{name}-texts")
        return out

    x, y = nodes.alias("x"), nodes.alias("y")

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs, those that both sketches allow."""
        both = _near("x", "y", similarity) & _wide_near("x", "y", similarity)
        return keep.keep(pairs.join(x, F.col("a") == F.col("x.key")).join(y, (F.col("b") == F.col("y.key")) & both).select("a", "b"), name)

    pivots = shared.join(nodes.select("key", "central"), "key").groupBy("token").agg(F.max(F.struct("central", "key", "n")).alias("p")).select("token", F.col("p.key").alias("a"), F.col("p.n").alias("na"))
    fits = f"100 * least(n, na) >= {similarity} * greatest(n, na)"
    stars = shared.join(pivots, "token").where(f"key <> a and {fits}").select("a", F.col("key").alias("b")).distinct()
    near = verified(likely(stars, "stars"), "near")
    roots = components(near, keep, "star")
    described = nodes.select("key", *(f"s{i}" for i in range(SKETCH)))
    described = described.withColumn("root", F.col("key")) if roots is None else described.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    described = keep.keep(described, "described")
    open_tokens = shared.join(described.select("key", "root"), "key").groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    left = keep.keep(shared.join(open_tokens, "token").join(described, "key"), "open")
    u, v = left.alias("u"), left.alias("v")
    rest = u.join(v, (F.col("u.token") == F.col("v.token")) & (F.col("u.key") < F.col("v.key")) & (F.col("u.root") != F.col("v.root")) & _near("u", "v", similarity))
    rest = likely(rest.select(F.col("u.key").alias("a"), F.col("v.key").alias("b")).distinct(), "rest")
    keep.drop("open", "shared")
    if rest.isEmpty():
        return near
    return keep.keep(near.union(verified(rest, "more")), "links")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row of each class: the one with the smallest id (null last), of equal ids the text with the smallest checksum.

    Rows without words stay as they are; so do texts that share an id but are in different classes.
    """
    spark: SparkSession = docs.sparkSession
    keep = Scratch(spark, "firsts")
    ids = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").count()
    if ids.where("id is null or count > 1").isEmpty():
        found = near_duplicates(docs, id_col, text_col, words, similarity)
        gone = keep.keep(found.where("component_id < doc_id").select(F.col("doc_id").alias("lintel_gone")), "gone")
        few = gone.count() <= BROADCAST_KEYS
        return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == F.col("lintel_gone"), "left_anti")
    # Rows get numbers of their own, so texts that share an id or have none are told apart.
    numbered = keep.keep(docs.select("*", F.monotonically_increasing_id().alias("lintel_row")), "rows")
    found = near_duplicates(numbered.select("lintel_row", F.col(text_col).alias("text")), "lintel_row", "text", words, similarity)
    found = keep.keep(found.where("n_shingles > 0").select(F.col("doc_id").alias("lintel_row"), F.col("component_id").alias("class")), "found")
    named = numbered.select("lintel_row", F.col(id_col).cast("long").alias("id"), F.crc32(F.col(text_col).cast("binary")).alias("sum"))
    ranked = keep.keep(found.join(named, "lintel_row").select("class", "lintel_row", F.struct(F.col("id").isNull().alias("none"), "id", "sum", "lintel_row").alias("place")), "ranked")
    first = ranked.groupBy("class").agg(F.min("place").alias("first")).select("class", F.col("first.lintel_row").alias("kept"))
    gone = keep.keep(ranked.join(first, "class").where("lintel_row <> kept").select("lintel_row"), "gone")
    few = gone.count() <= BROADCAST_KEYS
    keep.drop_but("rows", "gone")
    return numbered.join(F.broadcast(gone) if few else gone, "lintel_row", "left_anti").select(*docs.columns)

"""Ranked lexical search: the best documents of each query by TPUT over postings partitioned by term.

An index holds, for every term that some query asks for, the documents with it and the
term's share of their score, its impact; a term's impacts are one list, cut into several
partitions where it is long.  All queries go through it together:

1. the heads of all lists (the ``k`` highest impacts of each) give every query documents,
   whose exact scores are looked up; the k-th best of them is a lower bound t;
2. a document that is below t / m in each of a query's m lists can't reach t, so all
   lists are read down to that threshold; sums of what was read, and of the threshold
   (or a list's highest impact, if that is less) where nothing was, bound each score
   from below and above, and raise t;
3. documents whose upper bound reaches t are looked up in all lists and ranked.

A term's weight is w = floor(1000 ln((2N+2) / (2 df+1))) and its impact
w * (10^9 tf div (1000 tf + 8 m)) with m = 100 - 75 + (75 n N div L): N documents with
a term, L their terms with repeats, n those of one document, df documents with the
term, tf its occurrences there.  Terms are runs of letters and digits, ASCII letters in
lower case; they are told apart by 64-bit hashes (two of V query terms and W terms of
documents share one with probability VW / 2^64).

Defined results: a null or empty text has no terms and is never found; documents that
share an id are documents each; queries that share an id are one query with the terms
of all; queries without an id are left out; equal scores go by document id, null last,
then by the order in which the rows were read; queries without a term that any document
has, and documents with a score of 0, give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import ALNUM, chunks, small_batches
from .scratch import Scratch

K = 10
#: Most query terms that one pass over the documents asks for; more take further passes.
VOCABULARY = 2_000_000
#: Postings of a term in one partition; a term with more is dealt out to several.
PART = 200_000
#: Most rows of a side that is broadcast.
BROADCAST = 1_000_000


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text"), ALNUM):
            row = np.repeat(np.arange(len(c)), np.diff(c.off)) + c.first
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(c.word.view(np.int64))], ["item", "term"])


def _postings(asked, with_docs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uid = asked.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for c in chunks(batch.column("text"), ALNUM):
                n = np.diff(c.off)
                at = np.minimum(np.searchsorted(words, c.word), len(words) - 1)
                mine = np.flatnonzero(words[at] == c.word) if len(words) else np.empty(0, dtype=np.int64)
                row = np.searchsorted(c.off, mine, side="right") - 1
                key, tf = np.unique(row * len(words) + at[mine], return_counts=True)
                row, term = np.divmod(key, max(1, len(words)))
                yield _rows(words[term].view(np.int64), uid + c.first + row, None, tf, n[row])
                if with_docs:
                    ids = batch.column("doc_id").slice(c.first, len(c))
                    yield _rows(None, uid + c.first + np.arange(len(c)), ids, None, n)
            uid += batch.num_rows

    return run


def _rows(term, uid, doc_id, tf, n) -> pa.RecordBatch:
    made = [x if isinstance(x, pa.Array) else pa.nulls(len(uid), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (term, uid, doc_id, tf, n)]
    return pa.RecordBatch.from_arrays(made, ["term", "uid", "doc_id", "tf", "n"])


class Index:
    """Impact lists of the terms of some queries: ``postings`` (term, uid, impact), ``docs`` (uid, doc_id, n)."""

    def __init__(self, docs: DataFrame, terms: DataFrame, keep: Scratch, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, part: int = PART):
        """terms: a row for each term (its 64-bit hash) that is to have a list."""
        spark = docs.sparkSession
        small_batches(spark)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        asked = keep.keep(terms.select("term").distinct(), "terms")
        blocks = max(1, -(-asked.count() // vocabulary))
        raw = None
        for b in range(blocks):
            words = np.array([r[0] for r in asked.where(F.pmod("term", F.lit(blocks)) == b).toLocalIterator()], dtype=np.int64)
            held = spark.sparkContext.broadcast(np.sort(words.view(np.uint64)))
            found = keep.keep(rows.mapInArrow(_postings(held, not b), "term long, uid long, doc_id long, tf long, n long"), f"raw-{b}")
            held.destroy()
            raw = found if raw is None else raw.union(found)
        self.docs = keep.keep(raw.where("term is null").select("uid", "doc_id", "n"), "docs")
        raw = raw.where("term is not null").select("term", "uid", "tf", "n")
        self.documents, self.terms = self.docs.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.lists = keep.keep(self._weights(raw, part), "lists")
        self.size = self.lists.count()
        self.postings = keep.keep(self._impacts(raw), "postings")
        keep.drop(*(f"raw-{b}" for b in range(blocks)))

    def _weights(self, raw: DataFrame, part: int) -> DataFrame:
        """term, weight, parts of the terms that documents have."""
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1)))
        counts = raw.groupBy("term").agg(F.count("*").alias("df"))
        return counts.select("term", weight.cast("long").alias("weight"), F.ceil(F.col("df") / part).cast("int").alias("parts")).where("weight > 0")

    def _impacts(self, raw: DataFrame) -> DataFrame:
        m = f"25 + ((75L * n * {self.documents}L) div {max(1, self.terms)}L)"
        impact = F.expr(f"weight * ((1000000000L * tf) div (1000L * tf + 8L * ({m})))")
        rows = raw.join(small(self.lists, self.size), "term").select("term", "uid", impact.alias("impact"), F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part")).where("impact > 0")
        return rows.repartition("term", "part").sortWithinPartitions("term", F.desc("impact")).drop("part")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what is known to have few rows."""
    return F.broadcast(df) if rows <= BROADCAST else df


def best(df: DataFrame, by: str, order: list, k: int, rank: str = "place") -> DataFrame:
    """The first k rows of each group, with their place; tasks hand on k of a group at most."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


class Search:
    """TPUT for queries given as item, term, n (how often the item has the term)."""

    def __init__(self, index: Index, wanted: DataFrame, keep: Scratch, k: int = K):
        self.index, self.keep, self.k = index, keep, k
        lists = wanted.join(small(index.lists.select("term"), index.size), "term")
        #: item, term, n, m: the lists that each item reads, and how many they are
        self.wanted = keep.keep(lists.withColumn("m", F.count("*").over(Window.partitionBy("item"))), "wanted")
        self.rows = self.wanted.count()

    def bounds(self) -> DataFrame:
        """item, least: the k-th best exact score among documents at the heads of its lists."""
        heads = self.keep.keep(best(self.index.postings, "term", [F.desc("impact")], self.k), "heads")
        self.tops = self.keep.keep(heads.where("place = 1").select("term", F.col("impact").alias("top")), "tops")
        seen = heads.select("term", "uid").join(small(self.wanted.select("item", "term"), self.rows), "term").select("item", "uid").distinct()
        return self._kth(self.scores(self.keep.keep(seen, "seen")))

    def _kth(self, scores: DataFrame) -> DataFrame:
        return best(scores, "item", [F.desc("score")], self.k).where(F.col("place") == self.k).select("item", F.col("score").alias("least"))

    def scores(self, candidates: DataFrame) -> DataFrame:
        """item, uid, score of candidates (item, uid): all their postings are looked up.

        Many candidates meet the postings by document; what a document's postings give to
        its items is then added up where it is, and only postings as such are moved.
        """
        found = self.index.postings.join(small(candidates, candidates.count()), "uid")
        found = found.join(small(self.wanted.select("item", "term", "n"), self.rows), ["item", "term"])
        return found.groupBy("item", "uid").agg(F.sum(F.col("n") * F.col("impact")).alias("score"))

    def candidates(self, least: DataFrame) -> DataFrame:
        """item, uid of the documents whose upper bound reaches their item's k-th best score."""
        lists = self.wanted.join(small(self.tops, self.index.size), "term").join(small(least, self.rows), "item", "left")
        # An impact counts if n * impact * m >= least; the rest of a list is below that, and no higher than the list's top.
        level = F.expr("coalesce((least + n * m - 1) div (n * m), 1L)")
        lists = lists.withColumn("level", level).withColumn("rest", F.col("n") * F.least(F.col("level") - 1, F.col("top")))
        lists = self.keep.keep(lists.select("item", "term", "n", "level", "rest", "least"), "levels")
        # Postings that count for any item go to their document once, and to all items there.
        floor = lists.groupBy("term").agg(F.min("level").alias("floor"))
        read = self.index.postings.join(small(floor, self.index.size), "term").where("impact >= floor").select("term", "uid", "impact").repartition("uid")
        read = read.join(small(lists.select("item", "term", "n", "level", "rest"), self.rows), "term").where("impact >= level")
        sums = read.groupBy("uid", "item").agg(F.sum(F.col("n") * F.col("impact")).alias("low"), F.sum("rest").alias("met"))
        whole = lists.groupBy("item").agg(F.sum("rest").alias("all"), F.coalesce(F.max("least"), F.lit(0)).alias("least"))
        sums = sums.join(small(whole, self.rows), "item").select("item", "uid", "low", (F.col("low") + F.col("all") - F.col("met")).alias("high")).where("high >= least")
        sums = self.keep.keep(sums, "sums")
        kth = best(sums, "item", [F.desc("low")], self.k).where(F.col("place") == self.k).select("item", F.col("low").alias("kth"))
        return sums.join(small(kth, self.rows), "item", "left").where("kth is null or high >= kth").select("item", "uid")

    def top(self) -> DataFrame:
        """item, rank, doc_id, score."""
        least = self.keep.keep(self.bounds(), "least")
        scores = self.scores(self.keep.keep(self.candidates(least), "candidates"))
        # Ties go by document id, so all that reach the k-th score are looked up before they are ranked.
        ranked = F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))
        close = self.keep.keep(scores.withColumn("r", ranked).where(F.col("r") <= self.k), "close")
        named = self.index.docs.select("uid", "doc_id").join(small(close, close.count()), "uid")
        ends = best(named, "item", [F.desc("score"), F.asc_nulls_last("doc_id"), "uid"], self.k, "rank")
        return ends.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", vocabulary: int = VOCABULARY, part: int = PART) -> DataFrame:
    """item, rank, doc_id, score: the k best documents of each item."""
    keep = Scratch(docs.sparkSession, "search")
    kind = items.schema[item_col].dataType.simpleString()
    texts = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    wanted = texts.mapInArrow(_query_terms, f"item {kind}, term long").groupBy("item", "term").agg(F.count("*").alias("n"))
    wanted = keep.keep(wanted, "asked")
    index = Index(docs, wanted, keep, id_col, text_col, vocabulary, part)
    found = keep.keep(Search(index, wanted, keep, k).top(), "found")
    keep.drop_but("found")
    return found

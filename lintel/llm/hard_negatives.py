"""Hard negatives by vantage-point trees over norm-augmented vectors.

With M the largest squared norm, each vector x gets the coordinate sqrt(M - |x|^2) and an
anchor q the coordinate 0, so that d^2 = |q|^2 + M - 2 q.x: highest inner products are
nearest, and a window of scores is an annulus of distances around the anchor.

The index has two levels.  A tree fitted on a bounded sample (``CELL_SAMPLE`` rows a
cell) deals all vectors out to cells; a cell's rows are dealt to chunks of bounded size,
and each chunk has a tree of its own with exact distance intervals for each half.  An
anchor visits its nearest cell first; with the scores found there it then visits only
the cells that can hold better ones.  In a chunk, leaves are taken nearest first, those
outside the annulus are passed over, and an anchor is done when no leaf left can beat
its k-th row.  Results are exact: all distances are bounds with slack, all scores are
integers.  Anchors go through the chunks in blocks; nothing is broadcast but the cells'
tree (``CELL_VALUES`` numbers at most) and their sizes.

Defined results: rows without id, label or vector, or with a null or non-finite
component, take no part, nor do those with a scaled component beyond 2^26 (their products
pass 64 bits); shorter vectors count as filled up with zeros; repeated rows count each,
but repeated anchors once; rows with the anchor's id are never its positives or
negatives; different anchors that share an id have rows each; equal scores go by id; an
empty table, no anchors, or no row in a window give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import small_batches
from .scratch import Scratch

SCALE = 256
LARGEST = 1 << 26
#: Numbers in a chunk's matrix, rows in a leaf, chunks in a cell of even size, and most numbers in the cells' tree.
CHUNK_VALUES, LEAF, CELL_CHUNKS, CELL_VALUES = 1 << 18, 256, 4, 1 << 22
CELL_SAMPLE = 64
#: Anchors that go through a chunk together.
BLOCK = 512


def _spread(x: np.ndarray, extra: np.ndarray, limit: float) -> int:
    """Which of a few rows has the widest spread of distances to the others."""
    tries = np.unique(np.linspace(0, len(x) - 1, 6).astype(np.int64))
    some = np.unique(np.linspace(0, len(x) - 1, 256).astype(np.int64))
    return int(tries[np.argmax([_apart(x[some], extra[some], x[t], extra[t], limit).std() for t in tries])])


def _apart(x: np.ndarray, extra: np.ndarray, v: np.ndarray, ev: float, limit: float) -> np.ndarray:
    """Distances of augmented vectors to one of them."""
    return np.sqrt(np.maximum(0.0, 2 * limit - 2 * (x @ v) - 2 * extra * ev))


def _slack(limit: float) -> float:
    """More than any error of a score bound in doubles."""
    return 1 + 1e-12 * limit


class Tree:
    """A balanced vantage-point tree: 2^depth leaves, of each node the vantage vector and the distance interval of either half."""

    def __init__(self, limit: float, depth: int, vantage: np.ndarray, spans: np.ndarray):
        self.limit, self.depth, self.vantage, self.spans = limit, depth, vantage, spans

    @classmethod
    def fit(cls, x: np.ndarray, limit: float, depth: int) -> tuple[Tree, list[np.ndarray]]:
        """The tree of the rows of x, and the rows of each leaf."""
        x = x.astype(np.float64)
        extra = np.sqrt(np.maximum(0.0, limit - np.einsum("ij,ij->i", x, x)))
        parts, vantage, spans = [np.arange(len(x))], [], []
        for _ in range(depth):
            halves = []
            for rows in parts:
                v = rows[_spread(x[rows], extra[rows], limit)]
                d = _apart(x[rows], extra[rows], x[v], extra[v], limit)
                order, h = np.argsort(d, kind="stable"), len(rows) // 2
                vantage.append(x[v])
                spans.append([[d[order[0]], d[order[h - 1]]], [d[order[h]], d[order[-1]]]])
                halves += [rows[order[:h]], rows[order[h:]]]
            parts = halves
        return cls(limit, depth, np.array(vantage).reshape(-1, x.shape[1]), np.array(spans).reshape(-1, 2, 2)), parts

    def opened(self) -> Tree:
        """For rows that it was not fitted on: halves meet between their spans and reach from 0 to infinity."""
        spans = self.spans.copy()
        if self.depth:
            spans[:, 0, 1] = spans[:, 1, 0] = (self.spans[:, 0, 1] + self.spans[:, 1, 0]) / 2
            spans[:, 0, 0], spans[:, 1, 1] = 0, np.inf
        return Tree(self.limit, self.depth, self.vantage, spans)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Of an opened tree: the leaf of each row."""
        x = x.astype(np.float64)
        extra = np.sqrt(np.maximum(0.0, self.limit - np.einsum("ij,ij->i", x, x)))
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(self.depth):
            first, node = (1 << level) - 1, at.copy()
            for k in np.unique(node):
                own = np.flatnonzero(node == k)
                v = self.vantage[first + k]
                d = _apart(x[own], extra[own], v, np.sqrt(max(0.0, self.limit - v @ v)), self.limit)
                at[own] = 2 * k + (d > self.spans[first + k, 0, 1])
        return at

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor and leaf the highest and the lowest score that a row there can have."""
        q = q.astype(np.float64)
        whole = (np.einsum("ij,ij->i", q, q) + self.limit)[:, None]
        near = np.zeros((len(q), 1))
        far = np.sqrt(2 * self.limit + 2 * np.sqrt(self.limit * np.maximum(0, whole - self.limit)))
        for level in range(self.depth):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            d = np.sqrt(np.maximum(0.0, whole - 2 * (q @ self.vantage[nodes].T)))
            low, high = self.spans[nodes, :, 0], self.spans[nodes, :, 1]
            both = np.maximum(d[:, :, None] - high, low - d[:, :, None]).reshape(len(q), -1)
            near = np.maximum(np.repeat(near, 2, axis=1), both)
            far = np.minimum(np.repeat(far, 2, axis=1), (d[:, :, None] + high).reshape(len(q), -1))
        slack = _slack(self.limit)
        return (whole - near**2) / 2 + slack, (whole - far**2) / 2 - slack


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))


def _valid(vector: Column, scale: int) -> Column:
    bound = float(LARGEST) / scale
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= bound))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of one width, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), dtype=np.int32)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _windows(low: list[list[int]], high: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of some anchors as two matrices; those with fewer windows get ones that nothing meets."""
    n = max(map(len, low), default=0)
    nothing = 1 << 62
    return tuple(np.array([[*x, *[fill] * (n - len(x))] for x in side], dtype=np.int64).reshape(len(side), n) for side, fill in ((low, nothing), (high, -nothing)))


def _route(tree, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.value.leaf(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["cell", *batch.schema.names])

    return run


CHUNK = "cell int, part int, depth int, ids binary, labels binary, rows binary, vantage binary, spans binary, leaves binary"


def _chunk(limit: float, dim: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"), dim)
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        tree, leaves = Tree.fit(x, limit, depth)
        order = np.concatenate(leaves)
        own = [table.column(c).to_numpy().astype(np.int64)[order].tobytes() for c in ("id", "label")]
        sizes = np.array([len(r) for r in leaves], dtype=np.int64)
        made = [key[0].as_py(), key[1].as_py(), depth, *own, x[order].tobytes(), tree.vantage.tobytes(), tree.spans.tobytes(), sizes.tobytes()]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 6
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(made, kinds, strict=True)], [c.split()[0] for c in CHUNK.split(", ")])

    return run


class Chunk:
    def __init__(self, row: dict, limit: float, dim: int):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        exact = np.float64 if limit < 1 << 53 else np.int64
        self.rows = np.frombuffer(row["rows"], np.int32).reshape(-1, dim).astype(exact)
        self.tree = Tree(limit, row["depth"], np.frombuffer(row["vantage"]).reshape(-1, dim), np.frombuffer(row["spans"]).reshape(-1, 2, 2))
        self.ends = np.concatenate(([0], np.cumsum(np.frombuffer(row["leaves"], np.int64))))

    def nearest(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(anchor, window, id, score) of the first k rows of each anchor's windows [low, high]."""
        top, bottom = self.tree.bounds(q)
        q = q.astype(self.rows.dtype)
        order = np.argsort(-top, axis=1, kind="stable")
        every, least = np.arange(len(q)), low.copy()
        found = tuple(np.empty(0, dtype=np.int64) for _ in range(4))
        for r in range(order.shape[1]):
            leaf = order[:, r]
            if not (top[every, leaf][:, None] >= least).any():
                break  # leaves further on are no nearer
            asks = (top[every, leaf][:, None] >= least) & (bottom[every, leaf][:, None] <= high)
            new = [found]
            for n in np.unique(leaf[asks.any(axis=1)]):
                a, e = self.ends[n], self.ends[n + 1]
                who = np.flatnonzero((leaf == n) & asks.any(axis=1))
                scores = q[who] @ self.rows[a:e].T
                fits = (self.labels[a:e] == label[who, None]) == same
                fits &= self.ids[a:e] != own[who, None]
                for w in range(low.shape[1]):
                    i, j = np.nonzero(fits & (scores >= least[who, w, None]) & (scores <= high[who, w, None]))
                    new.append((who[i], np.full(len(i), w), self.ids[a:e][j], scores[i, j].astype(np.int64)))
            anchor, window, ids, score = (np.concatenate(c) for c in zip(*new, strict=True))
            first = np.lexsort((ids, -score, window, anchor))
            anchor, window = anchor[first], window[first]
            fresh = np.ones(len(first), dtype=bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
            place = np.arange(len(first)) - np.maximum.accumulate(np.where(fresh, np.arange(len(first)), 0)) if len(first) else first
            found = (anchor[place < k], window[place < k], ids[first][place < k], score[first][place < k])
            last = place == k - 1
            least[anchor[last], window[last]] = score[first][last]
        return found


ANCHOR = ("anchor", "label", "h")
FOUND = "anchor long, label long, h long, w int, id long, score long"


def _search(limit: float, dim: int, same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for i, row in enumerate(batch.drop_columns(["asked"]).to_pylist()):
                a = asked[i].values
                own, label, h = (a.field(c).to_numpy() for c in ANCHOR)
                low, high = _windows(a.field("low").to_pylist(), a.field("high").to_pylist())
                at, w, ids, score = Chunk(row, limit, dim).nearest(_matrix(a.field("v"), dim), own, label, low, high, same, k)
                made = [own[at], label[at], h[at], w.astype(np.int32), ids, score]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _visits(tree, dim: int):
    """cell and near (whether it is the anchor's nearest of those that meet its windows) of the cells that can hold what an anchor asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = _windows(batch.column("low").to_pylist(), batch.column("high").to_pylist())
            if not low.size:
                continue
            top, bottom = tree.value.bounds(_matrix(batch.column("v"), dim))
            meets = ((top[:, :, None] >= low[:, None, :]) & (bottom[:, :, None] <= high[:, None, :])).any(axis=2)
            nearest = np.argmax(np.where(meets, top, -np.inf), axis=1)
            row, cell = np.nonzero(meets)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cell, pa.int32()), pa.array(nearest[row] == cell)], [*batch.schema.names, "cell", "near"])

    return run


class Index:
    """Chunks of all rows (id, label, v) below a tree of cells."""

    def __init__(self, rows: DataFrame, keep: Scratch, chunk_values: int = CHUNK_VALUES):
        self.keep, self.spark = keep, rows.sparkSession
        square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        n, limit, dim = rows.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
        self.n, self.limit, self.dim = n, int(limit or 0), max(1, dim or 1)
        chunk = max(LEAF, chunk_values // self.dim)
        cells = min(max(1, n // (CELL_CHUNKS * chunk)), max(1, CELL_VALUES // self.dim))
        depth = int(np.log2(cells))
        sample = np.empty((0, self.dim), dtype=np.int32)
        if depth:
            first = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(CELL_SAMPLE << depth).toArrow()
            sample = _matrix(first.column("v"), self.dim)
        tree = Tree.fit(sample, float(self.limit), depth)[0].opened()
        self.tree = self.spark.sparkContext.broadcast(tree)
        routed = keep.keep(rows.select("id", "label", "v").mapInArrow(_route(self.tree, self.dim), "cell int, id long, label long, v array<int>"), "routed")
        parts = F.ceil(F.col("count") / chunk).cast("int")
        self.cells = keep.keep(routed.groupBy("cell").count().select("cell", parts.alias("parts")), "cells")
        dealt = routed.join(F.broadcast(self.cells), "cell").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"))
        self.chunks = keep.keep(dealt.select("cell", "part", "id", "label", "v").groupBy("cell", "part").applyInArrow(_chunk(float(self.limit), self.dim), CHUNK), "chunks")
        keep.drop("routed")

    def nearest(self, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """anchor, label, h, w, id, score, rank: the first k rows of each window of the anchors (anchor, label, h, v, low, high)."""
        columns = ", ".join(f"{c} {kind}" for c, kind in asked.dtypes)
        visits = asked.mapInArrow(_visits(self.tree, self.dim), f"{columns}, cell int, near boolean")
        first = self.keep.keep(self._look(visits.where("near"), same, k), f"{name}-near")
        if self.tree.value.depth == 0:
            return self._first(first, k)
        # What the nearest cell has bounds from below what the other cells must beat.
        full = self._first(first, k).where(F.col("rank") == k).groupBy(*ANCHOR).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("kth")[i], x)))
        rest = asked.join(full, list(ANCHOR), "left").withColumn("low", raised).select(*asked.columns)
        others = rest.mapInArrow(_visits(self.tree, self.dim), f"{columns}, cell int, near boolean").drop("near")
        seen = visits.where("near").select(*ANCHOR, "cell")
        others = self.keep.keep(self._look(others.join(seen, [*ANCHOR, "cell"], "left_anti"), same, k), f"{name}-far")
        return self._first(first.union(others), k)

    def _look(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """Send anchors in blocks to all chunks of the cells that they visit."""
        fields = F.struct(*ANCHOR, "v", "low", "high").alias("one")
        blocks = F.pmod(F.xxhash64(*ANCHOR), F.lit(self.blocks)).alias("block")
        sent = visits.join(F.broadcast(self.cells), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), blocks, fields)
        asked = sent.groupBy("cell", "part", "block").agg(F.collect_list("one").alias("asked"))
        return self.chunks.join(asked, ["cell", "part"]).drop("cell", "part", "block").mapInArrow(_search(float(self.limit), self.dim, same, k), FOUND)

    @staticmethod
    def _first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy(*ANCHOR, "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, k: int = 5, positives: int = 5, low: int = 80, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", chunk_values: int = CHUNK_VALUES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors.  Each has its first ``positives`` rows of its label, and
    for each of them the first k rows of other labels that score from ``low`` % of the
    positive's score up to that score.
    """
    small_batches(rows.sparkSession)
    keep = Scratch(rows.sparkSession, "negatives")
    taken = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & _valid(F.col(vec_col), scale)
    # What is compared goes by position, so columns of any other names may stand beside it.
    all_rows = rows.where(taken).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vec_col), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    every = keep.keep(all_rows, "rows")
    index = Index(every.select("id", "label", "v"), keep, chunk_values)
    asking = every.where("is_anchor").select(F.col("id").alias("anchor"), "label", F.xxhash64("v").alias("h"), "v").distinct()
    asking = keep.keep(asking, "anchors")
    index.blocks = max(1, -(-asking.count() // block))
    edge = F.lit((1 << 62)).cast("long")
    whole = asking.withColumns({"low": F.array(-edge), "high": F.array(edge)})
    near = keep.keep(index.nearest(whole, True, positives, "positives"), "positives")
    windows = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    with_windows = near.where("score >= 0").groupBy(*ANCHOR).agg(windows.alias("p"))
    bottom = F.transform("p", lambda p: F.ceil((p["score"] * low).cast("decimal(38,0)") / 100).cast("long"))
    ranges = asking.join(with_windows, list(ANCHOR)).select(*ANCHOR, "v", bottom.alias("low"), F.col("p.score").alias("high"))
    found = index.nearest(ranges, False, k, "found")
    ends = with_windows.select(*ANCHOR, F.posexplode("p").alias("w", "p"))
    out = found.join(ends, [*ANCHOR, "w"]).select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
    out = keep.keep(out, "out")
    keep.drop_but("out")
    return out

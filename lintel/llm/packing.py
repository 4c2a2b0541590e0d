"""Vector bin packing of instruction data into training sequences.

Every example has a demand vector: tokens, one segment, loss-bearing tokens.  A
sequence has a capacity for each.  Examples longer than a sequence are cut; full
pieces are sequences of their own, and the rest is placed by the dot-product
heuristic: of the open sequences that can take it whole, the one whose free
capacity has the largest dot product with its demand (both as shares of the
capacity).  If none can, a sequence is opened, and when ``POOL`` are open the
fullest one is topped up with the head of the example and closed.

Each task packs its own rows with ``POOL`` open sequences, so memory is bounded
and no row is moved; a lost task is packed again to the same result.  At a task's
end the pieces left in open sequences are laid one after the other, cut into full
sequences, and the tail into sequences whose lengths are powers of two, which
need no padding.

An example is a text whose tokens all bear loss, or with a loss column an array of
parts (a conversation's turns) and one flag for each: the tokens of flagged parts
bear loss, and the end token does if the last part does.  White space is taken to
stand between parts.

The tokenizer's file is read on the driver and sent to the tasks.  Units that recur
are remembered by 64-bit hashes of their bytes: two different units of one task share
one with probability n^2 / 2^65, and would then share their ids too.

Defined results: a null or empty text is the end token alone; no parts are the end
token alone, without loss; a null or missing flag bears no loss; repeated rows are
packed each; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED, chunks, small_batches

CAPACITY = 4096
SEGMENTS = 512
POOL = 16
END = 2
#: Most units whose ids a task remembers.
CACHE = 1_000_000


@dataclass
class Limits:
    """What one sequence can hold."""

    tokens: int = CAPACITY
    segments: int = SEGMENTS
    loss: int = CAPACITY


@dataclass
class Piece:
    """Tokens [start, start + length) of example ``row``; ``loss`` of them bear loss."""

    row: int
    start: int
    length: int
    loss: int


@dataclass
class Bin:
    tokens: int = 0
    loss: int = 0
    pieces: list[Piece] = field(default_factory=list)


class Packer:
    """Streaming packer; closed sequences are lists of pieces."""

    def __init__(self, limits: Limits, pool: int = POOL):
        self.limits, self.pool = limits, pool
        self.open: list[Bin] = []

    def _fits(self, b: Bin, p: Piece) -> bool:
        m = self.limits
        return b.tokens + p.length <= m.tokens and b.loss + p.loss <= m.loss and len(b.pieces) < m.segments

    def _gain(self, b: Bin, p: Piece) -> float:
        m = self.limits
        return (p.length / m.tokens) * (1 - b.tokens / m.tokens) + (1 / m.segments) * (1 - len(b.pieces) / m.segments) + (p.loss / m.loss) * (1 - b.loss / m.loss)

    def _put(self, b: Bin, p: Piece) -> None:
        b.pieces.append(p)
        b.tokens += p.length
        b.loss += p.loss

    def _closed(self, b: Bin) -> bool:
        return b.tokens >= self.limits.tokens or b.loss >= self.limits.loss or len(b.pieces) >= self.limits.segments

    def add(self, row: int, length: int, loss: np.ndarray | None = None) -> Iterator[list[Piece]]:
        """Place an example; loss: running count of its loss-bearing tokens, or None if all bear loss."""
        count = (lambda a, b: b - a) if loss is None else (lambda a, b: int(loss[b] - loss[a]))
        at = 0
        while at < length:
            whole = Piece(row, at, length - at, count(at, length))
            fitting = [b for b in self.open if self._fits(b, whole)]
            if fitting:
                best = max(fitting, key=lambda b: self._gain(b, whole))
                self._put(best, whole)
                at = length
                if self._closed(best):
                    self.open.remove(best)
                    yield best.pieces
                return
            if whole.length <= self.limits.tokens and whole.loss <= self.limits.loss and len(self.open) < self.pool:
                self.open.append(Bin())
                continue
            if whole.length > self.limits.tokens or whole.loss > self.limits.loss:
                target = Bin()
            else:
                target = max(self.open, key=lambda b: b.tokens)
                self.open.remove(target)
            n = self._head(target, at, length, loss)
            if n:
                self._put(target, Piece(row, at, n, count(at, at + n)))
                at += n
            yield target.pieces

    def _head(self, b: Bin, at: int, length: int, loss: np.ndarray | None) -> int:
        """How many tokens from ``at`` on the sequence can still take."""
        if len(b.pieces) >= self.limits.segments:
            return 0
        n = min(self.limits.tokens - b.tokens, length - at)
        room = self.limits.loss - b.loss
        if loss is None:
            return min(n, room)
        return min(n, int(np.searchsorted(loss[at + 1 : at + n + 1], loss[at] + room, side="right")))

    def finish(self, losses: dict[int, np.ndarray] | None = None) -> Iterator[list[Piece]]:
        """Lay what is left one after the other: full sequences, then lengths that are powers of two."""
        left = [p for b in self.open for p in b.pieces]
        self.open = []
        rest = sum(p.length for p in left)
        lengths: list[int] = []
        while rest >= self.limits.tokens:
            lengths.append(self.limits.tokens)
            rest -= self.limits.tokens
        lengths += [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        left.reverse()
        for size in lengths:
            b = Bin()
            while b.tokens < size:
                p = left.pop()
                n = min(size - b.tokens, p.length)
                loss = None if losses is None else losses.get(p.row)
                n = min(n, self._head(b, p.start, p.start + n, loss))
                if not n:
                    yield b.pieces
                    size, b = size - b.tokens, Bin()
                    left.append(p)
                    continue
                part = n if loss is None else int(loss[p.start + n] - loss[p.start])
                self._put(b, Piece(p.row, p.start, n, part))
                if n < p.length:
                    left.append(Piece(p.row, p.start + n, p.length - n, p.loss - part))
            yield b.pieces


#: Bytes of a text that a unit can end after or begin with: ASCII letters, and ASCII marks other than the apostrophe.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[0x21:0x7F] = True
MARKS[0x30:0x3A] = MARKS[0x27] = False
MARKS &= ~LETTERS


#: Texts with all that units are cut at.
PROBES = ["It's O'Neil's 'sup !'s a.b,c(d)e", "Über é日本 12,5x-y\tz\n\n w", "don't STOP;go 3.14 #tag @x_y", " lead and  trail "]


class Encoder:
    """Ids of texts by a public tokenizer file, remembered for units that recur.

    The tokenizer splits at white space and between ASCII letters and marks (the
    apostrophe is a mark that may go with letters), and lower-cases, before it does
    anything else.  So a text's ids are those of its units in order, and units that
    differ in the case of ASCII letters have the same ones.  Units are found and
    hashed as arrays; each distinct one is looked up, or encoded, once a batch.  A
    text with one of the tokenizer's special strings is encoded as a whole.  A tokenizer
    that does not give ``PROBES`` the same ids by units and as a whole is refused.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES]
        if [ids.tolist() for ids in self(pa.array(PROBES, pa.large_string()))] != whole:
            raise ValueError("this tokenizer does not split texts where the packer does")

    def _clear(self) -> None:
        #: hashes of known units in their order, and the place of each
        self.known, self.place = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.at = np.zeros(1, dtype=np.int64)
        self.flat = np.empty(0, dtype="<u4")

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column without nulls, in order."""
        for c in chunks(column, SPACED, cut=_cuts):
            special = self._special(column, c)
            hashes, first, which = np.unique(c.word, return_index=True, return_inverse=True)
            places = self._places(c, hashes, first)
            start, size = self.at[places], self.at[places + 1] - self.at[places]
            start, size = start[which], size[which]
            ends = np.concatenate(([0], np.cumsum(size)))
            ids = self.flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
            for r in range(len(c)):
                yield special[r] if r in special else ids[ends[c.off[r]] : ends[c.off[r + 1]]]

    def _special(self, column: pa.Array, c) -> dict[int, np.ndarray]:
        out = {}
        raw = c.data.tobytes()
        for mark in self.special:
            if mark.lower().encode() in raw:
                for r in range(len(c)):
                    text = column[c.first + r].as_py()
                    if mark in text:
                        out[r] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return out

    def _places(self, c, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        places = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            places = np.where(self.known[near] == hashes, self.place[near], -1)
        new = np.flatnonzero(places < 0)
        if not len(new):
            return places
        if len(self.known) + len(new) > CACHE:
            self._clear()
            new = np.arange(len(hashes))
        raw, starts, ends = c.data.tobytes(), c.start[first], c.end[first]
        sizes, ids = [], []
        for k in range(0, len(new), 1000):
            part = new[k : k + 1000].tolist()
            units = [raw[starts[i] : ends[i]].decode() for i in part]
            e = self.tokenizer.encode(units, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, dtype="<u4"))
            sizes.append(np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(part)))
        places[new] = len(self.at) - 1 + np.arange(len(new))
        at = np.searchsorted(self.known, hashes[new])
        self.known, self.place = np.insert(self.known, at, hashes[new]), np.insert(self.place, at, places[new])
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))))
        self.flat = np.concatenate((self.flat, *ids))
        return places


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether a unit ends before each byte but the first: between ASCII letters and marks."""
    letter, mark = LETTERS[data], MARKS[data]
    return (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])


_encoders: dict[str, Encoder] = {}


def _encoder(model: str) -> Encoder:
    """The encoder of this worker process, which its tasks share."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def _examples(encode: Encoder, batch: pa.RecordBatch, masked: bool, end: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Ids of each row, and the running count of those that bear loss (None: all do)."""
    last = np.array([end], dtype="<u4")
    if not masked:
        for ids in encode(batch.column("text").cast(pa.large_string()).fill_null("")):
            yield np.append(ids, last), None
        return
    rows = [parts or [] for parts in batch.column("text").to_pylist()]
    coded = iter(encode(pa.array([p or "" for parts in rows for p in parts], pa.large_string())))
    for parts, flags in zip(rows, batch.column("loss").to_pylist(), strict=True):
        flags = [bool(f) for f in [*(flags or []), *[False] * len(parts)][: len(parts)]]
        ids = [next(coded) for _ in parts]
        bears = np.repeat(np.array([*flags, bool(flags) and flags[-1]], dtype=np.int64), [*map(len, ids), 1])
        yield np.concatenate([*ids, last]), np.concatenate(([0], np.cumsum(bears)))


def _run(model, limits: Limits, pool: int, end: int, masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(model.value), Packer(limits, pool)
        base, sequence, row = TaskContext.get().partitionId() << 33, 0, 0
        #: of examples with pieces in open sequences
        held: dict[int, tuple[int, np.ndarray, np.ndarray | None]] = {}
        out: list[tuple] = []

        def close(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                doc, ids, _ = held[p.row]
                out.append((doc, p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].tobytes()), len(ids), base + sequence, offset, p.loss))
                offset += p.length
            sequence += 1

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            out.clear()
            n = len(names) if masked else len(names) - 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols[:n]], names[:n])

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for doc, (ids, loss) in zip(docs, _examples(encode, batch, masked, end), strict=True):
                held[row] = (doc, ids, loss)
                for pieces in packer.add(row, len(ids), loss):
                    close(pieces)
                row += 1
                if row % 64 == 0:
                    alive = {p.row for b in packer.open for p in b.pieces}
                    held = {r: held[r] for r in alive}
                if len(out) >= 10_000:
                    yield flush()
        for pieces in packer.finish({r: h[2] for r, h in held.items()} if masked else None):
            close(pieces)
        yield flush()

    return run


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, pool: int = POOL, end: int = END, loss_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    loss_col: flags of the parts that bear loss; text_col is then an array of parts, and each piece has its loss_tokens too.
    """
    text = F.col(text_col).cast("array<string>" if loss_col else "string").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, *([F.col(loss_col).cast("array<boolean>").alias("loss")] if loss_col else []))
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    return rows.mapInArrow(_run(model, limits or Limits(), pool, end, bool(loss_col)), SCHEMA + (", loss_tokens long" if loss_col else ""))


def examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: tuple[str, ...] = ("assistant",), turns: int = 64) -> DataFrame:
    """doc_id, part, texts, learn: conversations as examples for ``pack``, with a flag for each turn whose role is learned from.

    A conversation is cut into parts of ``turns`` turn numbers, so none is collected whole
    however long it is; turns without an id or a number are in no order and left out.
    """
    said = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(role_col).isin(*learn), F.lit(False)).alias("learn"))
    rows = conversations.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull())
    part = F.floor(F.col(turn_col) / turns).cast("long")
    parts = rows.groupBy(F.col(id_col).cast("long").alias("doc_id"), part.alias("part")).agg(F.array_sort(F.collect_list(said)).alias("said"))
    return parts.select("doc_id", "part", F.col("said.text").alias("texts"), F.col("said.learn").alias("learn"))

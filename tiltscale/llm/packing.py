"""Packing token ids into sequences, online and in bounded space.

Every partition streams its documents. Whole windows are cut off a document first; what is
left goes into that of a fixed number of open windows that it fits best. When none fits, a
new window is opened, or, once all are open, the fullest is filled with the head of the
piece and emitted, and the rest is placed in turn. At a partition's end its open windows
are leftovers: they go to fewer and fewer tasks, which pack them in the same way, until one
task is left; what it cannot fill is cut into powers of two. So no sequence has padding,
and a task holds no more than its open windows.

Each task writes its sequences to a flat file of ids (16-bit where the vocabulary allows
it, else 32-bit), one sequence after the other, and returns an index of the pieces; only
leftovers travel as rows. Files are written under a name of their own and renamed, so a
repeated task replaces what an earlier attempt left.

Each row is a document of its own, repeated ones too, and carries its doc_id, null or not.
A null text is empty; an empty text has the end id alone. Texts of any length are encoded
whole, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import shared
from .token_files import Store, encoder

#: Ids of a sequence, open windows of a task, and leftover partitions that one task merges.
LENGTH, WINDOWS, FAN_IN = 1024, 64, 16

#: ``at``: the piece's first id in the task's file. A null ``sequence``: the piece lies in an
#: open ``window`` and brings its ids along.
_PLACED = pa.schema({
    **dict.fromkeys(("doc_id", "start", "length", "doc_tokens", "offset", "part", "sequence", "at", "window"), pa.int64()), "ids": pa.binary(),
})


@dataclass
class Piece:
    """Ids of a document from ``start`` on."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Packer:
    """Places pieces; ``done`` are the emitted sequences, to be taken by the caller."""

    length: int = LENGTH
    windows: int = WINDOWS
    done: list[list[Piece]] = field(default_factory=list)
    #: (room left, window), least room first, and what the windows hold.
    room: list[tuple[int, int]] = field(default_factory=list)
    held: dict[int, list[Piece]] = field(default_factory=dict)
    opened: int = 0

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.length:
            head, piece = piece.cut(self.length)
            self.done.append([head])
        while len(piece):
            at = bisect_left(self.room, (len(piece), -1))
            if at < len(self.room):
                left, window = self.room.pop(at)
                self._put(window, left, piece)
                return
            if len(self.room) < self.windows:
                self.opened += 1
                self.held[self.opened] = []
                self._put(self.opened, self.length, piece)
                return
            left, window = self.room.pop(0)
            head, piece = piece.cut(left)
            self._put(window, left, head)

    def _put(self, window: int, left: int, piece: Piece) -> None:
        self.held[window].append(piece)
        if left == len(piece):
            self.done.append(self.held.pop(window))
        else:
            insort(self.room, (left - len(piece), window))

    def take(self) -> list[list[Piece]]:
        done, self.done = self.done, []
        return done

    def merge_all(self) -> None:
        """Fill windows from one another; what is left becomes sequences of powers of two."""
        pieces = [p for w in self.held.values() for p in w]
        last = Packer(self.length, 1)
        for p in pieces:
            last.add(p)
        self.done += last.done
        rest = [p for w in last.held.values() for p in w]
        size = sum(map(len, rest))
        for power in (1 << b for b in reversed(range(size.bit_length()))):
            if size & power:
                sequence, need = [], power
                while need:
                    head, tail = rest[0].cut(min(need, len(rest[0])))
                    sequence.append(head)
                    need -= len(head)
                    rest[:1] = [tail] if len(tail) else []
                self.done.append(sequence)
        self.room, self.held = [], {}


def _index(part: int, sequences: list[list[Piece]], first: int, at: int) -> Iterator[pa.RecordBatch]:
    """Index rows of emitted sequences, numbered from ``first`` and written from ``at`` on."""
    rows = []
    for k, sequence in enumerate(sequences, first):
        offset = 0
        for p in sequence:
            rows.append((p.doc_id, p.start, len(p), p.doc_tokens, offset, part, k, at, None, None))
            offset, at = offset + len(p), at + len(p)
    yield from _batch(rows)


def _left(part: int, held: dict[int, list[Piece]]) -> Iterator[pa.RecordBatch]:
    for window, pieces in held.items():
        yield from _batch([(p.doc_id, p.start, len(p), p.doc_tokens, k, part, None, None, window, p.ids.tobytes()) for k, p in enumerate(pieces)])


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _PLACED.types, strict=True)], schema=_PLACED)


def _packed(streams: Iterator[Iterator[Piece]], path: str, stage: int, length: int, windows: int, last: bool) -> Iterator[pa.RecordBatch]:
    part, packer, store, out, count, at = TaskContext.get().partitionId(), Packer(length, windows), Store(path), None, 0, 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal count, at, out, pending
        done = packer.take()
        if done and out is None:
            out, pending = store.create(name), store.pending
        for sequence in done:
            for p in sequence:
                out.write(p.ids.tobytes())
        yield from _index(part, done, count, at)
        count, at = count + len(done), at + sum(len(p) for s in done for p in s)

    name, pending = f"sequences-{stage}-{part}", ""
    for pieces in streams:
        for p in pieces:
            packer.add(p)
        yield from emit()
    if last:
        packer.merge_all()
        yield from emit()
    if out is not None:
        out.close()
        store.commit(name, pending)
    yield from _left(part, packer.held)


def _first(docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int, windows: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))

    def documents(batch: pa.RecordBatch, enc) -> Iterator[Piece]:
        end = np.array([end_id], enc.dtype).tobytes()
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.frombuffer(enc.encode(text.as_py()) + end, enc.dtype)
            yield Piece(i, 0, ids, len(ids))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        yield from _packed((documents(b, enc) for b in batches), path, 0, length, windows, False)

    return rows.mapInArrow(shared.tidy(pack), from_arrow_schema(_PLACED))


def _next(left: DataFrame, path: str, tokenizer: str, stage: int, length: int, windows: int, last: bool) -> DataFrame:
    """One round over leftovers, whose ``part`` says with which others they are merged."""

    def pieces(batch: pa.RecordBatch, dtype: np.dtype) -> Iterator[Piece]:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        return (Piece(i, s, np.frombuffer(ids, dtype), n) for i, s, ids, n in zip(*columns, strict=True))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        yield from _packed((pieces(b, dtype) for b in batches), path, stage, length, windows, last)

    place = F.floor(F.col("part") / FAN_IN)
    tasks = shared.partitions(left.sparkSession)
    dealt = left.withColumn("__to", place).repartition(tasks, "__to").sortWithinPartitions("__to", "part", "window", "offset").drop("__to")
    return dealt.mapInArrow(shared.tidy(pack), from_arrow_schema(_PLACED))


def pack(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """Write all documents' sequences below ``path``; returns the index of their pieces.

    doc_id, start, length, doc_tokens, sequence_id (0 to the number of sequences less one),
    offset in the sequence, and where the ids are: stage and part of the file, and at.
    """
    stages, kept = [], ["doc_id", "start", "length", "doc_tokens", "offset", "part", "sequence", "at"]
    found = shared.materialize(_first(docs, path, tokenizer, end_id, length, windows), "packed")
    while True:
        stages.append(found.where("sequence IS NOT NULL").select(*kept, F.lit(len(stages)).alias("stage")))
        left = found.where("sequence IS NULL")
        # tasks that left something are numbered without gaps, so that each round has a FAN_IN-th of the tasks before it
        parts = left.select("part").distinct().withColumn("__new", F.row_number().over(Window.orderBy("part")) - 1)
        tasks = parts.count()
        if not tasks:
            break
        left = left.join(parts, "part").withColumn("part", F.col("__new").cast("long")).drop("__new")
        found = shared.materialize(_next(left, path, tokenizer, len(stages), length, windows, tasks <= FAN_IN), "packed")
    every = stages[0]
    for more in stages[1:]:
        every = every.unionByName(more)
    # each task's first sequence id, from prefix sums over one row a task
    counts = every.groupBy("stage", "part").agg((F.max("sequence") + 1).alias("n"))
    before = Window.orderBy("stage", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shared.materialize(counts.select("stage", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packed-bases")
    return every.join(bases, ["stage", "part"]).withColumn("sequence_id", F.col("base") + F.col("sequence")).drop("base", "sequence")


def read_pieces(index: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """``index`` with ids, little-endian unsigned 32-bit integers, from the files; neighbouring rows are read at once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, dtype = Store(path), encoder(tokenizer).dtype
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, len(whole), 1000)):
                stage, part, at, n = (batch.column(c).to_numpy() for c in ("stage", "part", "at", "length"))
                # runs of rows that follow each other in a file
                apart = (np.diff(stage) != 0) | (np.diff(part) != 0) | (at[1:] != at[:-1] + n[:-1])
                starts, ids = [0, *(np.flatnonzero(apart) + 1).tolist(), len(at)], []
                for i, j in zip(starts, starts[1:], strict=False):
                    data = store.read(f"sequences-{stage[i]}-{part[i]}", dtype, int(at[i]), int(at[j - 1] + n[j - 1])).astype("<u4")
                    ids += [data[a : a + m].tobytes() for a, m in zip((at[i:j] - at[i]).tolist(), n[i:j].tolist(), strict=True)]
                yield batch.append_column("ids", pa.array(ids, pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(shared.tidy(scan), f"{schema}, ids binary")


def sequences(pieces: DataFrame, pad_id: int, length: int = LENGTH) -> DataFrame:
    """One training row per sequence of ``read_pieces``: sequence_id, ids (array, padded to ``length`` unless as
    many as a power of two) and starts, where its pieces begin (for attention masks)."""

    @F.pandas_udf("array<long>")
    def ids(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: np.frombuffer(b"".join(p), "<u4").astype(np.int64))

    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    rows = whole.select("sequence_id", ids(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
    n = F.size("ids")
    missing = F.when(F.expr("bit_count(size(ids))") == 1, 0).otherwise(length - n)
    return rows.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), missing)))


def sequence_dir(spark: SparkSession) -> str:
    return shared.new_dir(spark, "sequences")

"""Alignment of two tokenizers' tokens by the bytes they cover.

A text is read with a space before it. Where a space follows something else, both
tokenizers end a token, and what lies between two such cuts is tokenised on its own. A
*fragment* is what is known of a byte range: an open prefix up to its first cut, the closed
groups between its cuts, and an open suffix after its last. Fragments compose: suffix and
prefix that meet become groups as well. Composition is associative, so texts beyond
``CHUNK`` bytes are dealt out as byte ranges, made fragments by many tasks and composed in
a tree, FAN_IN neighbours a task and round. Other texts are one range in one task.

Documents are kept in blocks: the distinct stretches between cuts are aligned once a block,
and documents are lists of them. Pairs of ids are counted by block before they are shuffled,
so the commonest pair has one row a block, both for the counts and on their way back.

Nulls, empty texts, and texts whose tokens' bytes are not the text with a space before it,
have no tokens and add to no count. Each row is a document, repeated ones too, with its
doc_id or null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import pieces, shared
from .token_files import _is_byte_level

#: Bytes of a range, and neighbouring fragments that one step composes.
CHUNK, FAN_IN = 65_536, 16
#: Characters that a tokenizer gets at once.
AT_ONCE = 32_768
#: Before a space that follows no white space (nor the mark that stands for it) and does not end the range.
CUT = re.compile(rf"(?<=[^\s{pieces.MARK}])(?= .)", re.S)
ALONE = re.compile(rf"\s\Z|{pieces.MARK}")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Tokens:
    """Ids of both sides, each side's tokens by group, and groups by stretch, one after the other."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    n_groups: np.ndarray

    @classmethod
    def none(cls) -> Tokens:
        """A stretch without tokens."""
        return cls(*(np.zeros(0, np.int32) for _ in range(4)), np.zeros(1, np.int32))

    @classmethod
    def concat(cls, parts: list[Tokens]) -> Tokens:
        return cls(*(np.concatenate([np.zeros(0, np.int32), *(getattr(t, c) for t in parts)]).astype(np.int32) for c in cls.__dataclass_fields__))

    @classmethod
    def parse(cls, strings: list[str]) -> Tokens:
        """Back from ``strings``."""
        sides = [[[x.split(",") for x in g.split("|")] for g in text.split(";")[:-1]] for text in strings]
        ids = [[int(i) for groups in sides for g in groups for i in g[k]] for k in (0, 1)]
        sizes = [[len(g[k]) for groups in sides for g in groups] for k in (0, 1)]
        return cls(*(np.array(v, np.int32) for v in (*ids, *sizes, [len(groups) for groups in sides])))

    def strings(self) -> list[str]:
        """The groups of each stretch: ids joined by commas, sides by bars, each group ended by a semicolon."""
        ends, out = (np.cumsum(self.a_sizes), np.cumsum(self.b_sizes)), np.empty(len(self.a) + len(self.b), object)
        # a group's tokens of A come before those of B
        for ids, size, mine, others, mark in ((self.a, self.a_sizes, ends[0], ends[1] - self.b_sizes, "|"), (self.b, self.b_sizes, ends[1], ends[0], ";")):
            text = np.array([*map(str, ids.tolist())], object) + ","
            text[mine - 1] = [f"{i}{mark}" for i in ids[mine - 1].tolist()]
            out[np.arange(len(ids)) + np.repeat(others, size)] = text
        at = np.concatenate([[0], np.cumsum(self.n_groups)])
        cut = np.concatenate([[0], ends[0] + ends[1]])[at].tolist()
        words = out.tolist()
        return ["".join(words[i:j]) for i, j in zip(cut, cut[1:], strict=False)]

    def pairs(self) -> np.ndarray:
        """Of each group the last ids, which end together: A's in the upper 32 bits, B's in the lower."""
        return self.a[np.cumsum(self.a_sizes) - 1].astype(np.int64) << 32 | self.b[np.cumsum(self.b_sizes) - 1]

    def by_stretch(self, each: np.ndarray) -> np.ndarray:
        """Sums over the groups of each stretch."""
        total = np.concatenate([[0], np.cumsum(each.astype(np.int64))])
        return np.diff(total[np.concatenate([[0], np.cumsum(self.n_groups)])])


class Aligner:
    """Groups of two tokenizers: a byte-level one (A) and a SentencePiece model that adds a space (B)."""

    def __init__(self, a: str, b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters, entries = _byte_letters(), {i: p for p, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(letters[c] for c in entries[i]) if i in entries and all(c in letters for c in entries[i]) else entries.get(i, "").encode() for i in range(max(entries) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in each]) for each in (self.a_bytes, self.b_bytes))
        self.cuts = _is_byte_level(a) and self._cut_model(b)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(pieces.MARK, " ").encode()

    def _cut_model(self, path: str) -> bool:
        """Whether the model leaves texts as they are and no piece goes on over a space."""
        try:
            plain = pieces.model(path).plain
        except ValueError:  # not a byte-pair model
            return False
        return plain and not any(pieces.MARK in self.b.id_to_piece(i).lstrip(pieces.MARK) for i in range(self.b.get_piece_size()))

    def stretches(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def _run(self, run: list[str]) -> Tokens | None:
        """Of stretches that may be tokenised in one go; nothing where the tokens' bytes are not
        theirs or no token of one side ends where a stretch does."""
        text = "".join(run)
        a, b = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32), np.array(self.b.encode(text[1:]), np.int32)
        data = text.encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != data or b"".join([self.b_bytes[i] for i in b.tolist()]) != data:
            return None
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(a_end, b_end)
        ends = np.cumsum([len(s) for s in run] if len(text) == len(data) else [len(s.encode()) for s in run])
        last = np.searchsorted(both, ends)
        if last[-1] >= len(both) or (both[last] != ends).any():
            return None
        # tokens without bytes stay with the group that they end with
        sizes = [np.diff(np.searchsorted(e, both, "right"), prepend=0).astype(np.int32) for e in (a_end, b_end)]
        return Tokens(a, b, *sizes, np.diff(last + 1, prepend=0).astype(np.int32))

    def tokens(self, stretches: list[str]) -> Tokens:
        """The tokens of all stretches; those whose tokens' bytes are not their own have none."""
        out, run, size = [], [], 0

        def end() -> None:
            nonlocal run, size
            if run:
                found = self._run(run)
                out.extend([found] if found else [self._run([s]) or Tokens.none() for s in run])
            run, size = [], 0

        for s in stretches:
            alone = not self.cuts or ALONE.search(s) is not None
            if alone or size > AT_ONCE:
                end()
            run.append(s)
            size += len(s)
            if alone:
                end()
        end()
        return Tokens.concat(out)

    def align(self, stretches: list[str]) -> list[str]:
        """The groups of each stretch, ``a1,a2|b1;a3|b2;``; empty where it has no tokens."""
        return self.tokens(stretches).strings()

    def align_text(self, text: str) -> list[str]:
        return self.align(self.stretches(text))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


@dataclass
class Fragment:
    """A byte range of a text; without a cut in it (``closed`` is None) all of it is ``head``."""

    head: str
    closed: list[str] | None = None
    tail: str = ""

    @classmethod
    def of(cls, text: str, by: Aligner) -> Fragment:
        first, *rest = by.stretches(text)
        return cls(first, by.align(rest[:-1]), rest[-1]) if rest else cls(first)

    def then(self, other: Fragment, by: Aligner) -> Fragment:
        if self.closed is None:
            return Fragment(self.head + other.head, other.closed, other.tail)
        if other.closed is None:
            return Fragment(self.head, self.closed, self.tail + other.head)
        return Fragment(self.head, self.closed + by.align_text(self.tail + other.head) + other.closed, other.tail)

    def close(self, by: Aligner) -> list[str]:
        """The groups of the whole text."""
        if self.closed is None:
            return by.align_text(self.head)
        return by.align_text(self.head) + self.closed + by.align_text(self.tail)


def _packed(values: np.ndarray) -> bytes:
    """Compressed, after its size: blocks are written once and shuffled once."""
    return values.nbytes.to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), dtype)


class Block:
    """Documents as lists of stretches, the distinct stretches' tokens, and the counts of their links."""

    SCHEMA = pa.schema({
        "block": pa.string(), "doc_id": pa.list_(pa.int64()), "sizes": pa.binary(), "index": pa.binary(),
        **dict.fromkeys(Tokens.__dataclass_fields__, pa.binary()), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()),
    })

    def __init__(self) -> None:
        self.doc_id: list[int | None] = []
        self.index: list[np.ndarray] = []
        self.at: dict[str, int] = {}

    def add(self, doc_id: int | None, stretches: list[str]) -> None:
        at = self.at
        self.doc_id.append(doc_id)
        self.index.append(np.array([at.setdefault(s, len(at)) for s in stretches], np.int32))

    def row(self, name: str, tokens: Tokens) -> pa.RecordBatch:
        """``tokens``: of the distinct stretches in their order. A document with one that has none has none."""
        none = tokens.n_groups == 0
        index = [i if len(i) and not none[i].any() else i[:0] for i in self.index]
        flat = np.concatenate([np.zeros(0, np.int32), *index])
        used = np.bincount(flat, minlength=len(self.at))
        pairs, links = np.unique(tokens.pairs(), return_inverse=True)
        counts = np.bincount(links, weights=np.repeat(used, tokens.n_groups), minlength=len(pairs)).astype(np.int64)
        row = {"block": name, "doc_id": self.doc_id, "sizes": _packed(np.array([len(i) for i in index], np.int64)), "index": _packed(flat.astype(np.int32)), "pairs": pairs, "counts": counts}
        row |= {c: _packed(getattr(tokens, c)) for c in Tokens.__dataclass_fields__}
        return pa.RecordBatch.from_pydict({c: [row[c]] for c in self.SCHEMA.names}, self.SCHEMA)


def _whole(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Blocks of documents that are one range each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, part = aligner(a, b), TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            block = Block()
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t = text.as_py()
                block.add(i, by.stretches(" " + t) if t else [])
            yield block.row(f"whole-{part}-{k}", by.tokens(list(block.at)))

    return docs.mapInArrow(shared.tidy(scan), from_arrow_schema(Block.SCHEMA))


_CHUNKS = pa.schema({"text_key": pa.string(), "doc_id": pa.int64(), "at": pa.int64(), "last": pa.int64(), "text": pa.string()})
_FRAGMENTS = pa.schema({
    "text_key": pa.string(), "doc_id": pa.int64(), "at": pa.int64(), "last": pa.int64(), "head": pa.string(), "cut": pa.bool_(), "groups": pa.list_(pa.string()), "index": pa.binary(), "tail": pa.string()
})


def _ranges(docs: DataFrame, chunk: int) -> DataFrame:
    """The byte ranges of long texts, cut between characters and numbered, under a key of their row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data, ends = (" " + text.as_py()).encode(), [0]
                while ends[-1] < len(data):
                    end = min(ends[-1] + chunk, len(data))
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                    ends.append(end)
                texts = [data[x:y].decode() for x, y in zip(ends, ends[1:], strict=False)]
                n, m = n + 1, len(texts)
                yield pa.RecordBatch.from_pydict({"text_key": [f"{part}-{n}"] * m, "doc_id": [i] * m, "at": range(m), "last": [m - 1] * m, "text": texts}, _CHUNKS)

    return docs.mapInArrow(shared.tidy(scan), from_arrow_schema(_CHUNKS))


def _fragment_row(key: str, doc_id: int | None, at: int, last: int, f: Fragment) -> pa.RecordBatch:
    groups: dict[str, int] = {}
    index = np.array([groups.setdefault(g, len(groups)) for g in f.closed or []], np.int32)
    row = (key, doc_id, at, last, f.head, f.closed is not None, list(groups), index.tobytes(), f.tail)
    return pa.RecordBatch.from_pydict({c: [v] for c, v in zip(_FRAGMENTS.names, row, strict=True)}, _FRAGMENTS)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[str, int | None, int, int, Fragment]]:
    for row in batch.to_pylist():
        closed = [row["groups"][i] for i in np.frombuffer(row["index"], np.int32)] if row["cut"] else None
        yield row["text_key"], row["doc_id"], row["at"], row["last"], Fragment(row["head"], closed, row["tail"])


def _composed(fragments: DataFrame, a: str, b: str) -> DataFrame:
    """One fragment for each run of FAN_IN neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, now = aligner(a, b), None
        for batch in batches:
            for key, doc_id, at, last, f in _read(batch):
                if now and now[:3] == (key, doc_id, at // FAN_IN):
                    now = (*now[:4], now[4].then(f, by))
                else:
                    if now:
                        yield _fragment_row(*now)
                    now = (key, doc_id, at // FAN_IN, last // FAN_IN, f)
        if now:
            yield _fragment_row(*now)

    run = F.floor(F.col("at") / FAN_IN)
    dealt = fragments.withColumn("__run", run).repartition(shared.partitions(fragments.sparkSession), "text_key", "__run").sortWithinPartitions("text_key", "at").drop("__run")
    return dealt.mapInArrow(shared.tidy(scan), from_arrow_schema(_FRAGMENTS))


def _long(docs: DataFrame, a: str, b: str, chunk: int) -> DataFrame:
    """Blocks of the documents that are dealt out as byte ranges."""
    spark = docs.sparkSession

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a, b)
        for batch in batches:
            for row in batch.to_pylist():
                yield _fragment_row(row["text_key"], row["doc_id"], row["at"], row["last"], Fragment.of(row["text"], by))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, part, k = aligner(a, b), TaskContext.get().partitionId(), 0
        block, held = Block(), 0
        for batch in batches:
            for _, doc_id, _, _, f in _read(batch):
                block.add(doc_id, f.close(by))
                held += len(block.index[-1])
                if held > 500_000:
                    yield block.row(f"long-{part}-{k}", Tokens.parse(list(block.at)))
                    block, held, k = Block(), 0, k + 1
        if block.doc_id:
            yield block.row(f"long-{part}-{k}", Tokens.parse(list(block.at)))

    ranges = shared.materialize(_ranges(docs, chunk), "align-ranges")
    dealt = ranges.repartition(shared.partitions(spark), "text_key", "at")
    found = shared.materialize(dealt.mapInArrow(shared.tidy(lift), from_arrow_schema(_FRAGMENTS)), "align-fragments")
    while found.agg(F.max("last")).first()[0]:
        spent, found = found, shared.materialize(_composed(found, a, b), "align-fragments")
        shared.discard(spent)
    return found.mapInArrow(shared.tidy(close), from_arrow_schema(Block.SCHEMA))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A's id in the upper 32 bits, B's in the lower), n (its links in all documents) and
    best, whether no pair of that B id has more."""
    met = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = shared.materialize(met.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(docs: DataFrame, a: str, b: str, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other of
    its B id outnumbers), count_sum (of its links' counts) and groups (``a1,a2|b1;a3|b2``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    blocks = _whole(rows.where(~is_long), a, b).unionByName(_long(rows.where(is_long), a, b, chunk))
    blocks = shared.materialize(blocks, "align-blocks")
    met = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(blocks), "pair")
    back = met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("c"))
    counted = back.select("block", F.transform("c", lambda x: x["n"]).alias("n"), F.transform("c", lambda x: x["best"]).alias("best"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                tokens = Tokens(*(_unpacked(one[c], np.int32) for c in Tokens.__dataclass_fields__))
                index, ends = _unpacked(one["index"], np.int32), np.cumsum(_unpacked(one["sizes"], np.int64))
                links = np.unique(tokens.pairs(), return_inverse=True)[1]
                n, best = (np.array(one[c] or [], np.int64) for c in ("n", "best"))
                each = [tokens.by_stretch(v) for v in (tokens.a_sizes, tokens.b_sizes)] + [tokens.n_groups, tokens.by_stretch(best[links]), tokens.by_stretch(n[links])]
                sums = [np.diff(np.concatenate([[0], np.cumsum(v[index].astype(np.int64))])[np.concatenate([[0], ends])]) for v in each]
                groups, index, begin, text = tokens.strings(), index.tolist(), 0, []
                for end in ends.tolist():
                    text.append("".join([groups[i] for i in index[begin:end]])[:-1])
                    begin = end
                columns = [one["doc_id"], *sums[:3], sums[2], *sums[3:], text]
                names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
                whole = pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c == "groups" else pa.int64()) for c, v in zip(names, columns, strict=True)})
                yield from (whole.slice(i, 500) for i in range(0, len(whole), 500))

    return blocks.drop("pairs", "counts").join(counted, "block", "left").mapInArrow(shared.tidy(total), _ALIGNED)

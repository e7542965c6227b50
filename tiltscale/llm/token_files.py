"""Token ids as flat binary files that are memory-mapped, and their reader.

Documents are range-partitioned by id; each partition writes ``ids-N`` (unsigned 16-bit
little-endian ids where the vocabulary allows it, else 32-bit), ``keys-N`` (64-bit
document ids) and ``lens-N``. Prefix sums over the partitions' token counts give each
partition its base, and ``offsets-N`` (64-bit, one more than documents) is written with
positions in the whole corpus. Files are written under a name of their own and renamed,
so a repeated task replaces what an earlier attempt left.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: A null document id is written as the smallest 64-bit integer, and read as null.
NULL_KEY = -(2**63)
#: Bytes that a worker spends on remembering pre-tokens, and of an entry besides its ids and letters.
MEMORY, ENTRY = 96_000_000, 210

MANIFEST = "shard int, docs long, tokens long"


def _word_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern over Latin-1, with its classes written out."""
    chars = [chr(i) for i in range(256)]
    space = "".join(c for c in chars if c in "\t\n\x0b\x0c\r \x85\xa0")
    letters = "".join(c for c in chars if unicodedata.category(c)[0] == "L")
    digits = "".join(c for c in chars if unicodedata.category(c)[0] == "N")
    s, l, n = map(re.escape, (space, letters, digits))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them.

    Pre-tokens are independent of each other, so each distinct one is encoded by the
    library once and remembered. A text beyond Latin-1, or with a special token's string,
    is encoded by the library whole; so is every text if the tokenizer file names another
    normalizer or pre-tokenizer than the plain byte-level one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.spaced_word = _word_pattern(), re.compile(r" [^\W\d_]+").fullmatch
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids of pieces that begin with a space
        for piece, i in self.tokenizer.get_vocab().items():
            self.starts[i] = piece[0] == "\u0120"
        self.known: dict[str, bytes] = {}
        self.used, self.cuts = 0, _is_byte_level(path)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cuts:
            return self.library(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.library(text)
        if any(s in text for s in self.special):
            return self.library(text)
        known, words = self.known, self.words.findall(text)
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        new = {w for w in words if w not in known}
        if self.used > MEMORY:
            known.clear()
            self.used, new = 0, set(words)
        self.used += sum(map(len, new)) * (1 + self.dtype.itemsize) + ENTRY * len(new)
        # words with a space before them are encoded in one string: only their first pieces begin with a space
        spaced = [w for w in new if self.spaced_word(w)]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.starts[ids]) * self.dtype.itemsize
        if len(at) == len(spaced):
            data, at = ids.tobytes(), [*at.tolist(), ids.nbytes]
            known.update((w, data[a:b]) for w, a, b in zip(spaced, at, at[1:], strict=False))
            new.difference_update(spaced)
        new = list(new)
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, self.dtype).tobytes()
        return b"".join([known[w] for w in words])


def _is_byte_level(path: str) -> bool:
    """Whether the tokenizer cuts texts by the pattern of ``_word_pattern`` and changes nothing before or after."""
    with open(path, "rb") as f:
        found = json.load(f)
    cut, model = found.get("pre_tokenizer") or {}, found["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
    added = all(t.get("special") and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in found.get("added_tokens") or [])
    return plain and added and not found.get("normalizer") and not found.get("truncation") and not found.get("padding") and not model.get("dropout") and not model.get("ignore_merges")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Store:
    """Binary files below a shared folder: a mounted path, or any store pyarrow knows."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = None, re.sub(r"^file:/+", "/", uri)
        if "://" in self.root:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)
            self.fs.create_dir(self.root)
        else:
            os.makedirs(self.root, exist_ok=True)

    def create(self, name: str):
        """A writable file under a temporary name; ``commit`` gives it its own."""
        self.pending = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        return self.fs.open_output_stream(self.pending) if self.fs else open(self.pending, "wb")

    def commit(self, name: str, pending: str) -> None:
        (self.fs.move if self.fs else os.replace)(pending, f"{self.root}/{name}")

    def write(self, name: str, data: np.ndarray) -> None:
        with self.create(name) as out:
            out.write(data.tobytes())
        self.commit(name, self.pending)

    def map(self, name: str, dtype) -> np.ndarray:
        """Memory-mapped where the folder is mounted, else read."""
        at = f"{self.root}/{name}"
        if self.fs:
            return np.frombuffer(self.fs.open_input_stream(at).read(), dtype)
        return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.empty(0, dtype)

    def read(self, name: str, dtype: np.dtype, begin: int, end: int) -> np.ndarray:
        """Items ``begin`` to ``end`` of a file, without the rest of it."""
        at, first, size = f"{self.root}/{name}", begin * dtype.itemsize, (end - begin) * dtype.itemsize
        with self.fs.open_input_file(at) if self.fs else open(at, "rb") as f:
            f.seek(first)
            return np.frombuffer(f.read(size), dtype)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids in ascending doc_id order; returns the manifest.

    One manifest row per partition: shard, docs, tokens, base (tokens before it). Every
    document ends with ``end_id``. A null text is empty, a null doc_id comes first; equal
    ids are ordered by the text's hash, then by text. Texts of any length are encoded whole,
    repeated rows are all written. An empty table writes nothing. Only doc_id and text are read.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, store, shard = encoder(tokenizer), Store(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        keys, lens, out = [], [], None
        for batch in batches:
            if out is None:
                out, pending = store.create(f"ids-{shard}"), store.pending
            keys.append(batch.column("doc_id").cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
            for text in batch.column("text"):
                ids = enc.encode(text.as_py()) + end
                out.write(ids)
                lens.append(len(ids) // enc.dtype.itemsize)
        if out is not None:
            out.close()
            store.commit(f"ids-{shard}", pending)
            store.write(f"keys-{shard}", np.concatenate(keys).astype("<i8"))
            store.write(f"lens-{shard}", np.array(lens, "<u8"))
            if lens:
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": [len(lens)], "tokens": [sum(lens)]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))
    # ranges are sampled by id and hash, as whole texts are too much for the driver
    place = [F.col("doc_id").asc_nulls_first(), "text_key"]
    ordered = rows.withColumn("text_key", F.xxhash64("text")).repartitionByRange(shared.partitions(spark), *place).sortWithinPartitions(*place, "text").drop("text_key")
    manifest = shared.materialize(ordered.mapInArrow(shared.tidy(write), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def write_offsets(manifest: DataFrame, path: str) -> DataFrame:
    """Write each shard's 64-bit offsets into the whole corpus; returns the written manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(path)
        for batch in batches:
            for row in batch.to_pylist():
                lens = store.map(f"lens-{row['shard']}", "<u8")
                store.write(f"offsets-{row['shard']}", np.concatenate([[0], np.cumsum(lens)]).astype("<u8") + np.uint64(row["base"]))
            yield batch

    spread = manifest.repartition(shared.partitions(manifest.sparkSession), "shard")
    return shared.materialize(spread.mapInArrow(shared.tidy(write), MANIFEST + ", base long"), "token-index")


def read_ids(manifest: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read from the memory-mapped files.

    One row per written document, in no order; a null doc_id reads back as null, an empty
    text as the end id alone, and an empty index gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, dtype = Store(path), encoder(tokenizer).dtype
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys, offsets = (store.map(f"{kind}-{row['shard']}", d) for kind, d in (("ids", dtype), ("keys", "<i8"), ("offsets", "<u8")))
                at = (offsets - offsets[0]).astype(np.int64)
                for first in range(0, len(keys), 20_000):
                    span = range(first, min(first + 20_000, len(keys)))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if keys[i] == NULL_KEY else int(keys[i]) for i in span], pa.int64()),
                            "start": pa.array(offsets[span.start : span.stop].astype(np.int64)),
                            "n_tokens": pa.array(np.diff(at[span.start : span.stop + 1])),
                            "ids_crc32": pa.array([zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in span], pa.int64()),
                        }
                    )

    spread = manifest.repartition(shared.partitions(manifest.sparkSession), "shard")
    return spread.mapInArrow(shared.tidy(scan), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` below ``path`` and return the index of its shards."""
    return write_offsets(write_ids(docs, path, tokenizer, end_id), path)


def corpus_dir(spark: SparkSession) -> str:
    return shared.new_dir(spark, "token-ids")

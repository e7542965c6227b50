"""Quality rules, with the document frequency of lines per host.

One pass over the texts takes each document's measures and the hashes of its normalised
lines. Lines that more documents of a host hold than the host's limit are boilerplate, as
are long lines above a small fixed one: they are removed, and a document that they made up
most of is rejected. A line must also stand in several different texts, so that a text is
not boilerplate only because it was copied: its copies are near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: A line is above its host's limit if more than this share of the host's documents, and more texts than MIN_TEXTS, hold it.
MIN_TEXTS, MAX_SHARE = 5, 0.05
#: A line of so many words is seldom equal by chance: it is above if more texts of the host, however large, hold it.
LONG_WORDS, LONG_TEXTS = 50, 5
#: A document that keeps a smaller share of its words is depleted.
KEEP_SHARE = 0.3
#: Base rules: fewest words, and the largest percentage of words in repeated 5-word windows.
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
#: Most frequent lines that are broadcast; above it they are joined by a shuffle.
BROADCAST_LINES = 1_000_000

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, source string, row_key long, text_key long, " + ", ".join(f"{m} long" for m in MEASURES) + ", lines array<long>, line_words array<long>, long_lines array<long>"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside a window of ``size`` words that the text holds twice or more."""
    if len(words) <= size:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - size + 1
    w = h[:n].copy()
    for k in range(1, size):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    inside = np.zeros(len(words), bool)
    for k in range(size):
        inside[at + k] = True
    return int(inside.sum())


def line_key(host: bytes, line: bytes) -> int:
    """A line's key at its host: lower-cased A-Z, single spaces; signed 64 bits."""
    h = xxhash.xxh64_intdigest(host + b"\0" + b" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def measure(text: bytes, host: bytes) -> tuple[list[int], dict[int, int], set[int]]:
    """The measures, the words of each line key, and the keys of long lines."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    found: dict[int, int] = {}
    long = set()
    for line in lines:
        key, size = line_key(host, line), len(line.split())
        found[key] = found.get(key, 0) + size
        if size >= LONG_WORDS:
            long.add(key)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    chars = len(text.translate(None, _SPACE).decode("utf-8", "replace"))
    return [len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)], found, long


def _row_key() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source", "text")])


def _measured(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, keys, counts, ends, long, long_ends = [], [], [], [0], [], [0]
            for text, source in zip(batch.column("text"), batch.column("source"), strict=True):
                m, lines, some = measure(text.as_py() or b"", (source.as_py() or "").encode())
                numbers.append(m)
                keys += lines
                counts += lines.values()
                ends.append(len(keys))
                long += some
                long_ends.append(len(long))
            m = np.array(numbers, np.int64).reshape(-1, len(MEASURES))
            at = pa.array(ends, pa.int32())
            columns = [batch.column(c) for c in ("doc_id", "source", "row_key", "text_key")] + [pa.array(m[:, i]) for i in range(len(MEASURES))]
            columns += [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (keys, counts)]
            columns.append(pa.ListArray.from_arrays(pa.array(long_ends, pa.int32()), pa.array(long, pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _row_key().alias("row_key"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return shared.materialize(rows.mapInArrow(shared.tidy(scan), SCHEMA).withColumn("row", F.monotonically_increasing_id()), "measures")


def _frequent(rows: DataFrame) -> DataFrame:
    """line: the keys above their host's limit.

    A document is a doc_id; rows that repeat one with the same text count once. Copies of
    a text are counted before its lines are dealt out.
    """
    host = F.coalesce("source", F.lit("")).alias("host")
    unique = rows.groupBy(host, "text_key", "doc_id").agg(F.min("row").alias("row"))
    texts = unique.groupBy("host", "text_key").agg(F.min("row").alias("row"), F.count("*").alias("documents"))
    limits = texts.groupBy("host").agg((F.sum("documents") * MAX_SHARE).alias("limit"))
    once = rows.join(texts.join(limits, "host").select("row", "documents", "limit"), "row")
    held = once.select(F.explode("lines").alias("line"), "documents", "limit").groupBy("line").agg(F.count("*").alias("texts"), F.sum("documents").alias("documents"), F.max("limit").alias("limit"))
    long = once.select(F.explode("long_lines").alias("line")).groupBy("line").agg(F.count("*").alias("texts")).where(F.col("texts") > LONG_TEXTS)
    above = held.where((F.col("documents") > F.col("limit")) & (F.col("texts") > MIN_TEXTS))
    return shared.materialize(above.select("line").union(long.select("line")).distinct(), "frequent-lines")


def _judged(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The measured rows with their verdict and the lines to remove."""
    held = rows.select("row", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = held.join(lines, "line").groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < KEEP_SHARE * F.col("n_words")
    judged = rows.drop("lines", "line_words", "long_lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def _verdict(m: list[int], removed: int) -> bool:
    words, repeated = m[0], m[4]
    return words >= MIN_WORDS and 100 * repeated <= MAX_REPEAT * words and words - removed >= KEEP_SHARE * words


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five measures, base_failed, removed_words and kept, one row per row of ``docs``.

    A null text has no words; a null source is a host of its own, named ''. Repeated rows
    get equal verdicts. An empty table gives no rows; columns but doc_id, text and source
    are ignored.
    """
    rows = _measured(docs)
    lines = _frequent(rows)
    if lines.count() <= BROADCAST_LINES:
        lines = F.broadcast(lines)
    return _judged(rows, lines).select("doc_id", *MEASURES, "base_failed", "removed_words", "kept")


def _without(text: str, host: bytes, gone: set[int]) -> str:
    return "\n".join(x for x in text.split("\n") if not x.encode().strip(_SPACE) or line_key(host, x.encode()) not in gone)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, without the lines above the limits; all columns stay.

    ``n_chars``, where there is one, follows the new text. Null, empty and wordless texts
    fail the rules and go; repeated rows go or stay together; texts of any length are read
    whole; a null source is a host of its own; an empty table stays empty.
    """
    rows = _measured(docs)
    lines = _frequent(rows)
    out = _clean_by_broadcast(docs, lines) if lines.count() <= BROADCAST_LINES else _clean_by_join(docs, _judged(rows, lines))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def _clean_by_broadcast(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Each text is measured again where it is cleaned, so no text is shuffled."""
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(lines.toArrow().column("line").to_numpy()))  # at most BROADCAST_LINES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for whole in batches:
            for first in range(0, len(whole), 500):
                batch, texts, kept = whole.slice(first, 500), [], []
                for text, source in zip(batch.column("text"), batch.column("source"), strict=True):
                    text, host = text.as_py(), (source.as_py() or "").encode()
                    m, held, _ = measure((text or "").encode(), host)
                    keys = np.fromiter(held, np.int64, len(held))
                    gone = set(keys[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys].tolist()) if len(known) else set()
                    kept.append(_verdict(m, sum(held[k] for k in gone)))
                    texts.append(_without(text, host, gone) if gone else text)
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(shared.tidy(scan), docs.schema)


def _clean_by_join(docs: DataFrame, judged: DataFrame) -> DataFrame:
    verdicts = judged.where("kept").groupBy(F.col("row_key").alias("__key"), F.col("doc_id").alias("__id")).agg(F.first("removed").alias("__removed"))
    kept = docs.withColumn("__row", _row_key()).join(verdicts, (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))

    @F.pandas_udf("string")
    def without(text: pd.Series, source: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([_without(t, (s or "").encode(), set(map(int, gone))) for t, s, gone in zip(text, source, removed, strict=True)], dtype=object)

    return kept.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(without("text", "source", F.coalesce("__removed", F.array().cast("array<long>")))))

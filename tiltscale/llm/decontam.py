"""Benchmark decontamination, with DataFrame functions only.

The windows of all benchmark items are hashed. A document's windows are hashed from its
word hashes and looked up in the set of these hashes; only windows found there are built
as text and verified by a join with the benchmark's windows. Up to ``HASH_SET`` hashes go
to every task with the plan; more are a broadcast table up to ``BROADCAST_WINDOWS``, and a
shuffled one above. In each case only the hashes of a document's windows meet the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 10
#: Largest benchmark, in distinct windows, whose hashes go to every task.
HASH_SET = 200_000
#: Largest benchmark whose hashes are a broadcast table.
BROADCAST_WINDOWS = 2_000_000
#: Most hit words (and eight a document) that are broadcast to the documents they go from.
BROADCAST_HITS = 10_000_000
#: A document is dropped if more than this share of its words is hit; else the hit words go.
MAX_SHARE = 0.5

#: What separates words: ASCII but digits and letters.
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: Column) -> Column:
    """Words with A-Z lower-cased and no other letter changed; none for a null text."""

    def lowered(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _UPPER.lower()))

    split = F.filter(F.split(F.coalesce(text, F.lit("")), _SEPARATOR + "+"), lambda w: w != "")
    return F.transform(split, lowered)


def _starts(count: Column, size: Column | int) -> Column:
    """Starts of the windows of ``size`` words among ``count`` words."""
    last = count - size
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


_SPANS = "array<struct<start:int,n:int>>"


def _hash(words: Column) -> Column:
    return F.xxhash64(words)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """window_text, n (its words), hash and items, one row per distinct window of the items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    cut = items.select("item", F.explode(F.transform(_starts(F.size("w"), n), lambda i: F.slice(F.col("w"), i + 1, n))).alias("x"))
    return (
        cut.groupBy(F.array_join("x", " ").alias("window_text"))
        .agg(F.first(F.size("x")).alias("n"), F.first(_hash(F.transform("x", lambda w: F.xxhash64(w)))).alias("hash"), F.collect_set("item").alias("items"))
    )


def _looked_up(rows: DataFrame, known: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """``rows`` with ``maybe``, the windows whose hash is among the benchmark's; only hashes are dealt out."""

    def cut(n: int) -> Column:
        return F.transform(F.array("h"), lambda h: F.transform(_starts(F.size(h), n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), _hash(F.slice(h, i + 1, n)).alias("hash"))))[0]

    dealt = rows.select("doc_id", "text_key", F.inline(F.concat(*[cut(n) for n in sizes])))
    wanted = known.select("hash", "n").distinct()
    met = dealt.join(F.broadcast(wanted) if few else wanted, ["hash", "n"])
    hits = met.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("start", "n")).alias("maybe"))
    hits = shared.materialize(hits, "candidates")
    if (hits.agg(F.sum(F.size("maybe") + 8)).first()[0] or 0) <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left").drop("__id", "__key")
    return joined.withColumn("maybe", F.coalesce("maybe", F.array().cast(_SPANS)))


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, hash_set: int = HASH_SET) -> DataFrame:
    """doc_id, text_key, n_words, spans (array of start and n, in words) and items (sorted ids), however large the benchmark.

    One row per row of ``docs``. A null text has no words and no spans; an item without
    words is never found, one of fewer than ``size`` words is a single window; a null
    item_id counts as ''. Repeated rows are found alike; empty tables give no rows or no
    spans. Only doc_id and text, item_id and text are read.
    """
    known = shared.materialize(windows(benchmark, size), "windows")
    small = known.groupBy("n").agg(F.count("*").alias("k")).orderBy("n").collect()  # at most ``size`` rows
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _words(F.col("text")).alias("w"))
    rows = words.select("doc_id", "text_key", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    listed, few = (sum(r.k for r in small) <= most for most in (hash_set, BROADCAST_WINDOWS))
    hashes = [r.hash for r in known.select("hash").distinct().collect()] if listed and small else []

    def found(n: int) -> Column:
        def among(h: Column) -> Column:
            return F.filter(_starts(F.size(h), n), lambda i: _hash(F.slice(h, i + 1, n)).isin(hashes))

        # the array is a lambda's argument, so that it is made once and not once a window
        return F.transform(F.flatten(F.transform(F.array("h"), among)), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n")))

    if listed or not small:
        spans = F.concat(*[found(r.n) for r in small]) if small else F.array().cast(_SPANS)
        rows = rows.withColumn("maybe", spans)
    else:
        rows = _looked_up(rows, known, [r.n for r in small], few)
    marked = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "w", "maybe")
    texts = F.flatten(F.transform(F.array("w"), lambda w: F.transform("maybe", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.array_join(F.slice(w, s["start"] + 1, s["n"]), " ").alias("text")))))
    candidates = marked.select("row", "doc_id", "text_key", "n_words", F.explode_outer(texts).alias("c"))
    known = known.select("window_text", "items")
    hit = candidates.join(F.broadcast(known) if few else known, F.col("c.text") == F.col("window_text"), "left")
    span = F.when(F.col("window_text").isNotNull(), F.struct(F.col("c.start").alias("start"), F.col("c.n").alias("n")))
    return hit.groupBy("row", "doc_id", "text_key", "n_words").agg(
        F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    ).drop("row")


def hit_words(spans: Column) -> Column:
    """Positions of the words inside any span, each once."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` without the hit words, and without documents that have too many of them.

    A hit word goes with the separators before it. ``n_chars``, where there is one,
    follows the new text; all columns stay. Null and empty texts stay as they are; rows of
    equal id and text are treated alike; a document that nothing hits keeps its text
    exactly; an empty table stays empty. Hits are few, and broadcast up to
    ``BROADCAST_HITS`` hit words, so that no text is shuffled.
    """
    hits = find(docs, benchmark, size).where(F.size("spans") > 0)
    gone = hits.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), hit_words(F.col("spans")).alias("__gone"), "n_words").distinct()
    gone = shared.materialize(gone.withColumn("__drop", F.size("__gone") > max_share * F.col("n_words")).drop("n_words"), "hits")
    if (gone.agg(F.sum(F.size("__gone") + 8)).first()[0] or 0) <= BROADCAST_HITS:
        gone = F.broadcast(gone)
    joined = docs.withColumn("__text", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left")
    left = joined.where(~F.coalesce("__drop", F.lit(False)))
    pieces = F.regexp_extract_all("text", F.lit(f"{_SEPARATOR}*{_WORD}+"), F.lit(0))
    tail = F.regexp_extract("text", f"({_SEPARATOR}*)$", 1)
    places = F.transform(F.array(pieces), lambda p: F.transform(F.array_except(_starts(F.size(p), 1), "__gone"), lambda i: F.get(p, i)))
    stay = F.flatten(places)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.concat(F.array_join(stay, ""), tail))
    out = left.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)

"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and BK-trees, then an exact check.

Every set of shingles has a SimHash fingerprint. At similarity 0.8 the distance of two is about
ten of 64 bits and often more, and no bands of 64 bits are both as narrow and as selective as
that needs. So fingerprints are dealt to BK-trees by prefixes: in any order of all shingles, two
sets of similarity t share one of the first n - ceil(t n) + 1 of each, and so a tree. The order puts shingles
that are frequent in a sample of the texts last; the sample decides how much is compared, not
what is found. In its trees every fingerprint is looked up within ``RADIUS`` bits, and linked to the first that
is found. The place of a common shingle bounds what two sets share, as all of it stands there or
behind. What the trees find is bounded by sketches (how many shingles fall into each hash bucket;
the smaller counts of two texts sum to at least what they share), and what passes is verified on the
shingle sets. So sets are gathered of texts that are very likely similar, and of few others.

Texts with one shingle set are one class. The first of a tree is the class that has the shingle earliest; a shingle of more
than ``TREE`` classes has several trees, which all begin with it. So a large group of near copies costs about its size.

A fingerprint's distance proves nothing. So an exact check follows: in each prefix shingle, among classes
that the trees have not connected, all others outside the shingle's largest component are compared with all in it. Pairs that are
connected already are not compared, since only components are asked for. This comparison joins only pairs that
pass a bit bound besides that of the places: of every set there are 128 parity bits, one for
each hash bucket, and two sets differ in at least as many shingles as their bits do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, simhash

WORDS = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: One text in SAMPLE is counted for the order, and at most ORDERED shingles of FREQUENT such texts or more go last.
SAMPLE, FREQUENT, ORDERED = 16, 3, 200_000
#: Largest number of hash buckets of a sketch, as a power of two; a count of 255 stands for any more.
SKETCH_BITS = 14
#: Bits within which the trees are searched: at similarity 0.8 the distance has mean 9.7 and deviation 2.9.
RADIUS = 20
#: Most fingerprints of a tree, on average where a shingle has more; rows of a task that builds trees, and queries searched at a time.
TREE, ROWS, QUERIES = 128, 50_000, 4096
#: Most texts in candidate pairs whose keys are broadcast; above it they are joined by a shuffle.
BROADCAST_TEXTS = 500_000


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    found = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).view(np.int64))


def prefix(found: np.ndarray, last: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which a similar set shares one; ``last`` has the hashes that go last, sorted, and their ranks."""
    if not len(found):
        return found
    hashes, rank = last
    at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
    held = np.where(hashes[at] == found, rank[at], 0) if len(hashes) else np.zeros(len(found), np.int64)
    size = len(found) - -(-len(found) * OVER // UNDER) + 1
    return found[np.lexsort((found, held))[:size]]


def sketch(found: np.ndarray) -> bytes:
    """Shingles in each hash bucket; about two shingles a bucket."""
    buckets = 1 << min(SKETCH_BITS, max(4, (len(found) // 2).bit_length()))
    return np.minimum(np.bincount(found & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def parity(found: np.ndarray) -> np.ndarray:
    """Two words of bits: whether the shingles of each of 128 hash buckets are odd in number.

    The bits of two sets differ only where a shingle of just one of them falls, so the
    sets differ in at least as many shingles as their bits do.
    """
    odd = (np.bincount((found >> 32) & 127, minlength=128) & 1).astype(bool)
    return np.packbits(odd).view(np.int64)


def most_shared(u: bytes, v: bytes) -> int:
    """A bound of the shingles that two sets share, from their sketches."""
    u, v = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (u, v))
    size = min(len(u), len(v))
    u, v = (np.where(x == 255, 1 << 40, x).reshape(-1, size).sum(axis=0) for x in (u, v))
    return int(np.minimum(u, v).sum())


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that go last, sorted, and their ranks by frequency."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                found = [shingles(t.as_py()) for t in batch.column("text").slice(first, 200)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["h"])

    # copies of a text count once
    some = docs.where(F.pmod("text_key", F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = some.mapInArrow(shared.tidy(scan), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "h").limit(ORDERED).collect()  # at most ORDERED
    hashes, rank = np.array([r.h for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], rank[order]


def _classes(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, the text's key, and class, size, prefix, sketch, parity bits and fingerprint of the shingle set."""
    last = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = batch.slice(first, 200)
                sets = [shingles(t.as_py()) for t in part.column("text")]
                columns = [pa.array(_keys(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array([prefix(s, last.value) for s in sets], pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())]
                bits = np.array([parity(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), *columns, pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(_codes(sets))],
                    ["doc_id", "text_key", "key", "size", "prefix", "sketch", "low", "high", "code"],
                )

    schema = "doc_id long, text_key long, key long, size int, prefix array<long>, sketch binary, low long, high long, code long"
    return shared.materialize(docs.mapInArrow(shared.tidy(scan), schema), "classes")


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _codes(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprints of shingle sets."""
    return np.array([simhash.majority(s[i : i + simhash.CHUNK] for i in range(0, len(s), simhash.CHUNK)) for s in sets], np.uint64).view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and set (its hashes as bytes) of the classes of the texts ``wanted``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                sets = [shingles(t.as_py()) for t in batch.column("text").slice(first, 200)]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "set"])

    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    found = docs.join(wanted, "text_key").select("text").mapInArrow(shared.tidy(scan), "key long, set binary")
    return shared.materialize(found.dropDuplicates(["key"]), "sets")


def _similar(pairs: DataFrame, of: str, shared_of: Callable[[bytes, bytes], int]) -> DataFrame:
    """The pairs a, b whose column ``of`` at both ends (``of``_a, ``of``_b) and sizes allow the similarity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for u, v, sizes in zip(*[batch.column(c) for c in (f"{of}_a", f"{of}_b", "sizes")], strict=True):
                both = shared_of(u.as_py(), v.as_py())
                keep.append(UNDER * both >= OVER * (sizes.as_py() - both))
            yield batch.select(["a", "b", "sizes"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(shared.tidy(scan), "a long, b long, sizes long")


def _intersection(u: bytes, v: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(u, np.int64), np.frombuffer(v, np.int64), assume_unique=True))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs a, b, sizes of classes those whose shingle sets are similar."""

    def with_ends(pairs: DataFrame, table: DataFrame, of: str) -> DataFrame:
        ends = [table.select(F.col("key").alias(e), F.col(of).alias(f"{of}_{e}")) for e in ("a", "b")]
        return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "sizes", f"{of}_a", f"{of}_b")

    likely = shared.materialize(_similar(with_ends(pairs, classes, "sketch"), "sketch", most_shared), "likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = _sets(docs, shared.materialize(classes.join(ends, "key").select("text_key"), "wanted"))
    return shared.materialize(_similar(with_ends(likely, sets, "set"), "set", _intersection).select("a", "b"), "similar")


def _may_be_similar(size: Column, pos: Column, other_size: Column, other_pos: Column) -> Column:
    """Whether two sets can be similar whose first common shingle stands at these places of their orders.

    What they share begins there, so the shorter of both rests bounds it. A pair that is
    similar passes at its first common shingle, though perhaps not at later ones.
    """
    return (UNDER + OVER) * F.least(size - pos, other_size - other_pos) >= OVER * (size + other_size)


def tree_pairs(tree: np.ndarray, key: np.ndarray, size: np.ndarray, pos: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and, of each, the first other row of its BK-tree within ``RADIUS`` bits that may be similar; rows without one are left out.

    First is what has the tree's shingle earliest, and the tree is built in this order.
    """
    order = np.lexsort((key ^ tree, pos, tree))
    tree, key, size, pos, code = tree[order], key[order], size[order], pos[order], code[order].view(np.uint64)
    starts = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1))
    root = np.repeat(starts, np.diff(starts, append=len(tree)))
    trees, found = simhash.BKTree(code, root), []
    for at in range(0, len(code), QUERIES):
        who, other = trees.search(code[at : at + QUERIES], RADIUS, root[at : at + QUERIES])
        who += at
        ok = (other < who) & (key[other] != key[who])
        ok &= (UNDER + OVER) * np.minimum(size[who] - pos[who], size[other] - pos[other]) >= OVER * (size[who] + size[other])
        who, other = who[ok], other[ok]
        by = np.lexsort((other, who))
        who, once = np.unique(who[by], return_index=True)
        found.append((who, other[by][once]))
    who, other = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    return order[who], order[other]


def _tree_links(held: DataFrame) -> DataFrame:
    """Distinct a, b and sum of sizes of what ``tree_pairs`` finds among the rows h, n, key, size, pos, code."""
    parts = F.ceil(F.col("n") / TREE)
    rows = held.select("h", F.pmod(F.xxhash64("key", "h"), parts).alias("part"), "key", "size", "pos", "code")
    # the first of a shingle with several trees begins them all
    first = held.where(F.col("n") > TREE).groupBy("h").agg(F.min(F.struct("pos", "key", "size", "code")).alias("c"), F.max(parts).alias("parts"))
    begin = first.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "c.key", "c.size", "c.pos", "c.code")
    dealt = rows.unionByName(begin).select(F.xxhash64("h", "part").alias("tree"), "key", "size", "pos", "code")
    shards = max(1, math.ceil(held.count() / ROWS))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        key, size = pdf["key"].to_numpy(), pdf["size"].to_numpy()
        who, other = tree_pairs(pdf["tree"].to_numpy(), key, size, pdf["pos"].to_numpy(), pdf["code"].to_numpy())
        found = pd.DataFrame({"a": np.minimum(key[who], key[other]), "b": np.maximum(key[who], key[other]), "sizes": size[who] + size[other]})
        return found.drop_duplicates(["a", "b"])

    return dealt.withColumn("shard", F.pmod("tree", F.lit(shards))).groupBy("shard").applyInPandas(search, "a long, b long, sizes long").distinct()


def _may_differ_so_little(sizes: Column) -> Column:
    """Whether two sets whose sizes sum to ``sizes`` can be similar, by their parity bits.

    Similar sets share OVER / (OVER + UNDER) of the sum or more, so they differ in the rest at most.
    """
    differ = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))).cast("long") for c in ("low", "high"))
    return (UNDER + OVER) * differ <= (UNDER - OVER) * sizes


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct a, b and sum of sizes of the rows key, size, other, other_size."""
    return met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), (F.col("size") + F.col("other_size")).alias("sizes")).distinct()


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges a, b that connect all classes whose shingle sets are similar."""
    classes = shared.materialize(rows.where("size > 0").groupBy("key").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("code").alias("code"), F.min("text_key").alias("text_key")), "sets")
    # size and place of a shingle in one number, as these rows are the most that is shuffled
    dealt = classes.select(F.posexplode("prefix").alias("pos", "h"), "key", "size").select("h", "key", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")).alias("at")).repartition("h")
    several = dealt.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    bits, classes = classes.select("key", "low", "high", "code"), classes.select("key", "text_key", "sketch")
    held = dealt.join(several, "h").join(bits, "key").select("h", "n", "key", F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND((1 << 32) - 1).alias("pos"), "low", "high", "code")
    held = shared.materialize(held, "held")

    def fits(size: str = "size", pos: str = "pos") -> Column:
        return _may_be_similar(F.col(size), F.col(pos), F.col("other_size"), F.col("other_pos"))

    first = shared.materialize(_tree_links(held), "pairs")
    edges = _verified(docs, classes, first)
    # those that are still apart
    placed = held.join(simhash.components(edges), F.col("key") == F.col("node"), "left").select("h", "key", "size", "pos", F.coalesce("root", "key").alias("root"), "low", "high")
    placed = shared.materialize(placed, "placed")
    shared.discard(held)
    largest = placed.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).where("k > 1")
    apart = placed.join(largest.select("h", F.col("m.root").alias("most")), "h")
    apart = shared.materialize(apart, "apart")
    shared.discard(placed)
    others = apart.select("h", F.col("key").alias("other"), F.col("size").alias("other_size"), F.col("pos").alias("other_pos"), F.col("root").alias("other_root"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    once = (F.col("other_root") == F.col("most")) | (F.col("key") < F.col("other"))
    met = apart.where("root <> most").join(others, "h").where((F.col("root") != F.col("other_root")) & once & fits() & _may_differ_so_little(F.col("size") + F.col("other_size")))
    rest = shared.materialize(_pairs(met).join(first, ["a", "b"], "left_anti"), "pairs")
    shared.discard(apart)
    return edges.union(_verified(docs, classes, rest))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, one row per row of ``docs``.

    component_id is the smallest doc_id among all documents reachable over links of
    similarity OVER / UNDER or more; null ids never win, and a component of null ids has
    none. Null and wordless texts are similar to each other. Texts of any length are
    compared whole; repeated rows are one class. An empty table gives no rows; columns but
    doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    rows = _classes(docs)
    roots = simhash.components(links(docs, rows))
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least_id"))
    rooted = least.join(roots, F.col("key") == F.col("node"), "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("key", "component_id")
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")

"""SimHash near-duplicates: 64-bit fingerprints linked through BK-trees.

Distinct fingerprints are dealt to shards by bands: two fingerprints within ``radius``
bits agree in at least one of ``radius + 1`` bands, so they meet in that band's shard.
Each shard builds a BK-tree over its members (children keyed by the Hamming distance to
their parent) and looks every member up, following only edges within the radius. A shard
has about ``SHARD_NODES`` members however large the input is, and reports each member's
in-shard root, so its output is linear in its members. The trees stay where they are
built: sending them to all tasks would take every fingerprint through the driver.

The pipeline's stage (``drop_near_duplicates``) searches BK-trees of fingerprints of 5-word
shingles within a radius too wide for bands; ``similar`` deals these fingerprints to trees
by shingles instead, verifies what the trees find, and then makes the links exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, similar

WORDS, RADIUS, BITS = 3, 2, 64
#: Members of a shard tree, on average; a band value held by more is split by further bands.
SHARD_NODES = 4096
#: Most ids of dropped documents that are broadcast; above it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Shingles hashed at a time, and queries searched at a time.
CHUNK, QUERIES = 200_000, 512


def fingerprint(text: bytes | None, n: int = WORDS) -> int:
    """SimHash of the ``n``-word shingles of a UTF-8 text, A-Z lower-cased; no words: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(sizes + 1) - 1
        starts, ends = (stop - sizes)[: 1 - n].tolist(), stop[n - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, len(starts)
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8") for at in range(0, total, CHUNK))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The 64 bits that more than half of the hashes, in arrays of any size, have set; zero without hashes."""
    total, counts = 0, np.zeros(BITS, np.int64)
    for h in hashes:
        total += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(shared.tidy(scan), "doc_id long, fp long")


class BKTree:
    """A BK-tree over 64-bit codes, in arrays; codes are inserted in the given order.

    With ``root``, the place of the first code of each code's tree, there are several trees. Of equal codes each hangs below the one before it.
    """

    def __init__(self, codes: np.ndarray, root: np.ndarray | None = None) -> None:
        self.codes = codes
        self.root = np.zeros(len(codes), np.int64) if root is None else root
        keys, nodes = [], []
        left = np.flatnonzero(self.root != np.arange(len(codes)))
        at = self.root[left]
        while len(left):  # all codes go down one edge; the first on an edge becomes its child
            edge = at * (BITS + 1) + np.bitwise_count(codes[left] ^ codes[at])
            new, first, which = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(new)
            nodes.append(left[first])
            at = left[first][which]
            stay = at != left
            at, left = at[stay], left[stay]
        keys, nodes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, nodes))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def search(self, queries: np.ndarray, radius: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of codes within ``radius`` bits, by position; ``root`` names the tree of each query."""
        who, where = np.arange(len(queries)), np.zeros(len(queries), np.int64) if root is None else root
        found = []
        while len(who) and len(self.codes):
            d = np.bitwise_count(queries[who] ^ self.codes[where]).astype(np.int64)
            near = d <= radius
            found.append((who[near], where[near]))
            # edges of a node are sorted by distance, and those within the radius of d lie side by side
            edge = where * (BITS + 1)
            first = np.searchsorted(self.keys, edge + np.maximum(d - radius, 0))
            sizes = np.searchsorted(self.keys, edge + np.minimum(d + radius, BITS), "right") - first
            who = np.repeat(who, sizes)
            where = self.nodes[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(len(who))]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a[i]`` and ``b[i]``; ``root`` maps every member to its set's smallest."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := root[root], root):
            root[:] = up


def shard_links(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Members and their in-shard roots, where these differ."""
    codes = np.unique(codes.view(np.uint64))
    tree, root = BKTree(np.random.default_rng(0).permutation(codes)), np.arange(len(codes))
    for at in range(0, len(codes), QUERIES):
        q, node = tree.search(tree.codes[at : at + QUERIES], radius)
        unite(root, q + at, node)
    moved = root != np.arange(len(codes))
    return tree.codes[moved].view(np.int64), tree.codes[root[moved]].view(np.int64)


def _bands(code: Column, low: int, high: int, parts: int) -> list[Column]:
    """Bits low..high-1 of a long, cut into ``parts`` bands."""
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return [F.shiftrightunsigned(code, a).bitwiseAND((1 << (b - a)) - 1) if b - a < BITS else code for a, b in zip(cuts, cuts[1:], strict=False)]


def link(codes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Edges a, b that connect all distinct codes ``fp`` within ``radius`` bits of each other."""
    n = radius + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    keyed = codes.select("fp", F.posexplode(F.array(*_bands(F.col("fp"), 0, BITS, n))).alias("band", "value"))
    # a code alone with its band value has no partner there
    shared_values = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared_values, ["band", "value"])
    # many codes with one band value: those within the radius also agree in a band of the other bits
    rest = F.array(*[F.array(*_rest_bands(F.col("fp"), cuts[i], cuts[i + 1], n)) for i in range(n)])
    dealt = met.select(
        "fp", "band", "value",
        F.posexplode(F.when(F.col("n") <= shard_nodes, F.array(F.lit(-1).cast("long"))).otherwise(F.get(rest, "band"))).alias("part", "piece"),
        "n",
    )
    placed = shared.materialize(
        dealt.select("fp", F.xxhash64("band", "value", F.when(F.col("n") > shard_nodes, F.col("part")), "piece").alias("key")), "bands"
    )
    shards = max(1, math.ceil(placed.count() / shard_nodes))

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf["fp"].to_numpy(), radius)
        return pd.DataFrame({"a": a, "b": b})

    return placed.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(one_shard, "a long, b long")


def _rest_bands(code: Column, low: int, high: int, parts: int) -> list[Column]:
    """The bits outside low..high-1, cut into ``parts`` bands."""
    below = code.bitwiseAND((1 << low) - 1)
    above = F.shiftrightunsigned(code, high) if high < BITS else F.lit(0).cast("long")
    joined = F.shiftleft(above, low).bitwiseOR(below)
    return _bands(joined, 0, BITS - (high - low), parts)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of all nodes of the edges a, b.

    Alternating star contraction: each round links every node's larger neighbours, then
    its smaller ones, to its smallest neighbour, until each component is a star. Every
    round is written to the shared folder, and the round before it deleted.
    """
    edges = shared.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen:
        seen = now
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(down).distinct()
        before, edges = edges, shared.materialize(small, "edges")
        shared.discard(before)
    return edges.toDF("node", "root")


def near_duplicates(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, one row per row of ``docs``.

    component_id is the smallest doc_id among all documents reachable over links of at
    most ``radius`` differing bits; null ids never win, and a component of null ids has
    none. Null and wordless texts have fingerprint zero and link like any other. An empty
    table gives no rows; columns but doc_id and text are ignored.
    """
    marked = shared.materialize(fingerprints(docs, n), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(link(classes, radius, shard_nodes))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component of ``similar.near_duplicates``.

    Of several rows with the kept id one stays, that of the smallest text hash. Rows
    without an id cannot be told apart by id and stay; an empty table stays empty. The ids
    that go are broadcast up to ``BROADCAST_IDS`` of them, so no text is shuffled.
    """
    found = shared.materialize(similar.near_duplicates(docs), "components").where(F.col("doc_id").isNotNull())
    rows = found.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("n"))
    apart = shared.materialize(rows.where("n <> 1").select(F.col("doc_id").alias("__id"), "n"), "losers")
    sizes = apart.agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("again")).first()

    def ids(which: DataFrame) -> DataFrame:
        return F.broadcast(which.select("__id")) if sizes.ids <= BROADCAST_IDS else which.select("__id")

    out = docs.join(ids(apart), F.col("doc_id") == F.col("__id"), "left_anti")
    if sizes.again:
        several = docs.join(ids(apart.where("n > 1")), F.col("doc_id") == F.col("__id"), "left_semi")
        one = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("__row"))
        out = out.unionByName(one.select("__row.*"))
    return out

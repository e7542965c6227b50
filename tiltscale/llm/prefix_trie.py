"""The prefix trie of conversations, by vertical bitmaps over shards.

Conversations are range-partitioned by the keys of their first turns, so that those with a
common prefix are neighbours, and cut into shards of a bounded number of conversations and
turns. A shard indexes (position, turn) to the bitset of its conversations that have that
turn there. Depth first, the bitset of a node is intersected with the postings of the next
position; what comes out are its children, their members and the list of those that end.

All members of a node lie in one shard unless the node holds the shard's first or last
conversation. Such nodes, the trunk, are a few a shard: they are merged by their path's
hash, and sums over subtrees climb the trunk by doubling the distance to the ancestor, so
a trunk of depth d takes log2(d) rounds. A prefix that a third of all conversations share
is thus spread over many shards, and no task holds its members.

A turn is its role and text (null: empty), known by an MD5 of both. Turns are ordered by
turn, role and text, nulls first; repeated rows are turns of their own. A null conv_id is
one conversation, smaller than all others, and written as ``null`` in lists of ids. An
empty table has no nodes, not even a root. Other columns are ignored. The turns of one
conversation make one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import shared

#: Most conversations, and about as many turns, of a shard.
SHARD, SHARD_TURNS = 2048, 200_000
#: Turns that conversations are ordered by; below them neighbours may differ, so all of a shared path is trunk.
CUT = 12

_TYPES = {
    **{"shard": pa.string(), "trunk": pa.bool_(), "under_trunk": pa.bool_()},
    **dict.fromkeys(("node", "parent", "turn"), pa.binary()),
    **dict.fromkeys(("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size"), pa.int64()),
    "ends": pa.list_(pa.int64()),
}
#: Columns of ``Trie.nodes``.
NODE = ["node", "parent", "turn", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


@dataclass
class Trie:
    """``nodes``: NODE, and ``ends``: the sorted ids of conversations that end there, null for
    trunk nodes. ``trunk_ends``: (node, ends), runs of the ids that end at trunk nodes."""

    nodes: DataFrame
    trunk_ends: DataFrame


def turn_key(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path: per turn, in order, its key and the UTF-8 bytes of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    # ranked by a sort that spills, so that no row holds the texts of a conversation
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = rows.select("conv_id", F.row_number().over(order).alias("at"), turn_key(F.col("role"), F.col("text")).alias("key"), F.octet_length("text").alias("size"))
    turns = ranked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "key", "size"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("path"))


class Shard:
    """Bitsets over the conversations of one shard, the smallest conv_id in the lowest bit."""

    def __init__(self, rows: list[tuple[int | None, list[bytes], list[int]]]) -> None:
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
        self.rows = [rows[i] for i in order]
        self.edges = 1 << order.index(0) | 1 << order.index(len(rows) - 1)
        self.ended: dict[int, int] = {}
        self.postings: dict[tuple[int, bytes], int] = {}
        for i, (_, keys, _) in enumerate(self.rows):
            bit = 1 << i
            for at in enumerate(keys):
                self.postings[at] = self.postings.get(at, 0) | bit
            self.ended[len(keys)] = self.ended.get(len(keys), 0) | bit

    def members(self, bits: int) -> list[int | None]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.rows[low.bit_length() - 1][0])
            bits ^= low
        return out

    def nodes(self, shard: str) -> Iterator[dict]:
        """Rows of ``_TYPES``. A trunk node's sums leave out itself and the trunk below it."""
        found, above = [], []
        stack = [((1 << len(self.rows)) - 1, 0, None, None, 0)]
        while stack:
            bits, depth, parent, turn, size = stack.pop()
            up = found[parent] if parent is not None else None
            trunk = up is None or (up["trunk"] and (depth > CUT or bool(bits & self.edges)))
            node = hashlib.md5(up["node"] + turn).digest() if up else b""
            ends = bits & self.ended.get(depth, 0)
            low, n = (bits & -bits).bit_length() - 1, bits.bit_count()
            here = len(found)
            above.append(parent)
            found.append({
                "shard": shard, "trunk": trunk, "under_trunk": bool(up and up["trunk"]), "node": node, "parent": up and up["node"], "turn": turn, "depth": depth,
                "conv_id": self.rows[low][0], "parent_conv_id": up and up["conv_id"], "n_convs": n, "n_children": 0, "n_leaves": 0,
                "saved_tokens": 0 if trunk else (n - 1) * size, "size": size, "ends": self.members(ends),
            })
            rest = bits ^ ends
            while rest:
                _, keys, sizes = self.rows[(rest & -rest).bit_length() - 1]
                child = rest & self.postings[depth, keys[depth]]
                rest ^= child
                stack.append((child, depth + 1, here, keys[depth], sizes[depth]))
        # children come after their parents
        for one, parent in zip(reversed(found), reversed(above), strict=True):
            if not one["trunk"]:
                one["n_leaves"] = one["n_leaves"] or 1
                up = found[parent]
                up["n_children"] += 1
                up["n_leaves"] += one["n_leaves"]
                up["saved_tokens"] += one["saved_tokens"]
        return iter(found)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    rows, turns = [], 0
    for batch in batches:
        lists = batch.column("path")
        flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
        keys, sizes = flat.field("key").to_pylist(), flat.field("size").to_pylist()
        begin = 0
        for i, end in zip(batch.column("conv_id").to_pylist(), ends.tolist(), strict=True):
            rows.append((i, keys[begin:end], sizes[begin:end]))
            turns, begin = turns + end - begin, end
            if len(rows) >= most or turns >= SHARD_TURNS:
                yield rows
                rows, turns = [], 0
    if rows:
        yield rows


def _least(ids: str) -> Column:
    """The smallest id, null before all others."""
    return F.when(~F.bool_or(F.col(ids).isNull()), F.min(ids))


def _climb(trunk: DataFrame, deepest: int) -> DataFrame:
    """node, n_leaves, saved_tokens summed over the trunk's subtrees.

    After k rounds a node has the sums of all less than 2^k below it, and ``up`` is its
    ancestor 2^k above.
    """
    sums = ["n_leaves", "saved_tokens"]
    state = trunk.select("node", F.col("parent").alias("up"), *sums)
    for k in range(deepest.bit_length()):
        add = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
        higher = state.select(F.col("node").alias("up"), F.col("up").alias("__up"))
        joined = state.join(add, "node", "left").join(higher, "up", "left")
        grown = joined.select("node", F.col("__up").alias("up"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums])
        spent, state = state if k else None, shared.materialize(grown, "trie-climb")
        if spent is not None:
            shared.discard(spent)
    return state.drop("up")


def trie(convs: DataFrame, most: int = SHARD) -> Trie:
    """The trie of ``convs`` (conv_id, path as ``paths`` makes it), in shards of at most so
    many conversations; an empty path ends at the root."""
    spark, schema = convs.sparkSession, pa.schema(_TYPES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(_shards(batches, most)):
            found = list(Shard(rows).nodes(f"{part}-{k}"))
            for begin in range(0, len(found), 5000):
                yield pa.RecordBatch.from_pylist(found[begin : begin + 5000], schema)

    order = [F.transform(F.slice("path", 1, CUT), lambda t: t["key"]), F.xxhash64(F.transform("path", lambda t: t["key"])), F.col("conv_id").asc_nulls_first()]
    rows = convs.select("conv_id", "path").repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    raw = shared.materialize(rows.mapInArrow(shared.tidy(index), from_arrow_schema(schema)), "trie-shards")
    parts = raw.where("trunk")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.first(c).alias(c) for c in ("parent", "turn", "depth", "size")]
    merged = shared.materialize(parts.groupBy("node").agg(*same, _least("conv_id").alias("conv_id"), *sums), "trie-trunk")
    below = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("__below"))
    whole = merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("__below", F.lit(0))).drop("__below")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    own = whole.withColumns({"n_leaves": F.col("n_leaves") + leaf, "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")})
    own = shared.materialize(own, "trie-own")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    trunk = own.drop("n_leaves", "saved_tokens").join(_climb(own, deepest), "node").join(names, "parent", "left")
    # the parents' smallest members by shard, so that no key has a row for every child of the root
    known = parts.select("shard", F.col("node").alias("parent")).join(names, "parent")
    inner = raw.where("NOT trunk")
    deep = inner.where("NOT under_trunk").select(*NODE, "ends")
    upper = inner.where("under_trunk").drop("parent_conv_id").join(known, ["shard", "parent"]).select(*NODE, "ends")
    nodes = deep.unionByName(upper).unionByName(trunk.select(*NODE, F.lit(None).cast("array<long>").alias("ends")))
    return Trie(nodes, parts.where(F.size("ends") > 0).select("node", "ends"))


def ends_sha256(ends: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ends, lambda i: i.cast("string")), ",", "null"), 256)


def trunk_digests(trunk_ends: DataFrame) -> DataFrame:
    """node and ends_sha256 of its runs of ids, joined in ascending order.

    A hash needs its text in order, so one task reads a node's runs, one run at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for key, ends in zip(batch.column("node").to_pylist(), batch.column("ends"), strict=True):
                text = ",".join("null" if i is None else str(i) for i in ends.as_py())
                if key == node:
                    state.update(b",")
                else:
                    if state:
                        yield row()
                    node, state = key, hashlib.sha256()
                state.update(text.encode())
        if state:
            yield row()

    runs = trunk_ends.select("node", "ends", F.get("ends", F.lit(0)).alias("first")).repartition("node").sortWithinPartitions("node", F.col("first").asc_nulls_first())
    return runs.select("node", "ends").mapInArrow(shared.tidy(scan), "node binary, ends_sha256 string")


def with_digests(found: Trie) -> DataFrame:
    """The nodes with ends_sha256 in place of their lists of ids."""
    trunk = found.nodes.where("ends IS NULL").drop("ends").join(trunk_digests(found.trunk_ends), "node", "left")
    rest = found.nodes.where("ends IS NOT NULL").withColumn("ends_sha256", ends_sha256(F.col("ends"))).drop("ends")
    return rest.unionByName(trunk.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of each node's last turn; null for the root."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(turn_key(role, text).alias("turn"), role.alias("role"), text.alias("text")).dropDuplicates(["turn"])
    return nodes.join(turns, "turn", "left")

"""Operator 11 against plain prefixes, on shards of all sizes."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tiltscale.llm import prefix_trie


def brute(rows):
    """Nodes of conversations (id, turns), from every prefix."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    key = lambda i: (i is not None, i or 0)
    for i, turns in rows:
        for d in range(len(turns) + 1):
            members[turns[:d]].append(i)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
        ends[turns].append(i)
    own = {n: (len(m) - 1) * len(n[-1][1].encode()) if n else 0 for n, m in members.items()}
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += own[n]
    least = {n: min(m, key=key) for n, m in members.items()}
    text = lambda n: ",".join("null" if i is None else str(i) for i in sorted(ends[n], key=key))
    return sorted(
        repr((least[n], len(n), least[n[:-1]] if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(text(n).encode()).hexdigest())) for n, m in members.items()
    )


def found(spark, rows, most):
    table = [(i, k, r, t, "x") for i, turns in rows for k, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, path string")
    nodes = prefix_trie.with_digests(prefix_trie.trie(prefix_trie.paths(frame), most))
    return sorted(repr(tuple(r)) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("most", [1, 3, 2048])
def test_trie_of_random_conversations(spark, most):
    rng = random.Random(most)
    rows = [(i, tuple(("user", rng.choice(["a", "b", "été"])) for _ in range(rng.randint(1, 5)))) for i in range(120)]
    rows += [(1000 + i, (("user", "hello"), ("assistant", "hello again"))) for i in range(60)]  # copies
    long = tuple(("user", str(k % 3)) for k in range(40))  # beyond CUT, and parting there
    rows += [(2000 + i, long[: 20 + i] + (("user", f"end {i % 2}"),)) for i in range(8)] + [(3000 + i, long) for i in range(4)]
    rows.append((None, (("user", "hello"), ("assistant", "hello again"))))
    assert found(spark, rows, most) == brute(rows)


def test_trie_of_odd_rows(spark):
    table = [(1, None, None, "b"), (1, 0, "user", None), (1, 0, "user", None), (2, 1, "user", ""), (2, 1, "user", ""), (2, None, "", "b"), (3, 5, "user", "x" * 100_000)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    made = prefix_trie.trie(prefix_trie.paths(frame))
    nodes = {(r.depth, r.conv_id): r for r in prefix_trie.with_digests(made).collect()}
    # null turns first, null texts empty, repeated rows are turns: 1 and 2 are the same conversation
    assert nodes[3, 1].n_convs == 2 and nodes[3, 1].ends_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert nodes[0, 1].n_leaves == 2 and nodes[0, 1].saved_tokens == 1 and nodes[1, 3].n_convs == 1
    texts = {(r.depth, r.conv_id): (r.role, r.text) for r in prefix_trie.node_texts(made.nodes, frame).collect()}
    assert texts[0, 1] == (None, None) and texts[1, 1] == ("", "b") and texts[1, 3] == ("user", "x" * 100_000)
    none = prefix_trie.with_digests(prefix_trie.trie(prefix_trie.paths(frame.limit(0))))
    assert none.collect() == []


def test_roots_of_turnless_conversations(spark):
    convs = prefix_trie.paths(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    empty = convs.select(F.lit(7).cast("long").alias("conv_id"), F.slice("path", 1, 0).alias("path"))
    (row,) = prefix_trie.with_digests(prefix_trie.trie(empty)).collect()
    assert (row.depth, row.conv_id, row.n_convs, row.n_leaves, row.ends_sha256) == (0, 7, 1, 1, hashlib.sha256(b"7").hexdigest())

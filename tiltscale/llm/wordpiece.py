"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links: where no edge goes on, the link leads to the
node reached by what is left after popping the greedy pieces, and the number of pieces
popped is precomputed. A word's count of greedy word pieces is read off in one pass over
its letters, without building a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, shared

#: Bytes that a task spends on remembering the counts of words.
MEMORY = 48_000_000
#: Of a word that the vocabulary cannot spell.
UNKNOWN = -1


class Automaton:
    """Counts of greedy pieces: ``first`` may begin a word, ``later`` may go on with it."""

    def __init__(self, first: set[str], later: set[str]) -> None:
        self.edges: list[dict[str, int]] = [{}, {}]  # of the roots of first and later pieces
        self.link, self.pops = [UNKNOWN, UNKNOWN], [0, 0]
        ends = [False, False]
        for root, words in ((0, first), (1, later)):
            for word in sorted(words):
                node = root
                for c in word:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = self.edges[node][c]
                ends[node] = ends[node] or bool(word)
        self.link += [UNKNOWN] * (len(self.edges) - 2)
        self.pops += [0] * (len(self.edges) - 2)
        queue = [(0, c, n) for c, n in self.edges[0].items()] + [(1, c, n) for c, n in self.edges[1].items()]
        for parent, c, node in queue:  # by depth: links of shorter strings are ready
            if ends[node]:
                self.link[node], self.pops[node] = 1, 1
            else:
                at, popped = self.link[parent], self.pops[parent]
                while at != UNKNOWN and c not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at != UNKNOWN:
                    self.link[node], self.pops[node] = self.edges[at][c], popped
            queue.extend((node, d, n) for d, n in self.edges[node].items())

    def count(self, word: str) -> int:
        """Greedy pieces of a word, or UNKNOWN."""
        edges, link, pops, node, total = self.edges, self.link, self.pops, 0, 0
        for c in word:
            while c not in edges[node]:
                if link[node] == UNKNOWN:
                    return UNKNOWN
                total += pops[node]
                node = link[node]
            node = edges[node][c]
        while node != 1:
            if link[node] == UNKNOWN:
                return UNKNOWN
            total += pops[node]
            node = link[node]
        return total


def split_vocabulary(vocabulary: list[str]) -> tuple[set[str], set[str]]:
    """Pieces that begin a word, without their space mark, and pieces that go on with one."""
    first = {p[1:] for p in vocabulary if p.startswith(pieces.MARK) and pieces.MARK not in p[1:] and len(p) > 1}
    return first, {p for p in vocabulary if pieces.MARK not in p}


@lru_cache(4)
def automaton(path: str) -> Automaton:
    m = pieces.model(path)
    return Automaton(*split_vocabulary(list(m.ids)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words), one row per row of ``docs``.

    Words are what ASCII white space separates; a word that the vocabulary cannot spell is
    one unknown token. A null or empty text has no words; texts of any length are counted
    whole; repeated rows count alike; an empty table gives no rows; columns but doc_id and
    text are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        known = shared.Memo(lambda w: auto.count(w.decode()), MEMORY)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = text.as_py().split()
                found = list(map(known.__getitem__, words))
                unknown = found.count(UNKNOWN)
                rows.append((len(words), sum(found) + 2 * unknown, unknown))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(shared.tidy(scan), "doc_id long, n_words long, n_tokens long, n_unknown long")

"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine.

A bounded number of labelled documents of each class are the examples. All their words
are terms. A term's weight is its TF-IDF, times its relevance: chi-squared of the term and
the label, shrunk smoothly to between 0 and 1, so that no term is left out and those that
tell the classes apart count most. The examples' vectors are held in an inverted index
whose postings are cut into blocks of examples, each with its largest weight: a query
visits blocks by their upper bound and stops when none left can reach its k-th best
neighbour, so the neighbours are exact. Neighbours vote with weights that fall with
their distance; votes are calibrated on the examples, each left out in turn.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled examples of each class, at most; those of the smallest id hash are taken.
EXAMPLES = 1000
#: Relevance of a term: (x / (x + SHRINK)) squared, for the chi-squared x of term and label.
SHRINK = 30.0
NEIGHBOURS, BLOCK = 15, 256
#: A neighbour at distance d votes with weight 1 / (SMOOTH + d).
SMOOTH = 0.05
#: Labels are learnt only from ids whose crc32 is not 0 modulo this.
FOLDS = 5

_WORD = re.compile(r"[^\W_]+")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def words_of(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Index:
    """Inverted index of the examples: as large as the vocabulary of at most 2 * EXAMPLES texts."""

    terms: dict[str, int]
    weight: np.ndarray  # of terms: idf times relevance
    ids: np.ndarray  # of the examples that have words
    toxic: np.ndarray
    stands: np.ndarray  # labelled documents of its class that an example stands for
    start: np.ndarray  # postings of term t in block b: start[t, b] to start[t, b + 1]
    rows: np.ndarray  # within the block
    values: np.ndarray
    top: np.ndarray  # largest weight of term t in block b
    base: float  # toxic share of the labelled documents
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, counts: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, of length one; words that no example holds have no part in it."""
        get = self.terms.get
        at = np.array([get(w, -1) for w in counts], np.int64)
        tf = np.array(list(counts.values()), float)[at >= 0]
        at = at[at >= 0]
        w = (1 + np.log(tf)) * self.weight[at]
        return at, w / max(math.sqrt(w @ w), 1e-300)

    def nearest(self, terms: np.ndarray, q: np.ndarray, skip: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest examples, ties by row; ``skip`` leaves one out."""
        bound = q @ self.top[terms]
        rows, scores, least = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < least - 1e-6:
                break
            begin = self.start[terms, b]
            size = self.start[terms, b + 1] - begin
            ends = np.cumsum(size)
            at = np.repeat(begin - ends + size, size) + np.arange(ends[-1])
            found = np.bincount(self.rows[at], self.values[at] * np.repeat(q, size), BLOCK)
            new = np.flatnonzero(found)
            new = new[new + b * BLOCK != skip]
            rows, scores = np.concatenate([rows, new + b * BLOCK]), np.concatenate([scores, found[new]])
            keep = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[keep], scores[keep]
            least = scores[-1] if len(scores) == k else 0.0
        return rows, scores

    def vote(self, terms: np.ndarray, q: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray]:
        """The distance-weighted toxic share, and the neighbours; one vote more is the base share's."""
        rows, scores = self.nearest(terms, q, skip) if len(terms) else (np.empty(0, np.int64), np.empty(0))
        w = self.stands[rows] / (SMOOTH + np.maximum(0, 1 - scores))
        return float((w @ self.toxic[rows] + self.base) / (w.sum() + 1)), rows

    def calibrated(self, vote: float) -> float:
        p = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(p / (1 - p)) + self.shift)))

    def judge(self, text: str) -> tuple[float, np.ndarray]:
        """Score and neighbours of a text."""
        vote, rows = self.vote(*self.vector(words_of(text)))
        return self.calibrated(vote), rows


def term_weights(examples: list[tuple[int, int, Counter[str]]]) -> dict[str, float]:
    """idf times relevance of every word of the examples (id, toxic, word counts)."""
    held = Counter(), Counter()
    for _, y, counts in examples:
        held[y].update(counts.keys())
    words = sorted(held[0].keys() | held[1].keys())
    b, a = (np.array([side[w] for w in words], float) for side in held)
    n, p = (float(sum(e[1] == y for e in examples)) for y in (0, 1))
    spread = (a + b) * (p + n - a - b) * p * n
    chi = (p + n) * (a * (n - b) - b * (p - a)) ** 2 / np.where(spread > 0, spread, np.inf)
    # a word that is as frequent in both classes keeps a trace, so that every word finds neighbours
    relevance = np.maximum((chi / (chi + SHRINK)) ** 2, 1e-6)
    idf = np.log((1 + p + n) / (1 + a + b)) + 1
    return dict(zip(words, (idf * relevance).tolist(), strict=True))


def build(examples: list[tuple[int, int, Counter[str]]], totals: dict[int, int]) -> Index:
    """Index of examples (id, toxic, word counts); ``totals``: labelled documents of each class."""
    share = {y: totals.get(y, 0) / max(1, sum(e[1] == y for e in examples)) for y in (0, 1)}
    weights = term_weights(examples)
    terms = {w: i for i, w in enumerate(weights)}
    index = Index(terms, np.array(list(weights.values())), *[np.empty(0)] * 7, base=totals.get(1, 0) / max(1, sum(totals.values())))
    vectors = [(e, *index.vector(e[2])) for e in examples if e[2]]
    # examples that share their weightiest term stand together, so that bounds tell blocks apart
    vectors.sort(key=lambda v: (int(v[1][np.argmax(v[2])]), v[0][0], v[0][1]))
    n, blocks = len(vectors), -(-len(vectors) // BLOCK)
    index.ids, index.toxic = np.array([e[0] for e, _, _ in vectors], np.int64), np.array([e[1] for e, _, _ in vectors], float)
    index.stands = np.array([share[e[1]] for e, _, _ in vectors], float)
    joined = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    term, value = joined([t for _, t, _ in vectors], np.int64), joined([w for _, _, w in vectors], float)
    row = np.repeat(np.arange(n), [len(t) for _, t, _ in vectors])
    place = term * max(blocks, 1) + row // BLOCK
    order = np.argsort(place, kind="stable")
    index.rows, index.values = (row % BLOCK)[order].astype(np.int32), value[order]
    edges = np.searchsorted(place[order], np.arange(len(terms) * blocks + 1))
    index.start = np.zeros((len(terms), blocks + 1), np.int64)
    index.top = np.zeros((len(terms), blocks))
    if blocks and terms:
        index.start[:, :-1], index.start[:, -1] = edges[:-1].reshape(-1, blocks), edges[blocks::blocks]
        np.maximum.at(index.top.reshape(-1), place, value)
    return index


def calibrate(index: Index, votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 30) -> None:
    """Logistic fit of the labels on the votes' log-odds, with a small ridge, by Newton's method."""
    p = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.column_stack([np.log(p / (1 - p)), np.ones(len(p))])
    beta, w = np.array([1.0, 0.0]), weight / weight.mean()
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (w * (toxic - mu)) - (beta - [1.0, 0.0])
        beta = beta + np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x + np.eye(2), grad)
    if np.isfinite(beta).all() and beta[0] > 0:
        index.slope, index.shift = map(float, beta)


def _examples(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """The examples' id, text and label, written; and the labelled documents of each class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class ids are broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return shared.materialize(texts.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")), "examples"), totals


def fit(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES) -> Index:
    """Learn from the labelled documents outside fold 0.

    A label that is null or neither 0 nor 1 is none; a document with both labels is toxic;
    one text under both labels is two examples, several documents of one text and label are
    one. Empty tables give an index without examples, whose base share is that of the labels.
    """
    examples, totals = _examples(docs, labels, per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column("text")]
            words, counts = (pa.array([list(x) for x in xs], pa.list_(kind)) for xs, kind in (((c.keys() for c in found), pa.string()), ((c.values() for c in found), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), words, counts], ["doc_id", "toxic", "words", "counts"])

    held = examples.mapInArrow(shared.tidy(count), "doc_id long, toxic int, words array<string>, counts array<long>").toArrow()  # bounded by per_class
    rows = [(r["doc_id"], r["toxic"], Counter(dict(zip(r["words"], r["counts"], strict=True)))) for r in held.to_pylist()]
    index = build(sorted(rows, key=lambda r: (r[0], r[1], sorted(r[2].items())[:1])), totals)
    if len(index.ids):
        row_of = {(i, y): row for row, (i, y) in enumerate(zip(index.ids.tolist(), index.toxic.tolist(), strict=True))}
        at = np.array([row_of[e[0], e[1]] for e in rows if e[2]])
        votes = np.array([index.vote(*index.vector(e[2]), skip=row)[0] for e, row in zip((e for e in rows if e[2]), at, strict=True)])
        calibrate(index, votes, index.toxic[at], index.stands[at])
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the neighbours), per row of ``docs``.

    A null or empty text, or one of unknown words only, has no neighbours and gets the
    calibrated share of toxic labels (zero where nothing is labelled). Texts of any length
    are read whole. Repeated rows score alike; an empty table gives no rows; columns but
    doc_id and text are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            found = [index.judge(t.as_py()) for t in batch.column("text")]
            scores, evidence = [s for s, _ in found], [index.ids[rows].tolist() for _, rows in found]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), shared.text_or_empty().alias("text"))
    return rows.mapInArrow(shared.tidy(scan), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def drop_toxic(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns stay.

    Null and empty texts score as in ``score``; repeated rows stay or go together; an empty
    table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = held.value
        for batch in texts:
            yield pa.array([index.judge(t.as_py() or "")[0] >= 0.5 for t in batch], pa.bool_())

    toxic = F.arrow_udf(shared.tidy(predict), "boolean", F.ArrowUDFType.SCALAR_ITER)
    return docs.where(~toxic("text"))

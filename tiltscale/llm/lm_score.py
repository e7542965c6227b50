"""Scores of texts under a causal self-attention model over subword ids.

Subword ids fall into classes. In one layer of causal self-attention the classes of the
ids so far are attended to, with weights from learnt queries, keys and distances; every
class attended to has a learnt distribution of the next class as its value, so the next
class's distribution is their mean under the attention. An id follows its class by its
count over all training texts. A text is cut into units of ``UNIT`` ids; each unit is
scored with the unit before it as context, so windows overlap and every id is scored once.

A word's first id is the attention's. How the word goes on after it is a Witten-Bell mean
of the training count of the whole word among words of that first id and of the
attention's probability of its other ids and its end. So the scores of all texts of words
are one distribution.

Words are counted by 64-bit hash over all training texts. Texts are gathered into blocks
of bounded size, as numbers of the block's distinct words; a block sends each of its
distinct words once and gets the counts back.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .token_files import Store

FOLDS, HELD = 7, 2
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 16_000_000
#: Classes: of the end, of unseen first ids, of unseen inner ids, then of first ids, then of inner ids.
CLASSES, FIRST_CLASSES = 192, 76
#: Width of queries and keys, and ids of a unit.
WIDTH, UNIT = 16, 16
#: Rounds of local passes; each training text is in one of them, with all of its units.
ROUNDS = 2
#: Hash buckets of the ids before an id, and as many of those after it, that classes are told by.
BUCKETS = 8
#: Ids that are held in memory at a time, units of a training step, and units scored at a time.
CHUNK, BATCH, SCORED = 200_000, 512, 128
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


class Subwords:
    """Ids of words; the first id of a word begins with its space, and END follows the last word."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.first = np.zeros(self.size, bool)
        self.first[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True

    def ids(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode("utf-8", "replace"))

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has.

        Words of letters are encoded many at a time: of their pieces only the first begins
        with a space, so the joined ids can be cut apart again.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        alpha = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        source, size, start = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        base = 0
        for at in np.array_split(np.flatnonzero(alpha), max(1, int(alpha.sum()) // 20_000)):
            found = np.array(self.encode("".join([" " + texts[i] for i in at])), np.int32)
            cuts = np.flatnonzero(self.first[found]) if len(found) else np.empty(0, np.int64)
            if len(cuts) != len(at):
                alpha[at] = False
                continue
            size[at], start[at] = np.diff(np.append(cuts, len(found))), cuts + base
            source.append(found)
            base += len(found)
        for i in np.flatnonzero(~alpha):
            found = np.array(self.encode(" " + texts[i]), np.int32)
            size[i], start[i] = len(found), base
            source.append(found)
            base += len(found)
        return (np.concatenate(source)[runs(start, size)] if source else np.empty(0, np.int32)), size


class Numbers(dict):
    """Numbers of distinct words, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


_subwords: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.lower().split()


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[k], start[k] + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def buckets(size: int) -> np.ndarray:
    """Bucket of each id."""
    return (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Block:
    """Texts as numbers of distinct words, the last of which is the end; and the ids of these words."""

    doc_id: pa.Array
    held_out: np.ndarray
    word: np.ndarray
    at: np.ndarray  # where the words of each text begin, and the last's end
    ids: np.ndarray
    start: np.ndarray  # where the ids of each word begin, and the last's end
    counts: np.ndarray  # of the words in this block's training texts

    def __post_init__(self) -> None:
        self.size = np.diff(self.start)

    def write(self, store: Store, name: str) -> None:
        lists = lambda at, values: pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(values, pa.int32()))
        parts = {
            "docs": {"doc_id": self.doc_id, "held_out": pa.array(self.held_out), "words": lists(self.at, self.word)},
            "words": {"ids": lists(self.start, self.ids), "counts": pa.array(self.counts, pa.int64())},
        }
        for kind, columns in parts.items():
            with store.create(f"{kind}-{name}") as out:
                table = pa.table(columns)
                with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table)
            store.commit(f"{kind}-{name}", store.pending)

    @staticmethod
    def read(store: Store, name: str) -> Block:
        docs, words = (pa.ipc.open_file(pa.py_buffer(store.map(f"{kind}-{name}", np.uint8))).read_all().combine_chunks() for kind in ("docs", "words"))
        flat = lambda table, c: table.column(c).combine_chunks()
        lists, ids = flat(docs, "words"), flat(words, "ids")
        return Block(
            flat(docs, "doc_id"), flat(docs, "held_out").to_numpy(zero_copy_only=False), lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64),
            ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64), flat(words, "counts").to_numpy(),
        )

    def chunks(self, docs: np.ndarray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The texts ``docs`` in groups of about ``size`` ids (CHUNK): their numbers, words, words a text and ids."""
        sizes = np.diff(self.at)[docs]
        group = np.cumsum(sizes) // max(1, (size or CHUNK) // 2)
        for part in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                word = self.word[runs(self.at[docs[part]], sizes[part])]
                yield docs[part], word, sizes[part], self.ids[runs(self.start[word], self.size[word])]


def classes(around: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Class of each id, from the counts of the id buckets before and after it in all training texts.

    Spherical k-means, among first and among inner ids apart; centres start at the most
    frequent ids.
    """
    seen = around[:, :BUCKETS].sum(axis=1)
    out = np.where(first, 1, 2)
    for which, low, k in ((first, 3, FIRST_CLASSES), (~first, 3 + FIRST_CLASSES, CLASSES - 3 - FIRST_CLASSES)):
        often = np.flatnonzero((seen > 0) & which & (np.arange(len(seen)) != end))
        if len(often) <= k:
            out[often] = low + np.arange(len(often))
            continue
        x = around[often] / seen[often][:, None]
        x = np.sqrt(x) - np.sqrt(np.average(x, axis=0, weights=seen[often]))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        weight = np.sqrt(seen[often])
        centres = x[np.argsort(-seen[often], kind="stable")[:k]]
        for _ in range(15):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.array([np.bincount(near, x[:, d] * weight, k) for d in range(x.shape[1])]).T
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
        out[often] = near + low
    out[end] = 0
    return out


def opens() -> np.ndarray:
    """Whether a class is of the end or of first ids: what ends the word before."""
    at = np.arange(CLASSES)
    return (at != 2) & (at < 3 + FIRST_CLASSES)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Attention:
    """One causal self-attention layer over classes; index ``CLASSES`` of inputs is the start."""

    query: np.ndarray  # (CLASSES + 1, WIDTH)
    key: np.ndarray
    near: np.ndarray  # (2 * UNIT,): score of each distance
    own: np.ndarray  # (CLASSES + 1, CLASSES): logits of the class after the last one
    value: np.ndarray  # the same for classes farther back

    @classmethod
    def new(cls, shares: np.ndarray, seed: int = 3) -> Attention:
        """Small random queries and keys; all values are the classes' shares."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: 0.1 * rng.standard_normal(shape)
        logits = np.tile(np.log(shares), (CLASSES + 1, 1))
        return cls(small(CLASSES + 1, WIDTH), small(CLASSES + 1, WIDTH), np.zeros(2 * UNIT), logits, logits.copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.query, self.key, self.near, self.own, self.value)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Attention:
        shapes = [(CLASSES + 1, WIDTH)] * 2 + [(2 * UNIT,)] + [(CLASSES + 1, CLASSES)] * 2
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*[p.reshape(s) for p, s in zip(np.split(flat, cuts), shapes, strict=True)])

    def tables(self) -> tuple[np.ndarray, ...]:
        """exp of the scores of class pairs, and of distances as a UNIT by 2 UNIT causal mask; the values."""
        pair = np.exp(np.clip(self.query @ self.key.T / np.sqrt(WIDTH), -20, 20))
        near = np.exp(np.clip(self.near, -20, 20))
        mask = np.where(AWAY >= 0, near[np.maximum(AWAY, 0)], 0)
        return tuple(x.astype(np.float32) for x in (pair, mask, _softmax(self.own), _softmax(self.value)))


#: Distance from each place of a unit back to each place of its context; negative: ahead of it.
AWAY = np.arange(UNIT)[:, None] + UNIT - np.arange(2 * UNIT)[None, :]


def units(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of texts laid one after the other: the first place, whether it begins a text, places used."""
    count = -(-lengths // UNIT)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    which = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return base[which] + nth * UNIT, nth == 0, np.minimum(lengths[which] - nth * UNIT, UNIT)


def shifted(targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The class before each target; before a text's first stands the start."""
    inputs = np.concatenate([[CLASSES], targets[:-1]])
    inputs[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = CLASSES
    return inputs


class Room:
    """Arrays of up to ``n`` units' pairs of places, used again by each step: fresh ones cost more than what is done with them."""

    def __init__(self, n: int) -> None:
        shape = (n, UNIT, 2 * UNIT)
        self.at, self.to, self.a, self.r = np.empty(shape, np.intp), np.empty(shape, np.intp), np.empty(shape, np.float32), np.empty(shape, np.float32)

    def values(self, values: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` of each context class with each target, and the values there."""
        to = np.add((c * CLASSES)[:, None, :], t[:, :, None], out=self.to[: len(c)])
        return to, values.take(to, out=self.r[: len(c)], mode="clip")


class Batches:
    """Contexts and targets of the units of texts, laid one after the other."""

    def __init__(self, targets: np.ndarray, lengths: np.ndarray) -> None:
        pad = np.zeros(UNIT, np.intp)
        self.inputs = np.concatenate([pad, shifted(targets, lengths).astype(np.intp), pad])
        self.wanted = np.concatenate([targets.astype(np.intp), pad])
        self.start, self.first, self.used = units(lengths)

    def attend(self, pick: np.ndarray | slice, pair: np.ndarray, mask: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
        """Of the units: places, context classes, own classes, targets, pairs' places in ``pair``, and the masked attention."""
        start = self.start[pick]
        places = start[:, None] + np.arange(UNIT)
        c = self.inputs[start[:, None] + np.arange(2 * UNIT)]
        own, t = c[:, UNIT:], self.wanted[places]
        at = np.add((own * (CLASSES + 1))[:, :, None], c[:, None, :], out=room.at[: len(start)])
        a = pair.take(at, out=room.a[: len(start)], mode="clip")
        a *= mask
        a[self.first[pick], :, :UNIT] = 0
        a /= np.einsum("uij->ui", a)[:, :, None]
        return places, c, own, t, at, a


_DIAGONAL = np.arange(UNIT)


def class_scores(model: Attention, targets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs of the probability of each target class, and of any class that ``opens`` a word, at its place."""
    pair, mask, own_values, values = model.tables()
    own_opens, opening = own_values[:, opens()].sum(axis=1), values[:, opens()].sum(axis=1)
    b, out, room = Batches(targets, lengths), np.empty((2, len(targets)), np.float32), Room(SCORED)
    for at in range(0, len(b.start), SCORED):
        pick = slice(at, at + SCORED)
        places, c, own, t, _, a = b.attend(pick, pair, mask, room)
        last = a[:, _DIAGONAL, _DIAGONAL + UNIT].copy()
        a[:, _DIAGONAL, _DIAGONAL + UNIT] = 0
        p = np.einsum("uij,uij->ui", a, room.values(values, c, t)[1])
        p += last * own_values.take(own * CLASSES + t)
        s = np.matmul(a, opening.take(c)[:, :, None])[:, :, 0] + last * own_opens.take(own)
        ok = np.arange(UNIT) < b.used[pick, None]
        out[0, places[ok]], out[1, places[ok]] = np.log(p[ok]), np.log(s[ok])
    return out[0], out[1]


def train(flat: np.ndarray, targets: np.ndarray, lengths: np.ndarray, rate: float = 0.02) -> np.ndarray:
    """One pass of Adam over the units of the texts' classes, from the weights ``flat``; returns new weights."""
    b, room, k, root = Batches(targets, lengths), Room(BATCH), CLASSES + 1, np.sqrt(WIDTH)
    order = np.random.default_rng(len(targets)).permutation(len(b.start))
    flat = flat.astype(np.float32)
    m, v, grad, by = (np.zeros_like(flat) for _ in range(4))
    p, g = Attention.of(flat), Attention.of(grad)  # views
    away = np.maximum(AWAY, 0).ravel()
    for step, first in enumerate(range(0, len(order), BATCH), 1):
        pick = order[first : first + BATCH]
        pair, mask, own_values, values = p.tables()
        _, c, own, t, at, a = b.attend(pick, pair, mask, room)
        ok = (np.arange(UNIT) < b.used[pick, None]).astype(np.float32)
        to_own = own * CLASSES + t
        to, r = room.values(values, c, t)
        r *= a
        r[:, _DIAGONAL, _DIAGONAL + UNIT] = a[:, _DIAGONAL, _DIAGONAL + UNIT] * own_values.take(to_own)
        r *= (ok / np.einsum("uij->ui", r))[:, :, None]  # how much each place explains the target
        a *= ok[:, :, None]
        a -= r
        last = r[:, _DIAGONAL, _DIAGONAL + UNIT].copy()
        r[:, _DIAGONAL, _DIAGONAL + UNIT] = 0
        pairs = (np.bincount(at.ravel(), a.ravel(), k * k).reshape(k, k) / root).astype(np.float32)
        np.matmul(pairs, p.key, out=g.query)
        np.matmul(pairs.T, p.query, out=g.key)
        g.near[:] = np.bincount(away, a.sum(axis=0).ravel(), 2 * UNIT)
        for into, held, where, share in ((g.own, own_values, to_own, last), (g.value, values, to, r)):
            seen = np.bincount(where.ravel(), share.ravel(), k * CLASSES).reshape(k, CLASSES)
            np.multiply(held, seen.sum(axis=1, keepdims=True), out=into, casting="same_kind")
            into -= seen
        grad /= max(1.0, float(ok.sum()))
        m *= 0.9
        m += np.multiply(grad, 0.1, out=by)
        v *= 0.99
        v += np.multiply(np.square(grad, out=by), 0.01, out=by)
        np.sqrt(np.divide(v, 1 - 0.99**step, out=by), out=by)
        by += 1e-8
        flat -= np.multiply(np.divide(m, by, out=by), rate / (1 - 0.9**step), out=by)
    return flat.astype(np.float64)


def within(counts: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """log P(id | its class), from the ids' counts."""
    size, mass = np.bincount(class_of, minlength=CLASSES), np.bincount(class_of, counts, CLASSES)
    return np.log((counts + 0.5) / (mass + 0.5 * size)[class_of])


@dataclass
class Language:
    """The learnt model: its size is fixed by the ids and classes."""

    class_of: np.ndarray
    inside: np.ndarray  # log P(id | class)
    flat: np.ndarray  # of the attention
    total: np.ndarray  # training words by first id
    kinds: np.ndarray  # distinct training words by first id

    def text_scores(self, ids: np.ndarray, size: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log probability of texts laid one after the other.

        ``size`` and ``counts``: ids and training count of each word, ends included;
        ``words``: words of each text.
        """
        start, text = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(words)[:-1]])
        lp, opening = (x.astype(np.float64) for x in class_scores(Attention.of(self.flat), self.class_of[ids], np.add.reduceat(size, text)))
        lp += self.inside[ids]
        out = lp[start] - opening[start]
        is_word = np.ones(len(size), bool)
        is_word[np.cumsum(words) - 1] = False
        at = np.flatnonzero(is_word)
        rest = np.add.reduceat(lp, start)[at] - lp[start[at]] + opening[start[at + 1]]
        total, kinds = self.total[ids[start[at]]], self.kinds[ids[start[at]]]
        out[at] += np.where(total + kinds > 0, np.log(counts[at] + kinds * np.exp(rest) + (total + kinds == 0)) - np.log(np.maximum(total + kinds, 1)), rest)
        return np.add.reduceat(out, text)


GATHERED = "block string, trained long, hashes array<long>, counts array<long>, firsts array<int>, around array<int>, around_counts array<long>"


def _gather(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the texts in blocks, and return per block: its words, their training counts and
    first ids, and its training counts of (id, bucket of the id before or after)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, store, part = subwords(path), Store(folder), TaskContext.get().partitionId()
        bucket_of, n, held_bytes = buckets(sub.size), 0, 0
        numbers, rows = Numbers(), []

        def flush() -> pa.RecordBatch:
            nonlocal n, held_bytes
            name, words, end = f"{part}-{n}", list(numbers), np.array([len(numbers)], np.int32)
            word = np.concatenate([x for _, _, w in rows for x in (w, end)])
            at = np.concatenate([[0], np.cumsum([len(w) + 1 for _, _, w in rows])])
            held_out = np.array([h for _, h, _ in rows], bool)
            ids, size = sub.ids_of(words)
            ids, start = np.append(ids, np.int32(sub.end)), np.concatenate([[0], np.cumsum(np.append(size, 1))])
            learnt = ~np.repeat(held_out, np.diff(at))
            counts = np.bincount(word[learnt], minlength=len(words) + 1)
            block = Block(pa.array([d for d, _, _ in rows], pa.int64()), held_out, word, at, ids, start, counts)
            block.write(store, name)
            around, edge = np.zeros(sub.size * 2 * BUCKETS, np.int64), bucket_of[[sub.end]]
            for _, _, _, x in block.chunks(np.flatnonzero(~held_out), 10 * CHUNK):
                b, place = bucket_of[x], x.astype(np.int64) * (2 * BUCKETS)  # the end of the text before stands for a text's start
                around += np.bincount(np.concatenate([place + np.append(edge, b[:-1]), place + BUCKETS + np.append(b[1:], edge)]), minlength=len(around))
            used = np.flatnonzero(around)
            row = pa.RecordBatch.from_pydict({
                "block": [name], "trained": pa.array([int((~held_out).sum())], pa.int64()),
                "hashes": pa.array([np.fromiter(map(hash_of, words), np.uint64, len(words)).view(np.int64)], pa.list_(pa.int64())),
                "counts": pa.array([counts[:-1]], pa.list_(pa.int64())), "firsts": pa.array([ids[start[:-2]]], pa.list_(pa.int32())),
                "around": pa.array([used.astype(np.int32)], pa.list_(pa.int32())), "around_counts": pa.array([around[used]], pa.list_(pa.int64())),
            })
            n, held_bytes = n + 1, 0
            numbers.clear()
            rows.clear()
            return row

        for batch in batches:
            for doc_id, held, text in zip(*[batch.column(c) for c in ("doc_id", "held_out", "text")], strict=True):
                data = text.as_py()
                if rows and held_bytes + len(data) > BLOCK:
                    yield flush()
                words = words_of(data)
                rows.append((doc_id.as_py(), held.as_py(), np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                held_bytes += len(data)
        if rows:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD).alias("held_out"), shared.text_or_empty().cast("binary").alias("text"))
    return shared.materialize(rows.mapInArrow(shared.tidy(scan), GATHERED), "lm-blocks")


def _fit_attention(gathered: DataFrame, folder: str, class_of: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Rounds of local passes over each partition's texts and means of the weights, by ids seen."""
    spark, flat = gathered.sparkSession, Attention.new(shares).flat()
    few = max(1, min(16, shared.partitions(spark)))
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast((class_of, flat))  # fixed size

        def local(batches: Iterator[pa.RecordBatch], turn: int = turn, now: object = now) -> Iterator[pa.RecordBatch]:
            (class_of, flat), store, seen = now.value, Store(folder), 0
            for batch in batches:
                for name in batch.column("block").to_pylist():
                    block = Block.read(store, name)
                    docs = np.flatnonzero(~block.held_out)[turn::ROUNDS]
                    for _, word, words, ids in block.chunks(docs):
                        flat = train(flat, class_of[ids], np.add.reduceat(block.size[word], np.cumsum(words) - words))
                        seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_pydict({"weights": pa.array([flat], pa.list_(pa.float64())), "n": pa.array([seen], pa.int64())})

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = 0.0, 0
            for batch in batches:
                for w, n in zip(batch.column("weights"), batch.column("n"), strict=True):
                    total, seen = total + w.values.to_numpy() * n.as_py(), seen + n.as_py()
            if seen:
                yield pa.RecordBatch.from_pydict({"weights": pa.array([total / seen], pa.list_(pa.float64())), "n": pa.array([seen], pa.int64())})

        schema = "weights array<double>, n long"
        rows = gathered.select("block").mapInArrow(shared.tidy(local), schema).repartition(few).mapInArrow(mean, schema).collect()  # ``few`` rows
        if rows:
            flat = sum(np.array(r.weights) * r.n for r in rows) / sum(r.n for r in rows)
        now.destroy()
    return flat


def _fit(gathered: DataFrame, counted: DataFrame, folder: str, path: str) -> Language:
    """The model of all training texts; what reaches the driver is bounded by the number of ids."""
    sub = subwords(path)
    summed = gathered.select(F.explode(F.arrays_zip("around", "around_counts")).alias("x")).groupBy("x.around").agg(F.sum("x.around_counts").alias("n")).toArrow()
    around = np.zeros(sub.size * 2 * BUCKETS)
    around[summed.column("around").to_numpy()] = summed.column("n").to_numpy()
    around = around.reshape(sub.size, -1)
    class_of, counts = classes(around, sub.first, sub.end), around[:, :BUCKETS].sum(axis=1)
    shares = np.bincount(class_of, counts, CLASSES) + 1.0
    flat = _fit_attention(gathered, folder, class_of, shares / shares.sum())
    total, kinds = np.zeros(sub.size), np.zeros(sub.size)
    for r in counted.groupBy("first").agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect():
        total[r["first"]], kinds[r["first"]] = r.c, r.kinds
    return Language(class_of, within(counts, class_of), flat, total, kinds)


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, per row of ``docs``.

    A null text is empty: its only token is the end. Texts of fold ``HELD`` are scored but
    not learnt from; a null id counts as empty text there. Texts of any length are scored
    whole. Repeated rows score alike; an empty table gives no rows; columns but doc_id and
    text are ignored.
    """
    spark = docs.sparkSession
    folder = shared.new_dir(spark, "lm-texts")
    gathered = _gather(docs, path, folder)
    held = gathered.select("block", F.posexplode(F.arrays_zip("hashes", "counts", "firsts")).alias("word", "x")).select("block", "word", F.col("x.hashes").alias("h"), F.col("x.counts").alias("n"), F.col("x.firsts").alias("first"))
    counted = shared.materialize(held.groupBy("h").agg(F.sum("n").alias("c"), F.max("first").alias("first")).where("c > 0"), "word-counts")
    fixed = spark.sparkContext.broadcast(_fit(gathered, counted, folder, path))
    ends = gathered.agg(F.sum("trained")).first()[0] or 0
    n_train, n_words = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train, distinct = n_train + ends, n_words + (ends > 0)
    # a block has its own counts, and gets back those of words that other blocks have too
    back = held.select("block", "word", "h", "n").join(counted.select("h", "c"), "h").where("c > n").groupBy("block").agg(F.collect_list(F.struct("word", "c")).alias("words"))
    work = gathered.select("block").join(back, "block", "left").select("block", "words.word", "words.c")
    floor = float(np.log10(n_train + distinct + 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, store = fixed.value, Store(folder)
        for batch in batches:
            for name, word, c in zip(batch.column("block"), batch.column("word"), batch.column("c"), strict=True):
                block = Block.read(store, name.as_py())
                counts = block.counts.copy()
                if word.is_valid:
                    counts[word.values.to_numpy()] = c.values.to_numpy()
                counts[-1] = ends
                for some, at, words, ids in block.chunks(np.arange(len(block.doc_id))):
                    n, text = counts[at], np.cumsum(words) - words
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": block.doc_id.take(pa.array(some)), "held_out": pa.array(block.held_out[some]),
                        "n_tokens": pa.array(words), "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64), text)),
                        "train_tokens": pa.array(np.full(len(some), n_train, np.int64)),
                        "base_score": pa.array(np.add.reduceat(np.log10(n + 1), text) - words * floor),
                        "score": pa.array(language.text_scores(ids, block.size[at], n, words) / np.log(10)),
                    })

    return work.mapInArrow(shared.tidy(scan), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""SentencePiece encoding that keeps offsets, and decoding.

The model file is read directly. A text is normalised by the longest prefixes that its
compiled character map holds, and every normalised byte keeps the source byte it came
from. Byte-pair merges by piece score then give the pieces, whose spans are projected to
the source. Merges never join characters that no piece holds side by side. So where no
piece has a space mark inside it the normalised text is cut before space marks, and around
characters that stand in no longer piece, and each distinct cut is merged once. The cuts
that a few texts bring for the first time are merged together, a merge of each at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MARK = "▁"
#: Bytes that a task spends on remembering the ids of cuts.
MEMORY = 48_000_000
#: Longest cut that is merged with others, and characters of those merged together.
SHORT, TOGETHER = 60, 100_000
#: Letters of the texts whose cuts are merged together, if there are several.
LETTERS = 500_000

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes and its replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :] if blob else b""

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest prefix of ``data[at:]`` in the map."""
        if not self.units:
            return None
        units, found, node = self.units, None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            has_value, node = units[node] >> 8 & 1, node ^ self._offset(units[node])
            if has_value:
                start = units[node] & 0x7FFFFFFF
                found = self.texts[start : self.texts.index(0, start)], i + 1 - at
        return found


class Pairs:
    """What neighbours merge to: pieces and their characters as numbers, pairs of them, and merges of many cuts at once."""

    #: Of what merges with nothing, of a place whose character was merged to the one before it.
    OTHER, GONE = 0, -1

    def __init__(self, ids: dict[str, int], rank: dict[str, int], none: int) -> None:
        texts = list(dict.fromkeys([*(c for p in ids for c in p), *ids]))
        number = {t: i for i, t in enumerate(texts, 1)}
        self.many, self.none = len(texts) + 1, none
        self.of_char = np.zeros(0x110000, np.int32)
        for t in texts:
            if len(t) == 1:
                self.of_char[ord(t)] = number[t]
        #: Ids of the numbered; -1 of characters that are no pieces.
        self.ids = np.array([-1, *(ids.get(t, -1) for t in texts)], np.int32)
        found = sorted((number[p[:i]] * self.many + number[p[i:]], rank[p], number[p]) for p in ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        # the last stands for pairs that do not merge
        self.codes, self.rank, self.merged = (np.array([*x, y], t) for x, y, t in zip(zip(*found, strict=True) if found else ((), (), ()), (1 << 62, none, self.OTHER), (np.int64, np.int32, np.int32), strict=True))

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.many + b
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, at, len(self.codes) - 1)

    def merge(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts, one after the other, and how many each has; no cut is empty, the longest comes last."""
        wide, sizes = len(cuts[-1]), np.fromiter(map(len, cuts), np.int64, len(cuts))
        inside = np.arange(wide) < sizes[:, None]
        parts = np.full(inside.shape, self.GONE, np.int32)
        parts[inside] = self.of_char[np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)]
        to = np.full(inside.shape, len(self.codes) - 1, np.int64)
        both = inside[:, 1:]
        to[:, :-1][both] = self._place(parts[:, :-1][both], parts[:, 1:][both])
        rank = self.rank[to]
        # one place more, before and after each cut, for the neighbours that its ends lack
        after = np.tile(np.arange(1, wide + 2, dtype=np.int32), (len(cuts), 1))
        before = np.tile(np.arange(-1, wide, dtype=np.int32), (len(cuts), 1))
        rows = np.arange(len(cuts))
        while len(rows):
            i = rank[rows].argmin(axis=1)  # the leftmost of equals
            going = rank[rows, i] < self.none
            rows, i = rows[going], i[going]
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            parts[rows, i], parts[rows, j] = self.merged[to[rows, i]], self.GONE
            after[rows, i], before[rows, k] = k, i
            rank[rows, j] = self.none
            for left, right, ok in ((i, k, k < sizes[rows]), (h, i, h >= 0)):
                at = np.full(len(rows), len(self.codes) - 1)
                at[ok] = self._place(parts[rows[ok], left[ok]], parts[rows[ok], right[ok]])
                to[rows[ok], left[ok]] = at[ok]
                rank[rows[ok], left[ok]] = self.rank[at[ok]]
                if left is i:
                    rank[rows[~ok], i[~ok]] = self.none
        left = parts != self.GONE
        return self.ids[parts[left]], left.sum(axis=1)


class Model:
    """A byte-pair model: pieces, normaliser and decoder."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only byte-pair models are supported")
        if USER in self.types or UNUSED in self.types or trainer.get(24, 0):
            raise ValueError("user-defined and unused pieces and space marks as suffixes are not supported")
        self.map = CharMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        kinds = {NORMAL: {}, BYTE: {}, UNKNOWN: {}, CONTROL: {}}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.types, strict=True)):
            kinds[kind].setdefault(piece, i)
        self.ids, self.unknown = kinds[NORMAL], next(iter(kinds[UNKNOWN].values()))
        self.bytes = [kinds[BYTE].get(f"<0x{b:02X}>") for b in range(256)] if trainer.get(35, 0) else None
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[self.scores[i]] for p, i in self.ids.items()}
        self.none = len(order)
        self.pairs = Pairs(self.ids, self.rank, self.none)
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = re.escape("".join(chr(i) for i in range(128) if chr(i) not in joined))
        apart = f"[{alone}]|" if alone else ""
        self.cuts = re.compile(".+" if inner else f"{apart}{MARK}*[^{MARK}{alone}]+|{MARK}+", re.S)
        self.shown = [self._shown(i) for i in range(len(self.pieces))]
        self.id_text = [str(i) for i in range(len(self.pieces))]
        self.plain = not self.map.units and self.prefix and self.escape and not self.squeeze
        #: Bytes of each piece, none for bytes inside a character, and of the character that a byte's piece begins.
        self.size = np.array([len(p.encode()) if t == NORMAL else int(t == BYTE and self._shown(i) < b"\x80") for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True))])
        self.lead = np.array([1 + sum(self._shown(i) >= b for b in (b"\xc0", b"\xe0", b"\xf0")) if t == BYTE and self._shown(i) >= b"\xc0" else 0 for i, t in enumerate(self.types)])
        self.forget()

    def _shown(self, i: int) -> bytes:
        """What a piece adds to a decoded sentence."""
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode() if self.types[i] == NORMAL else b""

    def _normalize_plain(self, text: str) -> tuple[str, np.ndarray]:
        """``normalize`` where no prefix is replaced and spaces stay: each becomes a mark."""
        if not text:
            return "", np.zeros(1, np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(data))
        if not text.isascii():  # bytes inside a character come from its start
            at = np.maximum.accumulate(np.where(data & 0xC0 == 0x80, 0, at))
        size = len(MARK.encode())
        source = np.repeat(at, np.where(data == 32, size, 1))
        return MARK + text.replace(" ", MARK), np.concatenate([np.zeros(size, np.int64), source, [len(data)]])

    def normalize(self, text: str) -> tuple[str, list[int] | np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the source byte."""
        if self.plain:
            return self._normalize_plain(text)
        data, out, source, at = text.encode(), bytearray(), [], 0
        mark = MARK.encode() if self.escape else b" "

        def prefix() -> tuple[bytes, int]:
            found = self.map.longest(data, at)
            if found:
                return found
            size = 1 + sum(data[at] >= b for b in (0xC0, 0xE0, 0xF0))
            return data[at : at + size], size

        if self.squeeze:
            while at < len(data):
                new, size = prefix()
                if new != b" ":
                    break
                at += size
        if at == len(data):
            return "", [0]
        if self.prefix:
            out += mark
            source += [at] * len(mark)
        spaced = self.squeeze
        while at < len(data):
            new, size = prefix()
            new = new.lstrip(b" ") if spaced else new
            for byte in new:
                coded = mark if byte == 32 else bytes([byte])
                out += coded
                source += [at] * len(coded)
            if new:
                spaced = new.endswith(b" ")
            at += size
            spaced = spaced and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                at = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return out.decode(), [*source, at]

    def merge(self, cut: str) -> list[str]:
        """Byte-pair merges, the best score first and the leftmost of equals."""
        parts, rank, none = list(cut), self.rank, self.none
        if len(parts) <= SHORT:
            ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get(parts[i - 1] + parts[i], none)
                if i < len(ranks):
                    ranks[i] = rank.get(parts[i] + parts[i + 1], none)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(p) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j], after[i] = p, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(parts) and (q := parts[left] + parts[after[left]]) in rank:
                    heapq.heappush(heap, (rank[q], left, q))
        return [p for p in parts if p is not None]

    def cut_ids(self, cut: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of one cut and their spans in its bytes.

        Of a character spelt in bytes, the last byte's piece has the span and the others
        have empty ones before it, as in the library's own offsets.
        """
        ids, spans, at = [], [], 0
        for part in self.merge(cut):
            data = part.encode()
            if part in self.ids:
                ids.append(self.ids[part])
                spans.append((at, at + len(data)))
            elif self.bytes:
                ids += [self.bytes[b] for b in data]
                spans += [(at, at)] * (len(data) - 1) + [(at, at + len(data))]
            elif ids and ids[-1] == self.unknown:
                spans[-1] = (spans[-1][0], at + len(data))
            else:
                ids.append(self.unknown)
                spans.append((at, at + len(data)))
            at += len(data)
        return ids, spans

    def _ids_of(self, cut: str) -> tuple[int, ...]:
        found = tuple(map(self.ids.get, self.merge(cut)))
        return tuple(self.cut_ids(cut)[0]) if None in found else found

    def forget(self) -> None:
        """Forget the cuts met so far: their numbers, and of each number where in ``flat`` its ids begin and how many there are."""
        self.number, self.used, self.ready = defaultdict(itertools.count().__next__), 0, {}
        self.flat, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cut(self, text: str) -> list[str]:
        return self.cuts.findall(MARK + text.replace(" ", MARK) if self.plain and text else self.normalize(text)[0])

    def learn(self, texts: list[str]) -> None:
        """Number the cuts of the texts, and merge together those that are new."""
        if self.used > MEMORY:
            self.forget()
        number, self.ready = self.number.__getitem__, {}
        for t in texts:
            cuts = self._cut(t)
            self.ready[t] = np.fromiter(map(number, cuts), np.int64, len(cuts))
        new = list(itertools.islice(reversed(self.number), len(self.number) - len(self.count)))[::-1]
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        self.used += 210 * len(new) + 6 * int(lengths.sum())  # entries, letters, places and ids
        order, first = np.argsort(lengths, kind="stable"), 0
        lengths, begin, count, flat, size = lengths[order], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.flat], len(self.flat)
        while first < len(new):
            longest = lengths[first] + 3
            end = min(int(np.searchsorted(lengths, longest, "right")), first + max(1, TOGETHER // int(longest)))
            at, first = order[first:end], end
            some = [new[i] for i in at]
            ids, sizes = self.pairs.merge(some) if len(some[-1]) <= SHORT else (np.full(len(some), -1), np.ones(len(some), np.int64))
            if (ids < 0).any():  # long ones and those spelt in bytes
                starts = np.cumsum(sizes) - sizes
                each = [self._ids_of(c) if odd else ids[i : i + n] for c, odd, i, n in zip(some, np.minimum.reduceat(ids, starts) < 0, starts, sizes, strict=True)]
                ids, sizes = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            begin[at], count[at] = size + np.cumsum(sizes) - sizes, sizes
            flat.append(ids.astype(np.int32))
            size += len(ids)
        self.flat, self.begin, self.count = np.concatenate(flat), np.concatenate([self.begin, begin]), np.concatenate([self.count, count])

    def _ids_at(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered cuts, one after the other."""
        sizes = self.count[numbers]
        return self.flat[np.repeat(self.begin[numbers] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def surface(self, ids: list[int]) -> str:
        """The text of pieces inside a sentence."""
        return b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")

    def _first_cut(self, decoded: str) -> str:
        """A decoded sentence without the space that the prefix put first, or any if they are squeezed."""
        if self.squeeze:
            return decoded.lstrip(" ")
        return decoded[1:] if self.prefix and decoded.startswith(" ") else decoded

    def decode(self, ids: list[int]) -> str:
        return self._first_cut(self.surface(ids))

    def span_sizes(self, at: np.ndarray, text: str) -> np.ndarray:
        """Normalised bytes that each id of a text spans, as ``cut_ids`` gives them; the spans leave no gaps."""
        if (at == self.unknown).any():
            return np.array([b - a for c in self._cut(text) for a, b in self.cut_ids(c)[1]], np.int64)
        sizes, lead = self.size[at], self.lead[at]
        if lead.any():  # the last byte's piece has the span of its character
            first = np.flatnonzero(lead)
            sizes[first + lead[first] - 1] = lead[first]
        return sizes

    def aligned(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and the source bytes where they begin and, last, end."""
        if text not in self.ready:
            self.learn([text])
        ids, source = self._ids_at(self.ready[text]), self.normalize(text)[1]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.span_sizes(ids, text), out=at[1:])
        return ids.tolist(), np.asarray(source)[at]

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and the source byte span of each; a prefix mark spans no bytes."""
        ids, at = self.aligned(text)
        at = at.tolist()
        return ids, list(zip(at, at[1:], strict=False))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the texts whose hashes the query returns: ids and decoded."""
        ids, at = self.aligned(text)
        return len(at) - 1, ",".join(map(self.id_text.__getitem__, ids)), self.decode(ids)

    def each(self, texts: list[str], what: Callable) -> Iterator:
        """``what`` of each text, where the cuts of a few are learnt together."""
        first = 0
        while first < len(texts):
            end, room = first + 1, LETTERS - len(texts[first])
            while end < len(texts) and (room := room - len(texts[end])) > 0:
                end += 1
            self.learn(texts[first:end])
            yield from map(what, texts[first:end])
            first = end
        self.ready = {}


@lru_cache(4)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


@contextmanager
def remembering(path: str) -> Iterator[Model]:
    """The model for one task: what it remembers of texts ends with the task."""
    m = model(path)
    try:
        yield m
    finally:
        m.forget()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins and ends (byte spans in the UTF-8 text), one row per row of ``docs``.

    A null text is empty and has no ids. Repeated rows encode alike; an empty table gives
    no rows; columns but doc_id and text are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(path) as m:
            for batch in batches:
                for first in range(0, len(batch), 200):  # small batches: the lists are many times the text
                    part = batch.slice(first, 200)
                    found = list(m.each(part.column("text").to_pylist(), m.encode))
                    lists = [[ids for ids, _ in found], [[a for a, _ in s] for _, s in found], [[b for _, b in s] for _, s in found]]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.list_(pa.int32())) for x in lists]], ["doc_id", "ids", "begins", "ends"])

    return _texts(docs).mapInArrow(shared.tidy(scan), "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``encode`` and ``decode`` give.

    A null or empty text has no ids and decodes to an empty text. Texts of any length are
    encoded whole. Repeated rows give equal digests; an empty table gives no rows; columns
    but doc_id and text are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(path) as m:
            for batch in batches:
                counts, ids, decoded = [], [], []
                for n, a, b in m.each(batch.column("text").to_pylist(), m.digest):
                    counts.append(n)
                    ids.append(hashlib.sha256(a.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(shared.tidy(scan), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

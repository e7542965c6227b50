import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tiltscale.llm import pieces, wordpiece
from tiltscale.llm.queries import op4_sentencepiece, op10_token_counts

from .conftest import ODD, SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
DATA = open(PATH, "rb").read()
TEXTS = ["", " ", "  ", " a", "a ", "   leading", "▁x ▁", "a▁▁b", "x" * 3000, "<s> </s> <unk> <0x0A>", "\n\t\0 é́ 日本 \U0001f600\U0001f600", "A" + " " * 40 + "b", "ﬁne ＡＢＣ"]


def library(data=DATA):
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def spans_in_bytes(lib, text):
    return [(p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]


def check(m, lib, text):
    ids, spans = m.encode(text)
    assert ids == lib.encode(text)
    assert m.decode(ids) == lib.decode(ids)
    n, joined, decoded = m.digest(text)
    assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), lib.decode(ids))
    return spans


def test_pieces_match_the_library():
    m, lib = pieces.Model(DATA), library()
    for text in TEXTS:
        assert check(m, lib, text) == spans_in_bytes(lib, text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab e▁\né日th.<>0x", max_size=60))
def test_pieces_match_the_library_on_any_text(text):
    m, lib = pieces.model(PATH), library()
    assert check(m, lib, text) == spans_in_bytes(lib, text)


def darts(words):
    """A double-array trie of byte strings to values, one free block of cells per node."""
    nodes = [{}]
    values = [None]
    for word, value in words.items():
        at = 0
        for b in word:
            if b not in nodes[at]:
                nodes[at][b] = len(nodes)
                nodes.append({})
                values.append(None)
            at = nodes[at][b]
        values[at] = value
    units, block = {}, 256
    place = {0: 0}
    for node in range(len(nodes)):
        base = block * (node + 1)
        offset = place[node] ^ base
        # far offsets are stored without their low eight bits
        coded = offset << 10 if offset < 1 << 21 else (offset >> 8 << 10) | 1 << 9
        units[place[node]] = units.get(place[node], 0) | coded | (0x100 if values[node] is not None else 0)
        if values[node] is not None:
            units[base] = values[node] | 1 << 31
        for b, child in nodes[node].items():
            place[child] = base ^ b
            units[place[child]] = b
    return struct.pack(f"<{max(units) + 256}I", *[units.get(i, 0) for i in range(max(units) + 256)])


def field(number, data):
    size, out = len(data), bytearray()
    while size >= 128:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes([number << 3 | 2]) + bytes(out) + bytes([size]) + data


def with_map(rules, squeeze):
    """The model with a character map of its own."""
    texts, words = b"", {}
    for source, target in rules.items():
        words[source.encode()] = len(texts)
        texts += target.encode() + b"\0"
    trie = darts(words)
    blob = struct.pack("<I", len(trie)) + trie + texts
    spec = field(2, blob) + bytes([3 << 3, 1, 4 << 3, int(squeeze), 5 << 3, 1])
    out = b""
    for number, value in pieces._fields(DATA):
        if number in (1, 2):
            out += field(number, value)
    return out + field(3, spec)


@pytest.mark.parametrize("squeeze", [False, True])
def test_character_map_and_alignment(squeeze):
    data = with_map({"ﬁ": "fi", "Ａ": "A", "ab": "X", "abc": "the  long", "\t": " ", "é": "e", "q": ""}, squeeze)
    m, lib = pieces.Model(data), library(data)
    for text in [*TEXTS, "ab abc abcd aab", "ﬁne\tＡＢ  é q", " q ", "q", "\t\tab  \t", "abq c"]:
        check(m, lib, text)
        ids, spans = m.encode(text)
        assert spans == spans_in_bytes(lib, text), text


def test_digests_come_from_aligned_ids_and_decode(monkeypatch):
    m, calls = pieces.Model(DATA), []
    aligned, decode = m.aligned, m.decode
    monkeypatch.setattr(m, "aligned", lambda text: calls.append("aligned") or aligned(text))
    monkeypatch.setattr(m, "decode", lambda ids: calls.append("decode") or decode(ids))
    for text in TEXTS * 2:  # cuts met before give the same spans
        m.digest(text)
    assert calls == ["aligned", "decode"] * (2 * len(TEXTS))
    assert all(m.encode(t)[1] == spans_in_bytes(library(), t) for t in TEXTS)


def test_plain_alignment_is_that_of_prefixes(monkeypatch):
    m = pieces.Model(DATA)
    fast = [m.normalize(t) for t in TEXTS]
    m.plain = False
    assert [(t, list(at)) for t, at in fast] == [m.normalize(t) for t in TEXTS]


def test_queries(spark, odd, empty):
    lib, auto = library(), wordpiece.automaton(PATH)
    first, later = wordpiece.split_vocabulary(list(pieces.model(PATH).ids))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op4_sentencepiece(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d in docs:
        ids = lib.encode(d.text)
        assert got[d.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert len(got) == len(docs)
    assert sorted(r.n_tokens for r in pieces.digests(odd, PATH).collect()) == sorted(len(lib.encode(r[1] or "")) for r in ODD)
    spans = {r.doc_id: r for r in pieces.encode(odd, PATH).collect()}
    assert spans[2].ids == [] and spans[7].ids == lib.encode(ODD[7][1]) and spans[7].ends[-1] == len(ODD[7][1].encode())
    assert pieces.digests(empty, PATH).count() == pieces.encode(empty, PATH).count() == 0

    def greedy(word):
        at, n, vocabulary = 0, 0, first
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
            if end is None:
                return wordpiece.UNKNOWN
            at, n, vocabulary = end, n + 1, later
        return n

    words = {w for d in docs for w in d.text.split()} | {"日", "aé日", "\U0001f600", "zzzzqqqq", "Ꙁ"}
    assert all(auto.count(w) == greedy(w) for w in words)
    counts = {r.doc_id: r for r in op10_token_counts(spark, SF).collect()}
    for d in docs:
        found = [greedy(w.decode()) for w in d.text.encode().split()]
        r = counts[d.doc_id]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(abs(x) for x in found), found.count(-1))
    assert wordpiece.token_counts(odd, PATH).count() == len(ODD) and wordpiece.token_counts(empty, PATH).count() == 0


@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=4), max_size=8), st.sets(st.text(alphabet="abc", min_size=1, max_size=4), max_size=8), st.text(alphabet="abc", min_size=1, max_size=14))
def test_automaton_is_greedy(first, later, word):
    at, n, vocabulary = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            n = wordpiece.UNKNOWN
            break
        at, n, vocabulary = end, n + 1, later
    assert wordpiece.Automaton(first, later).count(word) == n


def test_new_cuts_are_merged_together(monkeypatch):
    m, lib, rng = pieces.Model(DATA), library(), random.Random(5)
    words = ["".join(rng.choices("etaoinshr,.$é1", k=rng.randint(1, 25))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 3000, 25)] + ["x" * 200 + " 日\U0001f600 " + "ab" * 31, "", ""]
    slow = []
    merge = m.merge
    monkeypatch.setattr(m, "merge", lambda cut: slow.append(cut) or merge(cut))
    monkeypatch.setattr(pieces, "LETTERS", 2000)
    assert list(m.each(texts, m.encode)) == [(ids, spans_in_bytes(lib, t)) for t, ids in zip(texts, lib.encode(texts), strict=True)]
    assert all(len(c) > pieces.SHORT or not c.isascii() for c in map(lambda c: c.lstrip(pieces.MARK), slow))
    monkeypatch.setattr(pieces, "MEMORY", 5000)  # forgotten cuts are merged anew
    assert [n for n, *_ in m.each(texts, m.digest)] == list(map(len, lib.encode(texts))) and len(m.number) < 1000

"""Operator 13 against whole texts through both libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tests.llm.conftest import SF
from tiltscale.llm import align, queries
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB_A, LIB_B = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
LIB_A.encode_special_tokens = True
ODD_TEXTS = [
    "<|endoftext|> </s> <0x41> <unk> x", "a▁b c", " lead  and   trail  ", "tab\there\n\n and\r\nthere \n", "nb sp 　 wide em   x", "'s 't don't  'll", "日本語 テキスト\U0001f600\U0001f468‍\U0001f469 ok",
    "x" * 300, " ", "\n", "é ä ñ " * 40, "▁", "a\x00b \x1c c\x85 d",
]


def brute(text):
    """Pairs of id lists, from both libraries' tokens of the whole text; none where bytes differ."""
    if not text:
        return []
    data = (" " + text).encode()
    back = {c: b for c, b in align._byte_letters().items()}
    a = [(i, bytes(back[c] for c in LIB_A.id_to_token(i))) for i in LIB_A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(LIB_B.id_to_piece(i)[3:5], 16)]) if LIB_B.is_byte(i) else LIB_B.id_to_piece(i).replace("▁", " ").encode()) for i in LIB_B.encode(text)]
    if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return []
    ends = []
    for side in (a, b):
        at, found = 0, {}
        for i, x in side:
            at += len(x)
            found[at] = i
        ends.append(found)
    groups, now, left = [], ([], []), 0
    for at in range(1, len(data) + 1):
        for k in (0, 1):
            if at in ends[k]:
                now[k].append(ends[k][at])
        if at in ends[0] and at in ends[1]:
            groups.append(now)
            now = ([], [])
    return groups


def expected(rows):
    groups = [(i, brute(t)) for i, t in rows]
    n = Counter((g[0][-1], g[1][-1]) for _, each in groups for g in each)
    most = defaultdict(int)
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    out = []
    for i, each in groups:
        links = [(g[0][-1], g[1][-1]) for g in each]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in each)
        digest = hashlib.sha256(text.encode()).hexdigest() if each else ""
        sums = (sum(len(a) for a, _ in each), sum(len(b) for _, b in each), len(each), len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links))
        out.append(repr((i, *sums, digest)))
    return sorted(out)


def digests(found):
    return sorted(repr((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")) for r in found.collect())


@pytest.mark.parametrize("chunk", [7, 200, align.CHUNK])
def test_alignment_of_odd_texts(spark, odd, chunk):
    rows = [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    if chunk == 7:
        docs = docs.where("text IS NULL OR length(text) < 3000")
    assert digests(align.align(docs, A, B, chunk)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_query_of_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op13_alignment(spark, SF).collect()
    assert sorted(repr(tuple(r)) for r in found) == expected(rows)


def test_empty_table(spark, empty):
    assert align.align(empty, A, B).collect() == []


BY = align.aligner(A, B)
PARTS = st.text(st.sampled_from("ab é日 \n,▁'s1"), max_size=12)


@settings(deadline=None, max_examples=200)
@given(st.lists(PARTS, min_size=1, max_size=6), st.integers(0, 5))
def test_fragments_compose_in_any_order(parts, at):
    parts[0] = " " + parts[0]
    fragments = [align.Fragment.of(p, BY) for p in parts]
    left = fragments[0]
    for f in fragments[1:]:
        left = left.then(f, BY)
    right = fragments[-1]
    for f in reversed(fragments[:-1]):
        right = f.then(right, BY)
    k = min(at, len(fragments) - 1)
    halves = [fragments[:k], fragments[k:]]
    whole = None
    for half in filter(None, halves):
        one = half[0]
        for f in half[1:]:
            one = one.then(f, BY)
        whole = one if whole is None else whole.then(one, BY)
    # equal groups, however the composition is bracketed and wherever its stretches end
    text = "".join(parts)
    expect = BY.align_text(text)
    if "" not in expect:
        assert "".join(left.close(BY)) == "".join(right.close(BY)) == "".join(whole.close(BY)) == "".join(expect)
        assert align.Tokens.parse(expect).strings() == expect
    assert ("" in left.close(BY)) == ("" in right.close(BY)) == ("" in expect)
    groups = brute(text[1:]) if text[1:] else None
    if groups:
        assert "".join(expect) == "".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for a, b in groups)
    elif groups == []:
        assert "" in expect

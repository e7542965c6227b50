"""Operator 12: every id in one piece, no padding, and the ids of the tokenizers library."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.conftest import SF
from tiltscale.llm import packing, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, length):
    """Sequences are gapless, at most ``length`` long and either full or as long as a power of two."""
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or (at < length and at.bit_count() == 1)


def packed(docs, *options):
    path = packing.sequence_dir(docs.sparkSession)
    return packing.read_pieces(packing.pack(docs, path, PATH, *options), path, PATH)


@pytest.mark.parametrize(("length", "windows"), [(1024, 64), (50, 3), (1, 1)])
def test_pieces_hold_the_library_ids(spark, odd, length, windows):
    docs = odd if length == 1 else spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd, allowMissingColumns=True).repartition(40, "doc_id")
    docs = docs.where("length(text) < 2000") if length == 1 else docs
    library = Tokenizer.from_file(PATH)
    rows = packed(docs, 0, length, windows).collect()
    check(rows, length)
    got, expected = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.doc_tokens, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()))
    for d in docs.collect():
        expected[d.doc_id].append([*library.encode(d.text or "", add_special_tokens=False).ids, 0])
    assert set(got) == set(expected)
    for i, parts in got.items():
        texts = expected[i]
        if len(texts) == 1:
            whole, at = [], 0
            for n, start, k, ids in sorted(parts):
                assert n == len(texts[0]) and start == at and k == len(ids)
                whole, at = whole + ids, at + k
            assert whole == texts[0]
        else:  # repeated rows: each position as often as there are rows
            counts = defaultdict(list)
            for _, start, _, ids in parts:
                for k, t in enumerate(ids):
                    counts[start + k].append(t)
            for at in range(max(map(len, texts))):
                assert sorted(counts[at]) == sorted(t[at] for t in texts if at < len(t))


def test_training_rows_are_padded_to_the_length_or_a_power_of_two(spark, odd):
    pieces = packed(odd, 0, 100, 4)
    rows = packing.sequences(pieces, 50256, 100).collect()
    assert sum(len(r.ids) for r in rows) == pieces.agg(F.sum("length")).first()[0]
    assert all(r.starts[0] == 0 and (len(r.ids) == 100 or len(r.ids).bit_count() == 1) for r in rows)
    assert packing.sequences(pieces.where("offset = 0 AND length = 100").withColumn("ids", F.expr("substring(ids, 1, 12)")), 7, 100).first().ids[3:] == [7] * 97


def test_empty_table(spark, empty):
    assert packed(empty).collect() == []


def test_query_columns(spark):
    found = queries.op12_packing(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 16), st.integers(1, 5))
def test_packer_places_each_id_once(sizes, length, windows):
    packer, done = packing.Packer(length, windows), []
    for i, n in enumerate(sizes):
        packer.add(packing.Piece(i, 0, np.full(n, i, "<u2"), n))
        assert len(packer.held) == len(packer.room) <= windows
        done += packer.take()
    packer.merge_all()
    done += packer.take()
    assert all(sum(map(len, s)) == length or sum(map(len, s)).bit_count() == 1 for s in done)
    seen = sorted((p.doc_id, p.start + k) for s in done for p in s for k in range(len(p)))
    assert seen == [(i, k) for i, n in enumerate(sizes) for k in range(n)]

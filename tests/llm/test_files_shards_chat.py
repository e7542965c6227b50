import hashlib
import itertools
import json
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tiltscale.llm import chat, shards, token_files
from tiltscale.llm.queries import op1_token_files, op8_hilbert_shards, op9_chat_format
from tokenizers import Tokenizer

from .conftest import ODD, SF

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def expected_ids(rows):
    library, start = Tokenizer.from_file(TOKENIZER), 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_match_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r)[:4] for r in op1_token_files(spark, SF).collect())
    assert got == sorted(expected_ids(rows))


def test_token_files_of_odd_rows(spark, odd, empty, tmp_path):
    index = token_files.token_files(odd, f"file://{tmp_path}/a", TOKENIZER)
    got = [tuple(r) for r in token_files.read_ids(index, f"file://{tmp_path}/a", TOKENIZER).collect()]
    want = list(expected_ids([r[:2] for r in ODD]))
    assert sorted(got, key=lambda r: r[1]) == want
    index = token_files.token_files(empty, f"file://{tmp_path}/b", TOKENIZER)
    assert token_files.read_ids(index, f"file://{tmp_path}/b", TOKENIZER).count() == 0


def test_other_tokenizers_are_the_librarys(spark, tmp_path):
    with open(TOKENIZER, "rb") as f:
        plain = json.load(f)
    assert token_files._is_byte_level(TOKENIZER)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**plain["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(plain | change))
        enc, library = token_files.Encoder(str(path)), Tokenizer.from_file(str(path))
        assert not enc.cuts
        for text in ("A plain Text, it's 12 ", " x  y", ""):
            assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    enc, room = token_files.Encoder(TOKENIZER), token_files.MEMORY
    token_files.MEMORY = 2000  # forgets often
    try:
        for text in ("one two three", "four five one", "six seven eight " * 9, "one two"):
            assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        token_files.MEMORY = room


def test_hilbert_curve_is_a_walk_through_the_grid(spark):
    for dims, bits in ((2, 3), (3, 2)):
        points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"x{i}" for i in range(dims)])
        h = points.withColumn("h", shards.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()
        assert [r.h for r in h] == list(range(1 << bits * dims))
        steps = [sum(abs(a[i] - b[i]) for i in range(dims)) for a, b in itertools.pairwise(h)]
        assert set(steps) == {1}


def test_shards_hold_the_rows_law(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op8_hilbert_shards(spark, SF).collect()
    assert len(got) == docs.count()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    order = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    few = shards.shard_documents(odd, 8).collect()
    assert len(few) == len(ODD) and set(Counter(r.shard for r in few).values()) <= {1, 2}
    assert shards.shard_documents(empty, 8).count() == 0


def plain_bins(values, room):
    known = sorted({v for v in values if v is not None})
    return [0 if v is None else (known.index(v) + 1) * room // (len(known) + 1) for v in values]


@pytest.mark.parametrize("sources", [3, 300])
def test_placement_is_that_of_plain_code(spark, sources, tmp_path):
    rng = np.random.default_rng(sources)
    texts = ["x" * int(n) for n in rng.integers(0, 400, 1500)]
    rows = [(int(i), t, [None, "de", "en"][i % 3], f"host{(i * 7) % sources:04d}" if i % 50 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in shards.shard_documents(docs, 8, 8).collect()}
    scale = [math.log2(len(t.encode()) + 2) for t in texts]
    low, high = min(scale), max(scale)
    dims = list(zip(plain_bins([r[3] for r in rows], 256), plain_bins([r[2] for r in rows], 256), [min(255, math.floor((v - low) / (high - low) * 256)) for v in scale], strict=True))
    index = [got[i].hilbert for i in range(len(rows))]
    # points and places go together; that the curve's steps are of one cell is tested above
    assert all((dims[i] == dims[j]) == (index[i] == index[j]) for i in range(0, 1500, 7) for j in range(0, 1500, 11))
    order = sorted(range(len(rows)), key=lambda i: (index[i], i))
    for place, i in enumerate(order):
        shard = place * 8 // len(rows)
        assert (got[i].shard, got[i].slot) == (shard, place - -(-shard * len(rows) // 8))
    # a column named slot stays
    kept = spark.createDataFrame([(1, "a", "x", "s", 5, 9)], "doc_id long, text string, lang string, source string, slot int, shard int")
    shards.write_shards(kept, str(tmp_path / "kept"))
    row = spark.read.parquet(str(tmp_path / "kept")).first()
    assert (row.slot, row.shard, row.source) == (5, 0, "s")


def test_shard_files_prune(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.octet_length("text"))
    shards.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    docs.repartition(8).write.parquet(str(tmp_path / "plain"))

    def touched(folder, column, low, high):
        """The share of files whose statistics do not rule a range out."""
        files = sorted((tmp_path / folder).rglob("*.parquet"))
        met = 0
        for f in files:
            meta = pq.ParquetFile(f).metadata
            at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
            stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
            met += any(x.min <= high and x.max >= low for x in stats)
        return met / len(files)

    for column, low, high in (("lang", "fr", "fr"), ("source", "src3", "src3"), ("size", 0, 300)):
        assert touched("out", column, low, high) < touched("plain", column, low, high), column


def test_shard_files_keep_odd_rows(spark, odd, empty, tmp_path):
    shards.write_shards(odd, str(tmp_path / "odd"))
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert Counter(map(str, back.select(odd.columns).collect())) == Counter(map(str, odd.collect()))
    assert back.select("shard").distinct().count() == 8
    shards.write_shards(empty, str(tmp_path / "empty"))
    assert not list((tmp_path / "empty").rglob("*.parquet"))


def turns_of(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_chats_read_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in op9_chat_format(spark, SF).collect()}
    want = turns_of(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chats_merge_and_escape(spark):
    rows = [
        (1, 0, "assistant", "<next>\\l<end>\n"), (1, 1, "assistant", ""), (1, 2, "assistant", None), (1, 3, "us>er", "\\b\\"), (1, None, "system", "é\U0001f600"),
        (1, 3, "us>er", "\\b\\"), (2, 0, None, "x"), (None, 5, "assistant", "y" * 30_000), (3, 0, "user", "only"),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.read_chats(done).collect()}
    want = turns_of(rows)
    assert {k: [tuple(t) for t in r.turns] for k, r in got.items()} == want
    assert {k: r.loss_texts for k, r in got.items()} == {k: [t for role, t in v if role == "assistant"] for k, v in want.items()}
    assert got[1].formatted.count("<turn:assistant>") == 1 and got[1].formatted.count("<turn:us\\ger>") == 1
    assert chat.read_chats(chat.format_chats(turns.limit(0))).count() == 0

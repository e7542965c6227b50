import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tiltscale.llm import decontam, quality, simhash, similar
from tiltscale.llm.queries import op3_simhash_bktree, op5_quality_rules, op6_decontamination

from .conftest import ODD, SF


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes, radius):
    """Smallest reachable index of each code, by comparing all."""
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    codes = [plain_fingerprint(d.text) for d in docs]
    roots = plain_components(codes, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash_bktree(spark, SF).collect()}
    assert got == {d.doc_id: (f"{c:016x}", docs[k].doc_id) for d, c, k in zip(docs, codes, roots, strict=True)}
    assert len({k for _, k in got.values()}) < len(docs)


def test_simhash_of_odd_rows(spark, odd, empty):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    ids = {}
    for doc_id, text, *_ in ODD:
        ids.setdefault(plain_fingerprint(text), []).append(doc_id)
    want = [(d, f"{plain_fingerprint(t):016x}", min((i for i in ids[plain_fingerprint(t)] if i is not None), default=None)) for d, t, *_ in ODD]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(empty).count() == 0
    left = Counter(r.doc_id for r in simhash.drop_near_duplicates(odd).collect())
    assert left == Counter([5, 2, None, 7, 8])
    assert simhash.drop_near_duplicates(odd).columns == odd.columns


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_links_of_crowded_codes(spark, radius):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    codes = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            code = int(c)
            for bit in rng.integers(0, 64, rng.integers(1, 7)):
                code ^= 1 << int(bit)
            codes.add(code)
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    # shards of eight codes: band values that more share are split by further bands
    edges = simhash.link(spark.createDataFrame(signed, "fp long"), radius, shard_nodes=8)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got, want = {}, {}
    for (s,), k in zip(signed, plain_components(codes, radius), strict=True):
        got.setdefault(roots.get(s, s), set()).add(s)
        want.setdefault(k, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def plain_similar(texts):
    """Smallest reachable index of each text over 5-word Jaccard of 0.8, by comparing all."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if 5 * len(s & t) >= 4 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("sample", [similar.SAMPLE, 1])
def test_near_duplicates_match_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    texts = [d.text for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    for base in list(texts[:3]):  # near copies, about the limit, and one passage that all hold
        for _ in range(40):
            words = base.split()[:120]
            for at in rng.integers(0, len(words), rng.integers(1, 6)):
                words[at] = f"new{rng.integers(0, 1000)}"
            texts.append(" ".join(words))
    texts += [f"{' '.join(texts[5].split()[:30])} own{i} words{i} of{i}" for i in range(40)] + ["few words", "Few  WORDS", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_similar(texts)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == dict(enumerate(want))
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(want)
    assert len({(plain_fingerprint(t)) for t in texts}) > len(set(want)) + 50  # not copies only


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(edges).collect()
    assert {r.node: r.root for r in got} == dict.fromkeys(range(1, 201), 0)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def test_quality_measures(spark, odd, empty):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = docs.select("doc_id", "text").collect()
        want = sorted(([r.doc_id, *plain_measures(r.text)] for r in rows), key=str)
        got = quality.judge(docs).collect()
        assert sorted(([r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in got), key=str) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.judge(empty).count() == 0
    assert op5_quality_rules(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_boilerplate_lines(spark, monkeypatch):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    note = "All  Rights reserved by the house and its heirs"
    rows = [(i, f"{own(i, 20)}\n{note if i % 2 else note.lower()}\nend of {own(i, 3)}", "a") for i in range(30)]
    rows += [(100, f"{note}\n{note}\nalone here", "a"), (101, f"{note}\n{own(101, 12)}", "b")]
    rows += [(200 + i, f"{own(1, 20)}\ncopied line", "c") for i in range(50)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].removed_words == 9 and got[i].kept for i in range(30))
    assert got[100].removed_words == 18 and not got[100].kept
    assert got[101].removed_words == 0 and got[101].kept
    assert all(got[200 + i].removed_words == 0 and got[200 + i].kept for i in range(50))
    for bound in (quality.BROADCAST_LINES, -1):  # by broadcast, and by join
        monkeypatch.setattr(quality, "BROADCAST_LINES", bound)
        left = {r.doc_id: r for r in quality.clean(docs).collect()}
        assert left.keys() == {r[0] for r in rows} - {100}
        assert left[3].text == f"{own(3, 20)}\nend of {own(3, 3)}" and left[3].n_chars == len(left[3].text)
        assert left[101].text == rows[31][1]


def test_long_lines_on_a_hot_host(spark):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    passage, short, half = own("p", 50), own("s", 49), own("h", 25)
    more = {0: [passage, short], 1: [passage, short], 2: [passage], 3: [passage], 4: [passage], 5: [passage.upper().replace(" ", "  ")]}
    more |= {10 + i: [own("q", 60)] for i in range(5)} | {20 + i: [half, half] for i in range(6)}
    rows = [(i, "\n".join([own(i, 70), *more.get(i, [])]), "hot") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.removed_words for r in quality.judge(docs).collect()}
    # six texts hold the passage; five the other one; a short line, repeated or not, has the host's share
    assert {i: n for i, n in got.items() if n} == dict.fromkeys(range(6), 50)
    left = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert left[5] == own(5, 70) and left[0] == f"{own(0, 70)}\n{short}" and len(left) == 394  # repeating halves fail the base rules


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_hits(text, items):
    words, hit, found = re.findall(WORD, lower(text)), set(), set()
    for item, t in items:
        w = re.findall(WORD, lower(t))
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, odd, empty, monkeypatch):
    items = [(1, "with two Lines, and"), (2, None), (3, ""), (None, "ÉTÉ çà"), (12, " ".join(["word"] * 12)), (10, "a b c d e f g h i j k l"), (4, "--")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    extra = spark.createDataFrame([(20, "z A b c-d e f g h i j k l, y", "en", "s", 1, "w", 2), (21, "a b c d e f g h i", "en", "s", 1, "w", 2)], odd.schema)
    docs = odd.union(extra)
    want = sorted((r.doc_id, *plain_hits(r.text, items)) for r in docs.where("doc_id is not null").collect())
    for hash_set, table, hits in ((decontam.HASH_SET, 10, 10), (0, 10**6, 10**6), (0, 0, 0)):  # in the plan, broadcast, shuffled
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", table)
        monkeypatch.setattr(decontam, "BROADCAST_HITS", hits)
        got = decontam.find(docs.where("doc_id is not null"), benchmark, hash_set=hash_set).collect()
        assert sorted((r.doc_id, r.n_words, len({k for s in r.spans for k in range(s.start, s.start + s.n)}), r["items"]) for r in got) == want
    assert decontam.find(empty, benchmark).count() == 0
    assert {len(r.spans) for r in decontam.find(odd, benchmark.limit(0)).collect()} == {0}
    left = {r.doc_id: r for r in decontam.clean(docs, benchmark).collect()}
    assert left[3].text == "" and left[2].text is None
    assert left[21].text == "a b c d e f g h i"
    assert 20 not in left and 8 not in left
    assert left[5].text == "A plain text a plain text."
    assert op6_decontamination(spark, SF).where("contaminated").count() > 0


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(8)
    for n in (1, 30, 900, 40_000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for share in (0.0, 0.5, 1.0):
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(-(2**63), 2**63 - 1, n // 2 + 1)]))
            most = similar.most_shared(similar.sketch(a), similar.sketch(b))
            assert most >= len(np.intersect1d(a, b))
        assert n < 100 or similar.most_shared(similar.sketch(a), similar.sketch(rng.integers(-(2**63), 2**63 - 1, n))) < 0.8 * n or n > 32_000
    same = np.full(1000, 64, np.int64)  # counts above 255 stand for any
    assert similar.most_shared(similar.sketch(same), similar.sketch(same)) >= 1000


def test_parity_bits_bound_how_much_sets_differ():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 60, 900, 40_000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for share in (0.0, 0.7, 0.9, 1.0):
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(-(2**63), 2**63 - 1, n // 9)]))
            bits = np.bitwise_xor(similar.parity(a), similar.parity(b))
            assert sum(int(x).bit_count() for x in bits.view(np.uint64)) <= len(np.setxor1d(a, b))
    assert similar.parity(np.array([5, 5 + (1 << 33)])).any()


@pytest.mark.parametrize("n", [40, 4000])
def test_candidates_of_a_hot_shingle_are_few(spark, monkeypatch, n):
    monkeypatch.setattr(similar, "FREQUENT", 10**9)  # no shingle goes last
    first = min((f"a{i} b{i} c{i} d{i} e{i}" for i in range(3000)), key=lambda s: similar.shingles(s.encode())[0])
    texts = [f"{first} " + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(n)]
    for i in range(9, n, 10):
        texts[i] = " ".join([*texts[i - 1].split()[:-1], "other"])
    assert all(similar.shingles(t.encode())[0] == similar.shingles(first.encode())[0] for t in texts[:1])
    want = [i - (i % 10 == 9) for i in range(n)]
    assert n > 40 or want == plain_similar(texts)
    rows, write = {}, similar.shared.materialize

    def counted(df, tag):
        out = write(df, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(similar.shared, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == dict(enumerate(want))
    assert rows["placed"] >= n and rows["pairs"] <= 2 * n  # all meet on that shingle, and few in pairs


def test_verbatim_reposts_count_as_documents(spark):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    note = "subscribe to our letter below"
    # seven texts of a host hold the note; one is posted 40 times, so 46 documents of 546 do
    rows = [(i, f"{own(0, 20)}\n{note}", "h") for i in range(40)] + [(100 + i, f"{own(i + 1, 20)}\n{note}", "h") for i in range(6)]
    rows += [(200 + i, own(i + 50, 20), "h") for i in range(500)]
    rows += [rows[0]] * 5  # a repeated row is no further document
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if r.removed_words} == {*range(40), *range(100, 106)} and all(r.kept for r in got)


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for stage in (quality.clean, simhash.drop_near_duplicates, lambda d: decontam.clean(d, benchmark)):
        assert stage(empty).count() == 0 and stage(empty).columns == odd.columns and stage(odd).columns == odd.columns
    wide = spark.createDataFrame([(i, f" 　\n{' '.join(f'w{i}x{k}' for k in range(20))}", "h") for i in range(30)], "doc_id long, text string, source string")
    cleaned = [r.text for r in quality.clean(wide).collect()]  # a line of other than ASCII white space is a word
    assert len(cleaned) == 30 and all("　" not in t for t in cleaned)


def test_near_duplicates_are_found_in_bk_trees_of_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(2**63), 2**63 - 1, 12)
    n = 900
    tree = np.sort(rng.integers(-4, 4, n))
    code = seeds[rng.integers(0, 12, n)] ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, (7, n)), axis=0)
    key, size, pos = rng.permutation(n), rng.integers(90, 110, n), rng.integers(0, 25, n)
    order = np.lexsort((key ^ tree, pos, tree))
    want = {}
    for i, a in enumerate(order):
        for b in order[:i]:
            near = np.bitwise_count((code[a] ^ code[b]).view(np.uint64)) <= similar.RADIUS
            if tree[a] == tree[b] and near and 9 * min(size[a] - pos[a], size[b] - pos[b]) >= 4 * (size[a] + size[b]):
                want[a] = b
                break
    assert len(want) > n / 3 and dict(zip(*similar.tree_pairs(tree, key, size, pos, code), strict=True)) == want
    none = np.empty(0, np.int64)
    assert [len(x) for x in similar.tree_pairs(none, none, none, none, none)] == [0, 0]
    # all near copies are found there, also those of a shingle with many trees; the exact check has nothing left to find
    words = [[f"w{c}x{i}" for i in range(120)] for c in range(3)]
    texts = [" ".join(["one two three four five", *w[:k], f"other{k}", *w[k + 1 :]]) for w in words for k in range(20, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, verified = [], similar._verified
    monkeypatch.setattr(similar, "TREE", 8)
    monkeypatch.setattr(similar, "_verified", lambda *args: found.append(verified(*args)) or found[-1])
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == {i: i // 40 * 40 for i in range(120)}
    assert found[0].count() >= 117 and found[1].count() == 0

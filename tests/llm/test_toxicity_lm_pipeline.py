import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tiltscale.llm import lm_score, toxicity
from tiltscale.llm.queries import QUERIES, op2_lm_score

from .conftest import ODD, SF
from .test_simhash_quality_decontam import WORD, lower, plain_measures, plain_similar

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_index(examples):
    """Weight of every word, and the unit vectors of the examples, as plain dictionaries."""
    p, n = sum(y for _, y, _ in examples), sum(1 - y for _, y, _ in examples)
    weight = {}
    for w in {w for e in examples for w in e[2]}:
        a, b = sum(w in e[2] for e in examples if e[1]), sum(w in e[2] for e in examples if not e[1])
        spread = (a + b) * (p + n - a - b) * p * n
        chi = (p + n) * (a * (n - b) - b * (p - a)) ** 2 / spread if spread else 0.0
        weight[w] = (math.log((1 + p + n) / (1 + a + b)) + 1) * max((chi / (chi + toxicity.SHRINK)) ** 2, 1e-6)
    return weight, [(e, plain_vector(weight, e[2])) for e in examples if e[2]]


def plain_vector(weight, counts):
    v = {w: (1 + math.log(c)) * weight[w] for w, c in counts.items() if w in weight}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / norm for w, x in v.items()} if v else {}


def plain_near(vectors, q, skip=None):
    """Cosine and example of all examples that share a word, the nearest first."""
    found = [(sum(q.get(w, 0.0) * x for w, x in v.items()), e) for e, v in vectors if e != skip]
    return sorted((f for f in found if f[0] > 0), key=lambda f: -f[0])


def plain_vote(vectors, q, totals, sizes, skip=None):
    near = plain_near(vectors, q, skip)[: toxicity.NEIGHBOURS]
    base = totals[1] / (totals[0] + totals[1])
    top, low = base, 1.0
    for s, e in near:
        w = totals[e[1]] / sizes[e[1]] / (toxicity.SMOOTH + max(0.0, 1 - s))
        top, low = top + w * e[1], low + w
    return top / low


def toy_examples():
    rng = random.Random(4)
    return sorted((i, rng.randint(0, 1), Counter({f"t{min(rng.randrange(400), rng.randrange(400))}": rng.randint(1, 4) for _ in range(rng.randint(0, 9))})) for i in range(700))


def test_block_max_search_is_exact():
    examples, rng = toy_examples(), random.Random(5)
    index, (_, vectors) = toxicity.build(examples, {0: 5000, 1: 300}), plain_index(examples)
    weight = plain_index(examples)[0]
    assert dict(zip(index.terms, index.weight, strict=True)) == pytest.approx(weight)
    for _ in range(60):
        counts = Counter({f"t{rng.randrange(420)}": rng.randint(1, 3) for _ in range(rng.randint(1, 8))})
        rows, scores = index.nearest(*index.vector(counts))
        want = plain_near(vectors, plain_vector(weight, counts))[: toxicity.NEIGHBOURS]
        assert scores == pytest.approx([s for s, _ in want])
        if want:
            last = want[-1][0]
            assert {int(index.ids[r]) for r, s in zip(rows, scores, strict=True) if s > last + 1e-6} == {e[0] for s, e in want if s > last + 1e-6}


def test_scores_match_a_plain_implementation(spark):
    docs, labels = marked(120)
    docs += [(1000, "", "x"), (1001, None, "x"), (1002, "unheard", "x")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, words string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, l)).collect()}
    truth = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5}
    examples = [(i, truth[i], Counter(t.split())) for i, t, _ in docs if i in truth]
    totals = sizes = {y: sum(v == y for v in truth.values()) for y in (0, 1)}
    weight, vectors = plain_index(examples)
    votes = [plain_vote(vectors, v, totals, sizes, skip=e) for e, v in vectors]
    index = toxicity.Index(*[None] * 9, base=0.0)
    toxicity.calibrate(index, np.array(votes), np.array([e[1] for e, _ in vectors], float), np.ones(len(vectors)))
    for i, text, _ in docs:
        want = index.calibrated(plain_vote(vectors, plain_vector(weight, Counter((text or "").split())), totals, sizes))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5), i


def marked(n):
    rng = random.Random(7)
    words = ["ba", "de", "gilo", "komu", "nare", "posi", "tuvo", "zek"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        text = [rng.choice(words) + rng.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["wretchling", "foulmouth"])
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = marked(400)
    d, l = spark.createDataFrame(docs, "doc_id long, text string, words string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = toxicity.fit(d, l)
    got = toxicity.score(d, index).collect()
    truth = {i: y for i, _, y in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(truth[r.evidence[0]] == 1 for r in held if r.predicted)
    left = toxicity.drop_toxic(d, index)
    assert left.columns == d.columns and left.count() == sum(1 - r.predicted for r in got)
    assert toxicity.score(odd, index).count() == len(ODD) and toxicity.score(empty, index).count() == 0
    nothing = toxicity.fit(d, l.limit(0))
    assert {(r.score < 0.01, r.predicted, len(r.evidence)) for r in toxicity.score(odd, nothing).collect()} == {(True, 0, 0)}
    assert toxicity.fit(d.limit(0), l).base == pytest.approx(0.25, abs=0.05)
    kept = toxicity.drop_toxic(odd, index)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - sum(r.predicted for r in toxicity.score(odd, index).collect())
    assert toxicity.drop_toxic(empty, index).count() == 0


def test_base_score_matches_brute_force(spark, odd, empty):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {r.doc_id: [*r.text.encode().lower().split(), None] for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in op2_lm_score(spark, SF).collect()}
    assert got.keys() == words.keys()
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    scored = lm_score.score(odd, BPE).collect()
    assert len(scored) == len(ODD) and all(np.isfinite([r.score, r.base_score]).all() for r in scored)
    assert lm_score.score(empty, BPE).count() == 0


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def plain_class_distribution(model, before):
    """Distribution of the next class after the classes ``before``, the last unit's and those of the unit before it."""
    lo = max(0, ((len(before) - 1) // lm_score.UNIT - 1) * lm_score.UNIT)
    c = np.array(before[lo:])
    score = np.array([model.query[c[-1]] @ model.key[x] / np.sqrt(lm_score.WIDTH) + model.near[len(c) - 1 - j] for j, x in enumerate(c)])
    rows = [softmax((model.own if j == len(c) - 1 else model.value)[x]) for j, x in enumerate(c)]
    return softmax(score) @ np.array(rows)


def random_model(seed):
    rng = np.random.default_rng(seed)
    k = lm_score.CLASSES
    return lm_score.Attention.of(rng.standard_normal(lm_score.Attention.new(np.full(k, 1 / k)).flat().shape))


def test_attention_is_causal_normalised_and_learns():
    rng, model = np.random.default_rng(0), random_model(0)
    k, unit = lm_score.CLASSES, lm_score.UNIT
    lengths = np.array([1, unit, 3 * unit + 5])
    targets = rng.integers(0, k, lengths.sum())
    lp, opening = lm_score.class_scores(model, targets, lengths)
    start = 1 + unit
    before = [k, *targets[start:]]
    for place in (0, 7, unit, 2 * unit + 3, 3 * unit + 4):
        p = plain_class_distribution(model, before[: place + 1])
        assert p.sum() == pytest.approx(1)
        assert lp[start + place] == pytest.approx(np.log(p[targets[start + place]]), abs=1e-3)
        assert opening[start + place] == pytest.approx(np.log(p[lm_score.opens()].sum()), abs=1e-3)
    # whoever changes the future leaves the past's scores alone
    later = targets.copy()
    later[-5:] = (later[-5:] + 1) % k
    assert np.allclose(lm_score.class_scores(model, later, lengths)[0][:-5], lp[:-5])
    joined, sizes = np.tile(np.arange(200) % 7, 400), np.full(400, 200)
    flat = lm_score.Attention.new(np.full(k, 1 / k)).flat()
    mean = lambda flat: lm_score.class_scores(lm_score.Attention.of(flat), joined, sizes)[0].mean()
    assert mean(lm_score.train(flat, joined, sizes, rate=0.3)) > mean(flat) + 2


def test_gradient_follows_the_likelihood(monkeypatch):
    rng, k = np.random.default_rng(2), lm_score.CLASSES
    lengths = np.array([40, 23])
    targets, model = rng.integers(0, 12, 63), random_model(3)
    flat, steps = model.flat(), {}
    lm_score.train(flat, targets, lengths, rate=1.0)
    moved = lm_score.train(flat, targets, lengths, rate=1.0) - flat  # the first Adam step is the gradient's sign
    loss = lambda f: lm_score.class_scores(lm_score.Attention.of(f), targets, lengths)[0].astype(float).sum()
    for at in [*rng.integers(0, len(flat), 12), 3 * lm_score.WIDTH, 2 * (k + 1) * lm_score.WIDTH + 2]:
        up, down = flat.copy(), flat.copy()
        up[at] += 0.05
        down[at] -= 0.05
        steps[at] = loss(up) - loss(down)
        assert abs(steps[at]) < 2e-3 or np.sign(steps[at]) == np.sign(moved[at])
    assert any(abs(x) > 2e-3 for x in steps.values())


def plain_score(language, sub, counts, text):
    """Natural log probability of one text, word by word."""
    model, words = lm_score.Attention.of(language.flat), text.encode().lower().split()
    ids = [sub.ids(w) for w in words]
    before, total = [lm_score.CLASSES], 0.0

    def place():
        p = plain_class_distribution(model, before)
        return np.log(p), np.log(p[lm_score.opens()].sum())

    for w, pieces_of in zip([*words, None], [*ids, (sub.end,)], strict=True):
        lp, opening = place()
        first = pieces_of[0]
        total += lp[language.class_of[first]] + language.inside[first] - opening
        before.append(language.class_of[first])
        if w is None:
            return total
        rest = 0.0
        for i in pieces_of[1:]:
            rest += place()[0][language.class_of[i]] + language.inside[i]
            before.append(language.class_of[i])
        rest += place()[1]
        n, kinds = language.total[first], language.kinds[first]
        total += np.log((counts[w] + kinds * np.exp(rest)) / (n + kinds)) if n + kinds else rest


def test_scores_match_a_plain_implementation_of_the_model(spark, monkeypatch, odd):
    learnt, fit = [], lm_score._fit
    monkeypatch.setattr(lm_score, "_fit", lambda *a: learnt.append(fit(*a)) or learnt[-1])
    monkeypatch.setattr(lm_score, "CHUNK", 5000)
    texts = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(r.doc_id, r.text[:900]) for r in texts] + [(9001, ""), (9002, None), (9003, "Unheard-of zzyzx \u00c9t\u00e9 \u65e5\u672c\u8a9e"), (9004, texts[0].text[:900])]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()}
    sub, language = lm_score.subwords(BPE), learnt[0]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    firsts = Counter(sub.ids(w)[0] for w in counts)
    assert {i: int(n) for i, n in enumerate(language.kinds) if n} == firsts
    assert language.total.sum() == sum(counts.values())
    for i, t in rows[::6] + rows[-4:]:
        assert got[i].score == pytest.approx(plain_score(language, sub, counts, t or "") / np.log(10), rel=1e-4), i


def test_counts_within_classes_are_probabilities():
    rng = np.random.default_rng(1)
    class_of = rng.integers(0, lm_score.CLASSES, 500)
    p = np.exp(lm_score.within(rng.poisson(1.0, 500).astype(float), class_of))
    sums = np.bincount(class_of, p, lm_score.CLASSES)
    assert np.allclose(sums[np.bincount(class_of, minlength=lm_score.CLASSES) > 0], 1)


def test_words_encode_alike_alone_and_together():
    sub = lm_score.subwords(BPE)
    words = [w.encode() for w in ["plain", "don't", "x", "Été", "日本", "a1b2", "--", "\u00a0odd\u00a0", "ſharp", "é" * 40, "aͤb"]] + [b"\xff\xfe", b"word"]
    ids, size = sub.ids_of(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [sub.ids(w) for w in words]
    assert [len(x) for x in sub.ids_of([])] == [0, 0]


def test_classes_tell_ids_by_their_surroundings():
    rng = np.random.default_rng(4)
    profiles = rng.dirichlet(np.full(2 * lm_score.BUCKETS, 0.3), 5)
    kind = rng.integers(0, 5, 900)
    around = np.array([rng.multinomial(400, profiles[x] / profiles[x].sum()) for x in kind] + [[50] * (2 * lm_score.BUCKETS)], float)
    first = np.r_[np.arange(900) % 2 == 0, False]
    found = lm_score.classes(around, first, 900)
    assert found[900] == 0 and set(found[:900][first[:900]]) <= set(np.flatnonzero(lm_score.opens())) and not lm_score.opens()[found[:900][~first[:900]]].any()
    for c in set(found[:900]):  # a class hardly mixes kinds
        assert np.bincount(kind[found[:900] == c]).max() > 0.8 * (found[:900] == c).sum()


def plain_quality(rows):
    """Texts by id that the rules keep, without frequent lines."""
    blank = lambda x: not re.search(r"[^\x20\x09-\x0D]", x)
    norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", lower(x)))
    hosts, lines = {}, {}
    for i, text, host in {(r.doc_id, r.text, r.source) for r in rows}:
        hosts.setdefault(host, set()).add(i)
        for x in {norm(x) for x in text.split("\n") if not blank(x)}:
            lines.setdefault((host, x), set()).add((i, text))
    def frequent(host, x):
        held = lines[host, x]
        texts = len({t for _, t in held})
        return texts > 5 and (len(held) > 0.05 * len(hosts[host]) or len(x.split(" ")) >= 50)
    out = {}
    for r in rows:
        kept = [x for x in r.text.split("\n") if blank(x) or not frequent(r.source, norm(x))]
        n, repeated = plain_measures(r.text)[0], plain_measures(r.text)[4]
        left = sum(plain_measures(x)[0] for x in kept)
        if n >= 10 and 100 * repeated <= 20 * n and left >= 0.3 * n:
            out[r.doc_id] = "\n".join(kept)
    return out


def plain_decontaminated(texts, items):
    out = {}
    for i, text in texts.items():
        words, hit = re.findall(WORD, lower(text)), set()
        for _, t in items:
            w = re.findall(WORD, lower(t or ""))
            n = min(10, len(w))
            known = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            hit |= {k + j for k in range(len(words) - n + 1) if n and tuple(words[k : k + n]) in known for j in range(n)}
        if 2 * len(hit) <= len(words):
            pieces_of = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
            tail = re.search(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", text).group()
            out[i] = "".join(p for k, p in enumerate(pieces_of) if k not in hit) + tail if hit else text
    return out


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    index = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality rules":
            want = plain_quality(docs.collect())
        elif name == "toxicity":
            want = {i: t for i, t in texts.items() if index.judge(t)[0] < 0.5}
        elif name == "near-duplicates":
            ids = sorted(texts)
            want = {ids[k]: texts[ids[k]] for k in set(plain_similar([texts[i] for i in ids]))}
        else:
            want = plain_decontaminated(texts, items)
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        rows = docs.collect()
        texts = {r.doc_id: r.text for r in rows}
        assert docs.columns == columns and len(rows) == len(texts) and texts == want and len(texts) > 50, name
        assert all(r.n_chars == len(r.text) for r in rows)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in out.collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))

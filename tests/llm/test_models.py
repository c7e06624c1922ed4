"""BPE, top-k, language ID, toxicity, language model and near duplicates against brute force, round trips or held-out accuracy."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from stowage.llm import bpe, knn, langid, lm, setsketch, toxicity
from stowage.llm import words as word_stream
from stowage.llm.queries import tokenizer_path

from .conftest import pairs, rows, text


def test_chunked_encoding_equals_the_library():
    codec = bpe.Codec(tokenizer_path())
    assert codec.splits
    r = random.Random(1)
    odd = ["word ", "<|endoftext|>", "it's ", "\n\n", "é", "À́", "\x85", "\x1c", " ", "中", "😀", "ſ", "K", "'ll", "12.", "\r\n", "<|end", "oftext|>"]
    texts = ["", " ", "x" * 5000, "ab " * 4000, "a" * 700 + " " + "b" * 700] + ["".join(r.choice(odd) for _ in range(n)) for n in (1, 3, 10, 100, 3000) for _ in range(12)]
    for t in [*texts, *texts]:
        assert codec.encode(t) == codec.whole(t)


def test_small_stores_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "CHUNK_TEXT", 200)
    codec, r = bpe.Codec(tokenizer_path()), random.Random(2)
    for _ in range(30):
        t = text(r, 300)
        assert codec.encode(t) == codec.whole(t)


def test_cuts_follow_the_content():
    r = random.Random(5)
    shared = text(r, 3000)
    a, b = bpe.cuts(shared), bpe.cuts("some other start " + shared)
    assert len(a) > 3 and set((a + 17).tolist()) <= set(b.tolist())


def test_encode_frame(odd, none):
    got = bpe.encode(odd.select("doc_id", "text", "ids"), tokenizer_path()).collect()
    codec = bpe.Codec(tokenizer_path())
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == Counter((x[0], *codec.whole(x[1] or "")) for x in rows())
    assert bpe.encode(none, tokenizer_path()).count() == 0


def brute_top(vectors, queries, k):
    out = set()
    for q, v in queries:
        scores = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("block", [knn.BLOCK, 7])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    r = np.random.default_rng(0)
    data = [(i, [float(x) for x in r.normal(size=6)]) for i in range(150)]
    data += [(i, [0.5] * 6) for i in range(150, 190)]  # ties
    data += [(300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (401, [math.nan] * 6), (402, [math.inf] * 6), (None, [1.0] * 6), (500, [9.0, 9.0])]
    df = spark.createDataFrame([(a, b, 1, "s") for a, b in data], "vec_id long, embedding array<double>, rank int, score string")
    good = [(i, np.array([math.floor(1024 * x) for x in v] + [0] * (6 - len(v)), dtype=np.int64)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = set(map(tuple, knn.top_k(df, df.vec_id % 50 == 0).collect()))
    assert got == brute_top(good, [(i, v) for i, v in good if i % 50 == 0], 10)


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert pairs(knn.top_k(df, df.vec_id % 100 == 0)) == [(0, 1, 1, 2048 * 1024)]
    assert knn.top_k(df.limit(0), df.vec_id == 0).count() == 0


def test_large_components_stay_exact():
    q, d = np.array([[1 << 31, 3]], np.int64), np.array([[1 << 30, 1], [(1 << 30), 2]], np.int64)
    got = knn.solve(np.array([9]), q, np.array([1, 2]), d, 1)
    assert got["score"].tolist() == [(1 << 61) + 6] and got["vec_id"].tolist() == [2]


def test_language_id_learns_and_holds_out(spark, none):
    r = random.Random(4)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(20))
    data = [(i, make("abcde" if i % 2 else "dexyz"), "aa" if i % 2 else "bb") for i in range(200)]
    data += [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (None, make("abcde"), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = langid.held_out(df.doc_id, 4, 2)
    model = langid.train(df.where(~out))
    assert model[0] == ["aa", "bb"]
    got = {x["doc_id"]: x for x in langid.predict(df, model, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data[:200])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0 and got[None]["lang_pred"] == "aa"
    empty = langid.train(none)
    assert {(x["lang_pred"], x["score"]) for x in langid.predict(df, empty, ["doc_id"]).collect()} == {("und", 0.0)}


def test_posteriors_match_brute_force(spark):
    r = random.Random(12)
    data = [("".join(r.choice("abcde "[k:]) for _ in range(r.randint(1, 40))), ["x", "y"][k]) for k in (0, 1) for _ in range(20)]
    names, logs = langid.train(spark.createDataFrame(data, "text string, lang string"))
    tried = [*(t for t, _ in data), "½ ² ①", "12 3", "", None, "ß"]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(tried)], "doc_id long, text string"), (names, logs), ["doc_id"]).collect()

    def grams(t):
        for order in langid.ORDERS:
            padded = [*map(ord, t.lower()), *[0] * (max(langid.ORDERS) - 1)]
            for i in range(len(t.lower())):
                whole = [*padded[i : i + order], *[0] * order][:order]
                yield int(langid.gram_ids(np.array(whole, np.uint32), order)[0])

    counts = {k: Counter(g for t, lang in data if lang == k for g in grams(t)) for k in names}
    for row in got:
        t = tried[row["doc_id"]]
        if not t or not re.search(r"[a-zß]", t):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        logp = [math.log(0.5) + sum(math.log((counts[k][g] + langid.SMOOTHING) / (sum(counts[k].values()) + langid.SMOOTHING * langid.BUCKETS)) for g in grams(t)) for k in names]
        post = 1 / sum(math.exp(x - max(logp)) for x in logp)
        assert row["lang_pred"] == names[logp.index(max(logp))] and abs(row["score"] - post) < 1e-6


def test_naive_bayes_sums_match_brute_force():
    t = "abcabcé"
    points = np.frombuffer((t + "\0\0").encode("utf-32-le"), np.uint32)
    for order in langid.ORDERS:
        ids = langid.gram_ids(points, order)
        one = [langid.gram_ids(points[i : i + order], order)[0] for i in range(len(points) - order + 1)]
        assert ids.tolist() == one


def toxic_rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [text(r, 1) for _ in range(r.randint(5, 150))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["vexoru", "vexoti", "vexola", "grumble"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_held_out_accuracy_and_odd_rows(spark, odd, none):
    data = toxic_rows(400, 1)
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    net = toxicity.fit(*toxicity.sample(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net, ["doc_id"]).where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in data if i in got]
    assert len(right) > 40 and sum(right) / len(right) > 0.9
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, net).collect())
    assert toxicity.score(none, net).count() == 0
    plain = toxicity.fit(*toxicity.sample(docs.select("doc_id", "text"), docs.limit(0)))
    assert {r["score"] for r in toxicity.score(docs, plain, ["doc_id"]).collect()} == {0.0}


def test_toxicity_scores_match_a_plain_pass_over_all_windows():
    data = toxic_rows(120, 5)
    net = toxicity.fit(*zip(*[(t, y) for _, t, y in data]))
    r = random.Random(6)
    texts = [text(r, n) for n in (1, 5, 31, 32, 33, 49, 400)] + [t for _, t, _ in data[:10]] + [None, "", "?!"]
    got = toxicity.Scorer(net).score(texts)
    p, h, sig = net.p, toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    for t, g in zip(texts, got):
        w = toxicity.words(t)
        if not w:
            assert g == net.empty
            continue
        x, best = net.inputs(*toxicity.features(w)), -np.inf
        for at in range(0, max(1, len(w) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            own, ways = x[at : at + toxicity.WINDOW], []
            for way in "fb":
                state, states = np.zeros(h), []
                for v in own if way == "f" else own[::-1]:
                    a, u = v @ p[f"w{way}"] + p[f"a{way}"], state @ p[f"u{way}"]
                    z, q = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
                    state = z * state + (1 - z) * np.tanh(a[2 * h :] + q * u[2 * h :])
                    states.append(state)
                ways.append(np.array(states if way == "f" else states[::-1]))
            both = np.hstack(ways)
            e = np.exp(both @ p["v"])
            best = max(best, float((e / e.sum()) @ both @ p["o"] + p["c"][0]))
        assert abs(sig(best) - g) < 1e-3


def test_toxicity_gradients():
    net = toxicity.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    inp = r.normal(size=(6, toxicity.INPUT))
    ids = np.array([[1, 2, 3, 4], [5, 6, 0, 0], [2, 2, 1, 0]])

    def table():
        return {w: np.vstack([np.zeros((1, 3 * toxicity.HIDDEN)), inp @ net.p[f"w{w}"] + net.p[f"a{w}"]]) for w in "fb"}

    g = np.array([1.0, -2.0, 0.5])
    _, kept = net.run(table(), ids, keep=True)
    d, _ = net.backward(g, table(), ids, kept)
    for name in ("uf", "ub", "v", "o"):
        at = tuple(0 for _ in net.p[name].shape)
        before, step = net.p[name][at], 1e-3
        net.p[name][at] = before + step
        up = (net.run(table(), ids) * g).sum()
        net.p[name][at] = before - step
        down = (net.run(table(), ids) * g).sum()
        net.p[name][at] = before
        assert abs((up - down) / (2 * step) - d[name][at]) < 2e-3 * max(1, abs(d[name][at]))


def test_long_runs_are_read_to_their_end():
    for n in (31, 32, 33, 47, 48, 49, 64, 65, 500):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        got = toxicity.words(f"a {run}_b")
        assert got[0] == "a" and max(map(len, got)) <= toxicity.LONGEST
        # all n-grams of the run stand whole in a piece
        for i in range(n + 2 - 5 + 1):
            assert any((run + "_b")[i : i + 5] in piece for piece in got[1:])
    net = toxicity.fit(*zip(*[(t, y) for _, t, y in toxic_rows(200, 2)]))
    clean, bad = "aa_" * 20 + "quiet_words_", "aa_" * 20 + "vexoru_words"
    _, a, _ = toxicity.features(toxicity.words(clean))
    _, b, _ = toxicity.features(toxicity.words(bad))
    assert net.odds[b].max() > net.odds[a].max()


def test_toxicity_features_in_blocks_are_those_of_each_word(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    vocabulary = ["a", "ab", "éà", "中", "😀b", "x" * 32, *(f"w{i}" for i in range(30))]
    word, grams, starts = toxicity.features(vocabulary)
    alone = [toxicity.features([w]) for w in vocabulary]
    assert word.tolist() == [int(w[0]) for w, _, _ in alone]
    assert [g.tolist() for g in np.split(grams, starts[1:])] == [g.tolist() for _, g, _ in alone]
    assert [len(x) for x in toxicity.features([])] == [0, 0, 0]


def test_toxicity_fit_takes_little_memory_beside_its_words(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_ROUNDS", 1)
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(60_000)]
    texts = [" ".join(vocabulary[i : i + 1000]) for i in range(0, len(vocabulary), 1000)]
    tracemalloc.start()
    try:
        toxicity.fit(texts, [int(i % 4 == 0) for i in range(len(texts))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1500 * len(vocabulary)  # 2,400 a word where the n-grams of all words were sorted at once, 1,000 by blocks


def test_all_windows_overlap():
    for n in (1, 31, 32, 33, 48, 49, 500):
        w = toxicity.windows(np.arange(1, n + 1))
        assert set(w.ravel().tolist()) - {0} == set(range(1, n + 1))
        assert n <= 32 or all(w[i][16:].tolist() == w[i + 1][:16].tolist() for i in range(len(w) - 1))


@pytest.mark.parametrize("most", [lm.MOST_BYTES, 0])
def test_base_scores_match_brute_force(odd, monkeypatch, most):
    monkeypatch.setattr(lm, "MOST_BYTES", most)
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    got = lm.held_out_scores(odd).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter()
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    for r in rows():
        if not out(r[0]):
            c.update(split(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows():
        w = split(r[1])
        want[(r[0], out(r[0]), len(w), sum(1 for x in w if c[x]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)


def test_language_model_of_nothing(spark, none):
    assert lm.held_out_scores(none).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(docs, lm.train(docs.limit(0))).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}


def test_filter_holds_what_was_put_in():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 32, 3000)).astype(np.uint32)
    n = r.integers(1, 5000, len(keys))
    bits, size = lm.fill(keys, lm.levels(n))
    got = lm.probe(keys, np.frombuffer(bits, np.uint8), size, 100)
    assert (got >= lm.levels(n)).all() and np.mean(got > lm.levels(n)) < 0.05
    assert np.mean(lm.probe(r.integers(0, 1 << 32, 3000).astype(np.uint32), np.frombuffer(bits, np.uint8), size, 100) > 0) < 0.05
    assert size == lm.BITS * int(lm.levels(n).sum())  # it follows the insertions
    for level in range(1, 30):
        held = [c for c in range(1, 200_000) if lm.LEVEL_BASE ** (level - 1) <= c + 1e-9 < lm.LEVEL_BASE**level]
        assert not held or lm.VALUES[level] == (held[0] + held[-1]) / 2


def test_all_words_and_pairs_count_and_no_score_exceeds_zero(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    said = [f"{r.choice(words)} {r.choice(words)}" for _ in range(200)]
    data = [(i, " ".join(r.choice(said) for _ in range(r.randint(0, 30)))) for i in range(120)] + [(7, "once only"), (500, "w1 never")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    split = lambda t: [" ", *t.split(), " "]
    n, c = Counter(), Counter()
    for _, t in data[:-1]:
        n.update(zip(split(t), split(t)[1:]))
        c.update(split(t)[1:])
    total = sum(c.values())

    def q(count):
        if not count:
            return 0
        low = 1.0
        while low * 1.5 <= count + 1e-9:
            low *= 1.5
        own = [x for x in range(math.ceil(low - 1e-9), math.ceil(low * 1.5 - 1e-9))]
        return sum(own) / len(own)

    def term(h, w):
        p = min(1, (q(c[w]) + 0.1) / (total + 0.1 * (len(c) + 1)))
        return math.log10((min(q(n[h, w]), q(c[h]), q(c[w])) + lm.PRIOR * p) / (q(c[h]) + lm.PRIOR))

    want = sorted((i, round(sum(term(*x) for x in zip(split(t), split(t)[1:])), 6)) for i, t in data)
    monkeypatch.setattr(lm, "BITS", 2000)  # no false hits
    for most, shard, chunk in ((lm.MOST_BYTES, lm.SHARD, lm.CHUNK), (0, lm.SHARD, lm.CHUNK), (0, 20, 500), (lm.MOST_BYTES, 20, 500)):
        monkeypatch.setattr(lm, "MOST_BYTES", most)
        monkeypatch.setattr(lm, "SHARD", shard)
        monkeypatch.setattr(lm, "CHUNK", chunk)
        model = lm.train(docs.where("doc_id < 500"))
        assert (model.local is None) == (most == 0)
        got = sorted((x["doc_id"], round(x["score"], 6)) for x in lm.score(docs, model).collect())
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-5 for g, w in zip(got, want)), (most, shard)
    # a filter of false hits only
    for part in model.local.values():
        part.bits, part.top = np.full(len(part.bits), 255, np.uint8), 100
    assert all(x["score"] <= 0 for x in lm.score(docs, model).collect())


def test_arrays_are_packed_and_unpacked():
    r = np.random.default_rng(3)
    for dtype in (np.uint8, np.uint32, np.uint64, np.int64):
        for n in (0, 1, lm.PRESSED - 1, lm.PRESSED, 5000):
            x = np.sort(r.integers(0, np.iinfo(dtype).max, n, dtype=dtype))
            for up in (False, True):
                got = lm.unpress(lm.press(x, up), dtype)
                assert got.dtype == dtype and (got == x).all()


def test_long_texts_and_words_hash_alike_in_pieces(monkeypatch):
    r = random.Random(4)
    texts = [text(r, 300), "x" * 700 + "Éß" * 300, "", "a " + "Qé" * 500 + "\tb \n", " " * 900, "one"]
    want = [x.copy() for x in word_stream.word_hashes(texts)]
    assert len(want[0]) == sum(len(t.encode().split()) for t in texts)
    monkeypatch.setattr(word_stream, "SLICE", 100)
    got = word_stream.word_hashes(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def brute_components(data, percent=80):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in data:
        w = words.findall((t or "").translate(low))
        sets.append((i, frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])))
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return Counter((i, len(s), label.get(i), i is None or label[i] == i) for i, s in sets)


def near_rows():
    r = random.Random(8)
    out = [(x[0], x[1]) for x in rows()]
    base = text(r, 120).split()
    for i in range(100, 130):  # a chain that drifts away from its start
        base[r.randrange(len(base))] = text(r, 1) + "q"
        out.append((i, " ".join(base)))
    out += [(200 + i, out[i][1].upper() if out[i][1] else None) for i in range(10)]
    return out


def test_near_duplicates_match_brute_force(spark, none):
    df = spark.createDataFrame(near_rows(), "doc_id long, text string")
    assert Counter(map(tuple, setsketch.near_duplicates(df).collect())) == brute_components(near_rows())
    assert setsketch.near_duplicates(none).count() == 0


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 2)
    monkeypatch.setattr(setsketch, "MEET", 2)
    monkeypatch.setattr(setsketch, "STAR", 2)
    df = spark.createDataFrame(near_rows()[:100], "doc_id long, text string")
    assert Counter(map(tuple, setsketch.near_duplicates(df).collect())) == brute_components(near_rows()[:100])


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(2)
    items = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = items[:2000], items[500:2500]  # 1500 of 2500 shared
    k = setsketch.sketches([a, b, np.concatenate([a, b])])
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    j = setsketch.estimate(k[:1], k[1:2], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 0.6) < 0.12


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 100), (500, 499), (500, 500)]
    got = dict(setsketch.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in [*range(41), *range(100, 120)]} == {0} and got[500] == 499
    assert setsketch.components(spark.createDataFrame([], "a long, b long")).count() == 0

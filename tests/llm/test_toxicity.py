"""Toxicity: gradients, scores against a plain network, held-out accuracy, edges."""

import math
import zlib

import numpy as np
import pytest

from tallyweave.llm import toxicity as tx

SF = "/root/testdata/sf0.1"
HARSH = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "clown", "trash", "disgusting", "stupid"}


def in_doubles(net):
    net.params = {k: p.astype(float) for k, p in net.params.items()}
    return net


def plain_score(net, words):
    """A text's score, word by word, from the definitions."""
    p = in_doubles(net).params
    s = lambda v: 1 / (1 + np.exp(-v))
    h = tx.HIDDEN

    def vector(w):
        grams = []
        for a, b, c in zip(" " + w, w, w[1:] + " "):
            mixed = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**64
            grams.append(p["grams"][(mixed >> 13) % tx.GRAMS])
        return np.concatenate([p["words"][net.vocabulary.get(w, 0)], np.mean(grams, 0)])

    def run(xs, k):
        state, out = np.zeros(h), []
        for x in xs:
            g, u = x @ p["gates"][k] + p["gate_bias"][k, 0], state @ p["states"][k]
            z, r = s(g[:h] + u[:h]), s(g[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * state
            out.append(state)
        return out

    best = 0.0
    for at in tx.window_starts(len(words)) if words else ():
        xs = [vector(w) for w in words[at : at + tx.WINDOW]]
        both = list(zip(run(xs, 0), run(xs[::-1], 1)[::-1]))
        e = [np.tanh(f @ p["attention"][0] + b @ p["attention"][1] + p["attention_bias"]) @ p["heed"] for f, b in both]
        w = np.exp(e) / np.exp(e).sum()
        best = max(best, s(sum(a * (f @ p["out"][0] + b @ p["out"][1]) for a, (f, b) in zip(w, both)) + p["out_bias"][0]))
    return best


def test_gradients():
    net = in_doubles(tx.Network(["aa", "bb"]))
    rng = np.random.default_rng(1)
    words = ["aa", "bb", "c", "déjà", "aab"]
    ids, lens = rng.integers(0, 5, (4, 6)), np.array([6, 6, 3, 1])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 0.5])

    def loss():
        z = net.forward(net.gate_inputs(net.inputs(words)["x"]), ids, lens)
        return (weight * np.where(y == 1, np.log1p(np.exp(-z)), np.log1p(np.exp(z)))).sum() / weight.sum()

    g = net.gradients(words, ids, lens, y, weight)
    grams, _ = tx.trigrams(words)
    for name, p in net.params.items():
        assert g[name].shape == p.shape
        places = [(int(grams[0]), 2), (int(grams[5]), 0)] if name == "grams" else [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)]
        for at in places:
            before, step = p[at], 1e-5
            p[at] = before + step
            high = loss()
            p[at] = before - step
            low = loss()
            p[at] = before
            assert abs((high - low) / (2 * step) - g[name][at]) < 1e-7, name


@pytest.fixture(scope="module")
def taught():
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for k in range(80):
        w = [f"w{rng.integers(0, 60)}" for _ in range(int(rng.integers(10, 200)))]
        if k % 2:
            w[int(rng.integers(0, len(w)))] = "Idiot"
        texts.append(" ".join(w))
        labels.append(k % 2)
    return tx.fit(texts, labels, steps=(10, 60))


def test_scores_brute(taught):
    rng = np.random.default_rng(3)
    texts = [None, "", " .,;", "idiot", "w1", "x" * 3000, " ".join(f"w{k % 50}" for k in range(33)), " ".join(["w1"] * 70 + ["idiot"] + ["w2"] * 70)]
    texts += [" ".join(rng.choice(["w1", "w2", "été", "idiot", "unknown"], 100, p=[0.5, 0.3, 0.1, 0.02, 0.08])) for _ in range(5)]
    got = tx.predict(taught, texts)
    small = tx.predict(taught, texts, at_once=64)
    want = [plain_score(taught, tx.words_of(t)) for t in texts]
    np.testing.assert_allclose(got, want, atol=1e-5)
    np.testing.assert_allclose([small[k] for k in (0, 1, 3, 7)], [want[k] for k in (0, 1, 3, 7)], atol=1e-5)
    assert want[:3] == [0, 0, 0]


def test_windows():
    for n in (0, 1, 31, 32, 33, 48, 64, 65, 500):
        s = tx.window_starts(n)
        seen = {p for a in s for p in range(a, min(a + tx.WINDOW, n))}
        assert seen == set(range(n)) and (np.diff(s) <= tx.STRIDE).all() and (np.diff(s) > 0).all()


def test_held_out_accuracy(spark):
    """Documents whose labels were not learned: those with harsh words are found, hardly any other is."""
    got = {r.doc_id: r for r in tx.op13_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == len(docs)
    found, false = [], []
    for d in docs:
        g = got[d.doc_id]
        assert g.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7)
        if g.held_out and d.doc_id in toxic:
            harsh = HARSH & set(tx.words_of(d.text))
            if toxic[d.doc_id] and harsh:
                found.append(g.predicted)
            if not toxic[d.doc_id]:
                false.append(g.predicted)
    assert np.mean(found) > 0.97 and np.mean(false) < 0.02


def test_edges(spark):
    """Nulls, repeated ids and labels, no labels, one class, an empty table, clashing columns."""
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, "c", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 0)], "doc_id long, toxic int")
    assert tx.learned(docs, labels) is None and tx.learned(docs, labels.limit(0)) is None
    assert sorted((str(r.doc_id), r.score) for r in tx.score_texts(docs, None).collect()) == sorted([("1", 0.0), ("1", 0.0), ("None", 0.0), ("2", 0.0), ("3", 0.0)])
    net = tx.Network(["a"])
    r = {r.doc_id: r.score for r in tx.score_texts(docs, net).collect()}
    assert r[2] == r[3] == 0 and 0 < r[1] < 1 and not any(map(math.isnan, r.values()))
    assert tx.score_texts(docs.limit(0), net).count() == 0
    assert [r[0] for r in docs.select(tx.held_out()).distinct().collect()].count(None) == 0


def test_repeated_id_sends_one_text(spark, monkeypatch):
    """An id that repeats is one document of the sample."""
    seen = []
    monkeypatch.setattr(tx, "fit", lambda texts, labels: seen.append(sorted(zip(texts, labels))))
    docs = spark.createDataFrame([(1, f"t{k}") for k in range(50)] + [(2, "b"), (3, "c"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 1)], "doc_id long, toxic int")
    tx.learned(docs, labels)
    assert seen == [[("b", 0), ("c", 0), ("t0", 1)]]
    seen.clear()
    tx.learned(docs, labels, sample_docs=1)
    assert len(seen[0]) == 2

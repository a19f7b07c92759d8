import random
import zlib

import numpy as np

from docquarry.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in quality.score_documents(docs, quality.fit(docs, labels)).collect()}
    rows = [(got[i], truth[i].quality) for i in truth if held(i)]
    assert len(got) == docs.count() and all(r.held_out == held(i) for i, r in got.items())
    assert np.mean([r.predicted == y for r, y in rows]) > 0.98
    assert np.mean([r.predicted for r, y in rows if y == 1]) > 0.99


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train(*toxicity.fit_rows(docs, labels, "toxic", toxicity.LABEL_ROWS))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    rows = [(got[i], truth[i].toxic) for i in truth if held(i)]
    assert np.mean([r.toxic for r, y in rows if y == 1]) > 0.85
    assert np.mean([r.toxic for r, y in rows if y == 0]) < 0.01
    assert all(0 <= r.severity <= len(model.thresholds) for r in got.values())
    assert model.thresholds == sorted(model.thresholds)


def test_learning_never_sees_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    texts, y = toxicity.fit_rows(docs, labels, "toxic", 50)
    by_text = {}
    for r in docs.select("doc_id", "text").collect():
        by_text.setdefault(r.text, []).append(r.doc_id)
    assert len(texts) == len(y) == 50
    assert all(any(not held(i) for i in by_text[t]) for t in texts)


def test_odd_texts_get_scores(frame, collected, odd):
    net = quality.train(["good text here"] * 8 + ["%%%###"] * 8, np.array([1] * 8 + [0] * 8), steps=30)
    got = collected(quality.score_documents(frame(odd, [None, *range(1, len(odd))]), net))
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.keep_good(frame(odd), net).columns == frame(odd).columns
    assert quality.score_documents(frame([]), net).count() == 0
    model = toxicity.train(["vile word"] * 30 + ["kind word"] * 30, np.array([1] * 30 + [0] * 30))
    tox = collected(toxicity.score_documents(frame(odd + ["VILE!"]), model))
    assert tox[-1]["severity"] > tox[0]["severity"] == tox[1]["severity"]
    assert toxicity.score_documents(frame([]), model).count() == 0


def test_training_without_labels():
    none = np.zeros(0, np.int64)
    assert toxicity.train([], none).weights == {}
    assert toxicity.train(["a", "b"], np.array([0, 0])).weights == {}
    assert quality.score_texts(quality.train([], none), ["x"]).shape == (1,)


def test_chunks_cover_whole_texts(monkeypatch):
    """Blocks and whole texts agree: no window is lost where a block ends."""
    net = quality.ByteNet.fresh()
    r = random.Random(1)
    text = "".join(r.choice("abc d\n") for _ in range(20_000))
    whole = quality.score_texts(net, [text, "b", None])
    monkeypatch.setattr(quality, "BLOCK", 1024)
    assert np.allclose(whole, quality.score_texts(net, [text, "b", None]), atol=1e-6)
    # a change at the very end changes the score
    assert quality.score_texts(net, [text + "%%%%%%%%%%%%%%%%"])[0] != whole[0]


def test_scores_order_grades():
    model = toxicity.OrdinalModel({"a": 2.0, "b": 4.0}, [1.0, 3.0, 5.0])
    expected = [sum(k * p for k, p in enumerate(model.grades(model.score(t)))) for t in ("", "a", "b", "a b")]
    assert expected == sorted(expected) and abs(sum(model.grades(2.0)) - 1) < 1e-12


def brute_score(net, text):
    """The network by its definition: every window of every chunk of the whole text, one at a time."""
    raw = (text or "").encode()
    n = (len(raw) + quality.WIDTH + quality.CHUNK - 1) // quality.CHUNK
    data = raw.ljust(n * quality.CHUNK + quality.WIDTH, b"\0")
    chunks = []
    for c in range(n):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(c * quality.CHUNK, (c + 1) * quality.CHUNK):
            if at + quality.WIDTH <= n * quality.CHUNK:
                seen = np.concatenate([net.embed[b] for b in data[at : at + quality.WIDTH]]).astype(np.float64)
                best = np.maximum(best, seen @ net.filters)
        chunks.append(np.maximum(best + net.bias, 0))
    summary = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), np.min(chunks, 0)])
    z = np.tanh(summary @ net.w1 + net.b1) @ net.w2 + net.b2
    return float(1 / (1 + np.exp(-z[0])))


def test_quality_against_direct_convolution(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 1024)
    r = random.Random(9)
    texts = [None, "", "a", "x" * 504, "y" * 505, "é" * 256] + ["".join(r.choice("abcü %$\n") for _ in range(r.randint(1, 3000))) for _ in range(12)]
    net = quality.train(texts, np.arange(len(texts)) % 2, steps=5, batch=6)
    assert np.allclose(quality.score_texts(net, texts), [brute_score(net, t) for t in texts], atol=1e-4)


def test_quality_gradient_reaches_filters():
    """Training alone separates two patterns at odd places, and the filters carry it."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(50, 1500))) for _ in range(60)]
    texts = [t + ("#%&" if k % 2 else "") + " tail" for k, t in enumerate(texts)]
    net = quality.train(texts, np.arange(60) % 2, steps=150)
    scores = quality.score_texts(net, texts)
    assert scores[1::2].min() > 0.5 > scores[::2].max()
    net.filters[:] = 0
    assert np.ptp(quality.score_texts(net, texts)) < 1e-6


def test_ordinal_fit_against_independent_likelihood():
    """No small step from the fitted parameters lowers the penalised likelihood, written out here."""
    r = np.random.default_rng(1)
    x = (r.random((200, 3)) < 0.5).astype(float)
    grades = np.clip(np.floor(x @ [1.5, -1.0, 0.5] + r.logistic(size=200) + 1), 0, 3).astype(np.int64)
    rows = [np.flatnonzero(v) for v in x]
    w, theta = toxicity._fit(rows, grades, 3, 4, 3000, 1e-4)

    def loss(w, theta):
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upto = lambda t: 1 / (1 + np.exp(-(t - x @ w)))
        with np.errstate(over="ignore"):
            return -np.mean(np.log(upto(edges[grades + 1]) - upto(edges[grades]))) + 0.5e-4 * (w @ w)

    best = loss(w, theta)
    assert theta.tolist() == sorted(theta.tolist())
    for k in range(3):
        for step in (-0.02, 0.02):
            assert loss(w + step * np.eye(3)[k], theta) > best - 1e-9 and loss(w, theta + step * np.eye(3)[k]) > best - 1e-9
    model = toxicity.OrdinalModel({"a": float(w[0]), "b": float(w[1])}, theta.tolist())
    for text, f in (("a", w[0]), ("b a", w[0] + w[1]), ("", 0.0)):
        upto = [*(1 / (1 + np.exp(-(t - f))) for t in theta), 1.0]
        assert np.allclose(model.grades(model.score(text)), np.diff([0.0, *upto]))


def test_features_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(toxicity, "PENDING", 50)
    r = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmno"]
    texts = [" ".join(r.choices(words, k=8) + (["vile", "vilely"] if k % 3 == 0 else ["kind"])) for k in range(300)]
    toxic = np.array([int(k % 3 == 0) for k in range(300)])
    kept, found = toxicity.evident(texts, toxic)
    want = set()
    for f in set().union(*map(toxicity.features, texts)):
        k1, k0 = (sum(f in toxicity.features(t) for t, y in zip(texts, toxic, strict=True) if y == label) for label in (1, 0))
        if k1 + k0 > 2 and abs(toxicity._deviations(k1, k0, 100, 200)) > toxicity.Z_LEAST:
            want.add(f)
    assert set(kept) == want and {"vile", "kind"} <= want
    assert [set(f) for f in found] == [want & toxicity.features(t) for t in texts]


def test_rows_to_learn_from(frame, spark):
    """Nulls count as empty; repeated ids give one text; the bound on characters passes over long ones."""
    ids = [i for i in range(1, 200) if not held(i)][:6]
    texts = ["first", None, "x" * 500, "twice the longer", "twice", "last one"]
    docs = frame(texts, [ids[0], ids[1], ids[2], ids[3], ids[3], ids[4]])
    labels = spark.createDataFrame([(i, 1, 0) for i in [*ids, None]], "doc_id long, quality int, toxic int")
    got, y = toxicity.fit_rows(docs, labels, "quality", 10)
    assert sorted(got) == ["", "first", "last one", "twice", "x" * 500] and y.tolist() == [1] * 5
    assert sorted(toxicity.fit_rows(docs, labels, "quality", 10, chars=100)[0]) == ["", "first", "last one", "twice"]
    assert toxicity.fit_rows(frame([]), labels, "quality", 10)[0] == []

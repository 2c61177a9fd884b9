import zlib

import numpy as np
import pytest

from quillon.llm import quality as Q


def test_encoding_of_odd_texts():
    raws = [b"", b"\n", b"\n\n\n", b"a", b"x" * 5000, b"one two\nthree\n", "été 🙂".encode(), b"De " * 400]
    x, bags = Q.encode(raws)
    assert len(bags) == len(raws) and (bags >= 1).all() and bags.sum() == len(x) and x.shape[1] == Q.FEATURES and np.isfinite(x).all()
    for i, b in enumerate(raws):  # a text's features do not depend on its neighbours
        alone, n = Q.encode([b])
        start = bags[:i].sum()
        np.testing.assert_allclose(alone, x[start : start + n[0]], rtol=1e-6)


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(0)
    bags = np.array([1, 3, 2])
    x, y = r.normal(size=(6, Q.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = Q.train(x, bags, np.array([1.0, 1.0, 1.0]))
    model.w["o"] = r.normal(size=Q.HIDDEN)
    loss = lambda: float(-np.mean(y * np.log(p := model.forward(x, bags)[0]) + (1 - y) * np.log(1 - p)))
    found = model.gradient(x, bags, y)
    for name in ("W", "b", "V", "U", "q", "o", "c"):
        w = model.w[name] = np.array(model.w[name], float)
        at = tuple(0 for _ in w.shape)
        old = float(w[at])
        values = []
        for step in (1e-5, -1e-5):
            w[at] = old + step
            values.append(loss())
        w[at] = old
        assert np.asarray(found[name])[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1.0), (1, None, 2.0), (1, "", 3.0), (2, "x" * 300_000, None), (3, "good text here.", 4.0), (3, "good text here.", 4.0)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (2, None), (None, 1), (9, 7)], "doc_id long, quality int")
    rows = Q.quality(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and sum(r.held_out for r in rows if r.doc_id is None) == 0
    assert Q.quality(docs, labels.limit(0)).first().score == pytest.approx(0.5)  # no labels: the base rate
    model = Q.fit(docs.limit(0), labels)
    assert Q.score(docs.limit(0), model).count() == 0
    assert Q.score(docs, model).columns == ["doc_id", "text", "quality_score"]

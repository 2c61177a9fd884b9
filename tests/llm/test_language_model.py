import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import language_model as L
from quillon.llm import queries

SF = "/root/testdata/sf0.001"


def _words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def _small(head: int = 6) -> L.Vocabulary:
    words = [L.END, b"the", b"of", b"a", b"en", b"x", b"rare.", b"zeta"]
    counts = np.array([5, 40, 20, 9, 4, 3, 2, 1])
    sizes = np.ones(L.FORMS, np.int64)
    for w, n in zip(words[head:], counts[head:], strict=True):
        sizes[L.form(w)] += n + 1
    return L.Vocabulary(words, counts, head, sizes, int(counts.sum()), len(words))


def _random_model(seed: int = 0) -> L.Model:
    model = L.Model.of(_small())
    r = np.random.default_rng(seed)
    model.w = {k: (x + r.normal(0, 0.4, x.shape)).astype(np.float32) for k, x in model.w.items()}
    return model


def plain(model: L.Model, tokens: list[int]) -> float:
    """ln of the probability of a text, a number at a time."""
    w, s = model.w, L.STATE
    sigma = lambda x: 1 / (1 + math.exp(-x))
    h, total, x = [0.0] * s, 0.0, w["X"].shape[1] - 1
    for y in tokens:
        a = [sum(h[i] * float(w["U"][j, i]) for i in range(s)) for j in range(3 * s)]
        g = [float(v) for v in w["X"][:, x]]
        new = []
        for i in range(s):
            z, r = sigma(g[i] + a[i]), sigma(g[s + i] + a[s + i])
            n = math.tanh(g[2 * s + i] + r * a[2 * s + i])
            new.append((1 - z) * n + z * h[i])
        h = new
        scores = [sum(h[i] * float(w["C"][k, i]) for i in range(s)) + float(w["c"][k]) for k in range(len(w["c"]))]
        total += scores[model.class_of[y]] - math.log(sum(map(math.exp, scores)))
        k = model.class_of[y]
        if k < model.n:
            members = range(model.starts[k], model.starts[k + 1])
            scores = {m: sum(h[i] * float(w["W"][m, i]) for i in range(s)) + float(w["b"][m]) for m in members}
            total += scores[y] - math.log(sum(map(math.exp, scores.values())))
        x = y
    return total


def test_scores_are_those_of_whole_texts_one_number_at_a_time():
    model, r = _random_model(), random.Random(1)
    texts = [[r.randrange(6 + L.FORMS) for _ in range(n)] + [0] for n in (0, 1, 5, 15, 16, 17, 40, 100, 3)]
    want = [plain(model, t) for t in texts]
    for lanes in (1, 2, 5, 512):
        found = L.score_texts(model, [np.array(t, np.int32) for t in texts], lanes)
        np.testing.assert_allclose(found, want, rtol=2e-5)


def test_probabilities_add_up_to_one():
    model = _random_model(3)
    h = np.random.default_rng(2).normal(size=(L.STATE, 1)).astype(np.float32)
    each = [float(model.output(h, np.array([y]))[0][0]) for y in range(6 + L.FORMS)]
    assert sum(map(math.exp, each)) == pytest.approx(1, abs=1e-5)
    v = _small()
    start = L.Model.of(v)
    zero = np.zeros((L.STATE, 1), np.float32)
    n = np.append(v.counts[:6] + 1, v.form_sizes)
    np.testing.assert_allclose([math.exp(start.output(zero, np.array([y]))[0][0]) for y in range(len(n))], n / n.sum(), rtol=1e-5)  # it starts from the counts


def test_gradients_are_those_of_the_loss():
    model, r = _random_model(5), np.random.default_rng(7)
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    x, y = r.integers(0, 6 + L.FORMS, (4, 3)), r.integers(0, 6 + L.FORMS, (4, 3))
    fresh, h = np.zeros((4, 3), bool), r.normal(size=(L.STATE, 3)).astype(np.float32)
    fresh[2, 1] = True
    loss = lambda: -model.output(L.columns(model.run(x, fresh, h)[0]), y.ravel())[0].sum()
    out, kept = model.run(x, fresh, h)
    _, grads, dh = model.output(L.columns(out), y.ravel(), gradient=True)
    grads |= model.back(x, fresh, kept, dh.reshape(L.STATE, *x.shape).transpose(1, 0, 2))
    for name, g in grads.items():
        flat, found = model.w[name].ravel(), np.asarray(g).ravel()
        for at in np.argsort(-np.abs(found))[:4]:
            old, values = flat[at], []
            for step in (1e-2, -1e-2):
                flat[at] = old + step
                values.append(loss())
            flat[at] = old
            assert found[at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=2e-2, abs=2e-3), name


def test_query_against_counts_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    c: Counter = Counter()
    for r in docs:
        if not held[r.doc_id]:
            c.update(_words(r.text))
    n, v = sum(c.values()), len(c)
    rows = queries.QUERIES["op11_recurrent_scores"](spark, SF).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for r in docs:
        words, row = _words(r.text), got[r.doc_id]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[r.doc_id], len(words), sum(c[w] > 0 for w in words), n)
        assert row.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    for kind in (True, False):
        of = [r for r in rows if r.held_out == kind]
        assert sum(r.score for r in of) > sum(r.base_score for r in of)  # contexts were learnt from


def test_words_and_tokens_of_odd_texts():
    texts = ["", " ", None, "The of\ta\n\nEN  x ", "rare. Zeta unknown, \u00fcn\u00efcode verylongword! \x0b\x0c", "\u00c9", "\U0001f600!", "a" * 9, "\x00 \x1f\u00a0\u2003z"]
    words, of = L.words_of(pa.array(texts))
    assert [[w.decode() for w, k in zip(words.to_pylist(), of, strict=True) if k == i] for i in range(len(texts))] == [_words(t)[:-1] for t in texts]
    v = _small()
    tokens, ids, of, words = L.Reader(v).read(pa.array(texts))
    for i, t in enumerate(texts):
        want = [v.words.index(w) if w in v.words[: v.head] else v.head + L.form(w) for w in (x.encode() for x in _words(t))]
        assert tokens[i].tolist() == want
    assert [i >= 0 for i in ids] == [w in v.words for w in words.to_pylist()]
    assert [t.tolist() for t in L.Reader(v, v.head).read(pa.array(texts))[0]] == [t.tolist() for t in tokens]
    assert [L.form(w) for w in (b"ab", b"ab.", "\u00e9a".encode(), "\u00e9".encode() + b"!", b"123456789", b"12345678.")] == [0, 1, 2, 3, 4, 5]


def test_words_beyond_the_known_ones_meet_their_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    few, v = L.log_likelihood(docs, ~L.held_out(), head=50, known=400)
    many, _ = L.log_likelihood(docs, ~L.held_out(), head=50, known=10**6)
    assert len(v.words) <= 401 < v.distinct
    a, b = ({r.doc_id: r for r in x.collect()} for x in (few, many))
    for k in a:
        assert a[k].n_known == b[k].n_known and a[k].base_score == pytest.approx(b[k].base_score, rel=1e-9)
        assert a[k].score == pytest.approx(b[k].score, rel=0.05)


def test_edge_rows(spark):
    rows = [(None, "A b c", 1), (1, None, 1), (1, "", 1), (2, "x" * 200_000, 1), (3, "a " * 30_000, 1), (4, "\x0b\x0c é f", 1), (4, "\x0b\x0c é f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out, v = L.log_likelihood(docs, ~L.held_out())
    got = out.collect()
    assert len(got) == 7 and all(np.isfinite([r.base_score, r.score]).all() and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 2, 3, 30_001]
    assert v.tokens == sum(r.n_tokens for r in got if not r.held_out)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none, v = L.log_likelihood(docs, F.lit(False))
    got = none.collect()
    assert v.tokens == 0 and len(got) == 7 and all(r.base_score == 0 and r.n_known == 0 and np.isfinite(r.score) for r in got)
    assert L.log_likelihood(docs.limit(0), F.lit(True))[0].count() == 0

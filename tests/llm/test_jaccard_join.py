import random
import re

import numpy as np
import pytest

from quillon.llm import _components, jaccard_join


def shingles(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n=3, num=90, den=100):
    sets = [shingles(t, n) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return {d: (len(s), find(d)) for (d, _), s in zip(rows, sets)}


def corpus(seed, copies=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6)))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(copies):  # near copies of a base and of each other, in chains
        w = (base if r.random() < 0.5 else r.choice(texts).split())[:]
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += ["", None, " \n\t", "One", "one", "one two", "ONE  two\n", "a b c", "a b c a b c", "É b c", "é b c", "x " * 3000, "x " * 3001]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("ngram", "num", "den", "block", "bucket"), [(3, 90, 100, 3_000_000, 2_000), (5, 80, 100, 3_000_000, 2_000), (3, 90, 100, 2_000, 5), (1, 50, 100, 3_000_000, 2_000), (1, 35, 100, 2_000, 2_000)])
def test_same_components_as_brute_force(spark, ngram, num, den, block, bucket):
    rows = corpus(ngram)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs, ngram, num, den, block_shingles=block, bucket=bucket).collect()}
    assert got == brute(rows, ngram, num, den)


def test_edge_rows(spark):
    rows = [(None, "p q r s"), (3, "p q r s"), (3, "p q r s"), (7, "P Q R S"), (9, None), (None, None), (4, "one"), (4, "two"), (5, "two")]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, node int, route string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.components(docs).collect())
    want = [(None, 2, 3), (3, 2, 3), (3, 2, 3), (7, 2, 3), (9, 0, 9), (None, 0, None), (4, 1, 4), (4, 1, 4), (5, 1, 4)]
    assert got == sorted((str(a), b, str(c)) for a, b, c in want)
    assert jaccard_join.components(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.components(docs, num=101)


def test_different_texts_of_one_id_keep_their_links(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(8, long), (8, long + " z"), (9, long + " y"), (20, "p q r"), (20, "s t u"), (21, "p q r"), (22, "s t u")] + [(30 + i, "c o p y") for i in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {8: 8, 9: 8, 20: 20, 21: 20, 22: 20} | {30 + i: 30 for i in range(40)}


def test_prefixes_meet_for_every_link():
    r = np.random.default_rng(5)
    frequency = r.integers(0, 9, jaccard_join.COUNTERS).astype(np.uint32)
    for num in (50, 90):
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(r.integers(0, max(1, n * (100 - num) // 90) + 1))
            b = np.unique(np.append(a[drop // 2 :], r.integers(0, 2**63, drop - drop // 2).astype(np.uint64)))
            if 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                assert set(jaccard_join.prefix(a, frequency, num, 100)) & set(jaccard_join.prefix(b, frequency, num, 100))


def test_tree_finds_what_the_bound_lets_through():
    r = np.random.default_rng(6)
    counts = r.poisson(r.choice([0.5, 4, 300], 700)[:, None], (700, jaccard_join.GROUPS)).astype(np.int32)
    counts[300:400] = counts[299] + r.integers(0, 2, (100, jaccard_join.GROUPS))
    sizes = counts.sum(1).astype(np.int64)
    tree = jaccard_join.RTree(counts, sizes)
    assert len(tree.levels) == 3 and sorted(tree.order) == list(range(700))
    for num in (50, 80, 90):
        got = set(zip(*(x.tolist() for x in tree.search(counts, sizes, num, 100))))
        want = (num + 100) * np.minimum(counts[:, None], counts[None]).sum(2) >= num * (sizes[:, None] + sizes[None])
        assert got == set(zip(*(x.tolist() for x in np.nonzero(want))))


@pytest.mark.parametrize(("num", "bucket"), [(80, 2_000), (90, 3)])
def test_long_sets_link_over_the_classes_of_lengths(spark, num, bucket):
    r = random.Random(num)
    top = jaccard_join.GROUPS * jaccard_join.FILL
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts, common = [], [word() for _ in range(300)]
    for n in (top - 60, top + 50, 4 * top + 20, 4 * top + 900):
        base = [word() for _ in range(n)]
        texts += [base] + [base[: n - r.randint(0, 200)] for _ in range(3)] + [[w if r.random() > 0.02 else word() for w in base]]
        texts += [common + [word() for _ in range(n)] for _ in range(3)]
    rows = list(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.components(docs, 3, num, 100, bucket=bucket).collect()}
    assert got == brute(rows, 3, num)


def test_looked_up_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(_components, "HEAVY", 2)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([1, 1, 1, 1, 2, 3, None, None])], "i int, k long")
    table = spark.createDataFrame([(1, 10, 4), (2, 20, 1)], "k long, v long, n long")
    got = sorted((r.i, r.v) for r in _components.looked_up(rows, "k", table, "v", "n").collect())
    assert got == [(0, 10), (1, 10), (2, 10), (3, 10), (4, 20), (5, None), (6, None), (7, None)]

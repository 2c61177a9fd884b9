import math

import duckdb
import numpy as np
import pytest

from quillon.llm import ann, queries, url_filter


def brute(rows, asked, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in good:
            score = {i: float(good[q] @ v / (np.sqrt(good[q] @ good[q]) * np.sqrt(v @ v))) for i, v in good.items() if i != q}
            out[q] = sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_search_finds_neighbours(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 24))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.7 * r.normal(size=24)]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)]  # a hot vector
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [None] + [1.0] * 23), (3003, [float("nan")] + [1.0] * 23), (3004, [float("inf")] + [1.0] * 23), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    asked = [i for i, _ in rows if i is not None and i % 50 == 0]
    got = {}
    for x in ann.search(df.filter("vec_id % 50 = 0"), df, 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows, asked, 5)
    assert set(got) == set(want)
    hits = sum(s >= want[q][-1][1] - 1e-12 for q, v in got.items() for _, _, s in v)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, v in got.items():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and all(a[2] >= b[2] for a, b in zip(v, v[1:]))
    assert [x[1] for x in got[0]] == [2000, 2001, 2002, 2003, 2004]  # ties to the smaller id


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0])], "vec_id long, embedding array<float>")
    got = sorted((x.query_id, x.rank, x.vec_id, round(x.score, 6)) for x in ann.search(df.filter("vec_id % 50 = 0"), df, 5).collect())
    assert got == [(0, 1, 7, 1.0), (0, 2, 50, 0.707107), (50, 1, 0, 0.707107), (50, 2, 7, 0.707107)]
    assert ann.search(df.limit(0), df, 5).count() == 0 and ann.search(df, df.limit(0), 5).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = queries.QUERIES["op1_anisotropic_search"](spark, "/root/testdata/sf0.001").collect()
    assert sum(x.score >= want[x.query_id][-1][1] - 1e-12 for x in got) / sum(map(len, want.values())) >= 0.9


URLS = [
    "http://www.Example.COM/en/x?q", "https://a.example.com/en/", "https://example.com/en", "http://example.com/fr/", "http://evil-example.com/en/", "http://x.net/es/1#f", "http://x.net/esx", "http://net/fr/?", "ftp://user@h.com:80/a", "no-scheme.com/x", "", None,
    "http://", "http:///en/", "http://example.com?x=/en/", "http://a.b.www.example.com/en/z://y", "http://com", "http://com/", "http://é.com/ü",
]


def test_verdicts_as_sql(spark):
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    want = sorted(con.execute(queries.ORACLE_SQL["op8_url_filter"]).fetchall(), key=str)
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string").repartition(2)
    for limit in (url_filter.BROADCAST_RULES, 0):
        got = sorted((tuple(r) for r in url_filter.judge(pages, queries.URL_RULES, broadcast_rules=limit).collect()), key=str)
        assert got == want


def test_longest_rule_with_open_segments(spark):
    rules = [("block", "a.com", "/"), ("allow", "a.com", "/x/y"), ("block", "a.com", "/x/yz"), ("allow", "b.a.com", "/"), ("block", "a.com", "/q/"), ("allow", "a.com", "/q/")]
    pages = spark.createDataFrame(list(enumerate(["u://a.com/x/y1", "u://a.com/x/yzz", "u://b.a.com/x/yzz", "u://a.com/x/", "u://a.com/q/1", "u://c.org/"])) + [(None, "u://a.com/")], "page_id long, url string")
    for limit in (99, 0):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, broadcast_rules=limit).collect()}
        assert got == {0: ("a.com/x/y", "allow"), 1: ("a.com/x/yz", "block"), 2: ("b.a.com/", "allow"), 3: ("a.com/", "block"), 4: ("a.com/q/", "block"), 5: (None, "allow"), None: ("a.com/", "block")}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_a_malformed_rule_is_refused_wherever_it_stands(spark):
    pages = spark.createDataFrame([(1, "u://a.com/")], "page_id long, url string")
    rules = [("allow", f"h{i}.com", "/") for i in range(1500)] + [("block", "a.com", "no-slash")]
    for limit in (url_filter.BROADCAST_RULES, 10):
        with pytest.raises(ValueError):
            url_filter.judge(pages, rules, broadcast_rules=limit)


def test_search_with_repeated_ids_and_other_lengths(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(120)]
    more = [(50, [9.0] * 6), (50, [-9.0] * 6), (200, [1.0, 2.0]), (250, [1.0, 2.0])]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").repartition(3)
    got = [[tuple(x) for x in ann.search(df.filter("vec_id % 50 = 0"), df, 3).orderBy("query_id", "rank").collect()] for _ in range(2)]
    assert got[0] == got[1] and {x[0] for x in got[0]} == {0, 50, 100} and not {200, 250} & {x[2] for x in got[0]}
    first = min([v for i, v in rows + more if i == 50])
    want = brute([(i, v) for i, v in rows if i != 50] + [(50, first)], [50], 3)[50]
    assert {x[2]: round(x[3], 9) for x in got[0] if x[0] == 50} == {i: round(s, 9) for i, s in want}


@pytest.mark.parametrize("kind", ["close to one direction", "close groups beside others", "many components", "opposite and of many sizes"])
def test_search_misses_none_whatever_the_rows(spark, kind):
    r = np.random.default_rng(8)
    if kind == "close to one direction":
        x = 10 + r.normal(size=(2000, 16))
    elif kind == "close groups beside others":
        x = np.where(r.random((2000, 1)) < 0.5, r.normal(size=(4, 16))[r.integers(0, 4, 2000)] + 1e-3 * r.normal(size=(2000, 16)), r.normal(size=(2000, 16)))
    elif kind == "many components":
        x = r.normal(size=(1500, 129))
    else:
        one = np.r_[np.ones((1, 8)), -np.ones((7, 8))]  # the query's own side is nearly empty
        x = (one[r.integers(0, 8, 1500)] + 0.1 * r.normal(size=(1500, 8))) * 10.0 ** r.integers(-30, 30, (1500, 1))
        x[0] = [2.0, 1, 1, 1, 1, 1, 1, 1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for row in ann.search(df.filter("vec_id % 50 = 0"), df, 5).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    want = brute(rows, range(0, len(rows), 50), 5)
    assert got == {q: [i for i, _ in best] for q, best in want.items()}

import inspect
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import distributions
from quillon.operators import estimators, metrics, paths, regime, scenario, wmcr
from quillon.plans import base, simulation, studies


def test_distribution_tails():
    assert distributions.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert distributions.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert distributions.ks_sf(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-6)
    assert distributions.ks_sf(1.358 / math.sqrt(10_000), 10_000) == pytest.approx(0.05, abs=0.002)


def test_ou_fit_recovers_parameters(spark):
    p = paths.ou(spark, 4, 3000, 0.5, 0.2, 0.5, 0.1)
    fit = estimators.ou_ols(p, "v", by=["sim_id"], order="t").toPandas()
    assert fit["kappa"].mean() == pytest.approx(0.2, abs=0.03) and fit["mu"].mean() == pytest.approx(0.5, abs=0.05) and fit["sigma"].mean() == pytest.approx(0.1, abs=0.005)


def test_paths_do_not_depend_on_partitions(spark):
    a = {tuple(r) for r in paths.heston(spark, 40, 12, 100.0, 0.1, 0.2, 2.0, 0.2, 0.5, -0.5).collect()}
    few = spark.range(0, 40, 1, 1)
    assert few.count() == 40
    b = {tuple(r) for r in paths.heston(spark, 60, 12, 100.0, 0.1, 0.2, 2.0, 0.2, 0.5, -0.5).filter("sim_id < 40").collect()}
    assert a == b and len(a) == 40 * 12


def test_martingales(spark):
    for p in (paths.gbm(spark, 4000, 20, 100.0, 0.0, 0.3, dt=1 / 20), paths.merton(spark, 4000, 20, 100.0, 0.0, 0.02, 0.1, -0.02, 0.05)):
        assert p.filter("t = 19").agg(F.avg("v")).first()[0] == pytest.approx(100, rel=0.03)


def test_garch_fit(spark):
    p = paths.arma_garch(spark, 1, 1500, 100.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.85).toPandas().sort_values("t")["v"].to_numpy()
    fit = estimators.garch_series(np.diff(np.log(p)), student=False)
    assert 0.8 < fit["alpha"] + fit["beta"] < 1.0 and fit["alpha"] == pytest.approx(0.1, abs=0.08)


def test_garch_query_fits_whole_series(spark):
    sf = "/root/testdata/sf0.001"
    days = simulation._returns(spark, sf).filter("r is not null").groupBy("s").count()
    want = {x.s: x["count"] for x in days.collect()}
    assert max(want.values()) > 250 and {x.s: x.n for x in simulation.garch_fit(spark, sf).collect()} == want


def test_garch_loss_as_plain_recursion():
    e = np.random.default_rng(7).standard_t(5, 400)
    for nu in (None, 5.0):
        s, total = float(e.var()), 0.0
        for x in e.tolist():
            total -= -0.5 * (math.log(2 * math.pi * s) + x * x / s) if nu is None else math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2) * s) - (nu + 1) / 2 * math.log1p(x * x / (s * (nu - 2)))
            s = 0.1 + 0.1 * x * x + 0.8 * s
        assert estimators._garch_loss(e, 0.1, 0.1, 0.8, nu) == pytest.approx(total, rel=1e-10)


def test_dtw_as_plain_recursion():
    r = np.random.default_rng(3)
    for n, m in ((1, 1), (5, 9), (20, 13)):
        a, b = r.normal(size=n), r.normal(size=m)
        x, y = ((v - v.min()) / (np.ptp(v) or 1) for v in (a, b))
        d = np.full((n + 1, m + 1), np.inf)
        d[0, 0] = 0
        for i in range(n):
            for j in range(m):
                d[i + 1, j + 1] = abs(x[i] - y[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert paths.dtw_series(a, b) == pytest.approx(d[n, m] / max(n, m), abs=1e-12)


def test_batched_warping_is_that_of_each_pair(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(7, 12)), r.normal(size=(7, 12))
    b[2] = 3.0  # a series that does not vary
    np.testing.assert_allclose(paths.dtw_batch(a, b), [paths.dtw_series(x, y) for x, y in zip(a, b)], atol=1e-12)
    rows = [(i, t, float(b[i, t])) for i in range(7) for t in range(12) if not (i == 5 and t > 8)] + [(6, 99, None)]
    p = spark.createDataFrame(rows, "sim_id int, t int, v double")
    actual = spark.createDataFrame([(t, float(a[0, t])) for t in range(12)], "t int, a double")
    got = {x.sim_id: x.dtw for x in paths.dtw(p, actual).collect()}
    assert got == {i: pytest.approx(paths.dtw_series(a[0, : 9 if i == 5 else 12], b[i, : 9 if i == 5 else 12])) for i in range(7)}


def test_what_a_fit_finds_again(spark):
    from quillon.operators import validation

    r = np.random.default_rng(6)
    x = [0.0]
    for _ in range(900):
        x.append(x[-1] + 0.2 * (1.0 - x[-1]) + 0.1 * r.normal())
    values = spark.createDataFrame([("a", t, v, int(t >= 880)) for t, v in enumerate(x)] + [("b", 0, 1.0, 0)], "s string, d int, value double, regime int")
    out = validation.validate(values, n=200, steps=400)
    table = {(q.s, q.regime, q.parameter): q for q in out["table"].collect()}
    assert set(table) == {("a", g, p) for g in (0, 1) for p in ("theta", "mu", "sigma")}  # too few values have no fit
    for p in ("theta", "mu", "sigma"):
        q = table["a", 0, p]
        assert q.n_paths == 200 and abs(q.again - q.fitted) < 0.1 * abs(q.fitted) and q.stationary
    assert table["a", 0, "mu"].observed == pytest.approx(np.mean(x[:880])) and table["a", 0, "sigma"].observed == pytest.approx(np.std(x[:880], ddof=1))
    assert {(q.s, q.regime, q.stationary) for q in out["adf"].collect()} >= {("a", 0, True), ("b", 0, None)}
    acf = {(q.regime, q.lag): q for q in out["acf"].collect()}
    assert {g for g, _ in acf} == {0} and acf[0, 0].acf == 1 and abs(acf[0, 3].acf - acf[0, 3].theory) < 0.15


def test_hmm_finds_two_regimes(spark):
    r = np.random.default_rng(5)
    state = np.repeat([0, 1, 0, 1], 60)
    y = np.where(state == 1, 3.0, 0.0) + r.normal(0, 0.5, 240)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "s string, d int, y double")
    got = {x.k: x for x in regime.hmm_regimes(df, "y", (1, 2), starts=2).collect()}
    assert got[2].bic < got[1].bic and np.mean(np.array(got[2].states) == state) > 0.98
    assert got[2].mu == sorted(got[2].mu)
    p = regime.bootstrap_lrt(df, "y", 1, replicates=6, starts=1).first()
    assert p.observed > 50 and p.p == 0


def test_regime_queries_use_every_series_and_replicate(spark, monkeypatch):
    from quillon.plans import studies

    seen = {}
    for name in ("sequential_lrt", "hmm_regimes", "choose_states"):
        monkeypatch.setattr(regime, name, lambda *a, f=getattr(regime, name), **b: seen.update({f.__name__: (a[0].select("s").distinct().count(), inspect.signature(f).bind(*a, **b))}) or [None, None])
    simulation.bootstrap_lrt(spark, "/root/testdata/sf0.001")
    simulation.hmm_regimes(spark, "/root/testdata/sf0.001")
    studies.hmm_selection(spark, "/root/testdata/sf0.001")
    assert {k: n for k, (n, _) in seen.items()} == {"sequential_lrt": 5, "hmm_regimes": 5, "choose_states": 5}
    for _, bound in seen.values():
        bound.apply_defaults()
    assert all(seen[n][1].arguments["replicates"] >= 1000 for n in ("sequential_lrt", "choose_states")) and seen["sequential_lrt"][1].arguments["starts"] >= 3
    assert seen["hmm_regimes"][1].arguments["starts"] >= 10 and seen["choose_states"][1].arguments["starts"] >= 10


def _two_kinds(spark):
    """Series of two clear states, of none, and one too short for three."""
    r = np.random.default_rng(7)
    two = np.where(np.repeat([0, 1, 0], 40) == 1, 4.0, 0.0) + r.normal(0, 0.5, 120)
    rows = [("two", i, float(v)) for i, v in enumerate(two)] + [("none", i, float(v)) for i, v in enumerate(r.normal(size=90))] + [("short", i, float(i % 3)) for i in range(12)]
    return spark.createDataFrame(rows, "s string, d int, y double")


def test_sequential_test_decides_as_all_replicates_do(spark, monkeypatch):
    monkeypatch.setattr(regime, "FIRST_LOOK", 10)
    monkeypatch.setattr(regime, "REPLICATES", 7)
    df = _two_kinds(spark).filter("s <> 'short'")
    got = {x.s: x for x in regime.sequential_lrt(df, "y", 1, 60, starts=1, alpha=0.2).collect()}
    whole = {x.s: x for x in regime.bootstrap_lrt(df, "y", 1, 60, starts=1).collect()}
    for s in ("two", "none"):
        assert got[s].rejects == (whole[s].p < 0.2) and got[s].observed == pytest.approx(whole[s].observed)
    assert got["two"].rejects and not got["none"].rejects
    assert got["none"].m < 60 and got["two"].m >= 49  # decided early; nearly all are needed to reject


def test_number_of_states_end_to_end(spark):
    fits, chosen = regime.choose_states(_two_kinds(spark), "y", starts=3, replicates=40, test_starts=1)
    got = {x.s: x for x in chosen.collect()}
    assert got["two"].best_k >= 2 and got["none"].best_k == 1 and got["none"].p23 is None and got["none"].reason.startswith("one state")
    assert (got["two"].p23 is not None) and {x.k for x in fits.filter("s = 'two'").collect()} == {1, 2, 3}


def test_two_states_as_three_with_one_unused():
    r = np.random.default_rng(8)
    y, start, move = r.normal(size=(3, 40)), np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.2, 0.8]])
    many = lambda x: np.repeat(np.asarray(x, float)[None], 3, 0)
    ll, gamma, pair = regime._expected(y, many([-1, 1]), many([1, 2]), many(start), many(move))
    ll3, gamma3, pair3 = regime._expected(y, many([-1, 1, 99]), many([1, 2, 1]), many(np.append(start, 0.0)), many(np.pad(move, ((0, 1), (0, 1)))))
    assert ll3 == pytest.approx(ll) and gamma3[:, :, :2] == pytest.approx(gamma) and pair3[:, :2, :2] == pytest.approx(pair)
    assert gamma3[:, :, 2].max() < 1e-12 and pair.sum((1, 2)) == pytest.approx(np.full(3, 39.0))


def test_em_likelihood_does_not_fall():
    y = np.random.default_rng(2).normal(size=150)
    lls = [regime.hmm_fit(y, 2, 1, rounds=n, tol=-1e9)["ll"] for n in (1, 3, 10, 40)]
    assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:]))


def test_adf_tells_a_walk_from_noise():
    r = np.random.default_rng(4)
    assert regime.adf_series(r.normal(size=400))["p"] < 0.01
    walks = [regime.adf_series(np.cumsum(r.normal(size=200)))["p"] for _ in range(40)]
    assert np.mean(walks) > 0.3 and np.mean(np.array(walks) < 0.05) < 0.2


def test_har_as_least_squares(spark):
    r = np.random.default_rng(6)
    y = np.abs(r.normal(size=200)).cumsum() % 7
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "s string, d int, y double")
    got = regime.har(df, "y").toPandas().sort_values("d")
    t = np.arange(22, 200)
    a = np.column_stack([np.ones(len(t)), y[t - 1], [y[i - 5 : i].mean() for i in t], [y[i - 22 : i].mean() for i in t]])
    c = np.linalg.lstsq(a, y[t], rcond=None)[0]
    np.testing.assert_allclose(got["residual"], y[t] - a @ c, atol=1e-8)


def test_kupiec_guards(spark):
    days = lambda hits: spark.createDataFrame([(i, h) for i, h in enumerate(hits)], "t int, hit int")
    assert metrics.kupiec(days([0] * 20), 0.05).first().lr == pytest.approx(-2 * 20 * math.log(0.95))
    assert metrics.kupiec(days([0] * 20), 0.05, guarded=True).first().lr == 0
    assert metrics.kupiec(days([1] * 5), 0.05, guarded=True).first().lr == math.inf


def test_lift_has_pairs_that_never_meet(spark):
    rows = [("s", d, v, x) for d, (a, b) in enumerate([(0, 0), (0, 0), (1, 1)]) for v, x in (("a", a), ("b", b))]
    got = {(r.state_a, r.state_b): (r.n_ab, r.lift) for r in scenario.pairwise_lift(spark.createDataFrame(rows, "s string, d int, variable string, state int")).collect()}
    assert got[(0, 1)] == (0, 0.0) and got[(0, 0)] == (2, 1.5) and sum(n for n, _ in got.values()) == 3


def test_block_bootstrap_and_p_value(spark):
    y = spark.createDataFrame([(i, float(i)) for i in range(10)], "t int, y double")
    starts = spark.createDataFrame([(0, 0, 8), (0, 1, 3), (0, 2, 0)], "b int, i int, start int")
    got = [r.y for r in wmcr.block_bootstrap(y, starts, 4, 10).orderBy("t").collect()]
    assert got == [8, 9, 0, 1, 3, 4, 5, 6, 0, 1]
    null = spark.createDataFrame([(0.9,), (0.8,), (1.0,)], "wmcr double")
    assert wmcr.p_value(null, 0.85).first().p == pytest.approx(0.5)
    assert [r.verdict for r in wmcr.binomial_test(spark, 343, (0.5, 0.8, 0.95), (0.3965, 0.8163, 0.8950)).orderBy("k").collect()] == ["NOT ACCEPTABLE", "ACCEPTABLE", "NOT ACCEPTABLE"]


def test_no_scenario_or_shift_is_dropped(spark):
    many = spark.range(10_500).select(F.col("id").alias("scenario_id"), F.lit(1).alias("a"))
    assert scenario.scenario_days(spark.createDataFrame([(0, 1)], "d int, a int"), many, ["a"]).count() == 10_500
    shifts = spark.range(100_500).select(F.col("id").alias("b"), F.lit(1).alias("shift"))
    assert wmcr.circular_shifts(spark.createDataFrame([(0, 1.0)], "t int, y double"), shifts, 1).count() == 100_500


def test_hidden_markov_batch_as_plain_recursion():
    r = np.random.default_rng(4)
    y = np.where(np.arange(160) // 40 % 2, 2.0, -1.0) + r.normal(0, 0.7, 160)
    fit = regime.hmm_best(y, 2, 4, 42)
    mu, sd, start, move = fit["mu"], np.sqrt(fit["var"]), fit["start"], fit["move"]
    density = np.exp(-0.5 * ((y[:, None] - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
    row, ll = start * density[0], 0.0
    for t in range(len(y)):
        row = (row @ move) * density[t] if t else row
        ll, row = ll + math.log(row.sum()), row / row.sum()
    assert fit["ll"] == pytest.approx(ll, rel=1e-9) and mu[0] < mu[1] and fit["gamma"].sum(1) == pytest.approx(np.ones(160))
    one = regime.hmm_fits(y[None], 2, [42])["ll"][0]
    both = regime.hmm_fits(np.stack([y, y[::-1]]), 2, [42, 43])["ll"]
    assert both[0] == pytest.approx(one, rel=1e-9)
    assert regime.hmm_best(y, 1, 1, 0)["ll"] == pytest.approx(-80 * (math.log(2 * math.pi * y.var()) + 1), rel=1e-6)


def test_recursion_in_blocks():
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 400):
        x, want = r.normal(size=n), [0.3]
        for v in x:
            want.append(-0.8 * want[-1] + v)
        assert estimators.recursion(x, -0.8, 0.3) == pytest.approx(want)


def test_judged_pairs_count_both_ways_and_unseen_combinations_are_not_taken(spark):
    combos = spark.createDataFrame([(a, b) for a in range(2) for b in range(2)], "a int, b int")
    lifts = spark.createDataFrame([("a", 0, "b", 0, 0.5)], "var_a string, state_a int, var_b string, state_b int, lift double")
    judged = spark.createDataFrame([("b", 0, "a", 0, "Possible"), ("a", 1, "b", 1, "Possible"), ("a", 0, "b", 1, "Ambiguity")], "var_a string, state_a int, var_b string, state_b int, judgement string")
    got = scenario.classify(combos, lifts, ["a", "b"], judged)
    assert {(x.a, x.b): x["class"] for x in got.collect()} == {(0, 0): "Possible", (1, 1): "Possible", (0, 1): "Ambiguity", (1, 0): "Ambiguity"}
    seen = spark.createDataFrame([(0, 0, 4)], "a int, b int, n int")
    ranked = scenario.rank_combos(got, seen, ["a", "b"])
    assert [(x.scenario_id, x.a, x.b) for x in scenario.greedy_diversity(ranked, ["a", "b"]).collect()] == [("S01", 0, 0)]
    assert [(x.a, x.b) for x in scenario.greedy_diversity(ranked, ["a", "b"], 0, least=0).collect()] == [(0, 0), (1, 1)]
    named = scenario.translated(spark.createDataFrame([("x", "q")], "u string, v string"), ["u", "v"], {"x": "y"})
    assert named.select(scenario.combo_label(["u", "v"])).first()[0] == "y-q"


def test_tails_and_test_tables_as_plain_loops(spark):
    r = np.random.default_rng(2)
    x, y = np.round(r.normal(size=90), 1), np.round(r.normal(0.2, 1.3, 70), 1)
    df = lambda v: spark.createDataFrame([(float(a),) for a in v], "v double")
    lo, hi = np.quantile(x, 0.1), np.quantile(x, 0.9)
    a, b = x[(x <= lo) | (x >= hi)], y[(y <= lo) | (y >= hi)]
    both, want = np.sort(np.concatenate([a, b])), 0.0
    for i in range(1, len(both) - 1):
        want += ((a <= both[i]).mean() - (b <= both[i]).mean()) ** 2 / (i * (len(both) - i))
    assert metrics.tail_weighted_distance(df(x), df(y)).first()[0] == pytest.approx(want)
    assert metrics.tail_weighted_distance(df(x[:10]), df(y)).first()[0] == math.inf
    days = spark.createDataFrame([(t, 0.0, int(t < 10), -1.0) for t in range(200)], "t int, a double, hit int, es double")
    assert metrics.kupiec_test(days, 0.05).first().p == pytest.approx(1.0) and metrics.es_tail_error(days).first().tail_error == 1.0
    none = days.withColumn("hit", F.lit(0))
    assert metrics.kupiec_test(none, 0.05, guarded=True).first().p == 1.0 and metrics.kupiec_test(none, 0.05).first().p < 0.001
    assert metrics.es_tail_error(none).first().tail_error is None and metrics.es_tail_error(none, 0.0).first().tail_error == 0.0


def test_legacy_capture_as_plain_windows(spark):
    r = np.random.default_rng(9)
    a, v = r.normal(size=60).cumsum(), r.normal(size=60).cumsum()
    n, w = len(a), 10
    corr = [np.corrcoef(a[i : i + w], v[i : i + w])[0, 1] for i in range(n - w + 1)]
    c = a - a.mean()
    acf = [(c[k:] * c[:-k]).sum() / (c * c).sum() for k in range(1, 6)]
    want = np.average(corr, weights=np.arange(1, len(corr) + 1)) - 0.6 * np.mean(acf)
    pair = spark.createDataFrame([(t, float(a[t]), float(v[t])) for t in range(n)], "t int, a double, v double")
    assert metrics.legacy_capture(pair).first().wmcr == pytest.approx(want, rel=1e-6)


def _rare_jumps(spark, folder):
    """Five series of orders; the s-th has s days of more than half up in logs, and falls back in smaller steps."""
    r = np.random.default_rng(4)
    rows = []
    for s in range(5):
        level = 6.0
        for d in range(90):
            level += 0.7 + 0.05 * r.random() if d % 17 == 5 and d // 17 < s else 0.3 * r.normal() * 0.5 - 0.1 * (level - 6.0)
            rows += [(f"P{s}", d, float(np.exp(level)) / n) for n in [int(r.integers(1, 5))] for _ in range(n)]
    df = spark.createDataFrame(rows, "o_orderpriority string, day int, o_totalprice double")
    df = df.select("o_orderpriority", "o_totalprice", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp").alias("o_orderdate"))
    df.write.parquet(f"{folder}/orders.parquet")


def _sql(view, sql):
    con = duckdb.connect()
    con.execute(view)
    return sorted(map(str, con.execute(sql).fetchall()))


def test_threshold_fit_of_few_values_is_that_of_its_sql(spark, tmp_path):
    _rare_jumps(spark, tmp_path)
    got = [tuple(x) for x in studies.threshold_ou(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == _sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'", base.ORACLE_SQL["threshold_ou"])
    assert {1, 2, 3, 4} <= {x[6] for x in got}
    small = "/root/testdata/sf0.001"  # has regimes in which the driver does not vary
    want = _sql(f"create view orders as select * from '{small}/orders.parquet'", base.ORACLE_SQL["threshold_ou"])
    assert sorted(str(tuple(x)) for x in studies.threshold_ou(spark, small).collect()) == want


def test_fit_of_a_regime_of_few_values_is_that_of_its_sql(spark, tmp_path):
    _rare_jumps(spark, tmp_path)
    got = [tuple(x) for x in simulation.ou_of_regime(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == _sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'", base.ORACLE_SQL["ou_of_regime"])
    assert {1, 2, 3, 4} <= {x[5] for x in got}

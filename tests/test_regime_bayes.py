import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline import Params
from wakeline.functions.columns import correlation_pvalue, hash_uniform
from wakeline.functions.em import causal_prior, fit_windows, pilot_prior
from wakeline.operators import bayes, regime
from wakeline.operators.markov import markov_filter
from wakeline.plans import inputs
from wakeline.session import durable

P = replace(inputs.REGIME_PARAMS, min_vessel_rows=30)


@pytest.fixture(scope="module")
def features(spark, small):
    return inputs.features(spark, small, P).persist()


def objective(x, y, v, prior):
    mu, gap, s0, s1, t0, t1, th0, th1 = v

    def mix(z, m0, a, m1, b):
        d = th0 * np.exp(-0.5 * ((z - m0) / a) ** 2) / a + th1 * np.exp(-0.5 * ((z - m1) / b) ** 2) / b
        return np.log(d).sum()

    prior_part = (
        (prior.a0 - 1) * np.log(th0) + (prior.a1 - 1) * np.log(th1) - 0.5 * ((mu - prior.m) / prior.s_m) ** 2
        - 0.5 * ((gap - prior.c) / prior.s_g) ** 2
        - 0.5 * (s0**2 + s1**2) / prior.s_speed**2 - 0.5 * (t0**2 + t1**2) / prior.s_turn**2
    )
    return mix(x, mu, s0, mu + gap, s1) + mix(y, 0, t0, 0, t1) + prior_part


def test_window_fit_never_loses_ground_and_is_a_local_best():
    rng = np.random.default_rng(0)
    prior = causal_prior(1.0, 2.0)
    for _ in range(20):
        x, y = rng.normal(size=(1, 36)), rng.normal(size=(1, 36)) * 1.3
        values = [objective(x[0], y[0], fit_windows(x, y, prior, k)[0], prior) for k in (1, 3, 10, 25, 60)]
        assert all(b >= a - 1e-6 for a, b in zip(values, values[1:]))
    best = fit_windows(x, y, prior, 400)[0]
    top = objective(x[0], y[0], best, prior)
    for i in range(6):
        for d in (-1e-3, 1e-3):
            near = best.copy()
            near[i] += d
            assert objective(x[0], y[0], near, prior) <= top + 1e-6


def test_known_mixture_is_recovered():
    rng = np.random.default_rng(1)
    z = rng.random(4000) < 0.3
    x = np.where(z, rng.normal(-1, 0.5, 4000), rng.normal(1.5, 0.4, 4000))
    y = np.where(z, rng.normal(0, 1.5, 4000), rng.normal(0, 0.4, 4000))
    mu, gap, *_, theta, _ = fit_windows(x[None], y[None], pilot_prior(2.0, 3.0), 60)[0]
    assert mu == pytest.approx(-1, abs=0.1) and gap == pytest.approx(2.5, abs=0.1) and theta == pytest.approx(0.3, abs=0.03)


def test_distributed_fit_equals_fit_in_tasks(spark, features):
    rows = durable(bayes.pilot_rows(features, P, 2))
    near = {r.MMSI: r for r in bayes.pilot_mixture(rows, replace(P, em_iterations=6)).collect()}
    for change in ({"group_rows": 0}, {"group_rows": 0, "broadcast_rows": 0}):
        change = change | {"em_iterations": 6}
        far = bayes.pilot_mixture(rows, replace(P, **change)).collect()
        assert len(far) == len(near) > 0
        for r in far:
            for c in ("mu_sospetto", "gap", "sigma_speed_0", "sigma_turn_1", "theta_0"):
                assert r[c] == pytest.approx(near[r.MMSI][c], abs=1e-6)


@pytest.mark.parametrize("rows", [3, 150, 20_000])
def test_sliced_filter_equals_plain_filter(spark, small, rows):
    p = replace(P, range_rows=rows)
    rows = inputs.event_pings(spark, small).withColumn(
        "prob_regime_sospetto", F.when(F.col("ping_seq") % 6 != 0, F.least(F.col("SOG") / 30, F.lit(0.99)))
    )
    a = {r.ping_seq: r.prob_regime_markov for r in markov_filter(rows, p).collect()}
    b = {r.ping_seq: r.prob_regime_markov for r in markov_filter(rows, p, bounded=True).collect()}
    assert a.keys() == b.keys()
    for k, v in b.items():
        assert (v is None) == (a[k] is None) and (v is None or a[k] == pytest.approx(v, abs=1e-9))


def test_scores_ignore_the_future(spark, features):
    a = regime.score_table(features, P)
    # the scaler is fitted on the first third of a vessel, so compare from a cut that keeps it whole
    assert a.filter("prob_regime_sospetto < 0 or prob_regime_sospetto > 1").count() == 0
    rows = regime.std_causal(features, P)
    most = lambda p: regime.refits(rows, p).groupBy("MMSI").agg(F.count_if("refit").alias("k")).agg(F.max("k")).first()[0]
    assert most(replace(P, max_fits=4)) == 4 < most(P)


def test_short_vessels_get_no_score(features):
    long = replace(P, window=10_000)
    assert regime.regime_score(features, long).filter("prob_regime_sospetto is not null").count() == 0


def test_null_gate(features):
    rows = regime.numbered(features).withColumn("prob_regime_sospetto", F.lit(None).cast("double"))
    with pytest.raises(regime.RegimeError):
        regime.null_gate(rows, P)


def test_the_scorer_calls_the_gate(features, monkeypatch):
    plain = regime.score_table(features, P)
    hidden = plain.withColumn("prob_regime_sospetto", F.when(F.col("MMSI") != plain.first().MMSI, F.col("prob_regime_sospetto")))
    monkeypatch.setattr(regime, "score_table", lambda *_: hidden)
    with pytest.raises(regime.RegimeError):
        regime.regime_score(features, P)
    assert regime.regime_score(features, P, gate=False).count() == plain.count()


def test_scorer_has_one_vessel_shuffle(features):
    plan = regime.score_table(features, P)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") <= 1


def test_empty_pilots_fall_back(spark, features):
    fits = bayes.pilot_mixture(bayes.pilot_rows(features, replace(P, min_vessel_rows=10_000)), P)
    row = bayes.eb_priors(fits).first()
    assert (row.sigma_prior_speed, row.sigma_prior_turn, row.method) == (1.0, 2.0, "fallback_default")


def test_pvalue_of_rank_correlation(spark):
    """Against values of the t distribution, and against exact forms for few degrees of freedom."""
    cases = [(0.5, 10), (1.0, 10), (-1.0, 5), (0.0, 7), (0.9, 4), (-0.3, 3), (0.05, 2000), (0.004, 500_000), (0.2, 60), (None, 9), (0.4, 2)]
    got = [r.p for r in spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, r double, n long").orderBy("k").select(
        correlation_pvalue("r", "n").alias("p")).collect()]

    def plain(r, n):
        grid = np.linspace(0, math.asin(abs(r)), 200_001)
        f = np.cos(grid) ** (n - 3)
        norm = math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt(math.pi)
        return 1 - 2 * norm * ((f[1:] + f[:-1]) / 2 * np.diff(grid)).sum()

    assert got[0] == pytest.approx(0.14111, abs=5e-6)
    assert got[1] == got[2] == 0.0 and got[3] == pytest.approx(1.0)
    assert got[4] == pytest.approx(0.1, abs=1e-11)  # two degrees: 1 - |r|
    assert got[5] == pytest.approx(1 - 2 * math.asin(0.3) / math.pi, abs=1e-11)  # one degree
    for p, (r, n) in list(zip(got, cases))[6:9]:
        assert p == pytest.approx(plain(r, n), abs=1e-7)
    assert got[9] is None and got[10] is None


def test_sensitivity_and_agreement_give_pvalues(spark):
    rows = spark.range(40).selectExpr("id % 2 as MMSI", "cast(id as double) as a", "cast((id * 7) % 13 as double) as b")
    for r in bayes.method_agreement(rows, "a", "b", P).collect():
        assert 0 <= r.p_value <= 1
    same = bayes.spearman(rows, "a", "a", P).first()
    assert same.rho == 1.0 and same.p_value == 0.0


@pytest.mark.parametrize("change", [{}, {"group_rows": 35}])
def test_many_fits_equal_single_fits(spark, features, change, monkeypatch):
    """Draws and prior sets of a vessel fitted together, in blocks or apart, give what single fits give."""
    monkeypatch.setattr(bayes, "VARIANT_VALUES", 150)
    p = replace(P, n_draws=6, em_iterations=6, **change)
    rows = durable(bayes.pilot_rows(features, p, 4))
    got = {(r.MMSI, r.draw): r for r in bayes.posterior_draws(rows, p).collect()}
    assert len(got) == 6 * rows.select("MMSI").distinct().count()
    for d in (0, 5):
        weight = -F.log(hash_uniform(p.seed, "MMSI", "t", F.lit(d)))
        for r in bayes.fit_mixture(rows, ["MMSI"], replace(p, group_rows=10**6), pilot_prior(1.0, 2.0), weight=weight).collect():
            for c in bayes.PARAMETERS:
                assert got[r.MMSI, d][c] == pytest.approx(r[c], abs=1e-8 if change else 1e-9)
    scores = {(r.spec, r.MMSI): r.suspicion for r in bayes.prior_scores(rows, p).collect()}
    for spec, (speed, turn) in bayes.SPECIFICATIONS.items():
        fits = bayes.fit_mixture(rows, ["MMSI"], replace(p, group_rows=10**6), pilot_prior(speed, turn))
        for r in bayes.suspicion_score(rows, fits, p).collect():
            assert scores[spec, r.MMSI] == pytest.approx(r.suspicion, abs=1e-8)


def test_rows_are_not_multiplied(features):
    rows = bayes.pilot_rows(features, P)
    for made in (bayes.posterior_draws(rows, P), bayes.prior_scores(rows, P)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0, 99" not in plan and "_o#" not in plan


def test_replicates_follow_their_parameters(spark):
    draw = spark.createDataFrame(
        [(1, 0, -1.0, 3.0, 0.5, 0.2, 1.0, 0.3, 0.25, 0.75)],
        "MMSI long, draw int, mu_sospetto double, gap double, sigma_speed_0 double, sigma_speed_1 double,"
        "sigma_turn_0 double, sigma_turn_1 double, theta_0 double, theta_1 double",
    )
    lengths = spark.createDataFrame([(1, 40_000)], "MMSI long, n long")
    s = bayes.ppc_stats(bayes.ppc_replicates(draw, lengths, Params()), ["MMSI", "draw"]).first()
    assert s.mean_speed == pytest.approx(0.25 * -1 + 0.75 * 2, abs=0.03)
    assert abs(s.autocorr_turn_lag1) < 0.02

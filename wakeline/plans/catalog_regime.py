"""Queries on regime scoring, mixtures and their checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wakeline.functions.columns import micros
from wakeline.functions.regimes import PARAMETERS, regime_probability
from wakeline.operators import bayes, regime
from wakeline.operators.markov import markov_filter, markov_sym
from wakeline.params import MMSI, REGIME, REGIME_MARKOV, REGIME_VAR
from wakeline.plans import inputs
from wakeline.plans.catalog import query, rounded, with_ctes
from wakeline.plans.inputs import REGIME_PARAMS as P
from wakeline.plans.sqlparts import FEATURES, PINGS, standardised

STD = (*FEATURES, standardised())


def us_col():
    return micros().alias("us")


def _features(spark, folder):
    return inputs.features(spark, folder, P)


def _std_cols(rows):
    return rounded(rows.select(MMSI, us_col(), "t", "n", "speed_std", "turn_std"), 7)


@query("std_causal", with_ctes(*STD) + "select MMSI, us, t, n, round(x, 7) as speed_std, round(v, 7) as turn_std from std_c")
def std_causal(spark, folder):
    return _std_cols(regime.std_causal(_features(spark, folder), P))


@query("std_full", with_ctes(*STD) + "select MMSI, us, t, n, round(x, 7) as speed_std, round(v, 7) as turn_std from std_f")
def std_full(spark, folder):
    return _std_cols(regime.std_full(_features(spark, folder)))


FIXED = replace(P, adaptive_threshold=None)


@query("refit_fixed", with_ctes(*STD, """
due as (select *, t >= 12 and (t - 12) % 5 = 0 and n > 12 as due from std_c),
no as (select *, sum(due::INTEGER) over (partition by MMSI order by us) as fit_no from due)""") + """
select MMSI, t, fit_no::BIGINT as fit_no from no where due """)
def refit_fixed(spark, folder):
    rows = regime.refit_fixed(regime.std_causal(_features(spark, folder), FIXED), FIXED)
    return rows.filter("refit").select(MMSI, "t", "fit_no")


# one step for each row: state is the row of the last refit and the number of fits
ADAPTIVE_SQL = """
change as (select *, abs(x - lag(x) over w) + abs(v - lag(v) over w) as ch from std_c window w as (partition by MMSI order by us)),
walk(MMSI, t, last_t, fits, fit) as (
  select MMSI, t, t, 1, true from change where t = 12 and n > 12
  union all
  select c.MMSI, c.t,
    case when (c.ch > 1.5 or c.t - w.last_t >= 5) then c.t else w.last_t end,
    case when (c.ch > 1.5 or c.t - w.last_t >= 5) then w.fits + 1 else w.fits end,
    (c.ch > 1.5 or c.t - w.last_t >= 5)
  from walk w join change c on c.MMSI = w.MMSI and c.t = w.t + 1)"""


@query("refit_adaptive", with_ctes(*STD, ADAPTIVE_SQL) + "select MMSI, t, fits::BIGINT as fit_no from walk where fit")
def refit_adaptive(spark, folder):
    rows = regime.refit_adaptive(regime.std_causal(_features(spark, folder), P), P)
    return rows.filter("refit").select(MMSI, "t", "fit_no")


@query("roll_window", with_ctes(*STD, ADAPTIVE_SQL) + """
select w.MMSI, w.t, count(*) as n_values, round(sum(s.x), 6) as sum_speed, round(sum(s.v * (s.t - w.t)), 5) as turn_moment
from walk w join std_c s on s.MMSI = w.MMSI and s.t between w.t - 11 and w.t where fit group by 1, 2""")
def roll_window(spark, folder):
    rows = regime.roll_windows(regime.refits(regime.std_causal(_features(spark, folder), P), P), P)
    rows = rows.filter("refit").select(
        MMSI, "t", "window_speed", F.posexplode("window_turn").alias("i", "turn")
    )
    return rounded(rows.groupBy(MMSI, "t").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.round(F.first(F.aggregate("window_speed", F.lit(0.0), lambda a, b: a + b)), 6).alias("sum_speed"),
        F.round(F.sum(F.col("turn") * (F.col("i") - 11)), 5).alias("turn_moment"),
    ))


@query("mixture_causal")
def mixture_causal(spark, folder):
    rows = regime.roll_windows(regime.refits(regime.std_causal(_features(spark, folder), P), P), P)
    return regime.mixture_causal(rows, P).filter("refit").select(MMSI, "t", *PARAMETERS)


FIXED_PARAMS = {
    "mu_sospetto": "-0.06 + cast({m} % 7 as double) / 100.0", "gap": "2.0 + cast({m} % 5 as double) / 10.0",
    "sigma_speed_0": "0.5 + cast({m} % 3 as double) / 10.0", "sigma_speed_1": "0.8 + cast({m} % 4 as double) / 10.0",
    "sigma_turn_0": "1.2", "sigma_turn_1": "0.6", "theta_0": "0.2 + cast({m} % 3 as double) / 10.0",
    "theta_1": "0.8 - cast({m} % 3 as double) / 10.0",
}


def _fixed_sql() -> str:
    return "fx as (select *, " + ", ".join(
        f"({e.format(m='MMSI')})::DOUBLE as {c}" for c, e in FIXED_PARAMS.items()
    ).replace("100.0", "100.0::DOUBLE").replace("10.0", "10.0::DOUBLE") + " from std_f)"


def _fixed(rows):
    return rows.withColumns({c: F.expr(e.format(m=MMSI)).cast("double") for c, e in FIXED_PARAMS.items()})


PROB_SQL = """
lj as (select *, ln(theta_0) - 0.5 * ((x - mu_sospetto) / sigma_speed_0) ** 2 - ln(sigma_speed_0)
    - 0.5 * (v / sigma_turn_0) ** 2 - ln(sigma_turn_0) as l0,
  ln(theta_1) - 0.5 * ((x - mu_sospetto - gap) / sigma_speed_1) ** 2 - ln(sigma_speed_1)
    - 0.5 * (v / sigma_turn_1) ** 2 - ln(sigma_turn_1) as l1 from fx),
pr as (select *, exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) as p from lj)"""


@query("regime_prob", with_ctes(*STD, _fixed_sql(), PROB_SQL) + "select MMSI, t, round(p, 7) as p from pr")
def regime_prob(spark, folder):
    rows = _fixed(regime.std_full(_features(spark, folder)))
    return rounded(rows.select(MMSI, "t", regime_probability().alias("p")), 7)


@query("regime_uncertainty", with_ctes(*STD, _fixed_sql(), PROB_SQL) + "select MMSI, t, round(p * (1 - p), 7) as u from pr")
def regime_uncertainty(spark, folder):
    rows = _fixed(regime.std_full(_features(spark, folder)))
    return rounded(regime.score_refits(rows).select(MMSI, "t", F.col(REGIME_VAR).alias("u")), 7)


CARRY_SQL = """
sparse as (select *, case when t >= 12 and t % 4 = 0 then p end as q from pr),
carried as (select *, last_value(q ignore nulls) over (partition by MMSI order by us rows between unbounded preceding and current row) as c from sparse)"""


def _carried(spark, folder):
    rows = regime.score_refits(_fixed(regime.std_full(_features(spark, folder))))
    hit = (F.col("t") >= 12) & (F.col("t") % 4 == 0)
    return regime.carry_forward(rows.withColumns({c: F.when(hit, F.col(c)) for c in (REGIME, REGIME_VAR)}))


@query("carry_forward", with_ctes(*STD, _fixed_sql(), PROB_SQL, CARRY_SQL) + """
select MMSI, t, round(c, 7) as p, round(c * (1 - c), 7) as u from carried""")
def carry_forward(spark, folder):
    return rounded(_carried(spark, folder).select(MMSI, "t", F.col(REGIME).alias("p"), F.col(REGIME_VAR).alias("u")), 7)


def chain_sql(p00: float, p11: float) -> str:
    return f"""
ps as (select MMSI, ping_seq, row_number() over (partition by MMSI order by us) as rn,
  least(greatest(SOG / 40.0::DOUBLE, 0.001::DOUBLE), 0.999::DOUBLE) as p from pings),
chain(MMSI, rn, ping_seq, s) as (
  select MMSI, rn, ping_seq, p from ps where rn = 1
  union all
  select n.MMSI, n.rn, n.ping_seq, n.p * (c.s * {p00} + (1 - c.s) * (1 - {p11}))
    / (n.p * (c.s * {p00} + (1 - c.s) * (1 - {p11})) + (1 - n.p) * (c.s * (1 - {p00}) + (1 - c.s) * {p11}) + 1e-12)
  from chain c join ps n on n.MMSI = c.MMSI and n.rn = c.rn + 1)"""


def _chain_input(spark, folder):
    from wakeline.functions.columns import clip

    return inputs.event_pings(spark, folder).withColumn(REGIME, clip(F.col("SOG") / 40.0, 0.001, 0.999))


@query("markov_filter", with_ctes(PINGS, chain_sql("0.85::DOUBLE", "0.9::DOUBLE")) + "select MMSI, ping_seq, round(s, 7) as s from chain")
def markov(spark, folder):
    out = markov_filter(_chain_input(spark, folder), P, p_00=0.85, p_11=0.9)
    return rounded(out.select(MMSI, "ping_seq", F.col(REGIME_MARKOV).alias("s")), 7)


@query("markov_sym", with_ctes(PINGS, chain_sql("0.8::DOUBLE", "0.8::DOUBLE")) + "select MMSI, ping_seq, round(s, 7) as s from chain")
def markov_symmetric(spark, folder):
    out = markov_sym(_chain_input(spark, folder), P, 0.8, out="s")
    return rounded(out.select(MMSI, "ping_seq", "s"), 7)


@query("short_vessel", with_ctes(*STD, ADAPTIVE_SQL) + """
select n.MMSI, n.t, n.n, n.n > 12 and n.t >= 12 and coalesce(max(w.fit::INTEGER) over (partition by n.MMSI order by n.t), 0) = 1 as scored
from std_c n left join walk w on w.MMSI = n.MMSI and w.t = n.t""")
def short_vessel(spark, folder):
    rows = regime.score_table(_features(spark, folder), P)
    return rows.select(MMSI, "t", "n", F.col(REGIME).isNotNull().alias("scored"))


@query("score_null_gate", with_ctes(*STD, """
late as (select MMSI, n, t, t % 4 = 0 as hole from std_c where n > 12 and t >= 12)""") + """
select MMSI, count(*) as n_late, sum(hole::INTEGER)::BIGINT as n_null, round(sum(hole::INTEGER)::DOUBLE / count(*), 7) as null_share
from late group by MMSI""")
def score_null_gate(spark, folder):
    rows = regime.numbered(_features(spark, folder)).withColumn(REGIME, F.when(F.col("t") % 4 != 0, F.lit(0.5)))
    return rounded(regime.null_share(rows, P), 7)


@query("regime_score")
def regime_score(spark, folder):
    out = regime.regime_score(_features(spark, folder), P)
    return out.select(MMSI, us_col(), REGIME, REGIME_VAR, REGIME_MARKOV)


# ------------------------------------------------------------ vessel studies

@query("pilot_mixture")
def pilot_mixture(spark, folder):
    return bayes.pilot_mixture(bayes.pilot_rows(_features(spark, folder), P), P)


@query("eligible_vessels", with_ctes(*FEATURES) + """
select MMSI, count(*) as n_rows from feats group by MMSI having count(*) >= 40 order by md5('42-' || MMSI), MMSI limit 6""")
def eligible_vessels(spark, folder):
    return bayes.eligible_vessels(_features(spark, folder), P, 6)


def _given_fits(spark, folder):
    return _fixed(bayes.eligible_vessels(_features(spark, folder), P).select(MMSI))


GIVEN_SQL = "elig as (select MMSI, count(*) as n_rows from feats group by MMSI having count(*) >= 40)"


@query("eb_priors", with_ctes(*FEATURES, GIVEN_SQL, _fixed_sql().replace("std_f", "elig"), """
s as (select count(*) as n, avg(mu_sospetto) as mm, stddev_samp(mu_sospetto) as sm, avg(gap) as mg, stddev_samp(gap) as sg,
  (avg(sigma_speed_0) + avg(sigma_speed_1)) / 2 as ms, (avg(sigma_turn_0) + avg(sigma_turn_1)) / 2 as mt from fx)""") + """
select n as n_pilot_vessels, round(mm, 8) as mean_mu_sospetto, round(sm, 8) as std_mu_sospetto, round(mg, 8) as mean_gap, round(sg, 8) as std_gap,
  round(ms, 8) as mean_sigma_speed, round(mt, 8) as mean_sigma_turn, round(greatest(sm, sg, ms, 0.3), 8) as sigma_prior_speed,
  round(greatest(mt, 0.3), 8) as sigma_prior_turn, 'two_stage_empirical_bayes' as method from s""")
def eb_priors(spark, folder):
    return rounded(bayes.eb_priors(_given_fits(spark, folder)), 8)


RESP_SQL = """
dens as (select MMSI,
  theta_0 * exp(-0.5 * ((x - mu_sospetto) / sigma_speed_0) ** 2) / (sigma_speed_0 * 2.5066282746310002)
    * exp(-0.5 * (v / sigma_turn_0) ** 2) / (sigma_turn_0 * 2.5066282746310002) as a,
  theta_1 * exp(-0.5 * ((x - mu_sospetto - gap) / sigma_speed_1) ** 2) / (sigma_speed_1 * 2.5066282746310002)
    * exp(-0.5 * (v / sigma_turn_1) ** 2) / (sigma_turn_1 * 2.5066282746310002) as b from fx where n >= 40)"""


@query("suspicion_score", with_ctes(*STD, _fixed_sql(), RESP_SQL) + """
select MMSI, round(avg(a / (a + b + 1e-12)), 7) as suspicion from dens group by MMSI""")
def suspicion_score(spark, folder):
    rows = bayes.pilot_rows(_features(spark, folder), P)
    return rounded(bayes.suspicion_score(rows, _given_fits(spark, folder), P), 7)


@query("prior_sensitivity")
def prior_sensitivity(spark, folder):
    return bayes.prior_sensitivity(bayes.pilot_rows(_features(spark, folder), P, P.n_pilot_vessels), P)


RANK_SQL = """
{n}a as (select {k} {a} as va, {b} as vb from {src} where {a} is not null and {b} is not null),
{n}b as (select *, rank() over ({p} order by va) + (count(*) over ({q} va) - 1) / 2.0::DOUBLE as ra,
  rank() over ({p} order by vb) + (count(*) over ({r} vb) - 1) / 2.0::DOUBLE as rb from {n}a)"""


def student_tail(rho: str, n: str) -> str:
    """Two-sided tail of Student's t with n - 2 degrees: Simpson's rule over the angle whose sine is the correlation."""
    angle = f"asin(abs({rho})) * i / 2000.0::DOUBLE"
    density = f"(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(cos({angle}), {n} - 3)"
    area = f"(select sum({density}) from range(2001) g(i)) * asin(abs({rho})) / 6000.0::DOUBLE"
    return f"greatest(0.0, 1 - 2 * exp(lgamma(({n} - 1) / 2.0::DOUBLE) - lgamma(({n} - 2) / 2.0::DOUBLE)) / sqrt(pi()) * {area})"


@query("spearman", with_ctes(PINGS, RANK_SQL.format(
    n="rk", k="", a="SOG", b="COG", src="pings", p="", q="partition by", r="partition by"), """
rho as (select count(*) as n, corr(ra, rb) as r from rkb)""") + f"""
select n as n_points, round(r, 7) as rho, round({student_tail('r', 'n')}, 6) as p_value from rho""")
def spearman(spark, folder):
    return rounded(bayes.spearman(inputs.event_pings(spark, folder), "SOG", "COG", P), 7, p_value=6)


@query("method_agreement", with_ctes(PINGS, RANK_SQL.format(
    n="rk", k="MMSI,", a="SOG", b="COG", src="pings", p="partition by MMSI", q="partition by MMSI,", r="partition by MMSI,"), """
rho as (select MMSI, count(*) as n_points, corr(ra, rb) as rho from rkb group by MMSI having count(*) >= 5)""") + f"""
select MMSI, n_points, round(rho, 7) as rho, round({student_tail('rho', 'n_points')}, 6) as p_value,
  case when rho > 0.85 then 'sufficient' else 'divergent' end as verdict from rho""")
def method_agreement(spark, folder):
    return rounded(bayes.method_agreement(inputs.event_pings(spark, folder), "SOG", "COG", P), 7, p_value=6)


@query("agreement_summary", with_ctes(PINGS, RANK_SQL.format(
    n="rk", k="MMSI,", a="SOG", b="COG", src="pings", p="partition by MMSI", q="partition by MMSI,", r="partition by MMSI,"), """
rho as (select MMSI, count(*) as n_points, corr(ra, rb) as rho from rkb group by MMSI having count(*) >= 5)""") + """
select count(*) as n_vessels, round(avg(rho), 7) as mean_rho, case when avg(rho) > 0.85 then 'sufficient' else 'divergent' end as verdict from rho""")
def agreement_summary(spark, folder):
    out = bayes.method_agreement(inputs.event_pings(spark, folder), "SOG", "COG", P)
    return rounded(bayes.agreement_summary(out, P), 7)


def _pilot(spark, folder):
    return bayes.pilot_rows(_features(spark, folder), P)


@query("posterior_draws")
def posterior_draws(spark, folder):
    return bayes.posterior_draws(_pilot(spark, folder), P)


@query("ppc_replicates")
def ppc_replicates(spark, folder):
    draws = _given_fits(spark, folder).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(4))))
    lengths = bayes.pilot_rows(_features(spark, folder), P).select(MMSI, "n").distinct()
    return bayes.ppc_replicates(draws, lengths, P)


PPC_SQL = """
ppcl as (select *, lag(v) over (partition by MMSI order by t) as pv, avg(v) over (partition by MMSI) as m from std_f where n >= 40),
ppc as (select MMSI, count(*) as n, avg(x) as mean_speed, stddev_pop(x) as std_speed,
  avg((v - m) * (pv - m)) / var_pop(v) as autocorr_turn_lag1, avg((abs(x) > 1.5)::INTEGER) as frac_extreme_speed from ppcl group by MMSI)"""


@query("ppc_stats", with_ctes(*STD, PPC_SQL) + """
select MMSI, n, round(mean_speed + 1, 7) as mean_speed, round(std_speed, 7) as std_speed, round(autocorr_turn_lag1, 7) as autocorr_turn_lag1,
  round(frac_extreme_speed, 7) as frac_extreme_speed from ppc""")
def ppc_stats(spark, folder):
    out = bayes.ppc_stats(bayes.pilot_rows(_features(spark, folder), P))
    # the mean of scaled values is zero up to rounding noise; one is added so that its sign cannot differ
    return rounded(out.withColumn("mean_speed", F.col("mean_speed") + 1), 7)


REP_SQL = """
rep as (select MMSI, d as draw, std_speed * (0.91 + d / 50.0) as std_speed, autocorr_turn_lag1 + (d - 7.5) / 100.0 as autocorr_turn_lag1,
  frac_extreme_speed + (d - 3.5) / 200.0 as frac_extreme_speed, d - 19.5 as mean_speed from ppc, range(20) t(d)),
pv as (select r.MMSI, avg((r.mean_speed >= o.mean_speed)::INTEGER) as p1, avg((r.std_speed >= o.std_speed)::INTEGER) as p2,
  avg((r.autocorr_turn_lag1 >= o.autocorr_turn_lag1)::INTEGER) as p3, avg((r.frac_extreme_speed >= o.frac_extreme_speed)::INTEGER) as p4
  from rep r join ppc o using (MMSI) group by 1),
pl as (select MMSI, 'mean_speed' as stat, p1 as p from pv union all select MMSI, 'std_speed', p2 from pv
  union all select MMSI, 'autocorr_turn_lag1', p3 from pv union all select MMSI, 'frac_extreme_speed', p4 from pv)"""


def _pvalues(spark, folder):
    observed = bayes.ppc_stats(bayes.pilot_rows(_features(spark, folder), P))
    d = F.col("draw")
    replicated = observed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumns({
        "std_speed": F.col("std_speed") * (0.91 + d / 50.0), "mean_speed": d - 19.5,
        "autocorr_turn_lag1": F.col("autocorr_turn_lag1") + (d - 7.5) / 100.0,
        "frac_extreme_speed": F.col("frac_extreme_speed") + (d - 3.5) / 200.0,
    })
    return bayes.ppc_pvalues(observed, replicated)


@query("ppc_pvalues", with_ctes(*STD, PPC_SQL, REP_SQL) + """
select MMSI, stat, round(p, 6) as p_value, p > 0.05 and p < 0.95 as inside from pl""")
def ppc_pvalues(spark, folder):
    return rounded(_pvalues(spark, folder))


@query("ppc_verdict", with_ctes(*STD, PPC_SQL, REP_SQL) + """
select count(distinct MMSI) as n_vessels, round(avg((p > 0.05 and p < 0.95)::INTEGER), 6) as frac_inside,
  avg((p > 0.05 and p < 0.95)::INTEGER) >= 0.75 as adequate from pl""")
def ppc_verdict(spark, folder):
    return rounded(bayes.ppc_verdict(_pvalues(spark, folder)))


@query("predictive_check")
def predictive_check(spark, folder):
    return bayes.predictive_check(_features(spark, folder), P)

"""Vessel-level mixtures: pilot fits, empirical priors, sensitivity, predictive checks.

Fits run for all keys at once. Keys whose row count was checked against a bound
are fitted inside tasks; longer ones take one map-side combined aggregate for
each iteration, so a long vessel is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from wakeline.functions.columns import clip, correlation_pvalue, hash_normal, hash_order, hash_uniform, next_uniform
from wakeline.functions.em import (
    SIGMA_FLOOR, START_SIGMA, START_TAU, THETA_FLOOR, Prior, centres, fit_windows, pilot_prior,
    quartile_start, scale,
)
from wakeline.functions.regimes import PARAMETERS, responsibility
from wakeline.operators.prefix import cumulative, order_statistics
from wakeline.operators.regime import SPEED, TURN, std_full
from wakeline.operators.slices import join_vessels
from wakeline.params import MMSI, Params
from wakeline.session import durable

PRIOR_COLUMNS = ("a0", "a1", "m", "s_m", "c", "s_g", "s_speed", "s_turn")
# Prior specifications of the sensitivity study (speed scale, turn scale).
SPECIFICATIONS = {"loose": (3.0, 6.0), "default": (1.0, 2.0), "tight": (0.3, 0.6)}
# Defaults of the pilot fit, fallback and floor of empirical priors.
PILOT_SCALES = (2.0, 3.0)
FALLBACK_SCALES = (1.0, 2.0)
SCALE_FLOOR = 0.3
# Statistics of the predictive check and its limits.
PPC_STATS = ("mean_speed", "std_speed", "autocorr_turn_lag1", "frac_extreme_speed")
EXTREME_SPEED = 1.5
PPC_LOW, PPC_HIGH, PPC_SHARE = 0.05, 0.95, 0.75
MIN_RANK_POINTS, MIN_AGREEMENT_POINTS = 3, 5
VARIANT_VALUES = 1_000_000  # values of one array of a block of variants


def eligible_vessels(df: DataFrame, p: Params, n: int | None = None) -> DataFrame:
    """(MMSI, n_rows): vessels with enough rows, a repeatable random choice of n."""
    out = df.groupBy(MMSI).agg(F.count(F.lit(1)).alias("n_rows")).filter(
        F.col("n_rows") >= p.min_vessel_rows
    )
    return out if n is None else out.orderBy(hash_order(p.seed, MMSI), MMSI).limit(n)


def pilot_rows(features: DataFrame, p: Params, n: int | None = None) -> DataFrame:
    """(MMSI, t, speed_std, turn_std) of eligible vessels, scaled by the whole vessel."""
    chosen = eligible_vessels(features, p, n).select(MMSI)
    if n is None:
        kept = join_vessels(features, chosen, p, "left_semi")
    else:
        kept = features.join(F.broadcast(chosen), MMSI, "left_semi")  # at most n rows
    rows = std_full(kept).filter(F.col("n") >= p.min_fit_rows)
    return rows.select(MMSI, "t", "n", SPEED, TURN)


# ------------------------------------------------------------------ MAP-EM

def _prior_columns(prior: Prior) -> list[Column]:
    return [F.lit(float(getattr(prior, c))).alias(c) for c in PRIOR_COLUMNS]


def start_table(rows: DataFrame, keys: Sequence[str], priors: Column, p: Params) -> DataFrame:
    """Start values and prior of every key: centres at the quartiles of speed."""
    quart = order_statistics(rows, SPEED, [0.25, 0.75], p, keys, "_q")
    base = rows.groupBy(*keys).agg(F.first(priors).alias("_p")).join(quart, list(keys))
    weight = F.col("_p.a0") / (F.col("_p.a0") + F.col("_p.a1"))
    return base.select(
        *keys, F.col("_q")[0].alias("mu_sospetto"), (F.col("_q")[1] - F.col("_q")[0]).alias("gap"),
        F.lit(START_SIGMA).alias("sigma_speed_0"), F.lit(START_SIGMA).alias("sigma_speed_1"),
        F.lit(START_TAU[0]).alias("sigma_turn_0"), F.lit(START_TAU[1]).alias("sigma_turn_1"),
        weight.alias("theta_0"), (1 - weight).alias("theta_1"),
        *[F.col(f"_p.{c}").alias(c) for c in PRIOR_COLUMNS],
    )


def _share(l0: Column, l1: Column) -> Column:
    top = F.greatest(l0, l1)
    return F.exp(l0 - top) / (F.exp(l0 - top) + F.exp(l1 - top))


def _kernel(x: Column, mu: Column, sd: str, theta: str) -> Column:
    z = (x - mu) / F.col(sd)
    return F.log(theta) - 0.5 * z * z - F.log(sd)


def _iterate(rows: DataFrame, params: DataFrame, keys: Sequence[str], small: bool, salts: int) -> DataFrame:
    x, y, w = F.col(SPEED), F.col(TURN), F.col("_w")
    mu0, mu1 = F.col("mu_sospetto"), F.col("mu_sospetto") + F.col("gap")
    if small:
        joined = rows.join(F.broadcast(params), list(keys))
    else:
        spread = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(spread, [*keys, "_salt"])
    joined = joined.withColumns({
        "_rx": _share(_kernel(x, mu0, "sigma_speed_0", "theta_0"), _kernel(x, mu1, "sigma_speed_1", "theta_1")),
        "_ry": _share(
            _kernel(y, F.lit(0.0), "sigma_turn_0", "theta_0"), _kernel(y, F.lit(0.0), "sigma_turn_1", "theta_1")
        ),
    })
    sums = []
    for k, (rx, ry) in enumerate(((F.col("_rx"), F.col("_ry")), (1 - F.col("_rx"), 1 - F.col("_ry")))):
        sums += [
            F.sum(w * rx).alias(f"sn_{k}"), F.sum(w * rx * x).alias(f"sa_{k}"),
            F.sum(w * rx * x * x).alias(f"sq_{k}"), F.sum(w * ry).alias(f"su_{k}"),
            F.sum(w * ry * y * y).alias(f"sv_{k}"),
        ]
    held = [F.max(c).alias(c) for c in (*PRIOR_COLUMNS, "sigma_speed_0", "sigma_speed_1")]
    s = joined.groupBy(*keys).agg(*sums, *held)
    c = F.col
    total = c("sn_0") + c("sn_1") + c("su_0") + c("su_1") + c("a0") + c("a1") - 2.0
    theta = F.least(
        F.greatest((c("sn_0") + c("su_0") + c("a0") - 1.0) / total, F.lit(THETA_FLOOR)), F.lit(1 - THETA_FLOOR)
    )
    mu, gap = centres(
        c("sn_0"), c("sn_1"), c("sa_0"), c("sa_1"), c("sigma_speed_0"), c("sigma_speed_1"),
        c("m"), c("s_m"), c("c"), c("s_g"), lambda q, a, b: F.when(q, a).otherwise(b),
    )
    s = s.withColumns({"mu_sospetto": mu, "gap": gap, "theta_0": theta, "theta_1": 1 - theta})

    def floor(value):
        return F.greatest(value, F.lit(SIGMA_FLOOR))

    scales = {}
    for k, centre in enumerate((mu0, mu1)):
        square = F.greatest(
            c(f"sq_{k}") - 2 * centre * c(f"sa_{k}") + centre * centre * c(f"sn_{k}"), F.lit(0.0)
        )
        scales[f"sigma_speed_{k}"] = floor(scale(c(f"sn_{k}"), square, c("s_speed"), F.sqrt))
        scales[f"sigma_turn_{k}"] = floor(scale(c(f"su_{k}"), c(f"sv_{k}"), c("s_turn"), F.sqrt))
    return s.withColumns(scales).select(*keys, *PARAMETERS, *PRIOR_COLUMNS)


def _fit_distributed(rows: DataFrame, keys: Sequence[str], p: Params) -> DataFrame:
    """Keys of any length: one aggregate for each iteration, only sums leave a task.

    The parameter table is broadcast only after its row count was checked;
    otherwise rows and parameters meet on (key, salt). Lineage is cut every few
    iterations through the reliable checkpoint folder.
    """
    salt = F.pmod(F.xxhash64(SPEED, TURN, "t"), F.lit(p.salts)).cast("int").alias("_salt")
    laid = durable(rows.select("*", salt))
    params = durable(start_table(laid, keys, F.col("_prior"), p))
    small = params.count() <= p.broadcast_rows
    laid = laid.drop("_prior")
    if not small:
        laid = durable(laid.repartition(*keys, "_salt"))
    for i in range(1, p.em_iterations + 1):
        params = _iterate(laid, params, keys, small, p.salts)
        if i % p.em_checkpoint_every == 0 or i == p.em_iterations:
            params = durable(params)
    return params.select(*keys, *PARAMETERS)


def _fit_in_groups(rows: DataFrame, keys: Sequence[str], p: Params) -> DataFrame:
    """Keys of at most ``group_rows`` rows: every fit runs where its rows are, in one pass."""
    iterations, columns = p.em_iterations, list(keys)

    def fit(table):
        first = table.slice(0, 1).to_pylist()[0]
        x, y, w = (table[c].to_numpy()[None, :] for c in (SPEED, TURN, "_w"))
        values = fit_windows(x, y, Prior(**first["_prior"]), iterations, w, quartile_start(x))[0]
        out = {c: [first[c]] for c in columns} | {c: [float(v)] for c, v in zip(PARAMETERS, values)}
        return pa.table(out, schema=arrow_schema)

    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField(c, T.DoubleType()) for c in PARAMETERS])
    arrow_schema = to_arrow_schema(schema)
    return rows.groupBy(*columns).applyInArrow(fit, schema)


def fit_mixture(
    rows: DataFrame, keys: Sequence[str], p: Params, prior: Prior | None = None,
    priors: Column | None = None, weight: Column | None = None,
) -> DataFrame:
    """Fit one mixture for each key. ``priors`` is a struct column when they differ by key.

    The size of every key is counted first. Keys within ``group_rows`` are
    fitted inside a task; longer ones go through distributed iterations with the
    same formulas, so no key is ever gathered beyond that bound.
    """
    keys = list(keys)
    laid = rows.select(
        *keys, "t", SPEED, TURN, (weight if weight is not None else F.lit(1.0)).alias("_w"),
        (priors if priors is not None else F.struct(*_prior_columns(prior))).alias("_prior"),
    )
    long = laid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > p.group_rows).select(*keys)
    if long.limit(1).count() == 0:
        return _fit_in_groups(laid, keys, p)
    long = durable(long)
    few = laid.join(long, keys, "left_anti")
    return _fit_in_groups(few, keys, p).unionByName(
        _fit_distributed(laid.join(long, keys, "left_semi"), keys, p)
    )


def pilot_mixture(
    rows: DataFrame, p: Params, sigma_speed: float = PILOT_SCALES[0], sigma_turn: float = PILOT_SCALES[1]
) -> DataFrame:
    """One fit for each vessel over its whole series."""
    return fit_mixture(rows, [MMSI], p, pilot_prior(sigma_speed, sigma_turn))


# --------------------------------------------------------------- use of fits

def eb_priors(fits: DataFrame) -> DataFrame:
    """Scales of the regime priors from pilot fits; defaults when there is no fit."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    speed = (F.avg("sigma_speed_0") + F.avg("sigma_speed_1")) / 2
    turn = (F.avg("sigma_turn_0") + F.avg("sigma_turn_1")) / 2
    out = fits.agg(
        F.count(F.lit(1)).alias("n_pilot_vessels"),
        F.avg("mu_sospetto").alias("mean_mu_sospetto"), sd("mu_sospetto").alias("std_mu_sospetto"),
        F.avg("gap").alias("mean_gap"), sd("gap").alias("std_gap"),
        speed.alias("mean_sigma_speed"), turn.alias("mean_sigma_turn"),
    )
    none = F.col("n_pilot_vessels") == 0
    return out.withColumns({
        "sigma_prior_speed": F.when(none, FALLBACK_SCALES[0]).otherwise(
            F.greatest("std_mu_sospetto", "std_gap", "mean_sigma_speed", F.lit(SCALE_FLOOR))
        ),
        "sigma_prior_turn": F.when(none, FALLBACK_SCALES[1]).otherwise(
            F.greatest("mean_sigma_turn", F.lit(SCALE_FLOOR))
        ),
        "method": F.when(none, "fallback_default").otherwise("two_stage_empirical_bayes"),
    })


def suspicion_score(rows: DataFrame, fits: DataFrame, p: Params, keys: Sequence[str] = (MMSI,)) -> DataFrame:
    """Mean responsibility of the suspicious component for each key."""
    keys = list(keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(SPEED, TURN, "t"), F.lit(p.salts)).cast("int"))
    spread = fits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return salted.join(spread, [*keys, "_salt"]).groupBy(*keys).agg(
        F.avg(responsibility(SPEED, TURN)).alias("suspicion")
    )


def average_ranks(df: DataFrame, value: str, p: Params, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, rank): ties share their mean rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = cumulative(counts, value, ["cnt"], p, keys)
    return ranked.select(
        *keys, value, (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias("rank")
    )


def spearman(
    df: DataFrame, a: str, b: str, p: Params, keys: Sequence[str] = (), minimum: int = MIN_RANK_POINTS
) -> DataFrame:
    """Rank correlation of two columns, and its two-sided p-value, for each key with enough points.

    Equal (a, b) pairs are merged before the ranks are joined.
    """
    keys = list(keys)
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(
        F.count(F.lit(1)).alias("w")
    )
    plain = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = pairs.join(
        average_ranks(plain, a, p, keys).withColumnRenamed("rank", "_ra"), [*keys, a]
    ).join(average_ranks(plain, b, p, keys).withColumnRenamed("rank", "_rb"), [*keys, b])
    w, ra, rb = F.col("w"), F.col("_ra"), F.col("_rb")
    s = ranked.groupBy(*keys).agg(
        F.sum("w").alias("n_points"), F.sum(w * ra).alias("sa"), F.sum(w * rb).alias("sb"),
        F.sum(w * ra * ra).alias("saa"), F.sum(w * rb * rb).alias("sbb"), F.sum(w * ra * rb).alias("sab"),
    )
    n = F.col("n_points")
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    rho = F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / n, F.sqrt(va * vb))
    found = s.select(*keys, "n_points", clip(rho, -1.0, 1.0).alias("rho")).filter(n >= minimum)
    return found.withColumn("p_value", correlation_pvalue("rho", "n_points"))


def fit_variants(
    rows: DataFrame, p: Params, name: str, labels: Sequence, priors: Sequence[Prior], seed: int | None = None
) -> DataFrame:
    """(name, MMSI, parameters): one fit of each vessel for each variant, without multiplying rows.

    A variant is a prior and, where a seed is given, random weights of the rows. All
    variants of a vessel are fitted where its rows are, by EM on arrays with one row for
    each variant, in blocks of bounded size. Vessels beyond ``group_rows`` rows take the
    distributed iterations of ``fit_mixture``, each variant as a key.
    """
    labels, iterations = list(labels), p.em_iterations
    kind = "int" if isinstance(labels[0], int) else "string"
    laid = rows.select(MMSI, "t", SPEED, TURN, F.xxhash64(F.lit(seed or 0), MMSI, "t").alias("_h"))
    long = laid.groupBy(MMSI).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > p.group_rows).select(MMSI)
    schema = to_arrow_schema(T.StructType(
        [T.StructField(name, T._parse_datatype_string(kind)), rows.schema[MMSI], *[T.StructField(c, T.DoubleType()) for c in PARAMETERS]]
    ))

    def fit(table):
        x, y = (table[c].to_numpy()[None, :] for c in (SPEED, TURN))
        low, gap = quartile_start(x)
        step, found = max(1, VARIANT_VALUES // x.shape[1]), []
        for at in range(0, len(labels), step):
            mine = labels[at : at + step]
            prior = Prior(*[np.array([getattr(q, c) for q in priors[at : at + step]]) for c in PRIOR_COLUMNS])
            w = None
            if seed is not None:
                w = -np.log(next_uniform(table["_h"].to_numpy(), np.array(mine)))
            wide = lambda v: np.repeat(v, len(mine), axis=0)
            found.append(fit_windows(wide(x), wide(y), prior, iterations, w, (wide(low), wide(gap))))
        values = np.concatenate(found)
        out = {name: labels, MMSI: [table[MMSI][0].as_py()] * len(labels)}
        return pa.table(out | {c: values[:, k] for k, c in enumerate(PARAMETERS)}, schema=schema)

    few = laid
    if long.limit(1).count():
        long = durable(long)
        few = laid.join(long, MMSI, "left_anti")
    fits = few.groupBy(MMSI).applyInArrow(fit, from_arrow_schema(schema))
    if few is laid:
        return fits
    options = F.array(*[F.struct(F.lit(v).alias("v"), F.struct(*_prior_columns(q)).alias("q")) for v, q in zip(labels, priors)])
    far = laid.join(long, MMSI, "left_semi").withColumn("_o", F.explode(options)).withColumn(name, F.col("_o.v"))
    weight = None if seed is None else -F.log(hash_uniform(seed, MMSI, "t", name))
    return fits.unionByName(fit_mixture(far, [name, MMSI], p, priors=F.col("_o.q"), weight=weight))


def prior_scores(rows: DataFrame, p: Params, specs: dict = SPECIFICATIONS) -> DataFrame:
    """(spec, MMSI, suspicion). Rows meet the fits of all specifications at once."""
    names = list(specs)
    fits = durable(fit_variants(rows, p, "spec", names, [pilot_prior(*specs[n]) for n in names]))
    wide = fits.groupBy(MMSI).agg(*[
        F.first(F.when(F.col("spec") == n, F.struct(*PARAMETERS)), ignorenulls=True).alias(f"_s{k}") for k, n in enumerate(names)
    ])
    means = [
        F.avg(responsibility(SPEED, TURN, lambda c, k=k: F.col(f"_s{k}.{c}"))).alias(f"_m{k}") for k, _ in enumerate(names)
    ]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(SPEED, TURN, "t"), F.lit(p.salts)).cast("int"))
    spread = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    scored = salted.join(spread, [MMSI, "_salt"]).groupBy(MMSI).agg(*means)
    each = F.array(*[F.struct(F.lit(n).alias("spec"), F.col(f"_m{k}").alias("suspicion")) for k, n in enumerate(names)])
    return scored.select(MMSI, F.explode(each).alias("_e")).select("_e.spec", MMSI, "_e.suspicion")


def prior_sensitivity(rows: DataFrame, p: Params, specs: dict = SPECIFICATIONS) -> DataFrame:
    """(spec_a, spec_b, n_points, rho, p_value, robust) for each pair of specifications."""
    scores = durable(prior_scores(rows, p, specs))
    wide = scores.groupBy(MMSI).pivot("spec", list(specs)).agg(F.first("suspicion")).dropna()
    names = list(specs)
    pairs = [
        F.struct(
            F.lit(a).alias("spec_a"), F.lit(b).alias("spec_b"), F.col(a).alias("a"), F.col(b).alias("b")
        )
        for i, a in enumerate(names) for b in names[i + 1:]
    ]
    long = wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    rho = spearman(long, "a", "b", p, ["spec_a", "spec_b"])
    # one row for each pair of specifications
    lowest = F.min("rho").over(Window.partitionBy(F.lit(0)))
    return rho.withColumn("robust", lowest > p.robust_rho)


def posterior_draws(rows: DataFrame, p: Params, sigma_speed: float = 1.0, sigma_turn: float = 2.0) -> DataFrame:
    """(MMSI, draw, parameters): Bayesian bootstrap, one weighted fit for each draw."""
    labels = list(range(p.n_draws))
    return fit_variants(rows, p, "draw", labels, [pilot_prior(sigma_speed, sigma_turn)] * len(labels), p.seed).select(
        MMSI, "draw", *PARAMETERS)


def ppc_replicates(draws: DataFrame, lengths: DataFrame, p: Params) -> DataFrame:
    """(MMSI, draw, t, speed_std, turn_std): one synthetic series for each draw."""
    rows = draws.join(lengths.select(MMSI, "n"), MMSI).withColumn(
        "t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    )
    ids = (MMSI, "draw", "t")
    calm = hash_uniform(p.seed + 11, *ids) < F.col("theta_1")
    speed = hash_normal(p.seed + 12, *ids)
    turn = hash_normal(p.seed + 13, *ids)
    mu1 = F.col("mu_sospetto") + F.col("gap")
    return rows.select(
        *ids,
        F.when(calm, mu1 + speed * F.col("sigma_speed_1"))
        .otherwise(F.col("mu_sospetto") + speed * F.col("sigma_speed_0")).alias(SPEED),
        F.when(calm, turn * F.col("sigma_turn_1")).otherwise(turn * F.col("sigma_turn_0")).alias(TURN),
    )


def ppc_stats(rows: DataFrame, keys: Sequence[str] = (MMSI,)) -> DataFrame:
    """Mean and std of speed, lag-1 autocorrelation of turn, share of extreme speed.

    The autocorrelation needs the mean; with the first and last value known it
    follows from plain sums, so one aggregate is enough.
    """
    keys = list(keys)
    prev = F.lag(TURN).over(Window.partitionBy(*keys).orderBy("t"))
    s = rows.withColumn("_prev", prev).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(SPEED).alias("mean_speed"), F.stddev_pop(SPEED).alias("std_speed"),
        F.avg((F.abs(SPEED) > EXTREME_SPEED).cast("double")).alias("frac_extreme_speed"),
        F.avg(TURN).alias("_m"), F.var_pop(TURN).alias("_c0"), F.sum(F.col(TURN) * F.col("_prev")).alias("_s11"),
        F.sum(TURN).alias("_s"), F.min_by(TURN, "t").alias("_y0"), F.max_by(TURN, "t").alias("_y1"),
    )
    n, m = F.col("n"), F.col("_m")
    pairs = F.col("_s11") - m * (2 * F.col("_s") - F.col("_y0") - F.col("_y1")) + (n - 1) * m * m
    auto = F.when((n < 2) | (F.col("_c0") < 1e-10), F.lit(0.0)).otherwise(
        F.try_divide(F.try_divide(pairs, n - 1), F.col("_c0"))
    )
    return s.select(*keys, "n", "mean_speed", "std_speed", auto.alias("autocorr_turn_lag1"), "frac_extreme_speed")


def _long(stats: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', `{c}`" for c in PPC_STATS)
    return stats.selectExpr(*keys, f"stack({len(PPC_STATS)}, {pairs}) as (stat, {value})")


def ppc_pvalues(observed: DataFrame, replicated: DataFrame) -> DataFrame:
    """(MMSI, stat, p_value, inside): share of replicates at or above the observed value."""
    obs = _long(observed, [MMSI], "seen")
    rep = _long(replicated, [MMSI, "draw"], "value")
    out = rep.join(obs, [MMSI, "stat"]).groupBy(MMSI, "stat").agg(
        F.avg((F.col("value") >= F.col("seen")).cast("double")).alias("p_value")
    )
    return out.withColumn("inside", (F.col("p_value") > PPC_LOW) & (F.col("p_value") < PPC_HIGH))


def ppc_verdict(pvalues: DataFrame) -> DataFrame:
    return pvalues.agg(
        F.count_distinct(MMSI).alias("n_vessels"),
        F.avg(F.col("inside").cast("double")).alias("frac_inside"),
    ).withColumn("adequate", F.col("frac_inside") >= PPC_SHARE)


def predictive_check(features: DataFrame, p: Params, n_vessels: int | None = None) -> DataFrame:
    """The whole check on all eligible vessels, or on a sample: fits, replicates, p-values."""
    rows = durable(pilot_rows(features, p, n_vessels))
    draws = posterior_draws(rows, p)
    lengths = rows.select(MMSI, "n").distinct()
    replicated = ppc_stats(ppc_replicates(draws, lengths, p), [MMSI, "draw"])
    return ppc_pvalues(ppc_stats(rows), replicated)


def method_agreement(df: DataFrame, a: str, b: str, p: Params) -> DataFrame:
    """Per vessel: rank agreement of two scores, its p-value and a verdict."""
    rho = spearman(df, a, b, p, [MMSI], MIN_AGREEMENT_POINTS)
    return rho.withColumn(
        "verdict", F.when(F.col("rho") > p.robust_rho, "sufficient").otherwise("divergent")
    )


def agreement_summary(agreement: DataFrame, p: Params) -> DataFrame:
    return agreement.agg(
        F.count(F.lit(1)).alias("n_vessels"), F.avg("rho").alias("mean_rho")
    ).withColumn("verdict", F.when(F.col("mean_rho") > p.robust_rho, "sufficient").otherwise("divergent"))

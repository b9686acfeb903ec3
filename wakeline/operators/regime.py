"""Rolling regime scores over the feature table.

The feature table is downsampled, so a vessel holds at most span / bin rows and
all windows here use the vessel key: the whole scorer runs behind one shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wakeline.functions.columns import micros
from wakeline.functions.em import causal_prior, fit_windows
from wakeline.functions.regimes import PARAMETERS, regime_probability
from wakeline.operators.markov import markov_filter
from wakeline.params import MMSI, REGIME, REGIME_MARKOV, REGIME_VAR, TIMESTAMP, Params
from wakeline.session import durable

SPEED, TURN = "speed_std", "turn_std"
# Fit rows of the scaler in windows and as a divisor, null share that fails a run.
SCALER_WINDOWS, SCALER_DIVISOR = 3, 3
MAX_NULL_SHARE = 0.5


class RegimeError(ValueError):
    """Scores are missing where they must exist."""


def _vessel():
    return Window.partitionBy(MMSI)


def _ordered():
    return Window.partitionBy(MMSI).orderBy("_us")


def numbered(features: DataFrame) -> DataFrame:
    """Rows with both inputs, their row number t from 0 and the vessel's row count."""
    return (
        features.dropna(subset=["speed_acc", "turn_rate"])
        .withColumn("_us", micros(TIMESTAMP))
        .withColumn("t", F.row_number().over(_ordered()).cast("bigint") - 1)
        .withColumn("n", F.count(F.lit(1)).over(_vessel()))
    )


def _scaled(rows: DataFrame, fit_row) -> DataFrame:
    cols = {}
    for raw, out in (("speed_acc", SPEED), ("turn_rate", TURN)):
        x = F.when(fit_row, F.col(raw))
        mean, sd = F.avg(x).over(_vessel()), F.stddev_pop(x).over(_vessel())
        cols[out] = (F.col(raw) - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return rows.withColumns(cols)


def std_causal(features: DataFrame, p: Params) -> DataFrame:
    """Scale by mean and population std of the vessel's first rows only."""
    rows = numbered(features)
    fit_end = F.least(F.lit(SCALER_WINDOWS * p.window), F.floor(F.col("n") / SCALER_DIVISOR))
    return _scaled(rows, F.col("t") < fit_end)


def std_full(features: DataFrame) -> DataFrame:
    """Scale by the whole vessel."""
    return _scaled(numbered(features), F.lit(True))


def refit_fixed(rows: DataFrame, p: Params) -> DataFrame:
    """Refit every update_freq rows after the warm-up, up to the hard cap."""
    due = (F.col("t") >= p.window) & (F.pmod(F.col("t") - p.window, F.lit(p.update_freq)) == 0)
    return _capped(rows.withColumn("_due", due), p)


def refit_adaptive(rows: DataFrame, p: Params) -> DataFrame:
    """Refit on a behaviour change, or update_freq rows after the last refit.

    A change always refits and thereby restarts the timer, and the first row
    after the warm-up always fits. So between two changes the timer fires at
    whole multiples of update_freq counted from the earlier one: the sequential
    rule is a "last change at or before t" window.
    """
    if p.adaptive_threshold is None:
        raise ValueError("adaptive_threshold is not set")
    change = F.abs(F.col(SPEED) - F.lag(SPEED).over(_ordered())) + F.abs(
        F.col(TURN) - F.lag(TURN).over(_ordered())
    )
    warm = F.col("t") >= p.window
    anchor_row = warm & ((F.col("t") == p.window) | F.coalesce(F.col("_change") > p.adaptive_threshold, F.lit(False)))
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_change", change).withColumn(
        "_anchor", F.last(F.when(anchor_row, F.col("t")), ignorenulls=True).over(upto)
    )
    due = F.coalesce(F.pmod(F.col("t") - F.col("_anchor"), F.lit(p.update_freq)) == 0, F.lit(False))
    return _capped(out.withColumn("_due", due).drop("_change", "_anchor"), p)


def _capped(rows: DataFrame, p: Params) -> DataFrame:
    """Fits are spent first come, first served; vessels too short to score get none."""
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    due = F.col("_due") & (F.col("n") > p.window)
    out = rows.withColumn("_due", due).withColumn(
        "fit_no", F.sum(F.when(F.col("_due"), 1).otherwise(0)).over(upto)
    )
    within = F.lit(True) if p.max_fits is None else F.col("fit_no") <= p.max_fits
    return out.withColumn("refit", F.col("_due") & within).drop("_due")


def refits(rows: DataFrame, p: Params) -> DataFrame:
    return refit_fixed(rows, p) if p.adaptive_threshold is None else refit_adaptive(rows, p)


def roll_windows(rows: DataFrame, p: Params) -> DataFrame:
    """On refit rows: the last ``window`` values of both inputs, this row included."""
    span = _ordered().rowsBetween(1 - p.window, 0)
    return rows.withColumn("_wx", F.collect_list(SPEED).over(span)).withColumn(
        "_wy", F.collect_list(TURN).over(span)
    ).withColumns({
        "window_speed": F.when(F.col("refit"), F.col("_wx")),
        "window_turn": F.when(F.col("refit"), F.col("_wy")),
    }).drop("_wx", "_wy")


def mixture_causal(rows: DataFrame, p: Params) -> DataFrame:
    """Add the parameters fitted on each refit window; other rows hold null.

    A window has a fixed number of values, so a whole Arrow batch of windows is
    fitted at once and rows without a window cost nothing.
    """
    prior, iterations = causal_prior(p.sigma_speed, p.sigma_turn), p.em_iterations
    schema = ", ".join(f"{c} double" for c in PARAMETERS)

    @F.pandas_udf(schema)
    def fit(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), len(PARAMETERS)), np.nan)
        has = x.notna().to_numpy()
        if has.any():
            out[has] = fit_windows(np.stack(x[has].tolist()), np.stack(y[has].tolist()), prior, iterations)
        return pd.DataFrame(out, columns=list(PARAMETERS))

    fitted = rows.withColumn("_fit", fit("window_speed", "window_turn"))
    return fitted.withColumns({
        c: F.when(F.col("refit"), F.col(f"_fit.{c}")) for c in PARAMETERS
    }).drop("_fit", "window_speed", "window_turn")


def score_refits(rows: DataFrame) -> DataFrame:
    """Posterior of the suspicious regime where parameters exist, with p (1 - p)."""
    prob = F.when(F.col("mu_sospetto").isNotNull(), regime_probability(SPEED, TURN))
    return rows.withColumn(REGIME, prob).withColumn(
        REGIME_VAR, F.col(REGIME) * (1 - F.col(REGIME))
    )


def carry_forward(rows: DataFrame) -> DataFrame:
    """Between refits the last probability and variance hold."""
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({
        c: F.last(c, ignorenulls=True).over(upto) for c in (REGIME, REGIME_VAR)
    })


def null_share(scored: DataFrame, p: Params) -> DataFrame:
    """Per vessel long enough to score: share of null scores after the warm-up."""
    late = F.col("t") >= p.window
    return scored.filter(F.col("n") > p.window).groupBy(MMSI).agg(
        F.count_if(late).alias("n_late"),
        F.count_if(late & F.col(REGIME).isNull()).alias("n_null"),
    ).withColumn("null_share", F.try_divide(F.col("n_null").cast("double"), F.col("n_late")))


def null_gate(scored: DataFrame, p: Params) -> DataFrame:
    """Return the table, or raise for a vessel that is mostly null."""
    bad = null_share(scored, p).filter(F.col("null_share") >= MAX_NULL_SHARE).first()
    if bad is not None:
        raise RegimeError(f"vessel {bad[MMSI]}: {bad.null_share:.1%} of scores are null")
    return scored


def score_table(features: DataFrame, p: Params) -> DataFrame:
    """Feature rows with t, n and both regime columns, before the chain filter."""
    rows = mixture_causal(roll_windows(refits(std_causal(features, p), p), p), p)
    return carry_forward(score_refits(rows)).select(*features.columns, "t", "n", REGIME, REGIME_VAR)


def regime_score(features: DataFrame, p: Params, apply_markov: bool = True, gate: bool = True) -> DataFrame:
    """Feature table plus regime probability, uncertainty and filtered probability.

    The gate stores the scores and raises where a vessel long enough to score is mostly null.
    """
    scored = score_table(features, p)
    scored = (null_gate(durable(scored), p) if gate else scored).drop("t", "n")
    if not apply_markov:
        return scored
    return markov_filter(scored, p, REGIME, REGIME_MARKOV, bounded=True)

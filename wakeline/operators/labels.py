"""Gap labels and label diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wakeline.functions.columns import MINUTE_US, micros
from wakeline.operators.ranges import placed
from wakeline.operators.series import gap_to_next
from wakeline.operators.slices import next_time, track_ranges, without_layout
from wakeline.params import MMSI, TARGET, Params

# Thresholds in hours and the accepted positive-rate range of a relabelling.
SWEEP_HOURS = (6.0, 12.0, 18.0, 24.0)
SWEEP_MIN_RATE, SWEEP_MAX_RATE = 0.001, 0.5


def label_last_ping(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    """1 iff the next gap lies in [gap, gap + horizon]; each vessel's last row is dropped."""
    gap = F.col("gap_to_next_h")
    hit = gap.between(p.gap_hours, p.gap_hours + p.horizon_hours)
    return (
        gap_to_next(df, p, bounded)
        .filter(gap.isNotNull())
        .withColumn(TARGET, hit.cast("int"))
        .drop("gap_to_next_h")
    )


def mark_last_ping(df: DataFrame, p: Params, name: str = "is_last_ping", bounded: bool = False) -> DataFrame:
    """True iff the row is followed by a gap at or above the threshold."""
    return gap_to_next(df, p, bounded).withColumn(
        name, F.coalesce(F.col("gap_to_next_h") >= p.gap_hours, F.lit(False))
    ).drop("gap_to_next_h")


def label_sliding(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    """1 iff a last ping before a gap lies in (t, t + horizon].

    The last row of a vessel stays with label 0: what follows it is unknown.
    """
    rows = df
    if not bounded:  # both steps share one layout
        cut, parts = track_ranges(df, p)
        bounded = parts == 1
        rows = df if bounded else placed(cut, parts)
    marked = mark_last_ping(rows, p, "_is_last", bounded)
    ahead = next_time(marked, p, F.col("_is_last"), "_next_last", bounded)
    limit = int(p.label_horizon_minutes * MINUTE_US)
    hit = F.coalesce(F.col("_next_last") <= micros() + limit, F.lit(False))
    return without_layout(ahead.withColumn(TARGET, hit.cast("int")).drop("_is_last", "_next_last"))


def label(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    """The labelling named in the parameters, whatever the source of the rows."""
    strategies = {"sliding_window": label_sliding, "last_ping": label_last_ping}
    if p.labeling not in strategies:
        raise ValueError(f"unknown labeling {p.labeling!r}; expected one of {sorted(strategies)}")
    return strategies[p.labeling](df, p, bounded)


def target_rate(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Positives, rows, rate in percent and a warning outside [0.1 %, 10 %]."""
    rate = F.try_divide(F.col("positives") * 100.0, F.col("n_rows"))
    return df.agg(
        F.sum(F.col(target).cast("bigint")).alias("positives"), F.count(target).alias("n_rows")
    ).select(
        "positives", "n_rows", rate.alias("rate_pct"),
        F.when(rate < 0.1, "very rare").when(rate > 10, "frequent").otherwise("ok").alias("note"),
    )


def label_sanity(labelled: DataFrame, n_gaps, p: Params) -> DataFrame:
    """Observed positives against gaps x bins in the horizon. ``n_gaps`` is a number or scalar column."""
    per_gap = max(1, int(p.label_horizon_minutes / p.bin_minutes))
    per_vessel = labelled.groupBy(MMSI).agg(
        F.count_if(F.col(TARGET) == 1).alias("pos"), F.count_if(F.col(TARGET) == 0).alias("neg")
    )
    gaps = n_gaps if not isinstance(n_gaps, int) else F.lit(n_gaps)
    return per_vessel.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.count_if(F.col("pos") > 0).alias("n_vessels_with_positive"),
    ).select(
        "positives", "negatives",
        F.try_divide(F.col("positives"), F.col("positives") + F.col("negatives")).alias("prevalence"),
        "n_vessels_with_positive",
        (gaps * per_gap).alias("expected_positives"),
        F.try_divide(F.col("positives"), gaps * per_gap).alias("observed_over_expected"),
    )


def target_verdict(sanity: DataFrame, n_gaps_filtered) -> DataFrame:
    """DATA-LIMITED below 50 gaps, LABELING-BUG when positives are missing, else OK."""
    gaps = n_gaps_filtered if not isinstance(n_gaps_filtered, int) else F.lit(n_gaps_filtered)
    verdict = (
        F.when(gaps < 50, "DATA-LIMITED")
        .when((gaps >= 200) & (F.col("positives") < 0.1 * F.col("expected_positives")), "LABELING-BUG")
        .otherwise("OK")
    )
    return sanity.select(
        gaps.alias("n_gaps_filtered"), "positives", "expected_positives", verdict.alias("verdict")
    )


def threshold_column(hours: float) -> str:
    return f"target_{hours:g}h"


def multi_threshold_labels(
    df: DataFrame, p: Params, thresholds: Sequence[float] = SWEEP_HOURS, bounded: bool = False
) -> DataFrame:
    """Last-ping labels for several thresholds from one pass over the gaps."""
    gap = F.col("gap_to_next_h")
    return (
        gap_to_next(df, p, bounded).filter(gap.isNotNull())
        .withColumns({
            threshold_column(h): gap.between(h, h + p.horizon_hours).cast("int") for h in thresholds
        })
        .drop("gap_to_next_h")
    )


def threshold_rates(labelled: DataFrame, thresholds: Sequence[float] = SWEEP_HOURS) -> DataFrame:
    """One row for each threshold: positive rate and whether it is usable."""
    one = labelled.agg(
        *[F.sum(threshold_column(h)).alias(f"s{i}") for i, h in enumerate(thresholds)],
        F.count(F.lit(1)).alias("n_rows"),
    )
    pairs = ", ".join(f"{float(h)}D, s{i}" for i, h in enumerate(thresholds))
    long = one.selectExpr("n_rows", f"stack({len(thresholds)}, {pairs}) as (gap_hours, positives)")
    rate = F.try_divide(F.col("positives"), F.col("n_rows"))
    return long.select(
        "gap_hours", "positives", rate.alias("pos_rate"),
        rate.between(SWEEP_MIN_RATE, SWEEP_MAX_RATE).alias("usable"),
    )

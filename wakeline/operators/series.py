"""Time-series operators over vessel tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wakeline.functions.columns import (
    GAP_BUCKETS, HOUR_US, MINUTE_US, bin_start, clip, gap_bucket, micros, risk_hex, row_order,
    safe_ratio, wrap_course,
)
from wakeline.operators.clean import bbox_filter, inside_box
from wakeline.operators.slices import neighbours, positions
from wakeline.params import KINEMATICS, MEASURES, MMSI, REGIME, TIMESTAMP, Params

# Clip limits of acceleration and turn rate.
ACC_LIMIT, TURN_LIMIT = 15.0, 180.0


def downsample_last(
    df: DataFrame, p: Params, cols: Sequence[str] = MEASURES, first_of_equal: bool = False
) -> DataFrame:
    """Last non-null value of every column for each vessel and fixed bin.

    One hash aggregate with map-side combine: time and input order are one exact decimal,
    so raw rows are neither sorted nor shuffled and a hot bin is combined before the
    exchange. Bins are counted from the epoch, which equals counting from
    midnight as the width divides a day. ``bin_label='end'`` stamps a row with a
    time no earlier than its data.

    ``first_of_equal`` takes the first of rows with the same time stamp. On rows
    whose columns are all present that equals ``dedup_first`` before this step,
    without shuffling every raw row once more.
    """
    us = micros(TIMESTAMP)
    start = bin_start(us, p.bin_us)
    stamp = start if p.bin_label == "start" else start + p.bin_us
    ordered = p.seq_col in df.columns
    if not ordered and first_of_equal:
        # no input order: the largest of equal rows, as dedup_first does
        return df.groupBy(MMSI, stamp.alias("_bin")).agg(
            F.max(F.struct(us.alias("_order"), *[c for c in df.columns if c in cols])).alias("_row")
        ).select(
            MMSI, F.timestamp_micros("_bin").alias(TIMESTAMP),
            *[F.col(f"_row.{c}").alias(c) for c in cols],
        )
    order = row_order(us, p.seq_col, first_of_equal) if ordered else us
    work = df.select(MMSI, stamp.alias("_bin"), order.alias("_order"), *cols)
    return (
        work.groupBy(MMSI, "_bin")
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in cols])
        .dropna(subset=[c for c in MEASURES if c in cols])
        .select(MMSI, F.timestamp_micros("_bin").alias(TIMESTAMP), *cols)
    )


def time_diff_min(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    out = neighbours(df.withColumn("_t", micros()), p, prev={"_prev_t": "_t"}, bounded=bounded)
    minutes = (F.col("_t") - F.col("_prev_t")) / float(MINUTE_US)
    return out.withColumn("time_diff_min", minutes).drop("_t", "_prev_t")


def kinematic_features(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    """Features that look backwards only; a vessel's first row gets zeros."""
    out = neighbours(
        df.withColumn("_t", micros()), p,
        prev={"_prev_t": "_t", "_prev_sog": "SOG", "_prev_cog": "COG"}, bounded=bounded,
    )
    hours = (F.col("_t") - F.col("_prev_t")) / float(HOUR_US)
    out = out.withColumns({
        "dt_prev_hours": hours,
        "delta_SOG": F.col("SOG") - F.col("_prev_sog"),
        "delta_COG": wrap_course(F.col("COG") - F.col("_prev_cog")),
    })
    out = out.withColumns({
        "speed_acc": clip(safe_ratio("delta_SOG", "dt_prev_hours"), -ACC_LIMIT, ACC_LIMIT),
        "turn_rate": clip(safe_ratio("delta_COG", "dt_prev_hours"), -TURN_LIMIT, TURN_LIMIT),
    })
    return out.fillna(0.0, subset=list(KINEMATICS)).drop("_t", "_prev_t", "_prev_sog", "_prev_cog")


def gap_to_next(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    out = neighbours(df.withColumn("_t", micros()), p, nxt={"_next_t": "_t"}, bounded=bounded)
    hours = (F.col("_next_t") - F.col("_t")) / float(HOUR_US)
    return out.withColumn("gap_to_next_h", hours).drop("_t", "_next_t")


def gap_from_prev(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    """Vessel and gap only; every gap report starts from this narrow table."""
    out = time_diff_min(df.select(MMSI, TIMESTAMP), p, bounded)
    return out.select(MMSI, (F.col("time_diff_min") / 60.0).alias("gap_h"))


def gap_counts(df: DataFrame, p: Params) -> DataFrame:
    """Per vessel: gaps at or above the threshold."""
    return gap_from_prev(df, p).groupBy(MMSI).agg(
        F.count_if(F.col("gap_h") >= p.gap_hours).alias("n_gaps")
    )


def gap_events(df: DataFrame, p: Params) -> DataFrame:
    return gap_counts(df, p).agg(
        F.sum("n_gaps").alias("n_gaps_ge_threshold"),
        F.count_if(F.col("n_gaps") > 0).alias("n_vessels_with_gap"),
    )


def gap_histogram(df: DataFrame, p: Params) -> DataFrame:
    """Eight fixed buckets; empty ones stay with a zero."""
    tagged = gap_from_prev(df, p).select(gap_bucket("gap_h").alias("b"))
    one = tagged.agg(
        *[F.count_if(F.col("b") == name).alias(f"c{i}") for i, (name, _, _) in enumerate(GAP_BUCKETS)]
    )
    pairs = ", ".join(f"'{name}', c{i}" for i, (name, _, _) in enumerate(GAP_BUCKETS))
    return one.selectExpr(f"stack({len(GAP_BUCKETS)}, {pairs}) as (bucket, n_gaps)")


def top_gap_vessels(df: DataFrame, p: Params, k: int = 10) -> DataFrame:
    return gap_counts(df, p).orderBy(F.desc("n_gaps"), MMSI).limit(k)


def inventory_stats(df: DataFrame) -> DataFrame:
    """Vessel rows are combined before the distinct count, so one pass is enough."""
    per_vessel = df.groupBy(MMSI).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(micros()).alias("t0"), F.max(micros()).alias("t1"),
        *[f(c).alias(f"{c}_{n}") for c in ("Lat", "Lon") for f, n in ((F.min, "min"), (F.max, "max"))],
    )
    return per_vessel.agg(
        F.sum("n").alias("n_pings"),
        F.count(F.lit(1)).alias("n_unique_mmsi"),
        F.min("t0").alias("ts_min_us"), F.max("t1").alias("ts_max_us"),
        F.min("Lat_min").alias("lat_min"), F.max("Lat_max").alias("lat_max"),
        F.min("Lon_min").alias("lon_min"), F.max("Lon_max").alias("lon_max"),
    )


def geo_filter_impact(df: DataFrame, p: Params) -> DataFrame:
    """Rows before and after the box, kept share, gaps among the kept rows."""
    kept = df.agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(inside_box(p)).alias("n_after")
    )
    gaps = gap_events(bbox_filter(df, p), p)
    return kept.select(
        "n_before", "n_after",
        (F.col("n_after") / F.greatest(F.col("n_before"), F.lit(1))).alias("frac_kept"),
        gaps.select("n_gaps_ge_threshold").scalar().alias("n_gaps_after"),
        gaps.select("n_vessels_with_gap").scalar().alias("n_vessels_with_gap_after"),
    )


def last_position(df: DataFrame, p: Params, score: str | None = REGIME) -> DataFrame:
    """Last known value of each column for each vessel; map-side combined."""
    cols = [c for c in df.columns if c not in (MMSI, TIMESTAMP, p.seq_col)]
    at = micros()
    order = row_order(at, p.seq_col) if p.seq_col in df.columns else at
    need = [c for c in ("Lat", "Lon", score) if c]
    return (
        df.groupBy(MMSI)
        .agg(
            F.max(TIMESTAMP).alias(TIMESTAMP),
            *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols],
        )
        .dropna(subset=need)
    )


def trajectory_points(df: DataFrame, p: Params) -> DataFrame:
    """Ordered path of each vessel as numbered points."""
    out = positions(df.dropna(subset=["Lat", "Lon"]), p, rn="seq", n="n_points")
    return out.select(MMSI, "seq", "n_points", micros().alias("us"), "Lon", "Lat")


def trajectories(df: DataFrame, p: Params) -> DataFrame:
    """The same paths as arrays of at most ``path_points`` points, numbered by ``part``.

    A whole path in one array would gather an unbounded group; parts join end
    to end in the order of ``part``.
    """
    part = F.floor((F.col("seq") - 1) / p.path_points).cast("bigint").alias("part")
    return (
        trajectory_points(df, p).groupBy(MMSI, part)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "us", "Lon", "Lat"))).alias("path"))
        .withColumn("n_points", F.size("path"))
    )


def map_markers(
    df: DataFrame, score: str = REGIME, low: str | None = None, high: str | None = None
) -> DataFrame:
    """Radius, marker size and colour of a score; interval size where bounds exist."""
    s = F.col(score)
    out = df.withColumns({
        "marker_radius": 5 + s * 10, "marker_size": 80 + s * 240, "marker_color": risk_hex(s),
    })
    if low and high:
        out = out.withColumn("interval_size", (F.col(high) - F.col(low)) * 30 + 8)
    return out

"""Cleaning, gating and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wakeline.functions.columns import finite
from wakeline.operators.slices import join_vessels
from wakeline.params import FEATURES_FULL, MEASURES, MMSI, TARGET, TIMESTAMP, Params

# Accepted spellings of the identifier and the time column.
ID_ALIASES = ("MMSI", "mmsi", "Mmsi")
TIME_ALIASES = ("Timestamp", "timestamp", "BaseDateTime", "time")


class QualityError(ValueError):
    """The table breaks a rule that later steps rely on."""


def _parsed_id(c: str) -> Column:
    return F.col(c).try_cast("string").try_cast("double").try_cast("bigint")


def normalise_mmsi(df: DataFrame) -> DataFrame:
    """Rename ``mmsi``, cast to bigint and drop rows that do not parse."""
    if MMSI not in df.columns and "mmsi" in df.columns:
        df = df.withColumnRenamed("mmsi", MMSI)
    if MMSI not in df.columns:
        return df
    if df.schema[MMSI].dataType != T.LongType():
        df = df.withColumn(MMSI, _parsed_id(MMSI))
    return df.filter(F.col(MMSI).isNotNull())


def count_bad_mmsi(df: DataFrame) -> DataFrame:
    """One row: rows in, rows dropped by ``normalise_mmsi``."""
    name = MMSI if MMSI in df.columns else "mmsi"
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(_parsed_id(name).isNull()).alias("n_dropped"),
    )


def alias_names(columns: Sequence[str]) -> dict[str, str]:
    """Column to rename -> MMSI or Timestamp, by the first accepted spelling."""
    names = {}
    for wanted, aliases in ((MMSI, ID_ALIASES), (TIMESTAMP, TIME_ALIASES)):
        found = next((a for a in aliases if a in columns), None)
        if found is None:
            raise KeyError(f"no {wanted} column among {list(columns)}")
        names[found] = wanted
    return names


def alias_columns(df: DataFrame) -> DataFrame:
    """Rename the first accepted id and time spelling to MMSI and Timestamp."""
    return df.withColumnsRenamed(alias_names(df.columns))


def inside_box(p: Params) -> Column:
    return F.col("Lat").between(p.min_lat, p.max_lat) & F.col("Lon").between(p.min_lon, p.max_lon)


def bbox_filter(df: DataFrame, p: Params) -> DataFrame:
    return df.filter(inside_box(p))


def in_range(p: Params) -> Column:
    return F.col("SOG").between(p.min_sog, p.max_sog) & F.col("COG").between(0.0, 360.0)


def range_filter(df: DataFrame, p: Params) -> DataFrame:
    """Spark sorts NaN above every number; both bounds are closed, so NaN fails the upper one."""
    return df.filter(in_range(p))


def drop_nonfinite(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols}).dropna(subset=list(cols))


def dedup_first(df: DataFrame, p: Params) -> DataFrame:
    """One row for each (vessel, time): the first in input order.

    An aggregate with map-side combine, so a vessel that repeats one time
    stamp a billion times collapses before the shuffle. With an input order
    column each value is picked on its own bigint order, which keeps the
    aggregate hash based. Without one the largest row wins, which at least
    repeats.
    """
    rest = [c for c in df.columns if c not in (MMSI, TIMESTAMP)]
    keyed = df.groupBy(MMSI, TIMESTAMP)
    if p.seq_col in rest:
        return keyed.agg(*[F.min_by(c, p.seq_col).alias(c) for c in rest]).select(*df.columns)
    picked = keyed.agg(F.max(F.struct(*rest)).alias("_row"))
    return picked.select(
        *[c if c in (MMSI, TIMESTAMP) else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def clean_pings(df: DataFrame, p: Params) -> DataFrame:
    """Range rules, first of duplicates, finite measures."""
    ranged = range_filter(df.withColumns({c: finite(c) for c in ("SOG", "COG")}), p)
    return drop_nonfinite(dedup_first(ranged, p))


def clean_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, after and removed, with the removed share."""
    n0 = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    return after.agg(F.count(F.lit(1)).alias("n_after")).select(
        n0.alias("n_before"),
        "n_after",
        (n0 - F.col("n_after")).alias("n_removed"),
        F.try_divide(n0 - F.col("n_after"), n0).alias("removed_share"),
    )


def quality_counts(df: DataFrame) -> DataFrame:
    """One row: rows, rows whose (vessel, time) is repeated, rows without a target.

    Grouping by the key first keeps the count exact without a global distinct.
    """
    keyed = df.groupBy(MMSI, TIMESTAMP).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col(TARGET).isNull()).alias("nulls")
    )
    return keyed.agg(
        F.sum("c").alias("n_rows"),
        F.sum(F.col("c") - 1).alias("n_duplicate_keys"),
        F.sum("nulls").alias("n_null_targets"),
    )


def quality_gate(df: DataFrame) -> DataFrame:
    """Return the table unchanged, or raise."""
    row = quality_counts(df).first()
    if row.n_duplicate_keys or row.n_null_targets:
        raise QualityError(
            f"{row.n_duplicate_keys} duplicate keys, {row.n_null_targets} null targets"
        )
    return df


def model_rows(df: DataFrame, features: Sequence[str] = FEATURES_FULL, label: str = TARGET) -> DataFrame:
    """Rows with a label and every feature; vessel and time stay with the row."""
    meta = [c for c in (MMSI, TIMESTAMP) if c in df.columns]
    return df.dropna(subset=[label, *features]).select(*meta, *features, label)


def id_type_check(df: DataFrame, id_col: str = MMSI) -> DataFrame:
    """One row on the identifier's type and whether its values are whole numbers."""
    dtype = df.schema[id_col].dataType.simpleString()
    as_double = F.col(id_col).try_cast("string").try_cast("double")
    floating = dtype in ("double", "float")
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(id_col).isNull()).alias("n_null"),
        F.count_if(F.col(id_col).isNotNull() & as_double.isNull()).alias("n_not_numeric"),
        F.count_if(as_double != F.floor(as_double)).alias("n_not_whole"),
        F.min(id_col).try_cast("string").alias("sample_min"),
        F.max(id_col).try_cast("string").alias("sample_max"),
    )
    issue = (
        F.when(F.lit(floating) & (F.col("n_not_whole") == 0), "CRITICAL: whole identifiers held as float")
        .when(F.lit(floating), "WARNING: identifier holds fractions")
        .when(
            F.lit(dtype == "string") & (F.col("n_not_numeric") > 0),
            "CRITICAL: mixed identifier values",
        )
    )
    return out.select(F.lit(dtype).alias("dtype"), "*", issue.alias("issue"))


def tag_split(df: DataFrame, holdout: DataFrame, p: Params) -> DataFrame:
    """Add split = test for vessels in the holdout list, train otherwise."""
    keys = holdout.select(MMSI).distinct().withColumn("_held", F.lit(True))
    return join_vessels(df, keys, p, "left").withColumn(
        "split", F.when(F.col("_held"), "test").otherwise("train")
    ).drop("_held")


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither keys, labels, scores nor excluded."""
    # Names that never count as a feature.
    never = {"MMSI", "mmsi", "Timestamp", "timestamp", "ship_name", "dark_fleet_true",
             "dark_fleet_probability", TARGET, *exclude}
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in never
    ]

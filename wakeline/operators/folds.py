"""Vessel-disjoint and time-ordered splits. Folds are tables keyed by row, never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.functions.columns import HOUR_US, micros
from wakeline.operators.prefix import global_row_index, hash_rank, quantiles
from wakeline.operators.slices import join_vessels
from wakeline.params import MMSI, TARGET, Params

# Smallest train and validation sides of a usable fold.
MIN_TRAIN_GROUP_TIME, MIN_VALID_GROUP_TIME = 50, 10
MIN_TRAIN_FIRST_SEEN, MIN_VALID_FIRST_SEEN = 100, 50
MIN_VALID_POSITIONAL, SMALLEST_VALID_BLOCK = 10, 100


class SplitError(ValueError):
    """The table cannot be split as asked."""


def round_half_even(c) -> Column:
    return F.bround(c, 0)


def tile(rank: Column, n: Column, k: int) -> Column:
    """Tile 0..k-1 of a 1-based rank; the first n mod k tiles hold one more."""
    q, m = F.floor(n / k), F.pmod(n, F.lit(k))
    r, edge = rank - 1, F.pmod(n, F.lit(k)) * (F.floor(n / k) + 1)
    return F.when(r < edge, F.floor(r / (q + 1))).otherwise(
        m + F.floor(F.try_divide(r - edge, q))
    ).cast("int")


def vessel_folds(df: DataFrame, p: Params) -> DataFrame:
    """(MMSI, fold): vessels in k disjoint folds of near equal size, in md5 order."""
    ranked = hash_rank(df.select(MMSI), MMSI, p.seed)
    return ranked.select(MMSI, tile(F.col("rank"), F.col("n"), p.n_splits).alias("fold"))


def fold_cutoffs(df: DataFrame, p: Params) -> DataFrame:
    """(fold, cut): time quantiles i / (k + 1) over all rows, exact and distributed."""
    k = p.n_splits
    levels = [i / (k + 1) for i in range(1, k + 1)]
    fold = F.round(F.col("level") * (k + 1)).cast("int") - 1
    return quantiles(df.withColumn("_t", micros()), "_t", levels, p).select(
        fold.alias("fold"), F.floor("quantile").cast("bigint").alias("cut")
    )


def _usable(assigned: DataFrame, min_train: int, min_valid: int) -> DataFrame:
    """Keep folds whose sides are both large enough; the size table has one row for each fold."""
    sizes = assigned.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("_tr"),
        F.count_if(F.col("role") == "valid").alias("_va"),
    ).filter((F.col("_tr") >= min_train) & (F.col("_va") >= min_valid))
    return assigned.join(F.broadcast(sizes.select("fold")), "fold", "left_semi")


def split_group_time(df: DataFrame, p: Params, usable_only: bool = True) -> DataFrame:
    """(fold, role, row): other vessels before cut - gap train, the fold's vessels validate.

    Every row meets at most k folds, so the output is at most k times the input.
    The cut-offs (k rows) ride along as one array; the vessel list is the only
    join.
    """
    if p.n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    cuts = fold_cutoffs(df, p).agg(
        F.array_sort(F.collect_list(F.struct("fold", "cut"))).alias("c")
    ).scalar()
    gap, horizon = int(p.fold_gap_hours * HOUR_US), int(p.fold_horizon_hours * HOUR_US)
    t = micros()
    rows = join_vessels(df, vessel_folds(df, p).withColumnRenamed("fold", "_home"), p)
    rows = rows.withColumn("_c", F.explode(cuts)).withColumns(
        {"fold": F.col("_c.fold"), "_cut": F.col("_c.cut")}
    )
    role = F.when(
        F.col("fold") == F.col("_home"),
        F.when((t >= F.col("_cut")) & (t < F.col("_cut") + horizon), "valid"),
    ).otherwise(F.when(t < F.col("_cut") - gap, "train"))
    out = rows.withColumn("role", role).filter(F.col("role").isNotNull()).select(
        "fold", "role", *df.columns
    )
    return _usable(out, MIN_TRAIN_GROUP_TIME, MIN_VALID_GROUP_TIME) if usable_only else out


def check_groups(df: DataFrame, p: Params) -> DataFrame:
    """Return the table, or raise where it has fewer vessels than folds."""
    n = df.select(MMSI).distinct().limit(p.n_splits).count()
    if n < p.n_splits:
        raise SplitError(f"only {n} vessels for {p.n_splits} folds")
    return df


def holdout_vessels(df: DataFrame, p: Params) -> DataFrame:
    """(MMSI): max(1, round(n * ratio)) vessels, half to even, first in md5 order."""
    ranked = hash_rank(df.select(MMSI), MMSI, p.seed)
    n_hold = F.greatest(F.lit(1.0), round_half_even(F.col("n") * p.holdout_ratio))
    return ranked.filter(F.col("rank") <= n_hold).select(MMSI)


def holdout_by_vessel(df: DataFrame, p: Params, holdout: DataFrame | None = None):
    """(pool, held out, list). Pass a stored list to repeat an earlier split."""
    held = holdout if holdout is not None else holdout_vessels(df, p)
    return join_vessels(df, held, p, "left_anti"), join_vessels(df, held, p, "left_semi"), held


def _ties(df: DataFrame, p: Params) -> list[str]:
    """What orders rows of one time: the vessel, then the input order where there is one."""
    return [MMSI, p.seq_col] if p.seq_col in df.columns else [MMSI]


def split_time_gap(df: DataFrame, p: Params, freq_minutes: int | None = None) -> DataFrame:
    """(fold, role, row_index, row): expanding positional train side, a gap in rows, a short block."""
    step = int(p.fold_gap_hours * 60 / (freq_minutes or p.bin_minutes))
    k = p.n_splits
    indexed = global_row_index(df.withColumn("_t", micros()), "_t", _ties(df, p), p).drop("_t")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    block = F.greatest(F.lit(SMALLEST_VALID_BLOCK), F.floor(n / (4 * k)))
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = indexed.withColumn("_n", n).withColumn("_block", block).withColumn("fold", fold)
    end = F.floor(F.col("_n") * (F.col("fold") + 1) / (k + 1))
    start = end + step
    stop = F.least(start + F.col("_block"), F.col("_n"))
    i = F.col("row_index")
    role = F.when(i < end, "train").when((i >= start) & (i < stop), "valid")
    usable = (start < F.col("_n")) & (stop - start >= MIN_VALID_POSITIONAL)
    return rows.withColumn("role", role).filter(usable & role.isNotNull()).select(
        "fold", "role", "row_index", *df.columns
    )


def vessel_first_seen(df: DataFrame) -> DataFrame:
    return df.groupBy(MMSI).agg(
        F.min(micros()).alias("first_us"), F.max(micros()).alias("last_us"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def first_seen_vessels(df: DataFrame, p: Params, usable_only: bool = True) -> DataFrame:
    """(fold, MMSI, role) by order of first appearance. All from the vessel table."""
    seen = vessel_first_seen(df)
    ranked = global_row_index(seen, "first_us", [MMSI], p, "_r")
    n = seen.agg(F.count(F.lit(1)).alias("n")).scalar()
    k, gap = p.n_splits, int(p.fold_gap_hours * HOUR_US)
    rows = ranked.withColumn("_n", n).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    ).withColumn("_train", F.col("_r") < F.floor(F.col("_n") * (F.col("fold") + 1) / (k + 1)))
    ends = rows.groupBy("fold").agg(
        F.max(F.when(F.col("_train"), F.col("last_us"))).alias("_end"),
    )
    roles = rows.join(F.broadcast(ends), "fold").withColumn(
        "role",
        F.when(F.col("_train"), "train").when(F.col("first_us") >= F.col("_end") + gap, "valid"),
    ).filter(F.col("role").isNotNull())
    if usable_only:
        sizes = roles.groupBy("fold").agg(
            F.sum(F.when(F.col("role") == "train", F.col("n_rows")).otherwise(0)).alias("_tr"),
            F.sum(F.when(F.col("role") == "valid", F.col("n_rows")).otherwise(0)).alias("_va"),
        ).filter((F.col("_tr") >= MIN_TRAIN_FIRST_SEEN) & (F.col("_va") >= MIN_VALID_FIRST_SEEN))
        roles = roles.join(F.broadcast(sizes.select("fold")), "fold", "left_semi")
    return roles.select("fold", MMSI, "role")


def split_first_seen(df: DataFrame, p: Params, usable_only: bool = True) -> DataFrame:
    """(fold, role, row): earlier vessels train, vessels that appear after them validate.

    When all vessels start together no fold is usable and the table is empty.
    """
    roles = first_seen_vessels(df, p, usable_only)
    # at most k (fold, role) pairs for each vessel, carried as one array per vessel
    packed = roles.groupBy(MMSI).agg(F.collect_list(F.struct("fold", "role")).alias("_roles"))
    return join_vessels(df, packed, p).select(F.explode("_roles").alias("_f"), *df.columns).select(
        "_f.fold", "_f.role", *df.columns
    )


def split_positional(df: DataFrame, p: Params, ratio: float | None = None) -> DataFrame:
    """(part, row_index, row): the first share of rows in (time, vessel) order is 'head'."""
    ratio = p.train_ratio if ratio is None else ratio
    indexed = global_row_index(df.withColumn("_t", micros()), "_t", _ties(df, p), p).drop("_t")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return indexed.withColumn("_cut", F.floor(n * F.lit(ratio))).select(
        F.when(F.col("row_index") < F.col("_cut"), "head").otherwise("tail").alias("part"),
        "row_index", *df.columns,
    )


def fold_positives(folds: DataFrame, target: str = TARGET) -> DataFrame:
    """One row for each fold: rows and positives on both sides, and whether it can be used."""
    tr, va = F.col("role") == "train", F.col("role") == "valid"
    pos = F.col(target) == 1
    return folds.groupBy("fold").agg(
        F.count_if(tr).alias("train_rows"), F.count_if(va).alias("valid_rows"),
        F.count_if(tr & pos).alias("train_pos"), F.count_if(va & pos).alias("valid_pos"),
    ).withColumn("usable", (F.col("train_pos") > 0) & (F.col("valid_pos") > 0))


def select_vessels(df: DataFrame, n: int, target: str = TARGET) -> DataFrame:
    """The first n vessels, ascending, that have a positive row."""
    return df.filter(F.col(target) == 1).select(MMSI).distinct().orderBy(MMSI).limit(n)


def selection_changes(selected: DataFrame, stored: DataFrame) -> DataFrame:
    """(MMSI, change): vessels that entered or left since the stored list."""
    now, then = selected.select(MMSI), stored.select(MMSI)
    return now.join(then, MMSI, "left_anti").withColumn("change", F.lit("added")).unionByName(
        then.join(now, MMSI, "left_anti").withColumn("change", F.lit("removed"))
    )

"""Are the last pings before a gap different from other pings of the same vessel?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from wakeline.functions.columns import hash_order, micros
from wakeline.operators import evaluation as ev
from wakeline.operators.labels import mark_last_ping
from wakeline.operators.model import SCORE, score_rows, train_logistic
from wakeline.operators.prefix import hash_rank, quantiles
from wakeline.params import MMSI, TIMESTAMP, Params
from wakeline.session import durable

CLASS = "is_last"
# Fewest vessels, ridge, verdict limits, folds.
MIN_VESSELS = 3
RIDGE = 1e-6
STRONG_AUC, WEAK_AUC = 0.70, 0.55
N_FOLDS = 2


def audit_sample(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    """All last pings, plus up to K other pings of each vessel that has one.

    Controls are the K smallest md5 values. A two-level choice keeps a hot
    vessel off a single task: first the K smallest of each hash group, then the
    K smallest of those few.
    """
    marked = mark_last_ping(df, p, CLASS, bounded).withColumn("_us", micros())
    has = marked.groupBy(MMSI).agg(F.max(CLASS).alias("_has"))
    lasts = marked.filter(F.col(CLASS))
    h = hash_order(p.seed, MMSI, "_us")
    others = marked.filter(~F.col(CLASS)).withColumn("_h", h).withColumn(
        "_g", F.substring("_h", -3, 3)
    )
    first = Window.partitionBy(MMSI, "_g").orderBy("_h")
    second = Window.partitionBy(MMSI).orderBy("_h")
    few = others.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= p.n_controls)
    controls = (
        few.withColumn("_r", F.row_number().over(second)).filter(F.col("_r") <= p.n_controls)
        .join(has.filter("_has").select(MMSI), MMSI, "left_semi")
    )
    # a vessel with last pings only has no controls and is left out altogether
    with_controls = controls.select(MMSI).distinct()
    lasts = lasts.join(with_controls, MMSI, "left_semi")
    cols = [*df.columns, CLASS]
    return lasts.select(*cols).unionByName(controls.select(*cols)).withColumn(
        CLASS, F.col(CLASS).cast("int")
    )


def eligible(df: DataFrame, p: Params, bounded: bool = False) -> DataFrame:
    """Vessels with a last ping before a gap, whether or not they have controls."""
    return mark_last_ping(df, p, CLASS, bounded).filter(F.col(CLASS)).select(MMSI).distinct()


def audit_counts(sample: DataFrame, vessels: DataFrame) -> DataFrame:
    """Rows of the sample, and vessels that were eligible before any was left out."""
    n = vessels.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sample.agg(
        F.count_if(F.col(CLASS) == 1).alias("n_last_pings"),
        F.count_if(F.col(CLASS) == 0).alias("n_controls"),
        n.alias("n_eligible_vessels"),
    ).withColumn(
        "status", F.when(F.col("n_eligible_vessels") < MIN_VESSELS, "INSUFFICIENT_DATA").otherwise("READY")
    )


def median_impute(df: DataFrame, cols: Sequence[str], p: Params) -> DataFrame:
    """Null features become the exact column median; all medians come from one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(F.explode(cells).alias("c")).select("c.name", "c.value")
    medians = quantiles(long, "value", [0.5], p, ["name"]).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "quantile"))).alias("m")
    ).scalar()
    return df.withColumn("_m", medians).withColumns({
        c: F.coalesce(F.col(c), F.col("_m")[c]) for c in cols
    }).drop("_m")


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = df.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).alias("s")).scalar()
    return df.withColumns({
        c: (F.col(c) - stats[f"m_{c}"])
        / F.when(stats[f"s_{c}"] == 0, F.lit(1.0)).otherwise(stats[f"s_{c}"])
        for c in cols
    })


def mahalanobis(df: DataFrame, cols: Sequence[str], label: str = CLASS) -> float:
    """Distance of the two class centroids under the covariance of all rows plus a ridge.

    One aggregate gives means and covariances; only the d x d inverse is local.
    """
    d = len(cols)
    row = df.agg(
        *[F.avg(F.when(F.col(label) == k, F.col(c))).alias(f"m{k}_{i}") for k in (0, 1) for i, c in enumerate(cols)],
        *[F.covar_samp(a, b).alias(f"v_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j],
    ).first()
    cov = np.array([[row[f"v_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    diff = np.array([row[f"m1_{i}"] - row[f"m0_{i}"] for i in range(d)], dtype=float)
    return float(np.sqrt(diff @ np.linalg.pinv(cov + RIDGE * np.eye(d)) @ diff))


def stratified_folds(df: DataFrame, p: Params, k: int = N_FOLDS, label: str = CLASS) -> DataFrame:
    """Folds dealt in turn by md5 rank inside each class, so every class is in every fold.

    Ranks come from even hash buckets and their offsets; no class meets in one task.
    """
    keyed = df.withColumn("_row", F.concat_ws("-", MMSI, micros(TIMESTAMP)))
    ranks = None
    for value in (0, 1):
        part = hash_rank(keyed.filter(F.col(label) == value), "_row", p.seed, "_rank", "_n").drop("_n")
        part = part.withColumn("_class", F.lit(value))
        ranks = part if ranks is None else ranks.unionByName(part)
    same = (F.col("a._row") == F.col("b._row")) & (F.col(f"a.{label}") == F.col("b._class"))
    return keyed.alias("a").join(ranks.alias("b"), same).select(
        *[F.col(f"a.{c}") for c in df.columns], F.pmod(F.col("b._rank") - 1, F.lit(k)).cast("int").alias("fold")
    )


def audit_auc(df: DataFrame, cols: Sequence[str], p: Params, k: int = N_FOLDS, label: str = CLASS) -> DataFrame:
    """(fold, roc_auc) of a balanced logistic regression."""
    folded = stratified_folds(df, p, k, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = []
        for fold in range(k):
            model = train_logistic(folded.filter(F.col("fold") != fold), cols, label)
            scored = score_rows(model, folded.filter(F.col("fold") == fold), p)
            rows.append((fold, ev.roc_auc(scored, SCORE, p, label).first()[0]))
    finally:
        folded.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, roc_auc double")


def audit_verdict(auc: DataFrame) -> DataFrame:
    mean = F.avg("roc_auc")
    return auc.agg(mean.alias("auc_last_vs_controls")).withColumn(
        "verdict",
        F.when(F.col("auc_last_vs_controls") >= STRONG_AUC, "DISTINGUISHABLE")
        .when(F.col("auc_last_vs_controls") >= WEAK_AUC, "WEAKLY_DISTINGUISHABLE")
        .when(F.col("auc_last_vs_controls").isNull(), "INSUFFICIENT_DATA")
        .otherwise("INDISTINGUISHABLE"),
    )


def last_ping_audit(df: DataFrame, cols: Sequence[str], p: Params, bounded: bool = False) -> DataFrame:
    """The whole audit as one row."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"features missing: {missing}")
    sample = audit_sample(df, p, bounded).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = audit_counts(sample, eligible(df, p, bounded)).first()
        auc = distance = None
        verdict = counts.status
        if counts.status == "READY":
            ready = durable(standardise(median_impute(sample, cols, p), cols))
            row = audit_verdict(audit_auc(ready, cols, p)).first()
            auc, verdict = row.auc_last_vs_controls, row.verdict
            distance = mahalanobis(ready, cols)
    finally:
        sample.unpersist()
    schema = (
        "n_eligible_vessels long, n_last_pings long, n_controls long,"
        " auc_last_vs_controls double, mahalanobis double, verdict string"
    )
    return df.sparkSession.createDataFrame(
        [(counts.n_eligible_vessels, counts.n_last_pings, counts.n_controls, auc, distance, verdict)], schema
    )

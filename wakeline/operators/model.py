"""Training and scoring on MLlib. Label, score and keys always share a row."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from wakeline.operators import evaluation as ev
from wakeline.operators.clean import model_rows
from wakeline.operators.folds import fold_positives, split_group_time, split_positional
from wakeline.operators.labels import (
    SWEEP_HOURS, multi_threshold_labels, threshold_column, threshold_rates,
)
from wakeline.operators.markov import markov_sym
from wakeline.operators.prefix import hash_rank
from wakeline.params import (
    FEATURES_BASELINE, FEATURES_FULL, FEATURES_MOTION, MMSI, REGIME, REGIME_SMOOTHED, TARGET,
    TIMESTAMP, Params,
)

# Search ranges (low, high, kind) of the trees and of the filter.
SEARCH_SPACE = {
    "markov_p": (0.70, 0.99, "float"),
    "learning_rate": (0.01, 0.2, "log"),
    "num_leaves": (16, 128, "int"),
    "max_depth": (3, 10, "int"),
    "min_child_samples": (20, 200, "int"),
    "subsample": (0.6, 1.0, "float"),
    "colsample_bytree": (0.6, 1.0, "float"),
    "scale_pos_weight": (1.0, 20.0, "float"),
}
# Boosting rounds (floor, default), VIF limit, interval widths, naive thresholds.
MIN_ROUNDS, DEFAULT_ROUNDS = 100, 500
VIF_LIMIT = 10.0
INTERVAL_WIDTHS = (0.20, 0.15)
NAIVE_SPEEDS = (6.0, 4.0)
SCORE = "score"


class SearchError(RuntimeError):
    """The search cannot pick parameters."""


@dataclass(frozen=True)
class TreeParams:
    markov_p: float = 0.85
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = 5
    min_child_samples: int = 20
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    scale_pos_weight: float = 1.0

    @property
    def depth(self) -> int:
        return min(self.max_depth, math.ceil(math.log2(self.num_leaves)))


def smoothed_features(features: Sequence[str]) -> list[str]:
    """The trees see the filtered regime score in place of the raw one."""
    return [REGIME_SMOOTHED if f == REGIME else f for f in features]


def with_smoothed(df: DataFrame, p: Params, p_stay: float, bounded: bool = True) -> DataFrame:
    return markov_sym(df, p, p_stay, bounded=bounded) if REGIME in df.columns else df


def _positive_probability(df: DataFrame) -> DataFrame:
    return df.withColumn(SCORE, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def train_gbt(
    df: DataFrame, features: Sequence[str], t: TreeParams, p: Params, rounds: int = 100,
    target: str = TARGET, valid_col: str | None = None,
) -> PipelineModel:
    """Boosted trees. With ``valid_col`` boosting stops when the marked rows stop improving."""
    weighted = df.withColumn(
        "_w", F.when(F.col(target) == 1, F.lit(float(t.scale_pos_weight))).otherwise(F.lit(1.0))
    ).withColumn("_y", F.col(target).cast("double"))
    options = {"validationIndicatorCol": valid_col} if valid_col else {}
    gbt = GBTClassifier(
        featuresCol="features", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=t.depth,
        stepSize=t.learning_rate, minInstancesPerNode=t.min_child_samples,
        subsamplingRate=t.subsample, featureSubsetStrategy=str(t.colsample_bytree), seed=p.seed,
        **options,
    )
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assemble, gbt]).fit(weighted)


def train_logistic(df: DataFrame, features: Sequence[str], target: str = TARGET) -> PipelineModel:
    """Scaled inputs with null as 0, class weights n / (2 n_class), unit ridge penalty on the summed loss.

    MLlib divides the loss by the sum of the weights, so the penalty is divided too.
    """
    df = df.fillna(0, list(features))
    pos, neg = df.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()
    total = pos + neg
    weight = F.when(F.col(target) == 1, F.lit(total / (2.0 * max(pos, 1)))).otherwise(F.lit(total / (2.0 * max(neg, 1))))
    summed = total if pos and neg else total / 2.0
    weighted = df.withColumn("_w", weight).withColumn("_y", F.col(target).cast("double"))
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="features", labelCol="_y", weightCol="_w", maxIter=1000, standardization=False,
            regParam=1.0 / max(summed, 1.0),
        ),
    ]).fit(weighted)


def model_features(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def score_rows(model: PipelineModel, df: DataFrame, p: Params, p_stay: float | None = None) -> DataFrame:
    """Rows with their score. The filter runs first when the model needs it."""
    need = model_features(model)
    if REGIME_SMOOTHED in need and p_stay is not None:
        df = with_smoothed(df, p, p_stay)
    missing = [f for f in need if f not in df.columns]
    if missing:
        raise ValueError(f"features missing for scoring: {missing}")
    return _positive_probability(model.transform(df)).drop("features", "raw_features")


# ------------------------------------------------------------------- search

def draw_parameters(n: int, seed: int) -> list[TreeParams]:
    """A repeatable random table over the search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        values = {}
        for name, (low, high, kind) in SEARCH_SPACE.items():
            if kind == "int":
                values[name] = rng.randint(low, high)
            elif kind == "log":
                values[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                values[name] = rng.uniform(low, high)
        out.append(TreeParams(**values))
    return out


def search_guard(n_trials: int, n_complete: int, n_pruned: int, prevalence: float) -> None:
    """Stop a search in which most trials had no usable fold, or none finished."""
    reason = None
    if 2 * n_pruned > n_trials:
        reason = f"no fold with both classes for {n_pruned} of {n_trials} trials, share of positives {prevalence:.6f}"
    elif n_complete == 0:
        reason = f"none of {n_trials} trials has a result"
    if reason is not None:
        # Fixed value: the start of the message.
        raise SearchError("HPO degenerate: " + reason)


def usable_folds(folds: DataFrame, target: str = TARGET) -> list[int]:
    """Folds with positives on both sides; one row for each fold reaches the driver."""
    return [r.fold for r in fold_positives(folds, target).filter("usable").orderBy("fold").collect()]


def boosted_rounds(model: PipelineModel) -> int:
    trees: GBTClassificationModel = model.stages[-1]
    return trees.getNumTrees


def final_rounds(best_iterations: Sequence[int], floor: int = MIN_ROUNDS) -> int:
    median = int(np.median(best_iterations)) if len(best_iterations) else DEFAULT_ROUNDS
    return max(median, floor)


def param_search(
    df: DataFrame, p: Params, features: Sequence[str] = FEATURES_FULL, n_trials: int = 10,
    max_rounds: int = 1000, target: str = TARGET, splitter=split_group_time,
) -> list[dict]:
    """Mean AP over usable folds for each drawn parameter set, best first.

    Trials and folds are a driver loop over distributed fits. Usable folds are
    found before any training; the folds are cached once and each trial adds
    its own filtered score.
    """
    rows = model_rows(df, features, target).persist(StorageLevel.MEMORY_AND_DISK)
    folds = splitter(rows, p).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        usable = usable_folds(folds, target)
        results = []
        for trial, t in enumerate(draw_parameters(n_trials, p.seed)):
            if not usable:
                continue
            smooth = with_smoothed(rows, p, t.markov_p)
            names = smoothed_features(features)
            if REGIME in features:
                extra = smooth.select(MMSI, TIMESTAMP, REGIME_SMOOTHED)
                tagged = folds.join(extra, [MMSI, TIMESTAMP])
            else:
                tagged = folds
            scores, rounds = [], []
            for fold in usable:
                part = tagged.filter(F.col("fold") == fold).withColumn("_valid", F.col("role") == "valid")
                model = train_gbt(part, names, t, p, max_rounds, target, "_valid")
                scored = score_rows(model, part.filter("_valid"), p)
                scores.append(ev.average_precision(scored, SCORE, p, target).first()[0])
                rounds.append(boosted_rounds(model))
            results.append({"trial": trial, "params": t, "mean_ap": float(np.mean(scores)), "rounds": rounds})
        prevalence = rows.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
        search_guard(n_trials, len(results), n_trials - len(results), prevalence)
        return sorted(results, key=lambda r: -r["mean_ap"])
    finally:
        folds.unpersist()
        rows.unpersist()


def search_and_train(
    df: DataFrame, p: Params, features: Sequence[str] = FEATURES_FULL, n_trials: int = 10,
    max_rounds: int = 1000, floor: int = MIN_ROUNDS, target: str = TARGET,
):
    """(model, best parameters, search table) on the whole training table."""
    table = param_search(df, p, features, n_trials, max_rounds, target)
    best = table[0]
    rows = with_smoothed(model_rows(df, features, target), p, best["params"].markov_p)
    rounds = final_rounds(best["rounds"], floor)
    return train_gbt(rows, smoothed_features(features), best["params"], p, rounds, target), best["params"], table


# ------------------------------------------------------------------ studies

def ablation_predictions(
    train: DataFrame, test: DataFrame, p: Params, t: TreeParams = TreeParams(), rounds: int = 100,
    target: str = TARGET,
) -> DataFrame:
    """Test rows with one score column for each of three models."""
    tr = with_smoothed(train, p, t.markov_p).dropna(subset=[target])
    short, full = smoothed_features(FEATURES_BASELINE), smoothed_features(FEATURES_FULL)

    def boosted(names):
        return train_gbt(tr.dropna(subset=list(names)), names, t, p, rounds, target)

    fits = {
        "pred_gb_enhanced": lambda: boosted(full),
        "pred_gb_baseline": lambda: boosted(short),
        "pred_logistic_baseline": lambda: train_logistic(tr, short, target),
    }
    out = with_smoothed(model_rows(test, FEATURES_FULL, target), p, t.markov_p)
    for column, fit in fits.items():
        out = score_rows(fit(), out, p).withColumnRenamed(SCORE, column)
    return out


def ablation(predictions: DataFrame, p: Params, target: str = TARGET) -> DataFrame:
    """model, AP, Brier."""
    scores = [c for c in predictions.columns if c.startswith("pred_")]
    return ev.metric_table(predictions, scores, p, target).select("model", "average_precision", "brier")


def gap_sensitivity(
    features: DataFrame, p: Params, thresholds: Sequence[float] = SWEEP_HOURS,
    t: TreeParams = TreeParams(), rounds: int = 50,
) -> DataFrame:
    """For each gap threshold: positive rate, and AP and Brier of kinematic trees."""
    labelled = multi_threshold_labels(features, p, thresholds, bounded=True).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = []
        for row in threshold_rates(labelled, thresholds).collect():
            ap = br = None
            if row.usable:
                target = threshold_column(row.gap_hours)
                split = split_positional(labelled.dropna(subset=list(FEATURES_MOTION)), p)
                train, test = split.filter("part = 'head'"), split.filter("part = 'tail'")
                ok = all(d.filter(F.col(target) == 1).limit(1).count() for d in (train, test))
                if ok:
                    model = train_gbt(train, FEATURES_MOTION, t, p, rounds, target)
                    m = ev.metrics(score_rows(model, test, p), SCORE, p, target).first()
                    ap, br = m.average_precision, m.brier
            out.append((row.gap_hours, row.pos_rate, ap, br))
    finally:
        labelled.unpersist()
    schema = "gap_hours double, pos_rate double, average_precision double, brier double"
    return features.sparkSession.createDataFrame(out, schema)


# ---------------------------------------------------------------- collinearity

def gram_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: sums of products of every feature pair, plus spreads."""
    products = [
        F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}")
        for i, a in enumerate(features) for j, b in enumerate(features) if i <= j
    ]
    spreads = [F.stddev_samp(f).alias(f"sd_{i}") for i, f in enumerate(features)]
    return df.dropna(subset=list(features)).agg(*products, *spreads)


def vif_from_gram(gram: np.ndarray) -> np.ndarray:
    """VIF without an intercept: diagonal of G times diagonal of its inverse.

    Columns that take part in an exact linear relation get infinity.
    """
    scale = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    flat = values < 1e-12 * values.max()
    vif = (vectors[:, ~flat] ** 2 / values[~flat]).sum(axis=1)
    tied = (vectors[:, flat] ** 2 > 1e-6).any(axis=1)
    return np.where(tied, np.inf, vif)


def vif_table(df: DataFrame, features: Sequence[str], limit: float = VIF_LIMIT) -> list[tuple[str, float, bool]]:
    """(feature, last VIF, kept). One distributed aggregate; the loop runs on a d x d matrix."""
    row = gram_matrix(df, features).first()
    names = [f for i, f in enumerate(features) if row[f"sd_{i}"] and row[f"sd_{i}"] > 0]
    index = {f: i for i, f in enumerate(features)}

    def g(a, b):
        i, j = sorted((index[a], index[b]))
        return row[f"g_{i}_{j}"]

    dropped: list[tuple[str, float, bool]] = [(f, float("nan"), False) for f in features if f not in names]
    while names:
        vif = vif_from_gram(np.array([[g(a, b) for b in names] for a in names], dtype=float))
        worst = int(np.argmax(vif))
        if vif[worst] <= limit or len(names) == 1:
            return [(f, float(v), True) for f, v in zip(names, vif)] + dropped
        dropped.append((names[worst], float(vif[worst]), False))
        del names[worst]
    return dropped


def vif_filter(df: DataFrame, features: Sequence[str], limit: float = VIF_LIMIT) -> list[str]:
    return [f for f, _, kept in vif_table(df, features, limit) if kept]


# ------------------------------------------------------------- interpretation

def importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance) of the trees."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(model_features(model), values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def shuffled(df: DataFrame, feature: str, p: Params, keys: Sequence[str] = (MMSI, TIMESTAMP)) -> DataFrame:
    """The feature's values dealt out again: the row of rank i in one md5 order gets the value of rank i in another.

    Both ranks run over the whole table, so the share of rows that keep their own value
    doesn't depend on its size. Keys are unique, as the quality gate makes sure.
    """
    base = df.withColumn("_row", F.concat_ws("-", *keys))
    giving = hash_rank(base, "_row", p.seed + 1, "_i").select("_row", "_i")
    taking = hash_rank(base, "_row", p.seed + 2, "_i").select("_row", "_i")
    values = base.select("_row", F.col(feature).alias("_v")).join(giving, "_row").select("_i", "_v")
    slots = base.join(taking, "_row").join(values, "_i")
    return slots.withColumn(feature, F.col("_v")).select(*df.columns)


def permutation_importance(
    model: PipelineModel, df: DataFrame, p: Params, target: str = TARGET
) -> DataFrame:
    """(feature, drop): fall in AP when one feature is shuffled."""
    base = ev.average_precision(score_rows(model, df, p), SCORE, p, target).first()[0]
    rows = []
    for f in model_features(model):
        ap = ev.average_precision(score_rows(model, shuffled(df, f, p), p), SCORE, p, target).first()[0]
        rows.append((f, float(base - ap)))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double")


def interaction_profile(
    df: DataFrame, feature: str, by: str, score: str, ranges: dict, n_bins: int = 10
) -> DataFrame:
    """Mean score over a grid of two binned features; ranges give (low, high)."""

    def cell(c):
        low, high = ranges[c]
        return F.least(
            F.greatest(F.floor((F.col(c) - low) / ((high - low) / n_bins)), F.lit(0)), F.lit(n_bins - 1)
        ).cast("int")

    return df.filter(F.col(feature).isNotNull() & F.col(by).isNotNull()).groupBy(
        cell(feature).alias("bin"), cell(by).alias("by_bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


def naive_scores(df: DataFrame) -> DataFrame:
    """Three scores that need no training."""
    cols = {"inverse_speed": 1.0 / (F.col("SOG") + 1)}
    for v in NAIVE_SPEEDS:
        cols[f"slow_{v:g}"] = (F.col("SOG") < v).cast("double")
    return df.withColumns(cols)


def naive_table(df: DataFrame, p: Params, target: str = TARGET) -> DataFrame:
    names = ["inverse_speed", *[f"slow_{v:g}" for v in NAIVE_SPEEDS]]
    return ev.metric_table(naive_scores(df), names, p, target).select("model", "average_precision", "roc_auc")


def score_interval(df: DataFrame, score: str, width: float = INTERVAL_WIDTHS[0]) -> DataFrame:
    """Bounds half a width below and above the score, inside [0, 1]."""

    def bound(c: Column) -> Column:
        return F.when(F.col(score).isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))

    return df.withColumns({
        "pi_lower": bound(F.col(score) - width / 2), "pi_upper": bound(F.col(score) + width / 2),
    })

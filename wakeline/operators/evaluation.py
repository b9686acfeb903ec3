"""Score metrics, curves, thresholds, calibration and intervals.

Every score-ordered metric reads one table: positives and negatives for each
distinct score, with running sums from the highest score down. Ties share one
row, so they are handled as a group. A weight column stands for resampled rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.functions.columns import hash_uniform
from wakeline.operators.draws import row_metrics, vessel_metrics
from wakeline.operators.prefix import cumulative, quantiles
from wakeline.params import MMSI, TARGET, Params

# Threshold grid, probability clip, gain cut-offs.
GRID_LOW, GRID_HIGH, GRID_SIZE = 0.01, 0.99, 200
LOG_EPS = 2.220446049250313e-16
LIFT_GO, LIFT_CAUTION = 5.0, 2.0
HIGH_RISK = 0.7
MIN_VARIANCE = 1e-6


class EvaluationError(ValueError):
    """A metric has nothing to work on, or a score column is degenerate."""


def score_counts(
    df: DataFrame, score: str, target: str = TARGET, keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """pos and neg for each distinct (keys, score)."""
    w = F.col(weight) if weight else F.lit(1)
    return df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(target) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(target) == 0, w).otherwise(0)).alias("neg"),
    )


def cumulative_counts(counts: DataFrame, p: Params, keys: Sequence[str] = ()) -> DataFrame:
    """Add tp, fp (at or above the score) and the totals n_pos, n_neg."""
    return cumulative(counts, "score", ["pos", "neg"], p, keys, descending=True).select(
        *keys, "score", "pos", "neg",
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("total_pos").alias("n_pos"), F.col("total_neg").alias("n_neg"),
    )


def score_cumulative(
    df: DataFrame, score: str, p: Params, target: str = TARGET, keys: Sequence[str] = ()
) -> DataFrame:
    return cumulative_counts(score_counts(df, score, target, keys), p, keys)


def ap_expr() -> Column:
    """Sum of precision times recall step."""
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    return F.sum(precision * F.try_divide(F.col("pos").cast("double"), F.col("n_pos")))


def auc_expr() -> Column:
    """Share of (positive, negative) pairs in the right order, ties half; null for one class."""
    above = F.col("tp") - F.col("pos") / 2.0
    return F.sum(
        F.try_divide(F.col("neg") * above, F.col("n_pos").cast("double") * F.col("n_neg"))
    )


def average_precision(
    df: DataFrame, score: str, p: Params, target: str = TARGET, keys: Sequence[str] = ()
) -> DataFrame:
    return score_cumulative(df, score, p, target, keys).groupBy(*keys).agg(
        ap_expr().alias("average_precision")
    )


def roc_auc(
    df: DataFrame, score: str, p: Params, target: str = TARGET, keys: Sequence[str] = ()
) -> DataFrame:
    return score_cumulative(df, score, p, target, keys).groupBy(*keys).agg(auc_expr().alias("roc_auc"))


def log_loss_expr(score: str, target: str) -> Column:
    q = F.least(F.greatest(F.col(score), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    return F.avg(-F.when(F.col(target) == 1, F.log(q)).otherwise(F.log(1 - q)))


def brier_expr(score: str, target: str) -> Column:
    d = F.col(score) - F.col(target)
    return F.avg(d * d)


def _scored(df: DataFrame, score: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull())


def log_loss(df: DataFrame, score: str, target: str = TARGET) -> DataFrame:
    return _scored(df, score).agg(log_loss_expr(score, target).alias("log_loss"))


def brier(df: DataFrame, score: str, target: str = TARGET) -> DataFrame:
    return _scored(df, score).agg(brier_expr(score, target).alias("brier"))


def metrics(df: DataFrame, score: str, p: Params, target: str = TARGET) -> DataFrame:
    """One row: AP, ROC-AUC, log loss, Brier, prevalence, rows."""
    ranked = score_cumulative(df, score, p, target).agg(
        F.struct(ap_expr().alias("ap"), auc_expr().alias("auc")).alias("m")
    ).scalar()
    flat = _scored(df, score).agg(
        log_loss_expr(score, target).alias("log_loss"), brier_expr(score, target).alias("brier"),
        F.avg(F.col(target).cast("double")).alias("prevalence"), F.count(F.lit(1)).alias("n_rows"),
    )
    return flat.select(
        ranked["ap"].alias("average_precision"), ranked["auc"].alias("roc_auc"),
        "log_loss", "brier", "prevalence", "n_rows",
    )


def pr_curve(df: DataFrame, score: str, p: Params, target: str = TARGET) -> DataFrame:
    return score_cumulative(df, score, p, target).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("recall"),
    )


def operating_point(curve: DataFrame, tau) -> DataFrame:
    """The curve point at the first threshold at or above tau."""
    return curve.filter(F.col("threshold") >= tau).agg(
        F.min("threshold").alias("threshold"),
        F.min_by("precision", "threshold").alias("precision"),
        F.min_by("recall", "threshold").alias("recall"),
    )


def roc_curve(df: DataFrame, score: str, p: Params, target: str = TARGET) -> DataFrame:
    return score_cumulative(df, score, p, target).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"),
    )


def grid_threshold(i) -> Column:
    step = (GRID_HIGH - GRID_LOW) / (GRID_SIZE - 1)
    return F.lit(GRID_LOW) + F.col(i).cast("double") * F.lit(step)


def fbeta_table(df: DataFrame, score: str, beta: float = 2.0, target: str = TARGET) -> DataFrame:
    """F-beta at each grid threshold, zero where undefined.

    A row is counted once, at the last grid threshold it reaches; suffix sums
    over the 201 counts give all confusion counts.
    """
    step = (GRID_HIGH - GRID_LOW) / (GRID_SIZE - 1)
    guess = F.least(
        F.greatest(F.floor((F.col(score) - GRID_LOW) / step), F.lit(-1)), F.lit(GRID_SIZE - 1)
    ).cast("int")
    near = _scored(df, score).withColumn("_g", guess).withColumn("_up", F.col("_g") + 1)
    reached = (
        F.when((F.col("_up") < GRID_SIZE) & (F.col(score) >= grid_threshold("_up")), F.col("_up"))
        .when((F.col("_g") >= 0) & (F.col(score) < grid_threshold("_g")), F.col("_g") - 1)
        .otherwise(F.col("_g"))
    )
    counts = near.groupBy(reached.alias("_i")).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")
    )
    # at most 201 rows from here on
    packed = counts.agg(
        F.collect_list(F.struct("_i", "pos", "neg")).alias("h"), F.sum("pos").alias("n_pos")
    )
    grid = packed.select("h", "n_pos", F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))).alias("i"))

    def above(field):
        return F.aggregate(
            F.filter("h", lambda e: e["_i"] >= F.col("i")), F.lit(0).cast("bigint"),
            lambda acc, e: acc + e[field],
        )

    b2 = beta * beta
    tp, fp = above("pos"), above("neg")
    f = F.coalesce(
        F.try_divide((1 + b2) * tp, (1 + b2) * tp + b2 * (F.col("n_pos") - tp) + fp), F.lit(0.0)
    )
    return grid.select("i", grid_threshold("i").alias("threshold"), f.alias("fbeta"))


def fbeta_scan(df: DataFrame, score: str, beta: float = 2.0, target: str = TARGET) -> DataFrame:
    """The first grid threshold with the highest F-beta."""
    return fbeta_table(df, score, beta, target).agg(
        F.max_by(F.struct("threshold", "fbeta"), F.struct("fbeta", -F.col("i"))).alias("b")
    ).select("b.threshold", "b.fbeta")


def confusion(df: DataFrame, score: str, tau, target: str = TARGET) -> DataFrame:
    """Counts, precision and recall at a threshold; zero where undefined."""
    up, pos = F.col(score) >= tau, F.col(target) == 1
    neg = F.col(target) == 0
    return _scored(df, score).agg(
        F.count_if(neg & ~up).alias("tn"), F.count_if(neg & up).alias("fp"),
        F.count_if(pos & ~up).alias("fn"), F.count_if(pos & up).alias("tp"),
    ).select(
        "*",
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
        .alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
        .alias("recall"),
    )


def conformal_threshold(
    calibration: DataFrame, score: str, p: Params, target_fpr: float = 0.05, target: str = TARGET
) -> DataFrame:
    """(1 - fpr) linear quantile of the scores of negatives, exact and distributed."""
    negatives = calibration.filter(F.col(target) == 0)
    return quantiles(negatives, score, [1 - target_fpr], p).select(
        F.col("quantile").alias("threshold")
    )


def conformal_report(
    calibration: DataFrame, test: DataFrame, score: str, p: Params, target_fpr: float = 0.05,
    target: str = TARGET,
) -> DataFrame:
    tau = conformal_threshold(calibration, score, p, target_fpr, target).scalar()
    ap = average_precision(test, score, p, target).scalar()
    at = test.withColumn("_tau", tau)
    return confusion(at, score, F.col("_tau"), target).select(
        tau.alias("threshold"), F.lit(target_fpr).alias("target_fpr"),
        F.coalesce(F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")), F.lit(0.0))
        .alias("empirical_fpr"),
        "precision", "recall", ap.alias("average_precision"),
    )


def equal_bin(score: str, n_bins: int, edge: str = "lower") -> Column:
    """Bin 0..n-1. ``edge`` says which bin takes a score on an inner edge."""
    s = F.col(score) * n_bins
    b = F.floor(s) if edge == "upper" else F.ceil(s) - 1
    return F.least(F.greatest(b, F.lit(0)), F.lit(n_bins - 1)).cast("int")


def calibration_curve(
    df: DataFrame, score: str, n_bins: int = 10, target: str = TARGET, edge: str = "lower"
) -> DataFrame:
    return _scored(df, score).groupBy(equal_bin(score, n_bins, edge).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
        F.avg(F.col(target).cast("double")).alias("observed"),
    )


def murphy(df: DataFrame, score: str, n_bins: int = 10, target: str = TARGET) -> DataFrame:
    """Reliability - resolution + uncertainty over equal bins; the upper bin takes an edge."""
    bins = calibration_curve(df, score, n_bins, target, "upper")
    # at most n_bins rows from here on
    packed = bins.agg(
        F.collect_list(F.struct("n", "mean_score", "observed")).alias("b"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("observed")).alias("pos"),
    ).withColumn("base", F.col("pos") / F.col("n"))

    def total(term):
        return F.aggregate("b", F.lit(0.0), lambda acc, e: acc + e["n"] * term(e)) / F.col("n")

    return packed.select(
        total(lambda e: (e["mean_score"] - e["observed"]) * (e["mean_score"] - e["observed"])).alias("reliability"),
        total(lambda e: (e["observed"] - F.col("base")) * (e["observed"] - F.col("base"))).alias("resolution"),
        (F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    ).withColumn("brier", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


# ---------------------------------------------------------------- resampling

def log_factorial(k: Column) -> Column:
    """ln k! for k >= 0: Stirling's series at k + 9, moved back by the eight factors between."""
    x = k + 9.0
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    between = sum((F.log(k + float(j)) for j in range(2, 9)), F.log(k + 1.0))
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + series - between


def poisson_weight(n: Column, seed: int, *ids) -> Column:
    """A repeatable Poisson(n) draw for a group of n rows.

    The sum of n Poisson(1) row weights is Poisson(n), so a group of equal
    (score, class) rows needs one draw. For every n the distribution is inverted
    outward from its mode, up and down in turn, in some 12 sqrt(n) steps at most.
    """
    u = hash_uniform(seed, *ids)
    mode = F.floor(n).cast("double")
    start = F.exp(mode * F.log(n) - n - log_factorial(mode))

    def outward(a, i):
        up = a["up"] * n / (mode + i)
        down = F.when(mode - i >= 0, a["down"] * (mode - i + 1) / n).otherwise(0.0)
        found = F.when(a["sum"] + up >= u, mode + i).when(a["sum"] + up + down >= u, mode - i)
        return F.when(a["k"].isNotNull(), a).otherwise(F.struct(
            up.alias("up"), down.alias("down"), (a["sum"] + up + down).alias("sum"), found.alias("k")
        ))

    walked = F.aggregate(
        F.sequence(F.lit(1), F.ceil(12 * F.sqrt(n) + 30).cast("int")),
        F.struct(start.alias("up"), start.alias("down"), start.alias("sum"), F.when(start >= u, mode).alias("k")),
        outward,
    )["k"]
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(F.coalesce(walked, mode).cast("bigint"))


def _interval(draws: DataFrame, value: str, alpha: float) -> list[Column]:
    # one row for each draw: bounded by the number of draws
    return [
        F.percentile(value, F.lit(alpha / 2)).alias("lower"),
        F.percentile(value, F.lit(1 - alpha / 2)).alias("upper"),
        F.count(value).alias("n_draws_used"),
    ]


def _draw_rows(df: DataFrame, **values) -> DataFrame:
    """One row for each draw; a draw without both classes holds null."""
    names = list(values)
    rows = [tuple(None if math.isnan(x) else float(x) for x in row) for row in zip(*values.values())]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def bootstrap_ci(
    df: DataFrame, score: str, p: Params, n_draws: int = 1000, alpha: float = 0.05,
    metric: str = "average_precision", target: str = TARGET,
) -> DataFrame:
    """Row bootstrap of a score-ordered metric: (lower, point, upper, draws used)."""
    points = {"average_precision": average_precision, "roc_auc": roc_auc}
    values = _draw_rows(df, value=row_metrics(score_counts(df, score, target), p, n_draws, metric))
    point = points[metric](df, score, p, target).scalar()
    return values.agg(*_interval(values, "value", alpha)).select(
        F.coalesce("lower", point).alias("lower"), point.alias("point"),
        F.coalesce("upper", point).alias("upper"), "n_draws_used",
    )


def grouped_draw_metrics(
    df: DataFrame, scores: Sequence[str], p: Params, n_draws: int, target: str = TARGET, metric: str = "average_precision"
) -> dict:
    """{score: metric in each draw} of a bootstrap that draws whole vessels; all scores share the draws.

    Rows are reduced to one for each (vessel, model, score) before any draw touches them.
    """
    long = df.select(
        MMSI, target,
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("value")) for s in scores
        ])).alias("_m"),
    ).select(MMSI, target, "_m.model", "_m.value")
    found = vessel_metrics(score_counts(long, "value", target, [MMSI, "model"]), p, n_draws, metric)
    return {s: found.get(s, [math.nan] * n_draws) for s in scores}


def bootstrap_grouped(
    df: DataFrame, score: str, p: Params, n_draws: int = 1000, alpha: float = 0.05, target: str = TARGET
) -> DataFrame:
    """Vessel bootstrap of AP: lower, point, upper, draws used."""
    values = _draw_rows(df, ap=grouped_draw_metrics(df, [score], p, n_draws, target)[score])
    point = average_precision(df, score, p, target).scalar()
    return values.agg(*_interval(values, "ap", alpha)).select(
        "lower", point.alias("point"), "upper", "n_draws_used"
    )


def compare_models(
    df: DataFrame, score_a: str, score_b: str, p: Params, n_draws: int = 1000, target: str = TARGET
) -> DataFrame:
    """Paired vessel bootstrap of AP(a) - AP(b); both models share every draw."""
    found = grouped_draw_metrics(df, [score_a, score_b], p, n_draws, target)
    deltas = _draw_rows(df, a=found[score_a], b=found[score_b]).select((F.col("a") - F.col("b")).alias("delta"))
    out = deltas.agg(
        F.avg("delta").alias("delta_mean"), F.percentile("delta", F.lit(0.025)).alias("ci_lower"),
        F.percentile("delta", F.lit(0.975)).alias("ci_upper"), F.count("delta").alias("n_draws_used"),
    )
    checked = F.when(
        F.col("n_draws_used") == 0, F.raise_error(F.lit("no draw holds both classes"))
    ).otherwise(F.col("ci_lower") > 0)
    return out.withColumn("significant", checked.cast("boolean"))


# ------------------------------------------------------------------ summaries

def lift(df: DataFrame, score: str, p: Params, target: str = TARGET) -> DataFrame:
    m = metrics(df, score, p, target).select(
        "average_precision", "prevalence",
        F.try_divide(F.col("average_precision"), F.col("prevalence")).alias("lift"),
    )
    verdict = F.when(F.col("lift") >= LIFT_GO, "GO").when(F.col("lift") > LIFT_CAUTION, "CAUTION")
    return m.withColumn("verdict", verdict.otherwise("NO-GO"))


def kpis(df: DataFrame, score: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(score) > HIGH_RISK).alias("n_high_risk"),
        F.try_divide(F.count_if(F.col(score) > HIGH_RISK).cast("double"), F.count(F.lit(1))).alias("share_high_risk"),
        F.avg(score).alias("mean_score"),
    )


def vessel_scores(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(MMSI).agg(
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"),
        F.stddev_samp(score).alias("score_std"),
    )


def vessel_validation(df: DataFrame, truth: DataFrame, score: str) -> DataFrame:
    """Per-vessel score summary joined to the known class."""
    return vessel_scores(df, score).join(
        truth.select(MMSI, F.col("is_dark").cast("int").alias("is_dark")), MMSI
    ).filter(F.col("is_dark").isNotNull())


def class_histogram(
    df: DataFrame, feature: str, low: float, high: float, n_bins: int = 20, target: str = TARGET
) -> DataFrame:
    """Count and density of a feature by class; bin 0 and n+1 hold what lies outside."""
    f = F.col(feature)
    inside = F.floor((f - low) / ((high - low) / n_bins)).cast("int") + 1
    b = F.when(f < low, 0).when(f >= high, n_bins + 1).otherwise(inside)
    counts = df.filter(f.isNotNull()).groupBy(F.col(target).alias("class"), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = counts.groupBy("class").agg(F.sum("n").alias("_n"))
    return counts.join(F.broadcast(sizes), "class").select(
        "class", "bin", "n", (F.col("n") / F.col("_n") / ((high - low) / n_bins)).alias("density")
    )


def split_drift(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Per split: rows, positives, speed moments by class, vessels.

    Vessels are reduced first, so the vessel counts need no distinct.
    """
    pos, neg = F.col(target) == 1, F.col(target) == 0
    pieces = []
    for name, cond in (("pos", pos), ("neg", neg)):
        x = F.when(cond, F.col("SOG"))
        pieces += [
            F.count(x).alias(f"n_{name}"), F.sum(x).alias(f"s_{name}"), F.sum(x * x).alias(f"q_{name}")
        ]
    per_vessel = df.groupBy("split", MMSI).agg(F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("p"), *pieces)

    def mean(c):
        return F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}"))

    def std(c):
        n, s, q = F.sum(f"n_{c}"), F.sum(f"s_{c}"), F.sum(f"q_{c}")
        return F.sqrt(F.greatest(F.try_divide(q - s * F.try_divide(s, n), n - 1), F.lit(0.0)))

    return per_vessel.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.sum("p").alias("n_pos"),
        mean("pos").alias("sog_mean_pos"), std("pos").alias("sog_std_pos"),
        mean("neg").alias("sog_mean_neg"), std("neg").alias("sog_std_neg"),
        F.count(F.lit(1)).alias("n_vessels"), F.count_if(F.col("p") > 0).alias("n_vessels_pos"),
    )


def score_summary(df: DataFrame, score: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(score).isNull()).alias("n_null"),
        F.try_divide(F.count_if(F.col(score).isNull()).cast("double"), F.count(F.lit(1))).alias("share_null"),
        F.var_pop(score).alias("variance"), F.avg(score).alias("mean"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    )


def score_gate(df: DataFrame, score: str) -> DataFrame:
    """Return the table, or raise on an all-null or constant score."""
    row = score_summary(df, score).first()
    if row.n_null == row.n_rows:
        raise EvaluationError(f"{score} is null in every row")
    if row.variance <= MIN_VARIANCE:
        raise EvaluationError(f"{score} has variance {row.variance:.3g}")
    return df


def preflight_positives(df: DataFrame, minimum: int = 10, target: str = TARGET) -> DataFrame:
    """Return the table, or raise where positives are too few to learn from."""
    n = df.filter(F.col(target) == 1).limit(minimum).count()
    if n < minimum:
        raise EvaluationError(f"{n} positives; at least {minimum} are needed")
    return df


def metric_table(df: DataFrame, scores: Sequence[str], p: Params, target: str = TARGET) -> DataFrame:
    """Model by metric, in one pass for all models: the model is a key of the score table."""
    long = df.select(
        target,
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("value")) for s in scores
        ])).alias("_m"),
    ).select(target, "_m.model", "_m.value").filter(F.col("value").isNotNull())
    ranked = cumulative_counts(score_counts(long, "value", target, ["model"]), p, ["model"]).groupBy("model").agg(
        ap_expr().alias("average_precision"), auc_expr().alias("roc_auc")
    )
    flat = long.groupBy("model").agg(
        log_loss_expr("value", target).alias("log_loss"), brier_expr("value", target).alias("brier")
    )
    return ranked.join(flat, "model")


def metric_pivot(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each metric, one column for each model."""
    cols = [c for c in table.columns if c != "model"]
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = table.selectExpr("model", f"stack({len(cols)}, {pairs}) as (metric, value)")
    return long.groupBy("metric").pivot("model", list(names)).agg(F.first("value"))


def prevalence_summary(
    df: DataFrame, calibration: DataFrame, score: str, p: Params, target: str = TARGET,
    target_fpr: float = 0.1,
) -> DataFrame:
    """Six headline metrics in one row."""
    best = fbeta_scan(df, score, 2.0, target).select("fbeta").scalar()
    conformal = conformal_report(calibration, df, score, p, target_fpr, target).select("empirical_fpr").scalar()
    return metrics(df, score, p, target).select(
        "average_precision", "roc_auc", "brier", "log_loss",
        best.alias("f2"), conformal.alias("conformal_fpr"),
    )

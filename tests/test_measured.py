"""The measured queries return the numbers of their fits, against plain numpy and on a model of known quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import audit, model
from wakeline.plans import catalog, catalog_model as cm, inputs
from wakeline.plans.inputs import SPARSE


def area(y, s):
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
    return pairs.mean()


def logistic(x, y, other):
    """Newton steps of a class-weighted logistic fit with a unit ridge, intercept free; scores of the other rows."""
    mean, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
    scaled = lambda m: np.c_[np.ones(len(m)), (m - mean) / np.where(spread == 0, 1, spread)]
    a, w = scaled(x), np.where(y == 1, len(y) / 2 / (y == 1).sum(), len(y) / 2 / (y == 0).sum())
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta += np.linalg.solve(a.T * (w * p * (1 - p)) @ a + ridge, a.T @ (w * (y - p)) - ridge @ beta)
    return 1 / (1 + np.exp(-scaled(other) @ beta))


def test_audit_auc(spark, small):
    ready = audit.standardise(audit.audit_sample(inputs.event_pings(spark, small), SPARSE), cm.AUDIT_FEATURES)
    rows = audit.stratified_folds(ready, SPARSE).select("fold", audit.CLASS, *cm.AUDIT_FEATURES).toPandas()
    got = {r.fold: r.roc_auc for r in cm.audit_auc_measured(spark, small).collect()}
    assert len(got) == rows.fold.nunique()
    for fold, found in got.items():
        train, test = rows[rows.fold != fold], rows[rows.fold == fold]
        scores = logistic(train[cm.AUDIT_FEATURES].to_numpy(), train[audit.CLASS].to_numpy(), test[cm.AUDIT_FEATURES].to_numpy())
        assert found == pytest.approx(area(test[audit.CLASS].to_numpy(), scores), abs=5e-3)


def test_logistic_metrics(spark, small):
    train, test = cm._sides(cm._labelled(spark, small))
    names = list(cm.FEATURES_BASELINE)
    part = lambda d: d.fillna(0, names).select(cm.TARGET, *names).toPandas().astype(float)
    train, test = part(train), part(test)
    y = test[cm.TARGET].to_numpy()
    scores = logistic(train[names].to_numpy(), train[cm.TARGET].to_numpy(), test[names].to_numpy())
    got = cm.train_logistic_measured(spark, small).first()
    assert got.n_rows == len(y) and got.prevalence == pytest.approx(y.mean())
    assert got.roc_auc == pytest.approx(area(y, scores), abs=5e-3)
    assert got.brier == pytest.approx(((scores - y) ** 2).mean(), abs=1e-4)


def test_good_and_bad_models_differ(spark, small, monkeypatch):
    """The rows of the SQL forms are alike for both; the measured ones are not."""
    y = F.col("target_dark_fleet")
    rows = spark.range(200).select(F.col("id").alias("MMSI"), (F.col("id") % 5 == 0).cast("int").alias("target_dark_fleet"))
    monkeypatch.setattr(cm, "_enriched", lambda *a: None)
    monkeypatch.setattr(cm, "_sides", lambda *a: (None, None))
    for good, expected in ((0.9, 1.0), (0.1, None)):
        monkeypatch.setattr(model, "ablation_predictions", lambda *a, g=good: rows.withColumn("pred_x", F.when(y == 1, g).otherwise(1 - g)))
        found = cm.ablation_measured(spark, small).first()
        assert cm.ablation(spark, small).select("ap_valid", "brier_valid").first() == (True, True)
        assert (found.average_precision == pytest.approx(1.0)) if expected else found.average_precision < 0.3
        assert found.brier == pytest.approx(0.01 if expected else 0.81)


def test_measured_queries_have_numbers():
    names = ("train_gbt", "train_logistic", "ablation", "gap_sensitivity", "importance", "audit_auc", "audit_verdict")
    assert {f"{n}_measured" for n in names} <= set(catalog.QUERIES)

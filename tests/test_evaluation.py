from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline import Params
from wakeline.operators import evaluation as ev

P = Params()


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(600).selectExpr(
        "id % 20 as MMSI", "cast((id * 31) % 7 = 0 as int) as target_dark_fleet",
        "cast((id * 17) % 41 as double) / 41 as a", "cast((id * 31 % 7) as double) / 10 + 0.05 as b",
    ).persist()


def brute_ap(y, s):
    out, tp, fp = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        pos = int(y[s == v].sum())
        tp, fp = tp + pos, fp + int((s == v).sum()) - pos
        out += tp / (tp + fp) * pos / y.sum()
    return out


def test_metrics_against_brute_force(table):
    pdf = table.toPandas()
    y, s = pdf.target_dark_fleet.to_numpy(), pdf.a.to_numpy()
    m = ev.metrics(table, "a", P).first()
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
    assert m.average_precision == pytest.approx(brute_ap(y, s), abs=1e-12)
    assert m.roc_auc == pytest.approx(pairs.mean(), abs=1e-12)
    assert m.brier == pytest.approx(((s - y) ** 2).mean(), abs=1e-12)


def test_one_class_has_no_auc(table):
    assert ev.roc_auc(table.filter("target_dark_fleet = 0"), "a", P).first()[0] is None


def test_few_ranges_or_many_give_the_same(table):
    a = ev.average_precision(table, "a", replace(P, range_rows=3)).first()[0]
    b = ev.average_precision(table, "a", replace(P, range_rows=10**6)).first()[0]
    assert a == pytest.approx(b, abs=1e-14)


def test_row_bootstrap_covers_the_point(table):
    r = ev.bootstrap_ci(table, "a", P, 60).first()
    assert r.lower < r.point < r.upper and r.n_draws_used == 60


def test_poisson_weights_have_mean_and_variance_n(spark):
    for n in (1.0, 5.0, 100.0):
        r = spark.range(20000).select(ev.poisson_weight(F.lit(n), 3, "id").alias("k")).agg(
            F.avg("k").alias("m"), F.var_samp("k").alias("v")
        ).first()
        assert r.m == pytest.approx(n, rel=0.03) and r.v == pytest.approx(n, rel=0.06)


def test_paired_bootstrap_finds_the_better_model(table):
    better = table.withColumn("b", 1 - F.col("b"))
    r = ev.compare_models(better, "b", "a", P, 30).first()
    assert r.significant and r.delta_mean > 0.5
    with pytest.raises(Exception, match="both classes"):
        ev.compare_models(table.filter("target_dark_fleet = 0"), "a", "b", P, 5).collect()


def test_gates(table):
    with pytest.raises(ev.EvaluationError):
        ev.preflight_positives(table.limit(0))
    with pytest.raises(ev.EvaluationError):
        ev.score_gate(table.withColumn("a", F.lit(0.5)), "a")
    with pytest.raises(ev.EvaluationError):
        ev.score_gate(table.withColumn("a", F.lit(None).cast("double")), "a")


def test_bins_and_edges(spark):
    t = spark.createDataFrame([(0.0, 0), (0.5, 1), (1.0, 1)], "a double, target_dark_fleet int")
    low = {r.bin for r in ev.calibration_curve(t, "a", 2).collect()}
    high = {r.bin: r.n for r in ev.calibration_curve(t, "a", 2, edge="upper").collect()}
    assert low == {0, 1} and high == {0: 1, 1: 2}


def test_fbeta_grid_edges(spark):
    step = 0.98 / 199
    t = spark.createDataFrame([(0.01 + 5 * step, 1), (0.005, 0), (0.999, 1)], "a double, target_dark_fleet int")
    rows = {r.i: r.fbeta for r in ev.fbeta_table(t, "a").collect()}
    grid = 0.01 + np.arange(200) * step
    for i in (0, 4, 5, 6, 199):
        tp = int(0.01 + 5 * step >= grid[i]) + 1
        assert rows[i] == pytest.approx(5 * tp / (5 * tp + 4 * (2 - tp)))


def weighted(y, s, w, metric):
    """A metric of weighted rows, ties as one group."""
    order = np.unique(s)[::-1]
    pos = np.array([w[(s == v) & (y == 1)].sum() for v in order], float)
    neg = np.array([w[(s == v) & (y == 0)].sum() for v in order], float)
    tp, fp = pos.cumsum(), neg.cumsum()
    if not tp[-1] or not fp[-1]:
        return np.nan
    if metric == "roc_auc":
        return (neg * (tp - pos / 2)).sum() / (tp[-1] * fp[-1])
    return (pos[tp + fp > 0] / tp[-1] * tp[tp + fp > 0] / (tp + fp)[tp + fp > 0]).sum()


@pytest.mark.parametrize("metric", ["average_precision", "roc_auc"])
@pytest.mark.parametrize("values, chunk, block", [(2_000_000, 1_000_000, 64_000_000), (300, 90, 64_000_000), (2000, 300, 700)])
def test_vector_draws_equal_drawn_rows(spark, table, metric, values, chunk, block, monkeypatch):
    """Any cut of rows, chunks and draw blocks gives what each draw's own rows give."""
    import hashlib

    from wakeline.operators import draws

    monkeypatch.setattr(draws, "VALUES", values)
    monkeypatch.setattr(draws, "CHUNK", chunk)
    monkeypatch.setattr(draws, "TIMES_BYTES", block)
    n_draws = 30
    got = ev.grouped_draw_metrics(table, ["a"], P, n_draws, metric=metric)["a"]
    pdf = table.toPandas()
    vessels = sorted(pdf.MMSI.unique(), key=lambda v: hashlib.md5(f"{P.seed}-{v}".encode()).hexdigest())
    number = {v: k for k, v in enumerate(vessels)}
    unit, y, s = pdf.MMSI.map(number).to_numpy(), pdf.target_dark_fleet.to_numpy(), pdf.a.to_numpy()
    for d in range(n_draws):
        picks = [int(hashlib.md5(f"{P.seed}-{d}-{i}".encode()).hexdigest()[:15], 16) % len(vessels) for i in range(len(vessels))]
        w = np.bincount(picks, minlength=len(vessels))[unit]
        assert got[d] == pytest.approx(weighted(y, s, w, metric), abs=1e-12, nan_ok=True)


def test_row_draws_repeat_and_spread(table):
    from wakeline.operators.draws import row_metrics

    counts = ev.score_counts(table, "a")
    one, two = (row_metrics(counts, P, 200, "average_precision") for _ in range(2))
    assert (one == two).all() and len(set(one)) > 150
    pdf = table.toPandas()
    point = weighted(pdf.target_dark_fleet.to_numpy(), pdf.a.to_numpy(), np.ones(len(pdf)), "average_precision")
    assert abs(np.mean(one) - point) < 3 * np.std(one)


def test_shuffled_rows_do_not_depend_on_draws(spark, table):
    """Only reduced scores are shuffled: the same exchanges for 10 and for 500 draws."""
    from wakeline.operators import draws

    seen = []
    real = draws.placed
    try:
        draws.placed = lambda cut, parts: seen.append(cut.count()) or real(cut, parts)
        for n in (10, 500):
            draws.VALUES = 100 * n
            ev.bootstrap_grouped(table, "a", P, n)
    finally:
        draws.placed, draws.VALUES = real, 2_000_000
    assert len(seen) == 2 and seen[0] == seen[1]


def test_blocks_of_draws_share_one_arrangement(table, monkeypatch):
    """Rows are shuffled and sorted once for all blocks of draws and both models, and stored packed."""
    from wakeline.operators import draws

    seen, real = [], draws.placed
    monkeypatch.setattr(draws, "placed", lambda cut, parts: seen.append(parts) or real(cut, parts))
    monkeypatch.setattr(draws, "VALUES", 300)
    whole = ev.grouped_draw_metrics(table, ["a", "b"], P, 12)
    assert len(seen) == 1 and seen.pop() > 1
    monkeypatch.setattr(draws, "TIMES_BYTES", 4 * table.select("MMSI").distinct().count())
    parts = ev.grouped_draw_metrics(table, ["a", "b"], P, 12)
    assert len(seen) == 1 and seen[0] > 1
    assert all(np.allclose(whole[s], parts[s], atol=1e-12, equal_nan=True) for s in ("a", "b"))


def test_picks_hash_many_numbers_at_once(spark):
    """Picks made in numpy are those of hash_integer, over changes of length and of a piece."""
    from wakeline.functions.columns import hash_integer, md5_integers

    for start, end in ((0, 120), (9_990, 10_010), (99_999_990, 99_999_999 + 8_200)):
        want = [r[0] for r in spark.range(start, end, 1, 1).select(hash_integer(42, F.lit(7), "id")).collect()]
        assert md5_integers("42-7-", start, end).tolist() == want


def test_draws_of_an_empty_table(table):
    r = ev.bootstrap_ci(table.limit(0), "a", P, 5).first()
    assert r.n_draws_used == 0 and r.point is None
    assert ev.bootstrap_grouped(table.limit(0), "a", P, 5).first().n_draws_used == 0

from dataclasses import replace

import pytest
from conftest import minutes
from pyspark.sql import functions as F

from wakeline import Params
from wakeline.operators import folds, labels
from wakeline.operators.prefix import cumulative, hash_rank, quantiles
from wakeline.plans import inputs

P = Params()
H = 60


def track(*hours):
    return [(1, h * H, 36, 12, 1, 1) for h in hours]


def test_gap_limits_are_closed(make):
    rows = make(track(0, 12, 24 + 24, 24 + 24 + 36.5))
    out = minutes(labels.label_last_ping(rows, P), "target_dark_fleet")
    assert [r[2] for r in out] == [1, 1, 0]


def test_sliding_window_is_open_left_closed_right(make):
    rows = make(track(0, 1, 2, 3, 20))
    out = minutes(labels.label_sliding(rows, P), "target_dark_fleet")
    assert [r[2] for r in out] == [0, 1, 1, 0, 0]


def test_no_gap_no_positive(make):
    rows = make(track(*range(30)))
    assert labels.label_sliding(rows, P).filter("target_dark_fleet = 1").count() == 0


@pytest.mark.parametrize("rows", [3, 150, 20_000])
def test_sliced_labels_equal_plain_windows(spark, small, rows):
    p = replace(inputs.SPARSE, range_rows=rows)
    pings = inputs.event_pings(spark, small)
    a, b = labels.label_sliding(pings, p), labels.label_sliding(pings, p, bounded=True)
    assert a.exceptAll(b).count() == 0


def test_unknown_strategy(make):
    with pytest.raises(ValueError):
        labels.label(make(track(0, 1)), replace(P, labeling="other"))


def test_verdicts(spark):
    sanity = spark.range(1).select(F.lit(5).alias("positives"), F.lit(1000).alias("expected_positives"))
    got = [labels.target_verdict(sanity, n).first().verdict for n in (49, 199, 200)]
    assert got == ["DATA-LIMITED", "OK", "LABELING-BUG"]


@pytest.fixture(scope="module")
def panel(spark):
    rows = spark.range(30 * 60).selectExpr(
        "id div 60 as MMSI",
        "timestamp_micros(1704067200000000L + ((id div 60) * 13 % 24) * 3600000000L + (id % 60) * 21600000000L) as Timestamp",
        "cast(id % 3 = 0 as int) as target_dark_fleet",
    )
    return rows.persist()


def test_group_time_folds(panel):
    p = replace(P, n_splits=5, fold_horizon_hours=240.0)
    out = folds.split_group_time(panel, p).withColumn("us", F.unix_micros("Timestamp"))
    sides = out.groupBy("fold").agg(
        F.collect_set(F.when(F.col("role") == "train", F.col("MMSI"))).alias("t"),
        F.collect_set(F.when(F.col("role") == "valid", F.col("MMSI"))).alias("v"),
        F.max(F.when(F.col("role") == "train", F.col("us"))).alias("te"),
        F.min(F.when(F.col("role") == "valid", F.col("us"))).alias("vs"),
    ).collect()
    assert len(sides) == 5
    seen = []
    for s in sides:
        assert not set(s.t) & set(s.v)
        assert s.vs - s.te >= 24 * 3_600_000_000
        seen += s.v
    assert len(seen) == len(set(seen))
    again = folds.split_group_time(panel.repartition(7), p)
    assert again.exceptAll(out.drop("us")).count() == 0
    with pytest.raises(folds.SplitError):
        folds.check_groups(panel, replace(P, n_splits=31))


def test_holdout_size_is_half_even(panel):
    pool, held, names = folds.holdout_by_vessel(panel, replace(P, holdout_ratio=0.25))
    assert names.count() == 8 and held.select("MMSI").distinct().count() == 8
    assert pool.count() + held.count() == panel.count()


def test_first_seen_reports_no_folds_for_a_common_start(panel):
    same = panel.withColumn("Timestamp", F.date_trunc("year", "Timestamp"))
    assert folds.split_first_seen(same, P).count() == 0


def test_cumulative_and_quantiles(spark):
    t = spark.range(1000).selectExpr("cast(pow(id, 3) as double) as v", "id as w")
    rows = cumulative(t, "v", ["w"], P).orderBy("v").collect()
    assert [r.cum_w for r in rows] == [i * (i + 1) // 2 for i in range(1000)]
    q = {r.level: r.quantile for r in quantiles(t, "w", [0.0, 0.25, 1.0], P).collect()}
    assert q == {0.0: 0.0, 0.25: 249.75, 1.0: 999.0}


def test_hash_rank_is_a_permutation(spark):
    ranks = hash_rank(spark.range(5000), "id", 42).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 5001)) and ranks[0].n == 5000

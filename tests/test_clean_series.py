import math
from dataclasses import replace

import pytest
from conftest import minutes
from pyspark.sql import functions as F

from wakeline import Params
from wakeline.operators import clean, series
from wakeline.plans import inputs, prep

P = Params()


def test_bbox_keeps_only_inside(make):
    df = make([(1, 0, 36, 12, 1, 1), (1, 1, 30, 12, 1, 1), (1, 2, 36, 20, 1, 1), (1, 3, 39, 12, 1, 1)])
    assert len(minutes(clean.bbox_filter(df, P))) == 1


def test_range_filter_drops_nan_and_bad_speed(make):
    df = make([(1, 0, 36, 12, 10, 1), (1, 1, 36, 12, -5, 1), (1, 2, 36, 12, 200, 1), (1, 3, 36, 12, math.nan, 1)])
    assert [r[1] for r in minutes(clean.clean_pings(df, P))] == [0]


def test_dedup_takes_first_in_input_order(make):
    df = make([(1, 0, 36, 12, 7, 1, 5), (1, 0, 36, 12, 9, 1, 2), (1, 0, 36, 12, 8, 1, 9)], seq=True)
    assert [r[2] for r in minutes(clean.dedup_first(df, P), "SOG")] == [9]


def test_last_in_bin(make):
    df = make([(1, 1, 36, 12, 10, 1), (1, 9, 36, 12, 20, 1), (1, 10, 36, 12, 30, 1), (1, 19, 36, 12, 40, 1)])
    assert minutes(series.downsample_last(df, P), "SOG") == [(1, 0, 20), (1, 10, 40)]
    late = series.downsample_last(df, replace(P, bin_label="end"))
    assert [r[1] for r in minutes(late)] == [10, 20]


def test_any_input_order_fits(make):
    high = 10**15
    df = make([(1, 1, 36, 12, 10, 1, high), (1, 1, 36, 12, 20, 1, high + 1), (1, 0, 36, 12, 30, 1, high + 2)], seq=True)
    assert minutes(series.downsample_last(df, P), "SOG") == [(1, 0, 20)]
    assert minutes(series.downsample_last(df, P, first_of_equal=True), "SOG") == [(1, 0, 10)]


def test_downsampling_sorts_no_raw_row(make):
    df = make([(1, 1, 36, 12, 10, 1, 1)], seq=True)
    plan = series.downsample_last(df, P)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_course_wraps_and_first_row_is_zero(make):
    df = make([(1, 0, 36, 12, 10, 350), (1, 60, 36, 12, 14, 10), (2, 0, 36, 12, 1, 1)])
    out = minutes(series.kinematic_features(df, P), "delta_COG", "speed_acc", "dt_prev_hours")
    assert out == [(1, 0, 0, 0, 0), (1, 60, 20, 4, 1), (2, 0, 0, 0, 0)]


def test_clip_keeps_null_apart(make):
    df = make([(1, 0, 36, 12, 0, 0), (1, 1, 36, 12, 50, 90)])
    out = minutes(series.kinematic_features(df, P), "speed_acc", "turn_rate")
    assert out[1][2:] == (15.0, 180.0)


@pytest.mark.parametrize("rows", [3, 150, 20_000])
def test_slices_equal_plain_windows(spark, small, rows):
    p = replace(inputs.SPARSE, range_rows=rows)
    pings = inputs.event_pings(spark, small)
    a = series.kinematic_features(pings, p)
    b = series.kinematic_features(pings, p, bounded=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_features_do_not_see_the_future(spark, small):
    pings = inputs.event_pings(spark, small).drop("ping_seq")
    cut = F.lit("2024-01-15").cast("timestamp")
    whole = series.kinematic_features(pings, P).filter(F.col("Timestamp") < cut)
    part = series.kinematic_features(pings.filter(F.col("Timestamp") < cut), P)
    assert whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0


def test_fused_prep_equals_step_by_step(spark):
    pings = inputs.item_pings(spark, "/root/testdata/sf0.001")
    p = inputs.ITEMS
    fused = prep.downsampled_table(pings, p)
    steps = series.downsample_last(clean.clean_pings(clean.bbox_filter(pings, p), p), p)
    assert fused.exceptAll(steps).count() == 0 and steps.exceptAll(fused).count() == 0
    plain = prep.downsampled_table(pings.drop("ping_seq"), p)
    other = series.downsample_last(clean.clean_pings(clean.bbox_filter(pings.drop("ping_seq"), p), p), p)
    assert plain.exceptAll(other).count() == 0 and plain.count() == fused.count()


def test_row_order_and_partitions_do_not_matter(spark, small):
    pings = inputs.event_pings(spark, small)
    a = prep.feature_table(pings, inputs.SPARSE)
    b = prep.feature_table(pings.orderBy(F.rand(1)).repartition(13), inputs.SPARSE)
    assert a.exceptAll(b).count() == 0


def test_prep_shuffles_bins_once_and_vessels_once(spark, small):
    df = prep.labelled_table(inputs.event_pings(spark, small), inputs.SPARSE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_quality_gate(make):
    bad = make([(1, 0, 36, 12, 1, 1), (1, 0, 36, 12, 2, 2)]).withColumn("target_dark_fleet", F.lit(1))
    with pytest.raises(clean.QualityError):
        clean.quality_gate(bad)
    clean.quality_gate(bad.limit(1))


def test_ids(spark):
    df = spark.createDataFrame([("1.0",), ("x",), (None,), ("7",)], "mmsi string")
    assert sorted(r.MMSI for r in clean.normalise_mmsi(df).collect()) == [1, 7]
    with pytest.raises(KeyError):
        clean.alias_columns(df.withColumnRenamed("mmsi", "ship"))
    floats = spark.createDataFrame([(1.0,), (2.0,)], "MMSI double")
    assert clean.id_type_check(floats).first().issue.startswith("CRITICAL")
    assert clean.feature_columns(df.withColumn("SOG", F.lit(1.0))) == ["SOG"]


def test_params_are_checked():
    with pytest.raises(ValueError):
        Params(bin_minutes=7)
    with pytest.raises(ValueError):
        Params(bin_label="middle")

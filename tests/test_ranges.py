"""Ranges by sampled splitters: even whatever the keys, and without effect on results."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import folds, labels, prefix, series, slices
from wakeline.operators.markov import DENOMINATOR_GUARD, _filtered, _replay, markov_filter
from wakeline.operators.ranges import RANGE, SPANS, placed, with_range
from wakeline.params import Params

START = 1_704_067_200_000_000
P = Params(range_rows=50)


def even(rows, most=2.0):
    """Rows of the largest partition are at most ``most`` times the mean of those that may hold rows."""
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return len(sizes) == parts and max(sizes) <= most * sum(sizes) / parts


@pytest.fixture
def many(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", held)


@pytest.fixture
def hot_track(many):
    """A third of 60,000 rows belongs to one vessel and lies in one hour."""
    hot = F.col("id") % 3 == 0
    us = F.when(hot, F.col("id") * 59_999).otherwise(F.col("id") * 7_777_777)
    return many.range(60_000).select(
        F.when(hot, F.lit(7)).otherwise(100 + F.col("id") % 1500).alias("MMSI"),
        F.timestamp_micros(F.lit(START) + us).alias("Timestamp"), F.col("id").alias("ping_seq"),
        (F.col("id") % 47).cast("double").alias("SOG"), (F.col("id") * 13 % 360).cast("double").alias("COG"),
        F.lit(36.0).alias("Lat"), F.lit(12.0).alias("Lon"),
    )


def test_a_hot_hour_is_spread(hot_track):
    rows = slices.by_track(hot_track, P)
    assert even(rows)
    assert rows.filter("MMSI = 7").select(RANGE).distinct().count() >= 8
    cut = rows.filter(SPANS).select("MMSI", RANGE).distinct()
    assert cut.count() <= 2 * 24  # what is broadcast


def test_a_hot_hour_changes_no_result(hot_track):
    for make in (
        lambda b: series.kinematic_features(hot_track, P, bounded=b),
        lambda b: series.gap_to_next(hot_track, P, bounded=b),
        lambda b: slices.positions(hot_track, P, bounded=b),
        lambda b: labels.label_sliding(hot_track, replace(P, gap_hours=1.0), bounded=b),
    ):
        cut, plain = make(False), make(True)
        assert cut.columns == plain.columns
        assert cut.exceptAll(plain).count() == 0 and plain.exceptAll(cut).count() == 0


def test_a_small_table_keeps_the_plain_plan(hot_track):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cut = plan(series.gap_to_next(hot_track, Params()))
    assert "Broadcast" not in cut and "shufflepartitionid" not in cut and cut.count("Exchange") == 1
    assert "MMSI" in cut.split("Exchange ")[1].split("\n")[0]


def test_rows_are_shuffled_once_by_range(hot_track):
    plan = series.kinematic_features(hot_track, P)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    plan = labels.label_sliding(hot_track, P)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(MMSI" not in plan.split("BroadcastExchange")[0]


def tied_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(12), k, rng.random() < 0.15) for k in range(n)]


@pytest.mark.parametrize("rows", [2, 7, 40, 5000])
def test_next_time_is_strict_across_ranges(spark, rows):
    table = tied_rows(400, rows)
    frame = spark.createDataFrame(table, "MMSI bigint, t bigint, ping_seq bigint, hit boolean").withColumn(
        "Timestamp", F.timestamp_micros("t"))
    got = {r.ping_seq: r.nxt for r in slices.next_time(frame, replace(P, range_rows=rows), F.col("hit"), "nxt").collect()}
    for vessel, t, seq, _ in table:
        later = [u for v, u, _, hit in table if v == vessel and hit and u > t]
        assert got[seq] == (min(later) if later else None)


@pytest.mark.parametrize("rows", [2, 7, 5000])
def test_neighbours_and_positions_with_ties(spark, rows):
    table = [r for r in tied_rows(400, 50 + rows) if r[0] is not None]
    frame = spark.createDataFrame(table, "MMSI bigint, t bigint, ping_seq bigint, hit boolean").withColumn(
        "Timestamp", F.timestamp_micros("t"))
    p = replace(P, range_rows=rows)
    near = slices.neighbours(frame.withColumn("s", F.col("ping_seq")), p, prev={"before": "ping_seq"}, nxt={"after": "s"})
    got = {r.t * 10_000 + r.MMSI * 1000 + (r.before if r.before is not None else 999): r for r in near.collect()}
    assert len(got) == len({(r.t, r.MMSI, r.before) for r in got.values()})
    place = {r.ping_seq: (r.rn, r.n) for r in slices.positions(frame, p).collect()}
    pairs = {(r.MMSI, r.before, r.after) for r in got.values()}
    for vessel in (1, 2, 3):
        track = [seq for v, t, seq, _ in sorted(table, key=lambda r: (r[1], r[2])) if v == vessel]
        for k, seq in enumerate(track):
            assert place[seq] == (k + 1, len(track))
        around = list(zip([None, *track[:-1]], [*track[1:], None]))
        assert {(vessel, a, b) for a, b in around} <= pairs


def test_a_hot_minute_of_the_row_index_is_spread(many):
    """A third of the rows shares one time stamp."""
    rows = many.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") * 37 % 100_003).alias("us"),
        (F.col("id") % 11).alias("MMSI"), (F.col("id") * 7919 % 30_011).alias("ping_seq"))
    cut = placed(*with_range(rows.withColumn("_tie", F.lit(0)), ["us", "MMSI", "ping_seq", "_tie"], P))
    assert even(cut)
    found = prefix.global_row_index(rows, "us", ["MMSI", "ping_seq"], P).collect()
    assert len(found) == 30_000
    for k, r in enumerate(sorted(found, key=lambda r: (r.us, r.MMSI, r.ping_seq))):
        assert r.row_index == k


def test_row_index_of_a_small_and_an_empty_table(spark):
    rows = spark.createDataFrame([(3, 1), (1, 2), (1, 1)], "us bigint, MMSI bigint")
    assert {(r.us, r.MMSI): r.row_index for r in prefix.global_row_index(rows, "us", ["MMSI"], Params()).collect()} == {
        (1, 1): 0, (1, 2): 1, (3, 1): 2}
    assert prefix.global_row_index(rows.limit(0), "us", ["MMSI"], Params()).count() == 0


def test_positional_folds_use_the_input_order(many):
    rows = many.range(3000).selectExpr("1 as MMSI", "timestamp_micros(id div 500) as Timestamp", "3000 - id as ping_seq")
    found = {r.ping_seq: r.row_index for r in folds.split_positional(rows, P).collect()}
    order = sorted(range(3000), key=lambda k: (k // 500, 3000 - k))
    assert all(found[3000 - k] == at for at, k in enumerate(order))


def test_a_narrow_column_in_a_pooled_table_gets_its_share(many):
    """Most values of one key lie in a span of a millionth of the other's."""
    wide = many.range(400_000).select(F.lit("wide").alias("k"), (F.col("id") * 1e9).alias("v"), F.lit(1).alias("w"))
    narrow = many.range(800_000).select(F.lit("narrow").alias("k"), (5e12 + F.col("id") * 1e-3).alias("v"), F.lit(2).alias("w"))
    table = wide.unionByName(narrow)
    assert even(placed(*with_range(table, ["k", "v"], P, 1)))
    for down in (False, True):
        ranked = prefix.cumulative(table, "v", ["w"], P, ["k"], down)
        at = F.when(F.col("k") == "wide", F.round(F.col("v") / 1e9)).otherwise(F.round((F.col("v") - 5e12) * 1e3))
        each = F.when(F.col("k") == "wide", 1).otherwise(2)
        n = F.when(F.col("k") == "wide", 400_000).otherwise(800_000)
        cum = each * ((n - at) if down else (at + 1))
        assert ranked.filter((F.col("cum_w") != cum) | (F.col("total_w") != each * n)).count() == 0
        assert ranked.count() == 1_200_000


def test_cumulative_with_null_keys_and_values(spark):
    table = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 1), (1, None, 5), (1, math.nan, 7), (1, 0.0, 3)], "k int, v double, w int")
    for rows in (1, 100):
        got = {(r.k, str(r.v)): (r.cum_w, r.total_w) for r in prefix.cumulative(table, "v", ["w"], replace(P, range_rows=rows), ["k"]).collect()}
        assert got == {(None, "1.0"): (1, 2), (None, "2.0"): (2, 2), (1, "None"): (5, 15), (1, "0.0"): (8, 15), (1, "nan"): (15, 15)}


def chains(seed, n):
    rng = np.random.default_rng(seed)
    vessel = np.sort(rng.integers(0, max(2, n // 90), n))
    q = rng.random(n)
    q[rng.random(n) < 0.2] = np.nan
    q[rng.random(n) < 0.05] = 0.0
    q[rng.random(n) < 0.05] = 1.0
    return vessel, q


@pytest.mark.parametrize("p00, p11", [(0.85, 0.85), (0.99, 0.6), (0.05, 0.3), (1.0, 1.0), (0.0, 0.4)])
@pytest.mark.parametrize("lot", [1, 7, 1000])
def test_scan_equals_the_plain_filter(p00, p11, lot):
    vessel, q = chains(3, 2000)
    last, got = (None, np.nan), []
    for k in range(0, len(q), lot):
        part = slice(k, k + lot)
        values, last = _filtered(q[part], vessel[part], np.full(len(q[part]), np.nan), last, p00, p11)
        got += list(values)
    want = []
    for v in np.unique(vessel):
        want += _replay([None if np.isnan(x) else x for x in q[vessel == v]], None, p00, p11)
    assert np.allclose(np.array(got), np.array([np.nan if w is None else w for w in want]), rtol=0, atol=1e-9, equal_nan=True)
    assert DENOMINATOR_GUARD < 1e-9


def test_a_carried_state_goes_on(spark):
    vessel, q = chains(5, 900)
    whole, _ = _filtered(q, vessel, np.full(900, np.nan), (None, np.nan), 0.8, 0.7)
    for cut in (1, 300, 455, 899):
        head, last = _filtered(q[:cut], vessel[:cut], np.full(cut, np.nan), (None, np.nan), 0.8, 0.7)
        carry = np.where(vessel[cut:] == last[0], last[1], np.nan)
        tail, _ = _filtered(q[cut:], vessel[cut:], carry, (None, np.nan), 0.8, 0.7)
        assert np.allclose(np.r_[head, tail], whole, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("rows", [2, 30, 700, 10**6])
def test_filter_across_ranges(spark, rows):
    rng = random.Random(rows)
    table = [(rng.choice([1, 1, 1, 1, 2, 3]), k * 1000, None if rng.random() < 0.5 else rng.random()) for k in range(1500)]
    frame = spark.createDataFrame(table, "MMSI bigint, t bigint, prob_regime_sospetto double").withColumn(
        "Timestamp", F.timestamp_micros("t"))
    got = {(r.MMSI, r.t): r.prob_regime_markov for r in markov_filter(frame, replace(P, range_rows=rows)).collect()}
    for vessel in (1, 2, 3):
        track = [(t, q) for v, t, q in table if v == vessel]
        for (t, _), s in zip(track, _replay([q for _, q in track], None, 0.85, 0.85)):
            assert (got[vessel, t] is None) == (s is None) and (s is None or got[vessel, t] == pytest.approx(s, abs=1e-9))

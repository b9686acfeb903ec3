"""Results don't depend on how long a key is, how large a number is, or how a column is spelt."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import audit, bayes, clean, evaluation
from wakeline.operators.regime import SPEED, TURN
from wakeline.params import Params
from wakeline.sources import pings, sinks

P = Params()


def test_long_and_short_keys_fit_alike(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, 3500), rng.normal(3, 2, 1500)])
    rows = [(1, int(t), float(a), float(b)) for t, (a, b) in enumerate(zip(x, rng.normal(0, 1, 5000)))]
    table = spark.createDataFrame(rows, f"MMSI bigint, t bigint, {SPEED} double, {TURN} double").repartition(4)
    prior = bayes.pilot_prior(1.0, 2.0)
    short, long = (
        bayes.fit_mixture(table, ["MMSI"], replace(P, group_rows=n), prior).first() for n in (200_000, 100)
    )
    for name in bayes.PARAMETERS:
        assert long[name] == pytest.approx(short[name], abs=1e-8)


@pytest.mark.parametrize("n", [0.5, 3, 60, 64, 65, 70, 1000, 20_000])
def test_poisson_draws(spark, n):
    draws = spark.range(20_000).select(evaluation.poisson_weight(F.lit(float(n)), 3, "id").alias("k"))
    mean, var, skew = draws.agg(F.avg("k"), F.var_samp("k"), F.skewness("k")).first()
    assert mean == pytest.approx(n, abs=5 * (n / 20_000) ** 0.5)
    assert var == pytest.approx(n, rel=0.08)
    assert skew == pytest.approx(n**-0.5, abs=max(0.09, 0.15 * n**-0.5))  # some four standard errors


def test_null_ids_go(spark):
    rows = spark.createDataFrame([(None, 1), (5, 2)], "MMSI bigint, x int")
    assert [r.x for r in clean.normalise_mmsi(rows).collect()] == [2]


def test_aliases_are_typed(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Mmsi,BaseDateTime,Lat\n7,2024-01-02 03:04:05,36.5\nbad,2024-01-02 03:04:06,36.5\n")
    table, used = pings.scan_first(spark, [str(tmp_path / "none.csv"), str(path)])
    assert used == str(path) and dict(table.dtypes) == {"MMSI": "bigint", "Timestamp": "timestamp", "Lat": "double"}
    assert [r.MMSI for r in table.collect()] == [7]


def test_geometry_of_two_files_and_by_line(spark, tmp_path):
    square = '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}'
    for name in ("a", "b"):
        (tmp_path / f"{name}.geojson").write_text('{"features": [{"geometry": %s}]}' % square)
    both = pings.read_geojson(spark, str(tmp_path / "*.geojson"), "land")
    assert both.count() == 6 and both.select("geom_id").distinct().count() == 2
    lines = tmp_path / "c.ndjson"
    lines.write_text('{"geometry": %s}\n{"geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 2]]}}\n' % square)
    assert sorted(r["count"] for r in pings.read_geojson(spark, str(lines), "land", by_line=True).groupBy("geom_id").count().collect()) == [1, 3]


def test_time_range_reads_its_folders(spark, tmp_path):
    rows = spark.range(240).selectExpr("id % 3 as MMSI", "timestamp_micros(1704067200000000L + id * 3600000000L) as Timestamp")
    path = sinks.write_table(rows, str(tmp_path / "t"))
    part = sinks.read_table(spark, path, "2024-01-03 06:00:00", "2024-01-04 12:00:00")
    assert part.count() == 30
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().executedPlan().toString()


def test_folds_hold_every_class(spark):
    rows = spark.range(200).selectExpr(
        "id as MMSI", "timestamp_micros(id) as Timestamp", "cast(id % 40 = 0 as int) as is_last")
    found = audit.stratified_folds(rows, P).groupBy("fold", "is_last").count().collect()
    assert {(r["fold"], r["is_last"], r["count"]) for r in found} == {(0, 1, 3), (1, 1, 2), (0, 0, 98), (1, 0, 97)}


def test_eligible_vessels_count_before_controls(spark):
    hours = [(1, 0), (1, 20), (2, 0), (2, 1), (2, 30), (3, 0), (3, 50)]
    rows = spark.createDataFrame(hours, "MMSI bigint, h int").selectExpr(
        "MMSI", "timestamp_micros(1704067200000000L + h * 3600000000L) as Timestamp")
    counts = audit.audit_counts(audit.audit_sample(rows, P), audit.eligible(rows, P)).first()
    assert counts.n_eligible_vessels == 3 and counts.status == "READY"


def test_files_are_even_on_a_skewed_table(spark, tmp_path):
    """Days of 100 to 40,000 rows, one vessel and one minute holding half of the largest."""
    import glob
    import os

    rows = spark.range(60_000).selectExpr(
        "case when id < 40000 then 0 else 1 + id % 9 end as d", "id", "cast(id % 977 as double) as SOG",
        "case when id < 20000 then 5 else id % 40 end as MMSI",
    ).selectExpr(
        "MMSI", "SOG", "id as ping_seq",
        "timestamp_micros(1704067200000000L + d * 86400000000L + case when id < 20000 then 7 else id end * 1000000L) as Timestamp")
    path = sinks.write_table(rows, str(tmp_path / "t"), rows_per_file=1000)
    sizes = {}
    for f in glob.glob(f"{path}/date=*/*.parquet"):
        sizes.setdefault(os.path.basename(os.path.dirname(f)), []).append(spark.read.parquet(f).count())
    assert len(sizes) == 10 and sum(map(sum, sizes.values())) == 60_000
    assert len(sizes["date=2024-01-01"]) == 40
    assert all(500 <= n <= 2000 for files in sizes.values() for n in files)
    one = spark.read.parquet(glob.glob(f"{path}/date=2024-01-01/*.parquet")[0]).select("Timestamp").collect()
    assert [r[0] for r in one] == sorted(r[0] for r in one)
    back = spark.read.parquet(path).select(rows.columns)
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
    assert sinks.read_table(spark, sinks.write_table(rows.limit(0), str(tmp_path / "e"))).count() == 0

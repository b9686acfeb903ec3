"""Queries on sources, cleaning, series and labels."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from wakeline.functions.columns import micros, wrap_course
from wakeline.operators import clean, incremental, labels, series
from wakeline.operators.folds import holdout_vessels
from wakeline.params import KINEMATICS, MMSI, TARGET
from wakeline.plans import inputs, prep, reports
from wakeline.plans.catalog import query, rounded, with_ctes
from wakeline.plans.inputs import SPARSE
from wakeline.plans.sqlparts import (
    DIRTY, FEATURES, GAPS, ITEMS, LASTLABEL, PINGS, SLIDELABEL, VESSELS, binned, first_rows, kept, wrap,
)
from wakeline.sources import pings as sources, sinks



def us_col():
    return micros().alias("us")


def ping_cols():
    return ["ping_seq", MMSI, us_col(), "Lat", "Lon", "SOG", "COG"]


PING_SQL = "ping_seq, MMSI, us, round(Lat, 6) as Lat, round(Lon, 6) as Lon, round(SOG, 6) as SOG, round(COG, 6) as COG"


def shared_folder(spark, name: str) -> str:
    """A new folder next to the checkpoints, which all executors can reach."""
    inputs.prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources

@query("scan_pings", with_ctes(PINGS) + f"select {PING_SQL} from pings")
def scan_pings(spark, folder):
    return rounded(inputs.event_pings(spark, folder).select(*ping_cols()))


@query("sink_parquet", with_ctes(PINGS) + """
select strftime(make_timestamp(us), '%Y-%m-%d') as date, ping_seq, MMSI, us, Lat, Lon, SOG, COG from pings""")
def sink_parquet(spark, folder):
    """Every value as it is read back, and the folder it was read from."""
    path = sinks.write_table(inputs.event_pings(spark, folder), shared_folder(spark, "pings"), rows_per_file=500)
    back = spark.read.parquet(path)
    return back.select(F.col("date").cast("string").alias("date"), "ping_seq", MMSI, us_col(), "Lat", "Lon", "SOG", "COG")


@query("sink_report", with_ctes(PINGS, GAPS) + """
select sum((gap_h >= 12.0)::INTEGER)::BIGINT as n_gaps_ge_threshold,
  count(distinct case when gap_h >= 12.0 then MMSI end) as n_vessels_with_gap from gaps""")
def sink_report(spark, folder):
    path = sinks.write_report(series.gap_events(inputs.event_pings(spark, folder), SPARSE), shared_folder(spark, "report"))
    return spark.read.schema("n_gaps_ge_threshold long, n_vessels_with_gap long").json(path)


@query("truth_explode", """
select distinct 200000000::BIGINT + user_id as MMSI, (200000000 + user_id) % 3 = 0 as is_dark,
  ((200000000 + user_id) % 5)::INTEGER as n_blackouts from events""")
def truth_explode(spark, folder):
    return sources.truth_explode(inputs.truth(spark, folder)).select(MMSI, "is_dark", "n_blackouts")


RINGS_SQL = """
tri as (
  select s_suppkey as geom_id, 10.5::DOUBLE + (s_suppkey * 7919 % 600)::DOUBLE / 100.0::DOUBLE as x,
    34.5::DOUBLE + (s_suppkey * 104729 % 450)::DOUBLE / 100.0::DOUBLE as y,
    0.02::DOUBLE + (s_suppkey % 7)::DOUBLE / 50.0::DOUBLE as z from supplier),
edges as (
  select geom_id, x as x1, y as y1, x + z as x2, y as y2 from tri
  union all select geom_id, x + z, y, x + z / 2, y + z from tri
  union all select geom_id, x + z / 2, y + z, x, y from tri)"""


@query("edges_from_geojson", with_ctes(RINGS_SQL) + """
select 'land' as layer, 0 as ring, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from edges""")
def edges_from_geojson(spark, folder):
    """Rings written as one GeoJSON feature for each line, then read and parsed."""
    path = shared_folder(spark, "geojson")
    ring = F.struct(F.lit("Polygon").alias("type"), F.array("pts").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), ring.alias("geometry")))
    inputs.coast_rings(spark, folder).select(feature.alias("value")).write.text(path)
    return rounded(sources.read_geojson(spark, path, "land", by_line=True).select("layer", "ring", "x1", "y1", "x2", "y2"))


# ----------------------------------------------------------------- cleaning

@query("norm_mmsi", with_ctes(PINGS, DIRTY) + """
select ping_seq, try_cast(try_cast(id_text as DOUBLE) as BIGINT) as MMSI from dirty
where try_cast(id_text as DOUBLE) is not null""")
def norm_mmsi(spark, folder):
    return clean.normalise_mmsi(inputs.dirty_ids(spark, folder)).select("ping_seq", MMSI)


@query("norm_mmsi_counts", with_ctes(PINGS, DIRTY) + """
select count(*) as n_rows, sum((try_cast(id_text as DOUBLE) is null)::INTEGER)::BIGINT as n_dropped from dirty""")
def norm_mmsi_counts(spark, folder):
    return clean.count_bad_mmsi(inputs.dirty_ids(spark, folder))


@query("alias_columns", with_ctes(PINGS) + "select ping_seq, MMSI, us from pings")
def alias_columns(spark, folder):
    odd = inputs.event_pings(spark, folder).withColumnRenamed(MMSI, "Mmsi").withColumnRenamed("Timestamp", "BaseDateTime")
    return clean.alias_columns(odd).select("ping_seq", MMSI, us_col())


@query("bbox_filter", with_ctes(PINGS) + f"""
select {PING_SQL} from pings where Lat between 35.0 and 38.0 and Lon between 11.0 and 15.5""")
def bbox_filter(spark, folder):
    return rounded(clean.bbox_filter(inputs.event_pings(spark, folder), SPARSE).select(*ping_cols()))


@query("range_filter", with_ctes(PINGS) + f"""
select {PING_SQL} from pings where SOG between 0 and 50 and COG between 0 and 360""")
def range_filter(spark, folder):
    return rounded(clean.range_filter(inputs.event_pings(spark, folder), SPARSE).select(*ping_cols()))


@query("dedup_first", with_ctes(ITEMS, first_rows("items")) + f"select {PING_SQL} from firsts")
def dedup_first(spark, folder):
    return rounded(clean.dedup_first(inputs.item_pings(spark, folder), SPARSE).select(*ping_cols()))


@query("drop_nonfinite", with_ctes(PINGS, DIRTY) + """
select ping_seq, round(Lat, 6) as Lat, round(Lon, 6) as Lon, round(SOG, 6) as SOG, round(COG, 6) as COG from dirty
where isfinite(Lat) and isfinite(Lon) and isfinite(SOG) and isfinite(COG)""")
def drop_nonfinite(spark, folder):
    return rounded(clean.drop_nonfinite(inputs.dirty_pings(spark, folder)).select("ping_seq", "Lat", "Lon", "SOG", "COG"))


CLEAN_SQL = (ITEMS, """
ranged as (select * from items where SOG between 0 and 50 and COG between 0 and 360)""", first_rows("ranged"))


@query("clean_pings", with_ctes(*CLEAN_SQL) + f"select {PING_SQL} from firsts")
def clean_pings(spark, folder):
    return rounded(clean.clean_pings(inputs.item_pings(spark, folder), SPARSE).select(*ping_cols()))


@query("clean_counts", with_ctes(*CLEAN_SQL) + """
select a.n as n_before, b.n as n_after, a.n - b.n as n_removed, round((a.n - b.n)::DOUBLE / a.n, 6) as removed_share
from (select count(*) as n from items) a, (select count(*) as n from firsts) b""")
def clean_counts(spark, folder):
    before = inputs.item_pings(spark, folder)
    return rounded(clean.clean_counts(before, clean.clean_pings(before, SPARSE)))


@query("quality_gate", with_ctes(ITEMS) + """
select count(*) as n_rows, (count(*) - count(distinct (MMSI, us))) as n_duplicate_keys,
  sum((ping_seq % 11 = 0)::INTEGER)::BIGINT as n_null_targets from items""")
def quality_gate(spark, folder):
    rows = inputs.item_pings(spark, folder)
    return clean.quality_counts(rows.withColumn(TARGET, F.when(F.col("ping_seq") % 11 != 0, 1)))


@query("model_rows", with_ctes(PINGS, DIRTY) + """
select ping_seq as MMSI, us, SOG, COG, (ping_seq % 2)::INTEGER as y from (
  select ping_seq, us, case when isnan(SOG) then null else round(SOG, 6) end as SOG, round(COG, 6) as COG from dirty)
where SOG is not null and COG is not null and ping_seq % 13 <> 0""")
def model_rows(spark, folder):
    rows = inputs.dirty_pings(spark, folder).withColumn(MMSI, F.col("ping_seq")).withColumn(
        TARGET, F.when(F.col("ping_seq") % 13 != 0, (F.col("ping_seq") % 2).cast("int"))
    )
    out = clean.model_rows(rows, ["SOG", "COG"])
    return rounded(out.select(MMSI, us_col(), "SOG", "COG", F.col(TARGET).alias("y")))


@query("id_type_check", with_ctes(PINGS, DIRTY) + """
select 'string' as dtype, count(*) as n_rows, sum((id_text is null)::INTEGER)::BIGINT as n_null,
  sum((try_cast(id_text as DOUBLE) is null)::INTEGER)::BIGINT as n_not_numeric,
  sum((try_cast(id_text as DOUBLE) <> floor(try_cast(id_text as DOUBLE)))::INTEGER)::BIGINT as n_not_whole,
  min(id_text) as sample_min, max(id_text) as sample_max, 'CRITICAL: mixed identifier values' as issue from dirty""")
def id_type_check(spark, folder):
    return clean.id_type_check(inputs.dirty_ids(spark, folder), "mmsi")


@query("tag_split", with_ctes(PINGS, VESSELS) + """
select ping_seq, p.MMSI, case when rank <= greatest(1, round_even(n * 0.2, 0)) then 'test' else 'train' end as split
from pings p join vessels using (MMSI)""")
def tag_split(spark, folder):
    rows = inputs.event_pings(spark, folder)
    return clean.tag_split(rows, holdout_vessels(rows, SPARSE), SPARSE).select("ping_seq", MMSI, "split")


@query("feature_columns", with_ctes(*FEATURES) + """
select count(*) as n_rows, round(sum(SOG + COG + dt_prev_hours + delta_SOG + delta_COG + speed_acc + turn_rate + Lat + Lon), 3) as total
from feats""")
def feature_columns(spark, folder):
    table = inputs.features(spark, folder)
    names = clean.feature_columns(table)
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(total), 3).alias("total"))


# ------------------------------------------------------------------- series

@query("downsample_last", with_ctes(ITEMS, binned("items")) + """
select MMSI, us, round(Lat, 6) as Lat, round(Lon, 6) as Lon, round(SOG, 6) as SOG, round(COG, 6) as COG from binned""")
def downsample_last(spark, folder):
    out = series.downsample_last(inputs.item_pings(spark, folder), inputs.ITEMS)
    return rounded(out.select(MMSI, us_col(), "Lat", "Lon", "SOG", "COG"))


@query("downsample_last_column", with_ctes(PINGS, DIRTY, """
d as (select *, try_cast(try_cast(id_text as DOUBLE) as BIGINT) as MMSI, us - us % 21600000000 as b,
  case when isfinite(Lat) then Lat end as la, case when isfinite(Lon) then Lon end as lo,
  case when isfinite(SOG) then SOG end as s, case when isfinite(COG) then COG end as c from dirty),
g as (select MMSI, b as us, arg_max(la, us) filter (la is not null) as Lat, arg_max(lo, us) filter (lo is not null) as Lon,
  arg_max(s, us) filter (s is not null) as SOG, arg_max(c, us) filter (c is not null) as COG
  from d where MMSI is not null group by 1, 2)""") + """
select MMSI, us, round(Lat, 6) as Lat, round(Lon, 6) as Lon, round(SOG, 6) as SOG, round(COG, 6) as COG from g
where Lat is not null and Lon is not null and SOG is not null and COG is not null""")
def downsample_last_column(spark, folder):
    from wakeline.functions.columns import finite

    rows = clean.normalise_mmsi(inputs.dirty_ids(spark, folder))
    rows = rows.withColumns({c: finite(c) for c in ("Lat", "Lon", "SOG", "COG")})
    return rounded(series.downsample_last(rows, SPARSE).select(MMSI, us_col(), "Lat", "Lon", "SOG", "COG"))


@query("prep_downsampled", with_ctes(ITEMS, kept("items"), first_rows("kept"), binned("firsts")) + """
select MMSI, us, round(Lat, 6) as Lat, round(Lon, 6) as Lon, round(SOG, 6) as SOG, round(COG, 6) as COG from binned""")
def prep_downsampled(spark, folder):
    out = prep.downsampled_table(inputs.item_pings(spark, folder), inputs.ITEMS)
    return rounded(out.select(MMSI, us_col(), "Lat", "Lon", "SOG", "COG"))


@query("time_diff_min", with_ctes(PINGS, GAPS) + """
select ping_seq, MMSI, (us - lag(us) over (partition by MMSI order by us))::DOUBLE / 60000000.0::DOUBLE as time_diff_min
from gaps""")
def time_diff_min(spark, folder):
    out = series.time_diff_min(inputs.event_pings(spark, folder), SPARSE)
    return out.select("ping_seq", MMSI, "time_diff_min")


FEATURE_SQL = "select MMSI, us, " + ", ".join(KINEMATICS) + " from feats"


@query("kinematic_features", with_ctes(*FEATURES) + FEATURE_SQL)
def kinematic_features(spark, folder):
    return inputs.features(spark, folder).select(MMSI, us_col(), *KINEMATICS)


@query("cog_wrap", with_ctes(PINGS) + f"""
select ping_seq, round({wrap('COG * 3 - 700.0::DOUBLE')}, 6) as wrapped from pings""")
def cog_wrap(spark, folder):
    rows = inputs.event_pings(spark, folder)
    return rounded(rows.select("ping_seq", wrap_course(F.col("COG") * 3 - 700.0).alias("wrapped")))


@query("speed_acc_turn_rate", with_ctes(PINGS, """
r as (select *, (us - lag(us) over w)::DOUBLE / 3600000000.0::DOUBLE as dt, SOG - lag(SOG) over w as ds,
  COG - lag(COG) over w as dc from pings window w as (partition by MMSI order by us))""") + f"""
select ping_seq, MMSI,
  case when dt is null or dt = 0 then 0 else least(greatest(ds / dt, -15.0::DOUBLE), 15.0::DOUBLE) end as speed_acc,
  case when dt is null or dt = 0 then 0 else least(greatest({wrap('dc')} / dt, -180.0::DOUBLE), 180.0::DOUBLE) end as turn_rate
from r""")
def speed_acc_turn_rate(spark, folder):
    out = series.kinematic_features(inputs.event_pings(spark, folder), SPARSE)
    return out.select("ping_seq", MMSI, "speed_acc", "turn_rate")


@query("gap_to_next", with_ctes(PINGS, GAPS) + "select ping_seq, MMSI, next_h as gap_to_next_h from gaps")
def gap_to_next(spark, folder):
    out = series.gap_to_next(inputs.event_pings(spark, folder), SPARSE)
    return out.select("ping_seq", MMSI, "gap_to_next_h")


@query("gap_events", with_ctes(PINGS, GAPS) + """
select sum((gap_h >= 12.0)::INTEGER)::BIGINT as n_gaps_ge_threshold,
  count(distinct case when gap_h >= 12.0 then MMSI end) as n_vessels_with_gap from gaps""")
def gap_events(spark, folder):
    return series.gap_events(inputs.event_pings(spark, folder), SPARSE)


BUCKET_SQL = """
buckets(bucket, lo, hi) as (values ('<1min', 0.0::DOUBLE, 1.0::DOUBLE / 60), ('1-10min', 1.0::DOUBLE / 60, 10.0::DOUBLE / 60),
  ('10min-1h', 10.0::DOUBLE / 60, 1.0::DOUBLE), ('1-6h', 1.0::DOUBLE, 6.0::DOUBLE), ('6-12h', 6.0::DOUBLE, 12.0::DOUBLE),
  ('12-24h', 12.0::DOUBLE, 24.0::DOUBLE), ('1-7d', 24.0::DOUBLE, 168.0::DOUBLE), ('>7d', 168.0::DOUBLE, 'inf'::DOUBLE))"""


@query("gap_histogram", with_ctes(PINGS, GAPS, BUCKET_SQL) + """
select bucket, count(gap_h) as n_gaps from buckets left join gaps on gap_h >= lo and gap_h < hi group by bucket""")
def gap_histogram(spark, folder):
    return series.gap_histogram(inputs.event_pings(spark, folder), SPARSE)


@query("top_gap_vessels", with_ctes(PINGS, GAPS) + """
select MMSI, sum(coalesce((gap_h >= 12.0)::INTEGER, 0))::BIGINT as n_gaps from gaps group by MMSI order by n_gaps desc, MMSI limit 10""")
def top_gap_vessels(spark, folder):
    return series.top_gap_vessels(inputs.event_pings(spark, folder), SPARSE)


@query("inventory_stats", with_ctes(ITEMS) + """
select count(*) as n_pings, count(distinct MMSI) as n_unique_mmsi, min(us) as ts_min_us, max(us) as ts_max_us,
  round(min(Lat), 6) as lat_min, round(max(Lat), 6) as lat_max, round(min(Lon), 6) as lon_min, round(max(Lon), 6) as lon_max
from items""")
def inventory_stats(spark, folder):
    return rounded(series.inventory_stats(inputs.item_pings(spark, folder)))


IMPACT_SQL = """
boxed as (select * from pings where Lat between 35.0 and 38.0 and Lon between 11.0 and 15.5),
bgaps as (select *, (us - lag(us) over (partition by MMSI order by us))::DOUBLE / 60000000.0::DOUBLE / 60.0::DOUBLE as gap_h from boxed)"""


@query("geo_filter_impact", with_ctes(PINGS, IMPACT_SQL) + """
select (select count(*) from pings) as n_before, count(*) as n_after,
  round(count(*)::DOUBLE / (select count(*) from pings), 6) as frac_kept,
  sum((gap_h >= 12.0)::INTEGER)::BIGINT as n_gaps_after,
  count(distinct case when gap_h >= 12.0 then MMSI end) as n_vessels_with_gap_after from bgaps""")
def geo_filter_impact(spark, folder):
    return rounded(series.geo_filter_impact(inputs.event_pings(spark, folder), SPARSE))


LAST_SQL = """
d as (select MMSI, us, ping_seq, case when ping_seq % 5 = 0 then null else Lat end as Lat, Lon, SOG / 40.0::DOUBLE as score from pings),
g as (select MMSI, max(us) as us, arg_max(Lat, us) filter (Lat is not null) as Lat, arg_max(Lon, us) as Lon,
  arg_max(score, us) as score from d group by MMSI)"""


def _positions(spark, folder):
    rows = inputs.event_pings(spark, folder).withColumn("Lat", F.when(F.col("ping_seq") % 5 != 0, F.col("Lat")))
    rows = rows.select(MMSI, "Timestamp", "Lat", "Lon", (F.col("SOG") / 40.0).alias("score"))
    return series.last_position(rows, SPARSE, "score")


@query("last_position", with_ctes(PINGS, LAST_SQL) + """
select MMSI, us, round(Lat, 6) as Lat, round(Lon, 6) as Lon, round(score, 6) as score from g where Lat is not null""")
def last_position(spark, folder):
    return rounded(_positions(spark, folder).select(MMSI, us_col(), "Lat", "Lon", "score"))


@query("trajectories", with_ctes(PINGS) + """
select MMSI, row_number() over (partition by MMSI order by us) as seq, count(*) over (partition by MMSI) as n_points,
  us, round(Lon, 6) as Lon, round(Lat, 6) as Lat from pings""")
def trajectories(spark, folder):
    return rounded(series.trajectory_points(inputs.event_pings(spark, folder), SPARSE))


@query("trajectory_parts", with_ctes(PINGS, """
numbered as (select *, row_number() over (partition by MMSI order by us) as seq from pings)""") + """
select MMSI, (seq - 1) // 25 as part, count(*) as n_points,
  round(arg_min(Lon, us), 6) as first_lon, round(arg_max(Lat, us), 6) as last_lat from numbered group by 1, 2""")
def trajectory_parts(spark, folder):
    parts = series.trajectories(inputs.event_pings(spark, folder), replace(SPARSE, path_points=25))
    return rounded(parts.select(
        MMSI, "part", F.col("n_points").cast("bigint").alias("n_points"),
        F.col("path")[0]["Lon"].alias("first_lon"), F.element_at("path", -1)["Lat"].alias("last_lat"),
    ))


@query("map_markers", with_ctes(PINGS, LAST_SQL, """
m as (select MMSI, score, least(greatest(score, 0.0::DOUBLE), 1.0::DOUBLE) as p from g where Lat is not null)""") + """
select MMSI, round(5 + score * 10, 6) as marker_radius, round(80 + score * 240, 6) as marker_size,
  '#' || lpad(lower(to_hex(floor(least(255.0::DOUBLE, p * 2 * 255))::INTEGER)), 2, '0')
      || lpad(lower(to_hex(floor(least(255.0::DOUBLE, (1 - p) * 2 * 255))::INTEGER)), 2, '0') || '00' as marker_color,
  round((least(p + 0.1, 1.0) - greatest(p - 0.1, 0.0)) * 30 + 8, 6) as interval_size from m""")
def map_markers(spark, folder):
    from wakeline.functions.columns import clip

    at = _positions(spark, folder)
    p = clip("score", 0.0, 1.0)
    at = at.withColumns({"lo": F.greatest(p - 0.1, F.lit(0.0)), "hi": F.least(p + 0.1, F.lit(1.0))})
    out = series.map_markers(at, "score", "lo", "hi")
    return rounded(out.select(MMSI, "marker_radius", "marker_size", "marker_color", "interval_size"))


# ------------------------------------------------------------------- labels

@query("label_last_ping", with_ctes(PINGS, GAPS, LASTLABEL) + "select ping_seq, MMSI, us, y as target_dark_fleet from labelled")
def label_last_ping(spark, folder):
    return labels.label_last_ping(inputs.event_pings(spark, folder), SPARSE).select("ping_seq", MMSI, us_col(), TARGET)


@query("label_sliding", with_ctes(PINGS, GAPS, SLIDELABEL) + "select ping_seq, MMSI, us, y as target_dark_fleet from slid")
def label_sliding(spark, folder):
    return labels.label_sliding(inputs.event_pings(spark, folder), SPARSE).select("ping_seq", MMSI, us_col(), TARGET)


@query("mark_last_ping", with_ctes(PINGS, GAPS) + "select ping_seq, MMSI, coalesce(next_h >= 12.0, false) as is_last_ping from gaps")
def mark_last_ping(spark, folder):
    return labels.mark_last_ping(inputs.event_pings(spark, folder), SPARSE).select("ping_seq", MMSI, "is_last_ping")


@query("label_dispatch", with_ctes(PINGS, GAPS, LASTLABEL, SLIDELABEL) + """
select 'last_ping' as strategy, count(*) as n_rows, sum(y)::BIGINT as positives from labelled
union all select 'sliding_window', count(*), sum(y)::BIGINT from slid""")
def label_dispatch(spark, folder):
    rows = inputs.event_pings(spark, folder)
    parts = [
        labels.label(rows, replace(SPARSE, labeling=s)).agg(
            F.lit(s).alias("strategy"), F.count(F.lit(1)).alias("n_rows"), F.sum(TARGET).alias("positives")
        )
        for s in ("last_ping", "sliding_window")
    ]
    return parts[0].unionByName(parts[1])


@query("target_rate", with_ctes(PINGS, GAPS, SLIDELABEL) + """
select sum(y)::BIGINT as positives, count(*) as n_rows, round(sum(y) * 100.0::DOUBLE / count(*), 6) as rate_pct,
  case when sum(y) * 100.0 / count(*) < 0.1 then 'very rare' when sum(y) * 100.0 / count(*) > 10 then 'frequent' else 'ok' end as note
from slid""")
def target_rate(spark, folder):
    return rounded(labels.target_rate(labels.label_sliding(inputs.event_pings(spark, folder), SPARSE)))


SANITY_SQL = """
sanity as (
  select sum(y)::BIGINT as positives, sum(1 - y)::BIGINT as negatives, sum(y)::DOUBLE / count(*) as prevalence,
    count(distinct case when y = 1 then MMSI end) as n_vessels_with_positive,
    (select sum((gap_h >= 12.0)::INTEGER) from gaps)::BIGINT * 4 as expected_positives from slid)"""


def _sanity(spark, folder):
    rows = inputs.event_pings(spark, folder)
    n = series.gap_events(rows, SPARSE).select("n_gaps_ge_threshold").scalar()
    return labels.label_sanity(labels.label_sliding(rows, SPARSE), n, SPARSE)


@query("label_sanity", with_ctes(PINGS, GAPS, SLIDELABEL, SANITY_SQL) + """
select positives, negatives, round(prevalence, 6) as prevalence, n_vessels_with_positive, expected_positives,
  round(positives::DOUBLE / expected_positives, 6) as observed_over_expected from sanity""")
def label_sanity(spark, folder):
    return rounded(_sanity(spark, folder))


@query("target_verdict", with_ctes(PINGS, GAPS, SLIDELABEL, SANITY_SQL, IMPACT_SQL) + """
select n_gaps_filtered, positives, expected_positives,
  case when n_gaps_filtered < 50 then 'DATA-LIMITED'
    when n_gaps_filtered >= 200 and positives < 0.1 * expected_positives then 'LABELING-BUG' else 'OK' end as verdict
from sanity, (select sum((gap_h >= 12.0)::INTEGER)::BIGINT as n_gaps_filtered from bgaps)""")
def target_verdict(spark, folder):
    impact = series.geo_filter_impact(inputs.event_pings(spark, folder), SPARSE)
    return labels.target_verdict(_sanity(spark, folder), impact.select("n_gaps_after").scalar())


@query("multi_threshold_labels", with_ctes(PINGS, GAPS, """
th(gap_hours) as (values (6.0::DOUBLE), (12.0::DOUBLE), (18.0::DOUBLE), (24.0::DOUBLE))""") + """
select gap_hours, sum((next_h >= gap_hours and next_h <= gap_hours + 24.0)::INTEGER)::BIGINT as positives,
  round(avg((next_h >= gap_hours and next_h <= gap_hours + 24.0)::INTEGER), 6) as pos_rate,
  avg((next_h >= gap_hours and next_h <= gap_hours + 24.0)::INTEGER) between 0.001 and 0.5 as usable
from gaps, th where next_h is not null group by gap_hours""")
def multi_threshold_labels(spark, folder):
    marked = labels.multi_threshold_labels(inputs.event_pings(spark, folder), SPARSE)
    return rounded(labels.threshold_rates(marked))


@query("target_report", with_ctes(PINGS, GAPS, SLIDELABEL, SANITY_SQL, IMPACT_SQL) + """
select (select count(*) from pings) as n_pings, (select count(distinct MMSI) from pings) as n_vessels,
  (select sum((gap_h >= 12.0)::INTEGER)::BIGINT from gaps) as n_gaps, (select count(*) from gaps where gap_h >= 12 and gap_h < 24) as n_gaps_12_24h,
  'bigint' as dtype, (select count(*) from boxed) as n_after_box, positives,
  case when n_gaps_filtered < 50 then 'DATA-LIMITED'
    when n_gaps_filtered >= 200 and positives < 0.1 * expected_positives then 'LABELING-BUG' else 'OK' end as verdict
from sanity, (select sum((gap_h >= 12.0)::INTEGER)::BIGINT as n_gaps_filtered from bgaps)""")
def target_report(spark, folder):
    return reports.target_report(inputs.event_pings(spark, folder), SPARSE).select(
        F.col("inventory.n_pings").alias("n_pings"), F.col("inventory.n_unique_mmsi").alias("n_vessels"),
        F.col("gaps.n_gaps_ge_threshold").alias("n_gaps"), F.col("gap_histogram")["12-24h"].alias("n_gaps_12_24h"),
        "identifier.dtype", F.col("box.n_after").alias("n_after_box"), "labels.positives", "verdict.verdict",
    )


# -------------------------------------------------------------- incremental

FINGER_SQL = """
rowsd as (select MMSI, md5(us::VARCHAR || '|' || SOG::VARCHAR || '|' || COG::VARCHAR) as d from pings),
pieces as (select MMSI, count(*) as n_rows,
  sum(('0x' || substr(d, 1, 8))::BIGINT) as s0, sum(('0x' || substr(d, 9, 8))::BIGINT) as s1,
  sum(('0x' || substr(d, 17, 8))::BIGINT) as s2, sum(('0x' || substr(d, 25, 8))::BIGINT) as s3 from rowsd group by MMSI),
prints as (select MMSI, n_rows, md5(concat_ws('|', MMSI, n_rows, s0, s1, s2, s3, 'CONFIG')) as fingerprint from pieces)"""
CONFIG = {"window": 36, "update_freq": 20}


def _prints(spark, folder):
    rows = inputs.event_pings(spark, folder).withColumn("us", micros())
    return incremental.vessel_fingerprint(rows, CONFIG, ["us", "SOG", "COG"])


@query("vessel_fingerprint", with_ctes(PINGS, FINGER_SQL.replace("CONFIG", incremental.config_digest(CONFIG)))
       + "select MMSI, n_rows, fingerprint from prints")
def vessel_fingerprint(spark, folder):
    return _prints(spark, folder)


NOW_US, TTL_HOURS = 1_706_745_600_000_000, 48.0


@query("stale_vessels", with_ctes(PINGS, FINGER_SQL.replace("CONFIG", incremental.config_digest(CONFIG))) + """
select MMSI, n_rows, fingerprint from prints
where not (MMSI % 3 = 0 and 1706745600000000 - (MMSI % 100) * 3600000000 >= 1706745600000000 - 172800000000)""")
def stale_vessels(spark, folder):
    now = _prints(spark, folder)
    changed = F.when(F.col(MMSI) % 3 == 0, F.col("fingerprint")).otherwise(F.lit("another"))
    stored = now.select(MMSI, changed.alias("fingerprint"), (F.lit(NOW_US) - F.col(MMSI) % 100 * 3_600_000_000).alias("stored_us"))
    return incremental.stale_vessels(now, stored, NOW_US, TTL_HOURS)

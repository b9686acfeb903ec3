"""Queries on geometry, training, scoring and the last-ping audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions.columns import micros
from wakeline.operators import audit, evaluation as ev, folds, model, spatial
from wakeline.operators.labels import label_last_ping
from wakeline.operators.regime import regime_score
from wakeline.params import FEATURES_BASELINE, FEATURES_FULL, FEATURES_MOTION, MMSI, REGIME, TARGET
from wakeline.plans import inputs
from wakeline.plans.catalog import query, rounded, with_ctes
from wakeline.plans.catalog_data import RINGS_SQL, shared_folder
from wakeline.plans.inputs import REGIME_PARAMS, SPARSE
from wakeline.plans.sqlparts import FEATURES, GAPS, PINGS
from wakeline.session import durable
from wakeline.sources import sinks


def us_col():
    return micros().alias("us")


# ------------------------------------------------------------------ geometry

MERCATOR = """
merc as (select *, 6378137.0::DOUBLE * radians(Lon) as px, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(Lat) / 2)) as py from {src})"""


@query("web_mercator", with_ctes(PINGS, MERCATOR.format(src="pings")) + "select ping_seq, round(px, 4) as x_m, round(py, 4) as y_m from merc")
def web_mercator(spark, folder):
    rows = spatial.web_mercator(inputs.event_pings(spark, folder))
    return rounded(rows.select("ping_seq", "x_m", "y_m"), 4)


EDGES_M = """
em as (select geom_id, 6378137.0::DOUBLE * radians(x1) as x1, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(y1) / 2)) as y1,
  6378137.0::DOUBLE * radians(x2) as x2, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(y2) / 2)) as y2 from {edges})"""

DISTANCE = """
tt as (select ping_seq, geom_id, px, py, x1, y1, x2, y2,
  least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0.0::DOUBLE), 1.0::DOUBLE) as t
  from merc, em),
pg as (select ping_seq, geom_id, min(sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2)) as d,
  sum(((y1 > py) <> (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (case when y2 = y1 then 1 else y2 - y1 end))::INTEGER) % 2 = 1 as within
  from tt group by 1, 2)"""


@query("dist_coast_nm", with_ctes(PINGS, RINGS_SQL, MERCATOR.format(src="pings"), EDGES_M.format(edges="edges"), DISTANCE) + """
select ping_seq, round(case when bool_or(within) then 0 else min(d) / 1852.0::DOUBLE end, 5) as dist_coast_nm from pg group by 1""")
def dist_coast(spark, folder):
    out = spatial.spatial_features(inputs.event_pings(spark, folder), SPARSE, inputs.coast_edges(spark, folder))
    return rounded(out.select("ping_seq", "dist_coast_nm"), 5)


ZONES = "zones as (select * from edges where geom_id % 5 = 0)"


@query("dist_fishing_zone_nm", with_ctes(PINGS, RINGS_SQL, ZONES, MERCATOR.format(src="pings"), EDGES_M.format(edges="zones"), DISTANCE) + """
select ping_seq, round(case when bool_or(within) then 0 else min(d) / 1852.0::DOUBLE end, 5) as dist_fishing_zone_nm from pg group by 1""")
def dist_fishing_zone(spark, folder):
    zones = inputs.coast_edges(spark, folder).filter("geom_id % 5 = 0")
    out = spatial.distance_nm(inputs.event_pings(spark, folder), zones, "dist_fishing_zone_nm", SPARSE)
    return rounded(out.select("ping_seq", "dist_fishing_zone_nm"), 5)


ROUTES = """
routes as (select a.geom_id, a.x1, a.y1, b.x1 as x2, b.y1 as y2 from (select geom_id, x as x1, y as y1 from tri) a
  join (select geom_id - 1 as geom_id, x as x1, y as y1 from tri) b using (geom_id))"""


def _routes(spark, folder):
    """A route leads from each triangle's first corner to that of the next one."""
    corner = inputs.coast_rings(spark, folder).select("geom_id", F.col("pts")[0].alias("a"))
    after = corner.select((F.col("geom_id") - 1).alias("geom_id"), F.col("a").alias("b"))
    return corner.join(after, "geom_id").select(
        "geom_id", F.col("a")[0].alias("x1"), F.col("a")[1].alias("y1"), F.col("b")[0].alias("x2"), F.col("b")[1].alias("y2")
    )


@query("dist_commercial_route_nm", with_ctes(PINGS, RINGS_SQL, ROUTES, MERCATOR.format(src="pings"), EDGES_M.format(edges="routes"), DISTANCE) + """
select ping_seq, round(min(d) / 1852.0::DOUBLE, 5) as dist_commercial_route_nm from pg group by 1""")
def dist_route(spark, folder):
    rows = inputs.event_pings(spark, folder)
    out = spatial.distance_nm(rows, _routes(spark, folder), "dist_commercial_route_nm", SPARSE, polygons=False)
    return rounded(out.select("ping_seq", "dist_commercial_route_nm"), 5)


UNIT = "cos(radians({y})) * cos(radians({x})) as {n}x, cos(radians({y})) * sin(radians({x})) as {n}y, sin(radians({y})) as {n}z"
ARCS = f"""
arcs as (select {UNIT.format(x='x1', y='y1', n='a')}, {UNIT.format(x='x2', y='y2', n='e')} from routes),
nn as (select *, ay * ez - az * ey as nx, az * ex - ax * ez as ny, ax * ey - ay * ex as nz from arcs),
pp as (select ping_seq, {UNIT.format(x='Lon', y='Lat', n='p')} from pings),
reach as (
  select ping_seq, sqrt(nx * nx + ny * ny + nz * nz) as n, abs(nx * px + ny * py + nz * pz) as aside,
    (ny * az - nz * ay) * px + (nz * ax - nx * az) * py + (nx * ay - ny * ax) * pz as after_a,
    (ey * nz - ez * ny) * px + (ez * nx - ex * nz) * py + (ex * ny - ey * nx) * pz as before_b,
    least(sqrt((px - ax) ** 2 + (py - ay) ** 2 + (pz - az) ** 2), sqrt((px - ex) ** 2 + (py - ey) ** 2 + (pz - ez) ** 2)) as chord
  from pp, nn)"""


@query("dist_route_great_circle_nm", with_ctes(PINGS, RINGS_SQL, ROUTES, ARCS) + """
select ping_seq, round(min(case when after_a >= 0 and before_b >= 0 then asin(least(aside / n, 1.0::DOUBLE))
  else 2 * asin(least(chord / 2, 1.0::DOUBLE)) end) * 6371008.8::DOUBLE / 1852.0::DOUBLE, 5) as dist_nm from reach group by 1""")
def dist_route_great_circle(spark, folder):
    rows = inputs.event_pings(spark, folder)
    out = spatial.distance_nm(rows, _routes(spark, folder), "dist_nm", SPARSE, polygons=False, metric="haversine")
    return rounded(out.select("ping_seq", "dist_nm"), 5)


# ------------------------------------------------------------------ training

ROUNDS = 5
TREES = model.TreeParams(max_depth=4, num_leaves=16)


def _labelled(spark, folder):
    return durable(label_last_ping(inputs.features(spark, folder), SPARSE, bounded=True))


def _enriched(spark, folder):
    rows = regime_score(inputs.features(spark, folder, REGIME_PARAMS), REGIME_PARAMS)
    # phase 2 ends here: training reads a materialised table
    return durable(label_last_ping(rows, REGIME_PARAMS, bounded=True).dropna(subset=[REGIME]))


def _sides(rows):
    pool, held, _ = folds.holdout_by_vessel(rows, SPARSE)
    return pool, held


# Fitted numbers depend on the solver, so these queries return what must hold for any
# fit: which rows are scored, once each, with which label, and whether a score is a probability.
# The numbers themselves are what the queries named ..._measured return, which have no SQL form.
LABELLED_SQL = """
nexts as (select *, (lead(us) over (partition by MMSI order by us) - us)::DOUBLE / 3600000000.0::DOUBLE as next_h from feats),
lab as (select *, (next_h >= 12.0 and next_h <= 36.0)::INTEGER as y from nexts where next_h is not null),
lv as (select MMSI, row_number() over (order by md5('42-' || MMSI), MMSI) as rank, count(*) over () as n
  from (select distinct MMSI from lab))"""
HELD_SQL = with_ctes(*FEATURES, LABELLED_SQL) + """
select MMSI, us, y as target_dark_fleet, true as is_probability
from lab join lv using (MMSI) where rank <= greatest(1, round_even(n * 0.2, 0))"""


def _within(column, low=0.0, high=1.0):
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


def _scored(fitted, test):
    scored = model.score_rows(fitted, test, SPARSE)
    return scored.select(MMSI, us_col(), TARGET, _within(model.SCORE).alias("is_probability"))


def _boosted(spark, folder):
    train, test = _sides(_labelled(spark, folder))
    return model.train_gbt(train, FEATURES_BASELINE, TREES, SPARSE, ROUNDS), test


@query("train_gbt", HELD_SQL)
def train_gbt(spark, folder):
    return _scored(*_boosted(spark, folder))


@query("train_gbt_measured")
def train_gbt_measured(spark, folder):
    fitted, test = _boosted(spark, folder)
    return model.score_rows(fitted, test, SPARSE).select(MMSI, us_col(), TARGET, model.SCORE)


@query("param_search")
def param_search(spark, folder):
    table = model.param_search(_enriched(spark, folder), REGIME_PARAMS, FEATURES_FULL, n_trials=2, max_rounds=ROUNDS)
    rows = [(r["trial"], r["mean_ap"], model.final_rounds(r["rounds"])) for r in table]
    return spark.createDataFrame(rows, "trial int, mean_ap double, final_rounds int")


@query("score_rows")
def score_rows(spark, folder):
    train, test = _sides(_enriched(spark, folder))
    names = model.smoothed_features(FEATURES_FULL)
    fitted = model.train_gbt(model.with_smoothed(train, SPARSE, 0.8), names, TREES, SPARSE, ROUNDS)
    path = shared_folder(spark, "model")
    sinks.save_model(fitted, path)
    return model.score_rows(sinks.load_model(path), test, SPARSE, 0.8).select(MMSI, us_col(), TARGET, model.SCORE)


def _logistic(spark, folder):
    train, test = _sides(_labelled(spark, folder))
    return model.train_logistic(train, FEATURES_BASELINE), test


@query("train_logistic", HELD_SQL)
def train_logistic(spark, folder):
    return _scored(*_logistic(spark, folder))


@query("train_logistic_measured")
def train_logistic_measured(spark, folder):
    fitted, test = _logistic(spark, folder)
    return ev.metrics(model.score_rows(fitted, test, SPARSE), model.SCORE, SPARSE)


@query("ablation_measured")
def ablation_measured(spark, folder):
    train, test = _sides(_enriched(spark, folder))
    return model.ablation(model.ablation_predictions(train, test, SPARSE, TREES, ROUNDS), SPARSE)


@query("ablation", """
select unnest(['pred_logistic_baseline', 'pred_gb_baseline', 'pred_gb_enhanced']) as model, true as ap_valid, true as brier_valid""")
def ablation(spark, folder):
    table = ablation_measured(spark, folder)
    return table.select("model", _within("average_precision").alias("ap_valid"), _within("brier").alias("brier_valid"))


@query("gap_sensitivity_measured")
def gap_sensitivity_measured(spark, folder):
    return model.gap_sensitivity(durable(inputs.features(spark, folder)), SPARSE, t=TREES, rounds=ROUNDS)


@query("gap_sensitivity", with_ctes(*FEATURES, LABELLED_SQL, """
th(gap_hours) as (values (6.0::DOUBLE), (12.0::DOUBLE), (18.0::DOUBLE), (24.0::DOUBLE))""") + """
select gap_hours, round(avg((next_h >= gap_hours and next_h <= gap_hours + 24.0)::INTEGER), 6) as pos_rate, true as valid
from lab, th group by gap_hours""")
def gap_sensitivity(spark, folder):
    table = gap_sensitivity_measured(spark, folder)
    fine = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    return table.select(
        "gap_hours", F.round("pos_rate", 6).alias("pos_rate"), (fine("average_precision") & fine("brier")).alias("valid")
    )


@query("importance_measured")
def importance_measured(spark, folder):
    rows = _labelled(spark, folder)
    fitted = model.train_gbt(rows, FEATURES_MOTION, TREES, SPARSE, ROUNDS)
    return model.importance(fitted, rows).join(model.permutation_importance(fitted, rows, SPARSE), "feature")


@query("importance", """
select unnest(['delta_SOG', 'delta_COG', 'speed_acc', 'turn_rate', 'dt_prev_hours']) as feature, true as share_valid,
  true as drop_valid, 1.0::DOUBLE as total""")
def importance(spark, folder):
    shares = importance_measured(spark, folder)
    total = shares.agg(F.round(F.sum("importance"), 9)).scalar()
    return shares.select(
        "feature", _within("importance").alias("share_valid"), _within("drop", -1.0).alias("drop_valid"), total.alias("total")
    )


# --------------------------------------------------------------------- audit

AUDIT_SQL = """
marked as (select MMSI, us, SOG, COG, coalesce(next_h >= 12.0, false) as is_last from gaps),
ctrl as (select MMSI, us, is_last from marked where not is_last and MMSI in (select MMSI from marked where is_last)
  qualify row_number() over (partition by MMSI order by md5('42-' || MMSI || '-' || us)) <= 5),
sample as (select MMSI, us, is_last from marked where is_last and MMSI in (select MMSI from ctrl)
  union all select MMSI, us, is_last from ctrl)"""


def _sample(spark, folder):
    return audit.audit_sample(inputs.event_pings(spark, folder), SPARSE)


@query("audit_sample", with_ctes(PINGS, GAPS, AUDIT_SQL) + "select MMSI, us, is_last::INTEGER as is_last from sample")
def audit_sample(spark, folder):
    return _sample(spark, folder).select(MMSI, us_col(), "is_last")


@query("median_impute", with_ctes(PINGS, """
holes as (select ping_seq, case when ping_seq % 7 = 0 then null else SOG end as s, case when ping_seq % 9 = 0 then null else COG end as c from pings)""") + """
select ping_seq, round(coalesce(s, (select quantile_cont(s, 0.5) from holes)), 6) as SOG,
  round(coalesce(c, (select quantile_cont(c, 0.5) from holes)), 6) as COG from holes""")
def median_impute(spark, folder):
    s = F.col("ping_seq")
    rows = inputs.event_pings(spark, folder).withColumns({
        "SOG": F.when(s % 7 != 0, F.col("SOG")), "COG": F.when(s % 9 != 0, F.col("COG")),
    })
    return rounded(audit.median_impute(rows, ["SOG", "COG"], SPARSE).select("ping_seq", "SOG", "COG"))


AUDIT_FEATURES = ["SOG", "COG"]


@query("mahalanobis", with_ctes(PINGS, GAPS, AUDIT_SQL, """
j as (select s.is_last, m.SOG as a, m.COG as b from sample s join marked m using (MMSI, us)),
z as (select is_last, (a - avg(a) over ()) / stddev_pop(a) over () as a, (b - avg(b) over ()) / stddev_pop(b) over () as b from j),
q as (select avg(a) filter (is_last) - avg(a) filter (not is_last) as da, avg(b) filter (is_last) - avg(b) filter (not is_last) as db,
  var_samp(a) + 1e-6 as va, var_samp(b) + 1e-6 as vb, covar_samp(a, b) as cab from z)""") + """
select round(sqrt((da * da * vb - 2 * da * db * cab + db * db * va) / (va * vb - cab * cab)), 6) as distance from q""")
def mahalanobis(spark, folder):
    sample = durable(_sample(spark, folder))
    ready = audit.standardise(audit.median_impute(sample, AUDIT_FEATURES, SPARSE), AUDIT_FEATURES)
    return rounded(spark.createDataFrame([(audit.mahalanobis(ready, AUDIT_FEATURES),)], "distance double"))


@query("audit_auc_measured")
def audit_auc_measured(spark, folder):
    ready = durable(audit.standardise(durable(_sample(spark, folder)), AUDIT_FEATURES))
    return audit.audit_auc(ready, AUDIT_FEATURES, SPARSE)


@query("audit_auc", "select unnest([0, 1]) as fold, true as valid")
def audit_auc(spark, folder):
    return audit_auc_measured(spark, folder).select("fold", _within("roc_auc").alias("valid"))


@query("audit_verdict_measured")
def audit_verdict_measured(spark, folder):
    return audit.last_ping_audit(inputs.features(spark, folder), FEATURES_MOTION, SPARSE, bounded=True)


@query("audit_verdict", with_ctes(*FEATURES, """
fgaps as (select *, (lead(us) over (partition by MMSI order by us) - us)::DOUBLE / 3600000000.0::DOUBLE as next_h from feats),
""" + AUDIT_SQL.replace("from gaps", "from fgaps")) + """
select (select count(distinct MMSI) from marked where is_last) as n_eligible_vessels, count(*) filter (is_last) as n_last_pings,
  count(*) filter (not is_last) as n_controls, true as verdict_fits, true as distance_valid from sample""")
def audit_verdict(spark, folder):
    table = audit_verdict_measured(spark, folder)
    auc = F.col("auc_last_vs_controls")
    expected = (
        F.when(F.col("n_eligible_vessels") < 3, "INSUFFICIENT_DATA").when(auc >= 0.70, "DISTINGUISHABLE")
        .when(auc >= 0.55, "WEAKLY_DISTINGUISHABLE").otherwise("INDISTINGUISHABLE")
    )
    return table.select(
        "n_eligible_vessels", "n_last_pings", "n_controls", (F.col("verdict") == expected).alias("verdict_fits"),
        F.coalesce(F.col("mahalanobis") >= 0, F.lit(False)).alias("distance_valid"),
    )

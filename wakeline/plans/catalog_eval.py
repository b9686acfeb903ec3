"""Queries on folds, metrics, thresholds and intervals."""

from __future__ import annotations


from pyspark.sql import functions as F

from wakeline.functions.columns import micros
from wakeline.operators import evaluation as ev, folds, model
from wakeline.operators.prefix import global_row_index, quantiles
from wakeline.params import MMSI, TARGET, TIMESTAMP
from wakeline.plans import inputs
from wakeline.plans.catalog import query, rounded, with_ctes
from wakeline.plans.inputs import SPARSE
from wakeline.plans.sqlparts import AP, AUC, DOCS, PINGS, SCORED, VESSELS, cumulated
from wakeline.session import durable

A, B = "score_a", "score_b"
N_DRAWS = 1000


def us_col():
    return micros().alias("us")


# -------------------------------------------------------------------- folds

GROUP_TIME_SQL = """
cuts as (select 0 as fold, floor(quantile_cont(us, 0.25::DOUBLE))::BIGINT as cut from scored
  union all select 1, floor(quantile_cont(us, 0.5::DOUBLE))::BIGINT from scored
  union all select 2, floor(quantile_cont(us, 0.75::DOUBLE))::BIGINT from scored),
svessels as (select MMSI, row_number() over (order by md5('42-' || MMSI), MMSI) as rank, count(*) over () as n
  from (select distinct MMSI from scored)),
home as (select MMSI, ntile(3) over (order by rank) - 1 as home from svessels),
assigned as (
  select fold, MMSI, us, y, case when fold = home and us >= cut and us < cut + 86400000000 then 'valid'
      when fold <> home and us < cut - 86400000000 then 'train' end as role
  from scored join home using (MMSI), cuts),
usable as (select fold from assigned group by fold
  having sum((role = 'train')::INTEGER) >= 50 and sum((role = 'valid')::INTEGER) >= 10)"""


@query("split_group_time", with_ctes(*SCORED, GROUP_TIME_SQL) + """
select fold::INTEGER as fold, role, MMSI, us from assigned where role is not null and fold in (select fold from usable)""")
def split_group_time(spark, folder):
    return folds.split_group_time(inputs.stored_scored(spark, folder), SPARSE).select("fold", "role", MMSI, us_col())


@query("holdout_by_vessel", with_ctes(PINGS, VESSELS) + """
select MMSI, rank <= greatest(1, round_even(n * 0.2, 0)) as held, count(*) as n_rows
from pings join vessels using (MMSI) group by 1, 2""")
def holdout_by_vessel(spark, folder):
    pool, held, _ = folds.holdout_by_vessel(inputs.event_pings(spark, folder), SPARSE)
    both = pool.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))
    return both.groupBy(MMSI, "held").agg(F.count(F.lit(1)).alias("n_rows"))


@query("split_time_gap", with_ctes(PINGS, """
indexed as (select *, row_number() over (order by us, MMSI) - 1 as row_index, count(*) over () as n from pings),
f as (select *, i as fold, (n * (i + 1)) // 4 as e, greatest(100, n // 12) as block from indexed, range(3) t(i)),
g as (select *, e + 4 as s, least(e + 4 + block, n) as stop from f)""") + """
select fold::INTEGER as fold, case when row_index < e then 'train' else 'valid' end as role, row_index, ping_seq from g
where s < n and stop - s >= 10 and (row_index < e or (row_index >= s and row_index < stop))""")
def split_time_gap(spark, folder):
    out = folds.split_time_gap(inputs.event_pings(spark, folder), SPARSE)
    return out.select("fold", "role", "row_index", "ping_seq")


@query("split_first_seen", with_ctes(PINGS, """
late as (select * replace (us + (MMSI % 9) * 3456000000000 as us) from pings),
seen as (select MMSI, min(us) as first_us, max(us) as last_us, count(*) as c from late group by MMSI),
r as (select *, row_number() over (order by first_us, MMSI) - 1 as r, count(*) over () as n from seen),
f as (select *, i as fold, r < (n * (i + 1)) // 4 as train from r, range(3) t(i)),
e as (select fold, max(case when train then last_us end) as e from f group by fold),
roles as (select f.fold, MMSI, c, case when train then 'train' when first_us >= e + 86400000000 then 'valid' end as role
  from f join e using (fold)),
ok as (select fold from roles group by fold
  having sum(case when role = 'train' then c end) >= 100 and sum(case when role = 'valid' then c end) >= 50)""") + """
select fold::INTEGER as fold, role, MMSI, us from late join roles using (MMSI)
where role is not null and fold in (select fold from ok)""")
def split_first_seen(spark, folder):
    rows = inputs.event_pings(spark, folder)
    # all rows, moved by up to 320 days, so that vessels start at different times
    late = rows.withColumn(TIMESTAMP, F.timestamp_micros(micros() + F.col(MMSI) % 9 * 3_456_000_000_000))
    return folds.split_first_seen(late, SPARSE).select("fold", "role", MMSI, us_col())


@query("split_positional", with_ctes(PINGS, """
indexed as (select *, row_number() over (order by us, MMSI) - 1 as row_index, count(*) over () as n from pings)""") + """
select case when row_index < floor(n * 0.8::DOUBLE) then 'head' else 'tail' end as part, row_index, ping_seq from indexed""")
def split_positional(spark, folder):
    return folds.split_positional(inputs.event_pings(spark, folder), SPARSE).select("part", "row_index", "ping_seq")


@query("fold_positives", with_ctes(*SCORED, GROUP_TIME_SQL) + """
select fold::INTEGER as fold, sum((role = 'train')::INTEGER)::BIGINT as train_rows, sum((role = 'valid')::INTEGER)::BIGINT as valid_rows,
  sum((role = 'train' and y = 1)::INTEGER)::BIGINT as train_pos, sum((role = 'valid' and y = 1)::INTEGER)::BIGINT as valid_pos,
  sum((role = 'train' and y = 1)::INTEGER) > 0 and sum((role = 'valid' and y = 1)::INTEGER) > 0 as usable
from assigned where role is not null and fold in (select fold from usable) group by fold""")
def fold_positives(spark, folder):
    return folds.fold_positives(folds.split_group_time(inputs.stored_scored(spark, folder), SPARSE))


@query("select_vessels", with_ctes(*SCORED) + "select distinct MMSI from scored where y = 1 order by MMSI limit 30")
def select_vessels(spark, folder):
    return folds.select_vessels(inputs.scored(spark, folder), 30)


@query("selection_changes", with_ctes(*SCORED, """
now as (select distinct MMSI from scored where y = 1 order by MMSI limit 30),
old as (select distinct MMSI + 5 as MMSI from now)""") + """
select MMSI, 'added' as change from now where MMSI not in (select MMSI from old)
union all select MMSI, 'removed' from old where MMSI not in (select MMSI from now)""")
def selection_changes(spark, folder):
    now = folds.select_vessels(inputs.scored(spark, folder), 30)
    return folds.selection_changes(now, now.select((F.col(MMSI) + 5).alias(MMSI)))


@query("global_row_index", with_ctes(PINGS) + """
select ping_seq, row_number() over (order by us, MMSI) - 1 as row_index from pings""")
def row_index(spark, folder):
    rows = inputs.event_pings(spark, folder).withColumn("us", micros())
    return global_row_index(rows, "us", [MMSI], SPARSE).select("ping_seq", "row_index")


@query("exact_quantiles", with_ctes(PINGS) + """
select MMSI, 0.1::DOUBLE as level, round(quantile_cont(SOG, 0.1::DOUBLE), 6) as quantile from pings group by MMSI
union all select MMSI, 0.5::DOUBLE, round(quantile_cont(SOG, 0.5::DOUBLE), 6) from pings group by MMSI
union all select MMSI, 0.9::DOUBLE, round(quantile_cont(SOG, 0.9::DOUBLE), 6) from pings group by MMSI""")
def exact_quantiles(spark, folder):
    return rounded(quantiles(inputs.event_pings(spark, folder), "SOG", [0.1, 0.5, 0.9], SPARSE, [MMSI]))


# ------------------------------------------------------------------ metrics

@query("score_cumulative", with_ctes(*SCORED, cumulated("scored", A)) + """
select round(score, 9) as score, pos, neg, tp, fp, n_pos, n_neg from cum""")
def score_cumulative(spark, folder):
    return rounded(ev.score_cumulative(inputs.scored(spark, folder), A, SPARSE), 9)


@query("average_precision", with_ctes(*SCORED, cumulated("scored", A)) + f"select round({AP}, 8) as average_precision from cum")
def average_precision(spark, folder):
    return rounded(ev.average_precision(inputs.scored(spark, folder), A, SPARSE), 8)


@query("roc_auc", with_ctes(*SCORED, cumulated("scored", A)) + f"select round({AUC}, 8) as roc_auc from cum")
def roc_auc(spark, folder):
    return rounded(ev.roc_auc(inputs.scored(spark, folder), A, SPARSE), 8)


@query("document_metrics", with_ctes(DOCS, cumulated("docs", "score")) + f"""
select round({AP}, 8) as average_precision, round({AUC}, 8) as roc_auc,
  (select round(avg(-case when y = 1 then ln(greatest(score, 2.220446049250313e-16)) else ln(1 - least(score, 1 - 2.220446049250313e-16)) end), 8) from docs) as log_loss,
  (select round(avg((score - y) * (score - y)), 8) from docs) as brier,
  (select round(avg(y), 8) from docs) as prevalence, (select count(*) from docs) as n_rows
from cum""")
def document_metrics(spark, folder):
    return rounded(ev.metrics(inputs.scored_documents(spark, folder), "score", SPARSE), 8)


LOSS = """avg(-case when y = 1 then ln(least(greatest({s}, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
  else ln(1 - least(greatest({s}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) end)"""


@query("log_loss", with_ctes(*SCORED) + f"select round({LOSS.format(s=A)}, 8) as log_loss from scored")
def log_loss(spark, folder):
    return rounded(ev.log_loss(inputs.scored(spark, folder), A), 8)


@query("brier", with_ctes(*SCORED) + "select round(avg((score_a - y) * (score_a - y)), 8) as brier from scored")
def brier(spark, folder):
    return rounded(ev.brier(inputs.scored(spark, folder), A), 8)


@query("pr_curve", with_ctes(*SCORED, cumulated("scored", B)) + """
select score as threshold, round(tp::DOUBLE / (tp + fp), 8) as precision, round(tp::DOUBLE / n_pos, 8) as recall from cum""")
def pr_curve(spark, folder):
    return rounded(ev.pr_curve(inputs.scored(spark, folder), B, SPARSE), 8)


@query("operating_point", with_ctes(*SCORED, cumulated("scored", B)) + """
select score as threshold, round(tp::DOUBLE / (tp + fp), 8) as precision, round(tp::DOUBLE / n_pos, 8) as recall
from cum where score >= 0.4505 order by score limit 1""")
def operating_point(spark, folder):
    return rounded(ev.operating_point(ev.pr_curve(inputs.scored(spark, folder), B, SPARSE), 0.4505), 8)


@query("roc_curve", with_ctes(*SCORED, cumulated("scored", B)) + """
select score as threshold, round(fp::DOUBLE / n_neg, 8) as fpr, round(tp::DOUBLE / n_pos, 8) as tpr from cum""")
def roc_curve(spark, folder):
    return rounded(ev.roc_curve(inputs.scored(spark, folder), B, SPARSE), 8)


FBETA_SQL = """
grid as (select i, 0.01::DOUBLE + i::DOUBLE * ((0.99::DOUBLE - 0.01::DOUBLE) / 199) as threshold from range(200) t(i)),
hits as (select i, threshold, sum((y = 1 and score_a >= threshold)::INTEGER) as tp, sum((y = 0 and score_a >= threshold)::INTEGER) as fp,
  sum((y = 1 and score_a < threshold)::INTEGER) as fn from scored, grid group by 1, 2),
fb as (select i, threshold, coalesce(5.0::DOUBLE * tp / nullif(5.0::DOUBLE * tp + 4.0::DOUBLE * fn + fp, 0), 0) as fbeta from hits)"""


@query("fbeta_table", with_ctes(*SCORED, FBETA_SQL) + """
select i::INTEGER as i, round(threshold, 9) as threshold, round(fbeta, 8) as fbeta from fb""")
def fbeta_table(spark, folder):
    return rounded(ev.fbeta_table(inputs.scored(spark, folder), A), 8, threshold=9)


@query("fbeta_scan", with_ctes(*SCORED, FBETA_SQL) + """
select round(threshold, 9) as threshold, round(fbeta, 8) as fbeta from fb order by fbeta desc, i limit 1""")
def fbeta_scan(spark, folder):
    return rounded(ev.fbeta_scan(inputs.scored(spark, folder), A), 8, threshold=9)


CONFUSION = """
  sum((y = 0 and {s} < {t})::INTEGER)::BIGINT as tn, sum((y = 0 and {s} >= {t})::INTEGER)::BIGINT as fp,
  sum((y = 1 and {s} < {t})::INTEGER)::BIGINT as fn, sum((y = 1 and {s} >= {t})::INTEGER)::BIGINT as tp"""


@query("confusion", with_ctes(*SCORED, f"c as (select {CONFUSION.format(s=A, t=0.12)} from scored)") + """
select tn, fp, fn, tp, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 8) as precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 8) as recall from c""")
def confusion(spark, folder):
    return rounded(ev.confusion(inputs.scored(spark, folder), A, 0.12), 8)


HALVES = """
halves as (select *, row_number() over (order by us, MMSI) - 1 < floor(count(*) over () * 0.5::DOUBLE) as calib from scored),
tau as (select quantile_cont(score_a, 0.9::DOUBLE) as tau from halves where calib and y = 0),
evals as (select * from halves where not calib)"""


def _halves(spark, folder):
    parts = durable(folds.split_positional(inputs.scored(spark, folder), SPARSE, 0.5))
    return parts.filter("part = 'head'"), parts.filter("part = 'tail'")


@query("conformal_threshold", with_ctes(*SCORED, HALVES, cumulated("evals", A),
       f"c as (select {CONFUSION.format(s=A, t='(select tau from tau)')} from evals)") + f"""
select round((select tau from tau), 8) as threshold, 0.1::DOUBLE as target_fpr, round(fp::DOUBLE / (fp + tn), 8) as empirical_fpr,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 8) as precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 8) as recall,
  round((select {AP} from cum), 8) as average_precision from c""")
def conformal_threshold(spark, folder):
    head, tail = _halves(spark, folder)
    return rounded(ev.conformal_report(head, tail, A, SPARSE, 0.1), 8)


@query("calibration_curve", with_ctes(*SCORED) + """
select least(greatest(ceil(score_b * 10.0::DOUBLE) - 1, 0), 9)::INTEGER as bin, count(*) as n,
  round(avg(score_b), 8) as mean_score, round(avg(y), 8) as observed from scored group by 1""")
def calibration_curve(spark, folder):
    return rounded(ev.calibration_curve(inputs.scored(spark, folder), B), 8)


@query("murphy", with_ctes(*SCORED, """
b as (select least(floor(score_b * 10.0::DOUBLE), 9) as bin, count(*) as n, avg(score_b) as s, avg(y) as o from scored group by 1),
base as (select avg(y) as base, count(*) as total from scored),
m as (select sum(n * (s - o) * (s - o)) / any_value(total) as reliability, sum(n * (o - base) * (o - base)) / any_value(total) as resolution,
  any_value(base * (1 - base)) as uncertainty from b, base)""") + """
select round(reliability, 8) as reliability, round(resolution, 8) as resolution, round(uncertainty, 8) as uncertainty,
  round(reliability - resolution + uncertainty, 8) as brier from m""")
def murphy(spark, folder):
    return rounded(ev.murphy(inputs.scored(spark, folder), B), 8)


@query("bootstrap_ci")
def bootstrap_ci(spark, folder):
    return ev.bootstrap_ci(inputs.stored_scored(spark, folder), B, SPARSE, N_DRAWS)


DRAWS_SQL = f"""
svessels as (select MMSI, row_number() over (order by md5('42-' || MMSI), MMSI) - 1 as i, count(*) over () as n
  from (select distinct MMSI from scored)),
picks as (select d as draw, (('0x' || substr(md5('42-' || d || '-' || i), 1, 15))::BIGINT) % n as i from svessels, range({N_DRAWS}) t(d)),
drawn as (select draw, MMSI, count(*) as times from picks join svessels using (i) group by 1, 2)"""


def drawn_ap(score: str, name: str) -> str:
    return f"""
{name}_c as (select draw, {score} as score, sum(y * times)::BIGINT as pos, sum((1 - y) * times)::BIGINT as neg
  from scored join drawn using (MMSI) group by 1, 2),
{name}_t as (select *, sum(pos) over (partition by draw order by score desc)::BIGINT as tp,
  sum(neg) over (partition by draw order by score desc)::BIGINT as fp, sum(pos) over (partition by draw)::BIGINT as n_pos,
  sum(neg) over (partition by draw)::BIGINT as n_neg from {name}_c),
{name} as (select draw, {AP} as ap from {name}_t where n_pos > 0 and n_neg > 0 group by draw)"""


@query("bootstrap_grouped", with_ctes(*SCORED, DRAWS_SQL, drawn_ap(A, "boot"), cumulated("scored", A)) + f"""
select round(quantile_cont(ap, 0.025::DOUBLE), 8) as lower, round((select {AP} from cum), 8) as point,
  round(quantile_cont(ap, 0.975::DOUBLE), 8) as upper, count(*) as n_draws_used from boot""")
def bootstrap_grouped(spark, folder):
    return rounded(ev.bootstrap_grouped(inputs.stored_scored(spark, folder), A, SPARSE, N_DRAWS), 8)


@query("compare_models", with_ctes(*SCORED, DRAWS_SQL, drawn_ap(A, "ba"), drawn_ap(B, "bb"), """
deltas as (select ba.ap - bb.ap as d from ba join bb using (draw))""") + """
select round(avg(d), 8) as delta_mean, round(quantile_cont(d, 0.025::DOUBLE), 8) as ci_lower,
  round(quantile_cont(d, 0.975::DOUBLE), 8) as ci_upper, count(*) as n_draws_used, quantile_cont(d, 0.025::DOUBLE) > 0 as significant
from deltas""")
def compare_models(spark, folder):
    return rounded(ev.compare_models(inputs.stored_scored(spark, folder), A, B, SPARSE, N_DRAWS), 8)


@query("lift", with_ctes(*SCORED, cumulated("scored", A), f"""
m as (select (select {AP} from cum) as ap, avg(y) as prev from scored)""") + """
select round(ap, 8) as average_precision, round(prev, 8) as prevalence, round(ap / prev, 7) as lift,
  case when ap / prev >= 5 then 'GO' when ap / prev > 2 then 'CAUTION' else 'NO-GO' end as verdict from m""")
def lift(spark, folder):
    return rounded(ev.lift(inputs.stored_scored(spark, folder), A, SPARSE), 8, lift=7)


@query("kpis", with_ctes(*SCORED) + """
select count(*) as n_rows, sum((score_b > 0.7)::INTEGER)::BIGINT as n_high_risk,
  round(avg((score_b > 0.7)::INTEGER), 8) as share_high_risk, round(avg(score_b), 8) as mean_score from scored""")
def kpis(spark, folder):
    return rounded(ev.kpis(inputs.scored(spark, folder), B), 8)


VALID_SQL = """
per as (select MMSI, avg(score_b) as m, max(score_b) as x, stddev_samp(score_b) as s, (MMSI % 3 = 0)::INTEGER as y from scored group by MMSI)"""


def _validated(spark, folder):
    from wakeline.sources.pings import truth_explode

    return ev.vessel_validation(inputs.scored(spark, folder), truth_explode(inputs.truth(spark, folder)), B)


@query("vessel_validation", with_ctes(*SCORED, VALID_SQL) + """
select MMSI, round(m, 8) as score_mean, x as score_max, round(s, 8) as score_std, y as is_dark from per""")
def vessel_validation(spark, folder):
    return rounded(_validated(spark, folder), 8)


@query("vessel_roc_auc", with_ctes(*SCORED, VALID_SQL, "per_r as (select y, round(m, 9) as m from per)", cumulated("per_r", "m"))
       + f"select round({AUC}, 8) as roc_auc from cum")
def vessel_roc_auc(spark, folder):
    scored = _validated(spark, folder).withColumn("score_mean", F.round("score_mean", 9))
    return rounded(ev.roc_auc(scored, "score_mean", SPARSE, "is_dark"), 8)


@query("class_histogram", with_ctes(*SCORED, """
h as (select y as class, case when SOG < 0 then 0 when SOG >= 40 then 21 else floor((SOG - 0.0::DOUBLE) / 2.0::DOUBLE) + 1 end::INTEGER as bin,
  count(*) as n from scored group by 1, 2)""") + """
select class, bin, n, round(n::DOUBLE / sum(n) over (partition by class) / 2.0::DOUBLE, 8) as density from h""")
def class_histogram(spark, folder):
    return rounded(ev.class_histogram(inputs.scored(spark, folder), "SOG", 0.0, 40.0), 8)


@query("split_drift", with_ctes(*SCORED, """
svessels as (select MMSI, row_number() over (order by md5('42-' || MMSI), MMSI) as rank, count(*) over () as n
  from (select distinct MMSI from scored)),
tagged as (select *, case when rank <= greatest(1, round_even(n * 0.2, 0)) then 'test' else 'train' end as split
  from scored join svessels using (MMSI))""") + """
select split, count(*) as n_rows, sum(y)::BIGINT as n_pos,
  round(avg(SOG) filter (y = 1), 6) as sog_mean_pos, round(stddev_samp(SOG) filter (y = 1), 6) as sog_std_pos,
  round(avg(SOG) filter (y = 0), 6) as sog_mean_neg, round(stddev_samp(SOG) filter (y = 0), 6) as sog_std_neg,
  count(distinct MMSI) as n_vessels, count(distinct case when y = 1 then MMSI end) as n_vessels_pos from tagged group by split""")
def split_drift(spark, folder):
    from wakeline.operators.clean import tag_split

    rows = inputs.scored(spark, folder)
    return rounded(ev.split_drift(tag_split(rows, folds.holdout_vessels(rows, SPARSE), SPARSE)))


@query("score_summary", with_ctes(*SCORED, """
s as (select case when ping_seq % 50 = 0 then null else score_b end as s from scored)""") + """
select count(*) as n_rows, sum((s is null)::INTEGER)::BIGINT as n_null, round(avg((s is null)::INTEGER), 8) as share_null,
  round(var_pop(s), 8) as variance, round(avg(s), 8) as mean, min(s) as min, max(s) as max from s""")
def score_summary(spark, folder):
    rows = inputs.scored(spark, folder).withColumn(B, F.when(F.col("ping_seq") % 50 != 0, F.col(B)))
    return rounded(ev.score_summary(ev.score_gate(rows, B), B), 8)


@query("preflight_positives", with_ctes(*SCORED) + "select sum(y)::BIGINT as positives from scored")
def preflight_positives(spark, folder):
    return ev.preflight_positives(inputs.scored(spark, folder)).agg(F.sum(TARGET).cast("bigint").alias("positives"))


def metric_rows(score: str, cum: str) -> str:
    return f"""select '{score}' as model, (select round({AP}, 8) from {cum}) as average_precision, (select round({AUC}, 8) from {cum}) as roc_auc,
  round(avg(-case when y = 1 then ln(least(greatest({score}, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
    else ln(1 - least(greatest({score}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) end), 7) as log_loss,
  round(avg(({score} - y) * ({score} - y)), 8) as brier from scored"""


TABLE_SQL = with_ctes(*SCORED, cumulated("scored", A, "ca"), cumulated("scored", B, "cb"),
                      f"mt as ({metric_rows(A, 'ca')} union all {metric_rows(B, 'cb')})")


@query("metric_table", TABLE_SQL + "select * from mt")
def metric_table(spark, folder):
    return rounded(ev.metric_table(inputs.scored(spark, folder), [A, B], SPARSE), 8, log_loss=7)


@query("metric_pivot", TABLE_SQL + """
, long as (select model, 'average_precision' as metric, average_precision as v from mt union all select model, 'roc_auc', roc_auc from mt
  union all select model, 'log_loss', log_loss from mt union all select model, 'brier', brier from mt)
select metric, max(v) filter (model = 'score_a') as score_a, max(v) filter (model = 'score_b') as score_b from long group by metric""")
def metric_pivot(spark, folder):
    table = rounded(ev.metric_table(inputs.scored(spark, folder), [A, B], SPARSE), 8, log_loss=7)
    return ev.metric_pivot(table, [A, B])


@query("prevalence_summary", with_ctes(*SCORED, HALVES, "tails as (select * from evals)", cumulated("evals", A),
       FBETA_SQL.replace("from scored, grid", "from evals, grid")) + f"""
select (select round({AP}, 8) from cum) as average_precision, (select round({AUC}, 8) from cum) as roc_auc,
  round(avg((score_a - y) * (score_a - y)), 8) as brier,
  round(avg(-case when y = 1 then ln(score_a) else ln(1 - least(score_a, 1 - 2.220446049250313e-16)) end), 7) as log_loss,
  (select round(max(fbeta), 8) from fb) as f2,
  round(avg((score_a >= (select tau from tau))::INTEGER) filter (y = 0), 8) as conformal_fpr from evals""")
def prevalence_summary(spark, folder):
    head, tail = _halves(spark, folder)
    return rounded(ev.prevalence_summary(tail, head, A, SPARSE), 8, log_loss=7)


# ------------------------------------------------- scores that need no model

NAIVE = """
naive as (select *, 1.0::DOUBLE / (SOG + 1) as inverse_speed, (SOG < 6)::INTEGER::DOUBLE as slow_6, (SOG < 4)::INTEGER::DOUBLE as slow_4 from scored)"""


@query("naive_scores", with_ctes(*SCORED, NAIVE, cumulated("naive", "inverse_speed", "c1"), cumulated("naive", "slow_6", "c2"),
       cumulated("naive", "slow_4", "c3")) + f"""
select 'inverse_speed' as model, round({AP}, 8) as average_precision, round({AUC}, 8) as roc_auc from c1
union all select 'slow_6', round({AP}, 8), round({AUC}, 8) from c2 union all select 'slow_4', round({AP}, 8), round({AUC}, 8) from c3""")
def naive_scores(spark, folder):
    return rounded(model.naive_table(inputs.scored(spark, folder), SPARSE), 8)


@query("score_interval", with_ctes(*SCORED) + """
select ping_seq, greatest(least(score_b - 0.1, 1.0), 0.0)::DOUBLE as pi_lower, greatest(least(score_b + 0.1, 1.0), 0.0)::DOUBLE as pi_upper from scored""")
def score_interval(spark, folder):
    return model.score_interval(inputs.scored(spark, folder), B).select("ping_seq", "pi_lower", "pi_upper")


@query("interaction_profile", with_ctes(*SCORED) + """
select least(greatest(floor((SOG - 0.0::DOUBLE) / 4.0::DOUBLE), 0), 9)::INTEGER as bin, least(greatest(floor((COG - 0.0::DOUBLE) / 36.0::DOUBLE), 0), 9)::INTEGER as by_bin,
  count(*) as n, round(avg(score_b), 8) as mean_score from scored group by 1, 2""")
def interaction_profile(spark, folder):
    ranges = {"SOG": (0.0, 40.0), "COG": (0.0, 360.0)}
    return rounded(model.interaction_profile(inputs.scored(spark, folder), "SOG", "COG", B, ranges), 8)


@query("vif_filter", with_ctes(PINGS, """
g as (select sum(SOG*SOG) a, sum(SOG*COG) b, sum(SOG*Lat) c, sum(COG*COG) d, sum(COG*Lat) e, sum(Lat*Lat) f from pings),
v as (select *, a*(d*f - e*e) - b*(b*f - c*e) + c*(b*e - c*d) as det from g),
one as (select 'SOG' as feature, a * (d*f - e*e) / det as vif from v union all select 'COG', d * (a*f - c*c) / det from v
  union all select 'Lat', f * (a*d - b*b) / det from v),
worst as (select feature, vif from one where vif > 4.5 order by vif desc limit 1),
pairs as (select 'SOG' as x, 'COG' as y, a*d / (a*d - b*b) as vif from g union all select 'SOG', 'Lat', a*f / (a*f - c*c) from g
  union all select 'COG', 'Lat', d*f / (d*f - e*e) from g),
two as (select x, y, vif from pairs where exists (select 1 from worst) and not exists (select 1 from worst where feature in (x, y)))""") + """
select feature, round(vif, 5) as vif, false as kept from worst
union all select unnest([x, y]), round(vif, 5), true from two
union all select feature, round(vif, 5), true from one where not exists (select 1 from worst)""")
def vif_filter(spark, folder):
    """With a limit that drops a feature; the others' values are those without it."""
    table = model.vif_table(inputs.event_pings(spark, folder), ["SOG", "COG", "Lat"], 4.5)
    return rounded(spark.createDataFrame(table, "feature string, vif double, kept boolean"), 5)
